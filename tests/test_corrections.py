"""Corrections make their tables once, and compare many pairs at a time."""

import random

from qacorpus.functions.text import osa, osa_all
from qacorpus.operators import questions as Q
from qacorpus.sources.scratch import stored


def test_many_distances_are_those_of_pairs():
    r = random.Random(2)
    a, b = ([*("".join(r.choice("abł") for _ in range(r.randint(0, 9))) for _ in range(2000)), word * 60] for word in ("ab", "ba"))
    for most in (1, 2, 1 << 20):
        assert list(osa_all(a, b, most, cells=999)) == [min(osa(x, y, 1 << 20), most + 1) for x, y in zip(a, b)]


def test_tables_are_stored_once(spark):
    words = spark.createDataFrame([("paczka", 5), ("przesyłka", 2)], "word string, cnt long")
    asked = spark.createDataFrame([(1, "gdzie paczkaa i przsylkaa")], "query_id long, text string")
    names = []

    def store(df, name):
        names.append(name)
        return stored(df, name)

    got = Q.correct_questions(asked, words, spark.createDataFrame([("gdzie", 5.0)], "word string, zipf double"), store=store).first()
    assert got.corrected == "gdzie paczka i przesyłka" and names == ["dictionary", "strange"]
