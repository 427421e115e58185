import itertools
import random
import zlib

import numpy as np
import pyarrow as pa

from qacorpus.llm import langid as L

SOUNDS = {"en": ["th", "the", "ing", "ed", "wh"], "fr": ["eau", "ai", "qu", "é", "oi"], "de": ["sch", "ung", "ü", "tz", "ei"]}


def _text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SOUNDS[lang]) for _ in range(rnd.randint(1, 3))).capitalize() for _ in range(n)) + "."


def test_forward_backward_is_exact():
    rnd = np.random.default_rng(0)
    field = L.Field(["a", "b", "c"], None, {}, None, rnd.normal(size=(3, 3)), np.log(np.array([0.5, 0.3, 0.2])))
    emission, sizes = rnd.normal(size=(13, 3)), np.array([5, 1, 7])

    def brute(e):
        p = np.zeros(e.shape)
        for path in itertools.product(range(3), repeat=len(e)):
            w = np.exp(field.prior[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
            for i, y in enumerate(path):
                p[i, y] += w
        return p / p.sum(1, keepdims=True)

    want = np.concatenate([brute(emission[:5]), brute(emission[5:6]), brute(emission[6:])])
    for block in (1, 2, 3, 64):
        assert abs(field.marginals(emission, sizes, block) - want).max() < 1e-12


def test_features_and_words():
    doc, place, names = L.split_words(pa.array(["The the, 12", None, "a-b É"], pa.large_string()))
    assert doc.tolist() == [0, 0, 2, 2] and [names[k] for k in place] == ["the", "the", "ab", "é"]
    features = L.Features(["ab", "b"])
    assert np.bincount(features.word).tolist() == [3 + 2 + 1, 2 + 1]


def test_held_out_documents(spark):
    rnd = random.Random(3)
    rows = [(i, _text(rnd, lang, rnd.randint(3, 150)), lang) for i in range(240) for lang in [rnd.choice(list(SOUNDS))]]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "12 |", "fr"), (1003, _text(rnd, "fr", 4000), None), (1003, rows[0][1], "de")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows + odd], "doc_id long, text string, lang string, score double").repartition(3)
    field = L.fit(df)
    got = L.predict(df, field).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: x for i, _, x in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.doc_id in truth and r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in tested]) > 0.95
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    # words of a text that changes its language
    mixed = spark.createDataFrame([(1, _text(rnd, "en", 20) + " " + _text(rnd, "de", 20))], "doc_id long, text string")
    words = L.label_words(mixed, field).orderBy("position").collect()
    assert np.mean([w.lang == ("en" if w.position < 20 else "de") for w in words]) > 0.9
    kept = L.identified(df)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() > 230


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(df, L.fit(df)).collect()] == [("und", 0.0)] * 2
    one = spark.createDataFrame([(1, "abc def", "en")], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in L.predict(one, L.fit(one)).collect()] == [("en", 1.0)]
    assert L.predict(df.filter("false"), L.fit(df)).count() == 0


def test_short_and_long_texts_teach(spark):
    rnd = random.Random(5)
    rows = [(i, _text(rnd, lang, rnd.randint(1, 31)), lang) for i in range(300) for lang in [list(SOUNDS)[i % 3]]]
    mixed = [(i, _text(rnd, lang, 2500 if lang == "de" else 3 if lang == "fr" else 100), lang) for i in range(90) for lang in [list(SOUNDS)[i % 3]]]
    assert all(len(t) > 10_000 for _, t, x in mixed if x == "de")
    for table in (rows, mixed):
        df = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(3)
        got, truth = L.predict(df, L.fit(df)).collect(), {i: x for i, _, x in table}
        for lang in SOUNDS:
            assert np.mean([r.lang_pred == lang for r in got if truth[r.doc_id] == lang and r.held_out]) > 0.9
        assert L.identified(df).count() > 0.95 * len(table)
    # all labels are drawn from, however few windows are used
    field = L.train([t for _, t, _ in mixed], [x for _, _, x in mixed], {x: 1 / 3 for x in SOUNDS}, most=9)
    assert field.predict(pa.array([_text(rnd, x, 40) for x in SOUNDS], pa.large_string()))[0] == list(SOUNDS)


def test_many_languages(spark):
    rnd = random.Random(7)
    rows = [(i, " ".join(f"{chr(0x4E00 + 7 * (i % 70))}{chr(0x4E01 + 7 * (i % 70) + rnd.randrange(3))}" for _ in range(8)), f"l{i % 70:02}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {i: x for i, _, x in rows}
    got = L.predict(df, L.fit(df, most=2000)).collect()
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got]) > 0.9
