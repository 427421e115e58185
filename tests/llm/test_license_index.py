"""License scans: base phrases against brute force, templates against hand-made files."""

import re
import random

import numpy as np
import pytest

from qacorpus.llm import license_index as X

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    """(n_words, places, labels) by the contract's words."""
    words = re.findall(WORD, (text or "").translate(lower))
    places, labels = [], set()
    for phrase, label in X.PHRASES.items():
        p = phrase.split()
        here = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
        places += here
        labels |= {label} if here else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_numbers_block_by_block():
    index = X.Index()
    text = "Licensed—under, MIT  License\x00apacheLICENSE éapache license_license 2.0 " * 7 + "sublicense" * 9
    known = {w: k for k, w in enumerate(index.words)}
    want = [known.get(w, -1) for w in X.words_of(text)]
    for block in (1, 3, 16, 1 << 20):
        assert index.numbers(text.encode(), block).tolist() == want
    assert len(index.numbers(b"")) == 0


def test_base_places_by_brute_force(spark):
    rng = random.Random(3)
    bits = ["MIT", "mit", "License", "license", "licenses", "APACHE", "general", "Public", "x", "GNU", "Énglish", "general public license"]
    rows = [(k, None if k == 0 else rng.choice(["", " "]) + rng.choice([" ", "-", "\n", "_", "("]).join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 40])))) for k in range(150)]
    rows += [(9, "MIT License MIT license")] * 2 + [(None, "apache license")]
    docs = spark.createDataFrame([(d, t, 1, "y") for d, t in rows], "doc_id long, text string, spans int, n_words string")
    found = [r[:6] for r in rows_of(X.labelled(docs))]
    assert sorted(found, key=repr) == sorted(((d, *base(t)) for d, t in rows), key=repr)
    again = X.labelled(docs).filter("doc_id = 9").select("labels", "n_base").distinct().collect()
    assert {(r.labels, r.n_base) for r in again} >= {("mit", 2)}


MIT = X.TEMPLATES[[t[0] for t in X.TEMPLATES].index("mit-text")][1]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        ("foo bar. Licensed under CC BY-NC 4.0.\nbaz", "cc-by-nc-4.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("Released under the MIT License.", "mit,mit-notice"),
        ("Copyright (c) 2024 Someone\n\n" + MIT, "mit-text"),
        (MIT.replace("without restriction", "with restriction"), ""),  # the mandatory phrase lacks
        (MIT.replace("obtaining a copy", "obtaining, by any lawful means, a copy"), "mit-text"),  # words put in
        (" ".join(reversed(MIT.split())), ""),  # all words, none in place
        ("public license general, mit apache", ""),
        ("", ""),
    ],
)
def test_labels(spark, text, labels):
    row = X.labelled(spark.createDataFrame([(1, text), (2, "other words")], "doc_id long, text string")).filter("doc_id = 1").first()
    assert row.labels == labels
    assert 0 <= row.score <= 1 and (row.score > 0) == bool(labels)


def test_many_places_of_one_file(spark):
    text = ("filler words here. " * 20 + "Licensed under CC BY-NC 4.0. ") * 300
    row = X.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    firsts = [s.first for s in row.spans if s.label == "cc-by-nc-4.0"]
    assert firsts == [60 + 67 * k for k in range(300)]


def test_idf_over_all_documents(spark):
    docs = spark.createDataFrame([(k, "mit mit license" if k % 2 else "license") for k in range(10)], "doc_id long, text string").repartition(4)
    index = X.Index()
    n, idf = X.word_idf(docs, index)
    assert n == 10
    assert idf[index.words.index(b"mit")] == pytest.approx(np.log(11 / 6)) and idf[index.words.index(b"license")] == pytest.approx(0)


def test_empty_table_and_refused_templates(spark):
    assert X.labelled(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        X.Index({"a" * 17: "x"}, [])
    with pytest.raises(ValueError):
        X.Index({}, [("x", "some text", [])])


def test_query_over_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    from qacorpus.llm.queries import op11_license_index

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op11_license_index(spark, sf_dir).collect()}
    assert len(found) == len(docs)
    for d, t in docs:
        r = found[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
        assert not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(","))
        assert ("cc-by-nc-4.0" in r.labels) == ("licensed under cc by-nc 4.0" in (t or "").lower())
