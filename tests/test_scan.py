"""Ranks straight from the texts: held against whole lists, and made without an index."""

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qacorpus.operators import bm25 as B
from qacorpus.operators import retrieval as R
from qacorpus.operators import scan as D
from qacorpus.plans import corpus_queries as C
from qacorpus.sources.scratch import stored

SF = "/root/testdata/sf0.001"


def test_words_and_their_tokens():
    texts = ["", " ", "a ab abc #a", "Łódź łąka  ĲSSEL ﬁx Σας İx", "x\x00 \x00\x1cy 😀 漢字漢字 ée", "".join(chr(c) for c in range(1, 0x2100))]
    words = D.Words(pa.array(texts))
    names: list[list[str]] = [[] for _ in words.tokens]
    for k, g in zip(words.owner, words.gram.tolist()):
        names[k].append(D._unpacked(g))
    for k, t in zip(words.long, words.plain.to_pylist()):
        names[k].append(t)
    got = [Counter() for _ in texts]
    for doc, code in zip(words.doc, words.code):
        got[doc].update(names[code])
    for k, text in enumerate(texts):
        wanted: Counter = Counter()
        for w in text.split():
            plain = "".join(c for c in unicodedata.normalize("NFKD", w.replace("ł", "l").replace("Ł", "L")) if not unicodedata.combining(c)).lower()
            marked = "#" + w
            wanted.update([plain] + ([marked] if len(marked) < 3 else [marked[i : i + 3] for i in range(len(marked) - 2)]))
        assert got[k] == wanted
        assert words.lengths()[k] == sum(wanted.values())


def tables(spark):
    """Chunks of few syllables with copies and empty texts, questions with and without vectors or hits."""
    r = np.random.default_rng(5)
    text = [" ".join(r.choice(["ka", "kalo", "Łąka", "mon", "nomi", "silo", "ta", "zu"], r.integers(0, 12))) for _ in range(150)]
    rows = [(k, "ab"[k % 3 > 0], text[k % 120], None if k % 11 == 0 else [float(x) for x in r.integers(-2, 3, 4)]) for k in range(150)]
    chunks = spark.createDataFrame(rows, "chunk_id long, side string, text string, vector array<double>").repartition(3)
    asked = [(k, "ab"[k % 2], " ".join(text[k * 3].split()[:4]) if k % 5 else "qqq www", None if k == 7 else [float(x) for x in r.integers(-2, 3, 4)]) for k in range(12)]
    return chunks, spark.createDataFrame(asked, "query_id long, side string, text string, vector array<double>")


def ranked(df):
    return sorted((r.query_id, r.pos, r.chunk_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("at_once", [1024, 5])
def test_like_whole_lists(spark, monkeypatch, at_once):
    monkeypatch.setattr(D, "AT_ONCE", at_once)
    monkeypatch.setattr(D, "BYTES", 300)
    chunks, asked = tables(spark)
    texts = D.statistics(chunks, stored)
    index = B.tables(chunks.withColumn("title", F.lit(None).cast("string")), F.col("side"), stored)
    assert {(r.side, r.token, r.df, round(r.idf, 9)) for r in texts.terms.collect()} == {(r.side, r.token, r.df, round(r.idf, 9)) for r in index[2].collect()}
    assert ranked(D.top(asked.drop("vector"), texts, 7, stored)) == ranked(R.bm25_rank(asked, index, 7))
    whole, near = R.bm25_rank(asked, index), R.vector_rank(asked, chunks, same="side")
    both = D.top(asked, texts, 9, stored, whole=True).cache()
    assert ranked(both.filter("not near")) == ranked(whole.filter("pos < 9"))
    assert ranked(both.filter("near")) == ranked(near.filter("pos < 9"))
    for k_raw in (1, 6, 40):
        assert ranked(D.fused(asked, texts, k_raw, stored, k=3)) == ranked(R.candidates([whole, near], k_raw, 3))


#: Queries of a bounded batch of questions, or of statistics alone.
SCANNED = ["r04_candidates", "r01_bm25", "l03_bm25_terms", "g06_features", "r03_fused", "r06_hybrid", "r08_reranked", "r09_score_table", "r10_replayed", "r13_hits", "r04_certified", "r11_reconciled", "r14_sources"]


@pytest.mark.parametrize("name", SCANNED)
def test_queries_make_no_index(spark, monkeypatch, name):
    def none(*_):
        raise AssertionError("postings of all texts")

    monkeypatch.setattr(B, "with_impacts", none)
    monkeypatch.setattr(C, "_kept", {})
    assert C.QUERIES[name](spark, SF).count() > 0
