"""The BM25 index that grows: equal to a fresh build after every change."""

import random

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import bm25 as B
from qacorpus.operators import growing as W
from qacorpus.operators import retrieval as R
from qacorpus.sources.scratch import scratch, stored

WORDS = ["zwrot", "konto", "paczka", "Łódź", "faktura", "ﬁrma", "x"]
SCHEMA = "chunk_id long, side string, title string, text string"


def _text(rnd):
    return rnd.choice([None, "", " ".join(rnd.choice(WORDS) + str(rnd.randrange(3)) for _ in range(rnd.choice([1, 4, 9])))])


def _same(spark, index, rows):
    fresh = B.tables(spark.createDataFrame([(k, *v) for k, v in rows.items()], SCHEMA), F.col("side"), stored)
    mine = W.tables(index)
    pick = lambda df, *c: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*c).collect())
    for k, columns in enumerate((("side", "token", "chunk_id", "tf"), ("side", "chunk_id", "len", "avg_len"), ("side", "token", "df", "idf"))):
        assert pick(mine[k], *columns) == pick(fresh[k], *columns)
    asked = spark.createDataFrame([(1, "a", "zwrot1 konto0"), (2, "b", "paczka2 x1 x1"), (3, "c", "x"), (4, "a", "")], "query_id long, side string, text string")
    ranked = ("query_id", "chunk_id", "score", "pos")
    assert pick(W.rank(asked, index, 3), *ranked) == pick(R.bm25_rank(asked, fresh, 3), *ranked)


@pytest.mark.parametrize("ratio", [0, 3])
def test_changes_equal_a_fresh_build(spark, ratio):
    rnd, rows, path = random.Random(ratio), {}, scratch(spark)
    index = W.open_index(spark, path, buckets=4)
    for step in range(3):
        changed = {k: (rnd.choice("ab"), rnd.choice([None, "t"]), _text(rnd)) for k in (range(20) if step == 0 else rnd.sample(range(26), 5))}
        removed = rnd.sample(range(30), 4) if step else []
        frame = spark.createDataFrame([(k, *v) for k, v in changed.items()] + [(None, "a", "t", "no id")], SCHEMA).withColumn("bucket", F.lit("clash"))
        index = W.grow(index, frame, spark.createDataFrame([(k,) for k in removed] + [(None,)], "chunk_id long"), F.col("side"), ratio=ratio)
        rows = {k: v for k, v in rows.items() if k not in removed} | changed
        assert W.open_index(spark, path) == index
        assert len(index.segments) == step + 1 if ratio == 0 else len(index.segments) <= step + 1
    _same(spark, index, rows)
    if ratio:
        assert len(index.segments) < 3
        assert W.vacuum(index) > 0 and W.vacuum(index) == 0
        assert W.tables(W.open_index(spark, path))[1].count() == len(rows)


def test_repeats_empty_changes_and_a_lost_run(spark):
    path = scratch(spark)
    index = W.grow(W.open_index(spark, path, buckets=2))
    assert index.segments == () and W.open_index(spark, path).version == 1
    assert [t.count() for t in W.tables(index)] == [0, 0, 0]
    twice = [(1, "b", "t", "konto"), (1, "a", "t", "zwrot"), (1, "a", "t", "zwrot"), (2, "a", None, None)]
    index = W.grow(index, spark.createDataFrame(twice, SCHEMA), sides=F.col("side"))
    _same(spark, index, {1: ("a", "t", "zwrot"), 2: ("a", None, None)})
    spark.createDataFrame([(9,)], "x long").write.parquet(f"{path}/segment-lost/postings")  # no manifest names it
    _same(spark, W.open_index(spark, path), {1: ("a", "t", "zwrot"), 2: ("a", None, None)})
    index = W.grow(index, removed=spark.createDataFrame([(1,), (2,), (3,)], "chunk_id long"))
    assert [t.count() for t in W.tables(index)] == [0, 0, 0]


def test_snapshot_searches_by_impact(spark):
    index = W.open_index(spark, scratch(spark), buckets=2)
    texts = [f"zwrot towaru numer{k} {'rzadkie' if k % 9 == 0 else 'inne'}" for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").withColumn("title", F.lit("t"))
    index = W.grow(W.grow(index, rows), removed=spark.range(0, 60, 9).select(F.col("id").alias("chunk_id")).filter("chunk_id > 20"))
    asked = spark.createDataFrame([(1, "all", "rzadkie numer9")], "query_id long, side string, text string")
    found = B.top_chunks(asked, W.snapshot(index, stored), 3, stored)
    pick = lambda df: sorted((r.pos, r.chunk_id, round(r.score, 6)) for r in df.collect())
    assert pick(found) == pick(W.rank(asked, index, 3))
    assert {c for _, c, _ in pick(found)} >= {0, 9, 18}
