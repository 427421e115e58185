"""Exact nearest vectors with pruning."""

import random

import pytest
from pyspark.sql import functions as F

from qacorpus.operators import nearest as N
from qacorpus.operators import retrieval as R
from qacorpus.sources.scratch import stored


def _frames(spark, clustered):
    rnd = random.Random(3)
    centre = [[rnd.gauss(0, 5) for _ in range(8)] for _ in range(12)]
    row = lambda k: [c + rnd.gauss(0, 0.1 if clustered else 9) for c in centre[k % 12]]
    vectors = [(k, row(k)) for k in range(600)] + [(1000 + k, [1.0] * 8) for k in range(200)]  # a third or so are equal
    odd = [(2000, None), (2001, []), (2002, [float("nan")] * 8), (2003, [None] * 8), (2004, [0.0] * 8), (None, [1.0] * 8), (5, row(5))]
    asked = [(k, v) for k, v in vectors[:20]] + [(5000, [0.0] * 8), (5001, [1.0] * 8), (5002, None), (5003, [float("inf")] * 8)]
    return spark.createDataFrame(asked, "query_id long, vector array<double>"), spark.createDataFrame(vectors + odd, "chunk_id long, vector array<double>")


@pytest.mark.parametrize("clustered", [True, False])
def test_same_as_all_products(spark, clustered):
    asked, vectors = _frames(spark, clustered)
    good = "vector IS NOT NULL AND size(vector) = 8 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    reads = {}
    pick = lambda df: sorted(tuple(r) for r in df.select("query_id", "pos", "chunk_id", F.round("score", 6)).collect())
    whole = R.vector_rank(asked.filter(good), vectors.filter(good), 7, own=False)
    assert pick(N.vector_top(asked, vectors, 7, stored, pivots=24, shells=4, block=50, queries_at_once=8, own=False, reads=reads)) == pick(whole)
    if clustered:
        assert reads["pairs"] < reads["all"] / 3


def test_empty_sides_and_short_lists(spark):
    asked, vectors = _frames(spark, True)
    assert N.vector_top(asked, vectors.limit(0), 3, stored).count() == 0
    assert N.vector_top(asked.limit(0), vectors, 3, stored).count() == 0
    few = N.vector_top(asked.filter("query_id = 0"), vectors.filter("chunk_id < 3"), 9, stored)
    assert sorted(r.chunk_id for r in few.collect()) == [0, 1, 2]
