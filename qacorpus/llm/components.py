"""Connected components of a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _lowest(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of an edge (u, v): the smallest id that edges lead to. Loops and repeats are allowed.

    Alternates two steps until nothing changes, a number of rounds that grows with the logarithm of the longest path:
    larger neighbours move to the smallest one of the row's id, then smaller neighbours do. Only edges between a row
    and its smallest neighbour are kept, so the table never grows. Each round is stored in the shared folder.
    """
    now = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        large = both.filter("v > u").join(_lowest(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        moved = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            break
        mark = (row.n, row.h)
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("label"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("label")).union(roots)
