"""Ranks and quantiles of whole columns without one task that sorts them: ranges are counted, then offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def _dealt(values: DataFrame, by: list[str], column: str, store) -> tuple[DataFrame, DataFrame]:
    """values (*by, column, n) in ranges of their order, stored, with `part`; and for each group's ranges how much weight
    lies before them and in them: a row per range that a group touches, its names with `_of` behind."""
    placed = store(values.repartitionByRange(*by, column).withColumn("part", F.spark_partition_id()), "ranges")
    sums = placed.groupBy(*[F.col(c).alias(f"{c}_of") for c in [*by, "part"]]).agg(F.sum("n").alias("inside"))
    group = [f"{c}_of" for c in by]
    before = F.coalesce(F.sum("inside").over(Window.partitionBy(*group).orderBy("part_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, sums.withColumns({"before": before, "total": F.sum("inside").over(Window.partitionBy(*group))})


def _same(by: list[str]):
    out = F.col("part") == F.col("part_of")
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}_of"))
    return out


def running(values: DataFrame, column: str, by: list[str] | None = None, store=stored) -> DataFrame:
    """values (*by, column, n) of distinct values with upto, the weight of all that are at most as great in their group,
    and total. A null group is one; null values come first."""
    by = by or []
    placed, sums = _dealt(values, by, column, store)
    inside = F.sum("n").over(Window.partitionBy(*by, "part").orderBy(column))
    return placed.join(sums, _same(by)).withColumn("upto", F.col("before") + inside).select(*by, column, "n", "upto", "total")


def nearest_rank_quantiles(df: DataFrame, column: str, qs: list[float], by: list[str] | None = None, store=stored) -> DataFrame:
    """(*by, q, value): for each q the value at place round(q (n - 1)), halves to even, of the sorted ones of each group.

    Values are counted, so copies are one row; only the ranges that hold a wanted place are sorted. Nulls don't count; a
    group without values has no row.
    """
    by = by or []
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    placed, sums = _dealt(counts, by, column, store)
    at = F.bround(F.col("q") * (F.col("total") - 1)).cast("long")
    wanted = sums.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).withColumn("at", at).filter((F.col("before") <= F.col("at")) & (F.col("at") < F.col("before") + F.col("inside")))
    wanted = wanted.groupBy(*[f"{c}_of" for c in [*by, "part"]], "before").agg(F.collect_list(F.struct("q", "at")).alias("asked"))  # as many as there are qs
    end = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "part").orderBy(column))
    met = placed.join(wanted, _same(by)).withColumn("end", end).select(*by, column, "n", "end", F.explode("asked").alias("a"))
    return met.filter((F.col("a.at") < F.col("end")) & (F.col("a.at") >= F.col("end") - F.col("n"))).select(*by, F.col("a.q").alias("q"), F.col(column).alias("value"))
