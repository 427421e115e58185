"""A BM25 index that grows by parts: stored segments of postings with tombstones, merged by size, statistics kept as sums."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bm25 import Bm25Index, Store, asked_tokens, idf, token_counts, with_impacts
from .retrieval import bm25_rank

_TABLES = {
    "postings": "side string, token string, chunk_id long, tf long",
    "forward": "chunk_id long, side string, len long, tokens array<string>, bucket int",
    "gone": "chunk_id long, side string, len long, tokens array<string>",
    "terms": "side string, token string, df long",
    "sides": "side string, n long, total long",
}
_MANIFEST = "version long, buckets int, name string, seq long, size long, gone long"


@dataclass(frozen=True)
class Segment:
    """What one change, or several merged ones, added and took off. size: its postings and tombstones."""

    name: str
    seq: int
    size: int
    gone: int


@dataclass(frozen=True)
class GrowingIndex:
    """A version of the index in a shared folder: its segments, oldest first.

    A segment has postings by range of (side, token), so that a common token lies in many files; forward, of each chunk
    its tokens, in `buckets` folders by the chunk's id, so that a change reads only those of its ids; gone, the chunks of
    older segments that it replaces or removes; and what it adds to each token's and side's sums, less what it takes off.
    """

    spark: SparkSession
    path: str
    buckets: int
    version: int = 0
    segments: tuple[Segment, ...] = ()


def open_index(spark: SparkSession, path: str, buckets: int = 64) -> GrowingIndex:
    """The newest version in a folder, empty where there is none. buckets: of a new index; some thousands for 100 TB."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
        newest = rows.agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:
        return GrowingIndex(spark, path, buckets)
    found = rows.filter(F.col("version") == newest).orderBy("seq").collect()  # a row per segment: their number grows with the logarithm
    return GrowingIndex(spark, path, found[0].buckets, newest, tuple(Segment(r.name, r.seq, r.size, r.gone) for r in found if r.name))


def grow(index: GrowingIndex, changed: DataFrame | None = None, removed: DataFrame | None = None, sides: Column | None = None, lang: str | None = None, lemmas: DataFrame | None = None, ratio: int = 4) -> GrowingIndex:
    """The index with chunks (chunk_id, title, text) added or, where it has their ids, replaced, and with ids removed.

    Rows without an id take no part; of several rows with an id the first by side and text stays; an id that is both changed
    and removed is changed; ids that aren't there can be removed. Null titles and texts are empty. Work grows with the
    change: its own texts, the forward lists of its buckets, and merges. A segment is merged with the one before while
    that has at most `ratio` times its size, so that a posting is written again as often as the logarithm of all.
    A version counts once its rows are in the manifest, by one append: what a lost run leaves behind is never read. One
    writer at a time.
    """
    spark, seq = index.spark, index.version + 1
    new = Segment(f"segment-{seq:09d}-{uuid.uuid4().hex}", seq, 0, 0)
    base = f"{index.path}/{new.name}"
    bucket = F.pmod(F.xxhash64(F.col("chunk_id").cast("long")), F.lit(index.buckets)).cast("int")
    if changed is None:
        rows = spark.createDataFrame([], "chunk_id long, side string, text string, lang string")
    else:
        side = sides if sides is not None else F.lit("all")
        rows = changed.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.struct(side.alias("side"), F.concat_ws("\n", "title", "text").alias("text"), (F.lit(None).cast("string") if lang is None else F.col(lang)).alias("lang")).alias("r"))
        rows = rows.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("r").alias("r")).select("chunk_id", "r.*")
    counts = token_counts(rows, ["side", "chunk_id"], "text", None if lang is None else "lang", lemmas).select("side", "token", "chunk_id", F.col("n").alias("tf"))
    _postings(counts, base)
    added = _read(spark, base, "postings")
    lists = added.groupBy("chunk_id").agg(F.sum("tf").alias("len"), F.collect_list("token").alias("tokens"))
    lists = rows.select("chunk_id", "side").join(lists, "chunk_id", "left").withColumns({"len": F.coalesce("len", F.lit(0)), "tokens": F.coalesce("tokens", F.array().cast("array<string>")), "bucket": bucket})
    _forward(lists, base)
    here = _read(spark, base, "forward")
    touched = here.select("chunk_id", "bucket")
    if removed is not None:
        touched = touched.unionByName(removed.select(F.col("chunk_id").cast("long").alias("chunk_id")).filter("chunk_id IS NOT NULL").withColumn("bucket", bucket)).distinct()
    places = [r.bucket for r in touched.select("bucket").distinct().collect()]  # at most `buckets`
    old = _live(index, "forward", only=F.col("bucket").isin(places))
    old.join(touched.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "side", "len", "tokens").write.parquet(f"{base}/gone")
    gone = _read(spark, base, "gone")
    per_token = gone.select("side", F.explode("tokens").alias("token")).groupBy("side", "token").agg((-F.count(F.lit(1))).alias("df"))
    _sums(added.groupBy("side", "token").agg(F.count(F.lit(1)).alias("df")).unionByName(per_token), "terms", base)
    _sums(here.select("side", F.lit(1).alias("n"), F.col("len").alias("total")).unionByName(gone.select("side", F.lit(-1).alias("n"), (-F.col("len")).alias("total"))), "sides", base)
    n_gone = gone.count()
    new = replace(new, size=added.count() + n_gone, gone=n_gone)
    return _committed(replace(index, version=seq, segments=_merged(index, new, ratio)))


def _read(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{base}/{name}")


def _postings(rows: DataFrame, base: str) -> None:
    rows.repartitionByRange("side", "token", "chunk_id").sortWithinPartitions("side", "token", "chunk_id").write.parquet(f"{base}/postings")


def _forward(rows: DataFrame, base: str) -> None:
    rows.repartition("bucket").sortWithinPartitions("bucket", "chunk_id").write.partitionBy("bucket").parquet(f"{base}/forward")


def _sums(rows: DataFrame, name: str, base: str) -> None:
    """Rows of one table of sums, added up and written; keys whose sums are 0 go."""
    keys = [c for c in ("side", "token") if c in rows.columns]
    values = [c for c in rows.columns if c not in keys]
    summed = rows.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in values])
    summed.filter(reduce(lambda x, y: x | y, [F.col(c) != 0 for c in values])).write.parquet(f"{base}/{name}")


def _rows(index: GrowingIndex, name: str, segments: tuple[Segment, ...] | None = None) -> DataFrame:
    parts = [_read(index.spark, f"{index.path}/{s.name}", name).withColumn("seq", F.lit(s.seq).cast("long")) for s in (index.segments if segments is None else segments)]
    return reduce(DataFrame.unionByName, parts) if parts else index.spark.createDataFrame([], f"{_TABLES[name]}, seq long")


def _live(index: GrowingIndex, name: str, segments: tuple[Segment, ...] | None = None, only: Column | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Postings or forward lists without those that a later segment takes off; of asked (side, token) only."""
    segments = index.segments if segments is None else segments
    rows = _rows(index, name, segments)
    rows = rows if only is None else rows.filter(only)
    rows = rows if asked is None else rows.join(asked, ["side", "token"], "left_semi")
    later = tuple(s for s in segments[1:] if s.gone)
    if later:
        dead = _rows(index, "gone", later).groupBy(F.col("chunk_id").alias("gone_id")).agg(F.max("seq").alias("gone_at"))
        rows = rows.join(dead, (F.col("chunk_id") == F.col("gone_id")) & (F.col("seq") < F.col("gone_at")), "left_anti")
    return rows.drop("seq")


def _merged(index: GrowingIndex, new: Segment, ratio: int) -> tuple[Segment, ...]:
    """The segments with the new one, the last of them merged while the one before isn't much larger."""
    every = (*index.segments, new)
    first, size = len(every) - 1, new.size
    while first and every[first - 1].size <= ratio * size:
        first -= 1
        size += every[first].size
    group = every[first:]
    if len(group) == 1:
        return tuple(s for s in every if s.size)
    name = f"segment-{new.seq:09d}-{uuid.uuid4().hex}"
    base = f"{index.path}/{name}"
    _postings(_live(index, "postings", group), base)
    _forward(_live(index, "forward", group), base)
    # tombstones for what came before the group; behind the first segment there is nothing that they could be for
    gone = _rows(index, "gone", group if first else ()).groupBy("chunk_id").agg(F.first("side").alias("side"))
    gone.select("chunk_id", "side", F.lit(None).cast("long").alias("len"), F.lit(None).cast("array<string>").alias("tokens")).write.parquet(f"{base}/gone")
    _sums(_rows(index, "terms", group).drop("seq"), "terms", base)
    _sums(_rows(index, "sides", group).drop("seq"), "sides", base)
    n_gone = _read(index.spark, base, "gone").count()
    return (*every[:first], Segment(name, new.seq, _read(index.spark, base, "postings").count() + n_gone, n_gone))


def _committed(index: GrowingIndex) -> GrowingIndex:
    rows = [(index.version, index.buckets, s.name, s.seq, s.size, s.gone) for s in index.segments] or [(index.version, index.buckets, None, None, None, None)]
    index.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{index.path}/manifest")
    return index


def tables(index: GrowingIndex, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, terms) as bm25.tables() makes them of the chunks that are there now. asked: postings of these
    (side, token) only. Statistics come from the sums, without a look at postings."""
    sides = _rows(index, "sides").groupBy("side").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).filter("n > 0")  # a row per side
    counts = _rows(index, "terms").groupBy("side", "token").agg(F.sum("df").alias("df")).filter("df > 0")
    lengths = _live(index, "forward").join(sides, "side").select("side", "chunk_id", "len", (F.col("total") / F.col("n")).alias("avg_len"))
    return _live(index, "postings", asked=asked), lengths, idf(counts, sides.select("side", "n"))


def rank(queries: DataFrame, index: GrowingIndex, depth: int, lang: str | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """As bm25_rank(), straight from the segments: of the postings only those of asked tokens are joined with anything."""
    asked = asked_tokens(queries, lang, lemmas).select("side", "token").distinct()
    return bm25_rank(queries, tables(index, asked), depth, lang=lang, lemmas=lemmas)


def snapshot(index: GrowingIndex, store: Store, size: int = 1024) -> Bm25Index:
    """The index by impact of the chunks that are there now, for top_chunks(); no text is read."""
    postings, lengths, terms = tables(index)
    return with_impacts(store(postings, "postings"), store(lengths, "lengths"), store(terms, "terms"), store, size=size)


def vacuum(index: GrowingIndex) -> int:
    """Deletes the segments that this version, which must be the newest, doesn't name; how many. No reader may be at older ones."""
    spark = index.spark
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(index.path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    used = {s.name for s in index.segments}
    old = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("segment-") and f.getPath().getName() not in used]
    for path in old:
        files.delete(path, True)
    return len(old)
