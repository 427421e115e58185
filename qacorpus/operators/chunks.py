"""From articles to overlapping chunks that know their section, and what is done with the chunk table."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import content_sha, strip


def sections_of(body: str) -> list[tuple[str | None, str]]:
    """(heading, text) of each section; see split_sections()."""
    lines = [x.strip() for x in body.split("\n")]
    begin = next((k for k, x in enumerate(lines) if x), len(lines))
    end = next((k for k in range(begin, len(lines)) if not lines[k]), len(lines))
    contents, rest = lines[begin:end], lines[end:]
    if len(contents) < 2 or not set(contents) <= set(rest):
        return [(None, body)]
    cuts = []  # places of the headings, each searched for behind the one before
    for k, line in enumerate(rest):
        if len(cuts) < len(contents) and line == contents[len(cuts)]:
            cuts.append(k)
    parts = [(contents[n], rest[a + 1 : b]) for n, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(rest)]))]
    intro = "\n".join(rest[: cuts[0] if cuts else len(rest)]).strip()
    return ([(None, intro)] if intro else []) + [(h, "\n".join(x).strip()) for h, x in parts]


def split_sections(body: Column) -> Column:
    """array of (heading, text). The first run of filled lines is a table of contents if it has two lines at least and
    each occurs again as a line below; then its lines, matched in order and once each, begin the sections."""

    @F.pandas_udf("array<struct<heading:string,text:string>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([[{"heading": h, "text": t} for h, t in sections_of(x or "")] for x in bodies], dtype=object)

    return of(body)


def words_of(text: Column) -> Column:
    """The default tokens: words between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def window_tokens(tokens: Column, size: Column, overlap: int) -> Column:
    """Windows of size tokens from 0 on in steps of size - overlap, 1 at least, until a start is past the end; a last
    window that is overlap only stays."""
    step = F.greatest(F.lit(1), size - overlap)
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, step)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, size), " "))


def chunk_documents(articles: DataFrame, key: str = "doc_id", size: int = 500, overlap: int = 50, tokens: Callable[[Column], Column] = words_of) -> DataFrame:
    """The chunks of articles (key, url, title, section, subslug, body): for each section with text its heading, then a
    window of its tokens, in at most about `size` tokens together. section_pos and chunk_pos give the order."""
    rows = articles.select("*", F.posexplode(split_sections(F.col("body"))).alias("section_pos", "part")).filter(strip(F.col("part.text")) != "")
    prefix = F.when(F.col("part.heading").isNull(), F.lit("")).otherwise(F.concat("part.heading", F.lit("\n")))
    room = F.greatest(F.lit(overlap + 1), F.lit(size) - F.size(tokens(prefix)))
    rows = rows.withColumns({"prefix": prefix, "room": room}).select("*", F.posexplode(window_tokens(tokens(F.col("part.text")), F.col("room"), overlap)).alias("chunk_pos", "window"))
    return rows.select(key, "section_pos", "chunk_pos", *[c for c in ("url", "title", "section", "subslug", "lang") if c in articles.columns], F.coalesce("part.heading", F.lit("")).alias("heading"), F.concat("prefix", "window").alias("text"))


def with_ids(chunks: DataFrame, order: list[str], store) -> DataFrame:
    """Adds chunk_id, from 0 on without gaps in this order: sorted by ranges, counted by partition, then offset."""
    placed = store(chunks.orderBy(*order).withColumn("part", F.spark_partition_id()), "sorted")
    within = placed.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("offset"))  # a row per partition
    return within.join(offsets, "part").withColumn("chunk_id", F.col("offset") + F.col("row")).drop("part", "row", "offset")


def section_counts(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    return chunks.groupBy("section").agg(F.count_distinct(key).alias("documents"), F.count(F.lit(1)).alias("chunks"))


def merge_corpora(base: DataFrame, extra: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """Base chunks, then extra ones with ids behind them. checked: an earlier base, which must still be there as it was."""
    if checked is not None and not checked.exceptAll(base.select(*checked.columns)).isEmpty():
        raise ValueError("the base has changed")
    offset = base.agg(F.coalesce(F.max("chunk_id") + 1, F.lit(0))).first()[0]
    return base.unionByName(extra.withColumn("chunk_id", F.col("chunk_id") + offset))


def partition_by_side(chunks: DataFrame) -> DataFrame:
    """Adds side: seller for the seller section, buyer for all others, by the section's lower case."""
    section = F.lower(F.trim("section"))
    return chunks.withColumns({"section": section, "side": F.when(section == lists.SELLER_SECTION, lists.SIDES[1]).otherwise(lists.SIDES[0])})


def passage_text(title: Column, text: Column, prefix: str = "passage: ") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def query_text(text: Column, prefix: str = "query: ") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))


def append_embeddings(chunks: DataFrame, existing: DataFrame, encoder: Callable[[Column], Column]) -> DataFrame:
    """existing (chunk_id, sha, embedding) and, encoded, the chunks that it lacks or whose content has changed."""
    now = chunks.select("chunk_id", content_sha(F.col("title"), F.col("text")).alias("sha"), passage_text(F.col("title"), F.col("text")).alias("passage"))
    kept = existing.join(now, ["chunk_id", "sha"], "left_semi")
    fresh = now.join(existing, ["chunk_id", "sha"], "left_anti")
    return kept.unionByName(fresh.select("chunk_id", "sha", encoder(F.col("passage")).alias("embedding")))


def fingerprint_runs(df: DataFrame, order: str, columns: list[str], store, size: int = 1 << 12) -> DataFrame:
    """run, place, h and n of each distinct row in an order: its hash, how often it is there, and runs of `size` ranks.

    Nulls come first; rows with the same place in the order go by their hash, and equal ones are one.
    """
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    rows = df.select(F.col(order).alias("at"), row.alias("h")).groupBy("at", "h").agg(F.count(F.lit(1)).alias("n"))
    return with_ids(rows, ["at", "h"], store).select(F.floor(F.col("chunk_id") / size).alias("run"), F.col("chunk_id").alias("place"), "h", "n")


def fingerprint(df: DataFrame, order: str, columns: list[str], store, size: int = 1 << 12) -> DataFrame:
    """One row: how many rows, and a hash of their columns in an order; of runs of `size` rows first, then of as many
    runs each, level by level, until one run is left. An array has `size` entries at most."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h", "n"))), lambda x: F.concat_ws(" ", x["h"], x["n"].cast("string"))), "\n"), 256)
    level = fingerprint_runs(df, order, columns, store, size)
    while True:
        level = store(level.groupBy("run").agg(joined.alias("h"), F.sum("n").alias("n")), "runs")
        if level.count() <= size:
            break
        level = level.select(F.floor(F.col("run") / size).alias("run"), F.col("run").alias("place"), "h", "n")
    return level.withColumnRenamed("run", "place").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined.alias("fingerprint"))
