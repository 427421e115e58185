"""The registered queries of the operators, with production parameters, each over its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_neighbours, fill_in_middle, jaccard_join, katz, langid, license_index, line_dedup, packing, phrase_automata, quality, sentencepiece_codec, tiff_pages, token_counts
from .common import stored, table


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file's bytes, of a fixed size: read where the query is built and sent with its tasks."""
    with open(os.environ.get("QACORPUS_TOKENIZERS", os.path.dirname(public_tokenizers.path("x"))) + f"/{name}", "rb") as f:
        return f.read()


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every document: its source in front, a passage of up to 40 characters
    after the first third taken out, its language behind."""
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang")
    edit = lambda at, size, put: F.struct(at.cast("long").alias("at"), F.lit(size).cast("long").alias("size"), put.alias("put"))
    front = F.concat(F.lit("Source: "), F.coalesce("source", F.lit("")), F.lit("\n"))
    edits = F.array(edit(F.lit(0), 0, front), edit(F.length(front) + F.floor(n / 3), 40, F.lit("[...]")), edit(F.lit(1 << 40), 0, F.concat(F.lit("\n"), F.coalesce("lang", F.lit("")))))
    return token_counts.count_edited(docs.withColumn("edits", edits), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", line_dedup.host(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    return line_dedup.drop_lines(stored(pages, "pages"), "host")  # both passes read the lines: pages are parsed once


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff_pages.stored_features(tiff_pages.store_texts(table(spark, sf_dir, "documents")))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op11_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.labelled(table(spark, sf_dir, "documents"))


def op12_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.collocations(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.transformed(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i+4], ' ')))
                                      ELSE [hash(array_to_string(w, ' '))] END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE common >= 0.8 * (p.n + q.n - common) - 1e-9
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = d.doc_id), d.doc_id)) AS class_id,
       (SELECT count(*) FROM links l WHERE l.x = d.doc_id) AS n_links
FROM documents d
"""


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.PAGES_SQL, "op4_neighbours": block_neighbours.SQL, "op10_jaccard_join": OP10_SQL, "op12_phrase_automata": phrase_automata.SQL}
