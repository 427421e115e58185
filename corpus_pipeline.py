"""From raw documents to packed training sequences: STAGES in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qacorpus.llm import jaccard_join, langid, line_dedup, packing, quality
from qacorpus.llm.common import stored, table
from qacorpus.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.clean(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language has at least 0.4 of the words' probability, so that texts in two languages stay; those without letters go."""
    return langid.identified(docs).select(*COLUMNS)


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; n_chars follows the text.

    Copies of a text count once, for the next stage is to find them by their content.
    """
    lines = line_dedup.drop_lines(docs, "source", copies_once=True)
    return lines.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by word shingles."""
    return jaccard_join.keep_one(docs).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", quality_filter),
    ("language ID", language_filter),
    ("line dedup", site_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", sequences),
]

#: No SQL expresses the classifiers and the packing: tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if not k else stored(docs, "stage"), sf_dir)
    return docs
