"""Statistics of the corpus: dictionary, document frequencies, BM25 index tables, word frequencies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, tokenize_words
from .bm25 import tables


def build_dictionary(chunks: DataFrame, min_len: int = 4, min_count: int = 1, order: str | None = None) -> DataFrame:
    """word and cnt over title and text of all chunks; with an order of chunks also place, where a word first stands, by
    which a dictionary that is filled chunk by chunk lists it."""
    tokens = tokenize_words(F.concat_ws("\n", "title", "text"))
    if order is None:
        words = chunks.select(F.explode(tokens).alias("word"))
        return words.filter(F.length("word") >= min_len).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= min_count)
    words = chunks.select(F.col(order).alias("chunk"), F.posexplode(tokens).alias("pos", "word"))
    return words.filter(F.length("word") >= min_len).groupBy("word").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("chunk", "pos")).alias("place")).filter(F.col("cnt") >= min_count)


def idf_table(chunks: DataFrame, lang: str | None = None, table: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lemma, df, idf) and one row (n, idf_max): chunks (chunk_id, text) count once for each of their lemmas, which a
    table (lang, form, lemma) gives by the chunks' column of languages."""
    total = chunks.agg(F.greatest(F.lit(1), F.count(F.lit(1))).alias("n"))
    counts = lemma_sets(chunks, ["chunk_id"], "text", lang, table).groupBy("lemma").agg(F.count(F.lit(1)).alias("df"))
    n = total.scalar()
    return counts.withColumn("idf", F.log((F.lit(1) + n) / (F.lit(1) + F.col("df")))), total.withColumn("idf_max", F.log1p("n"))


def lemma_sets(rows: DataFrame, keys: list[str], text: str = "text", lang: str | None = None, table: DataFrame | None = None, min_len: int = 4) -> DataFrame:
    """(*keys, lemma): the distinct lemmas of each text's words of min_len letters and more. Each distinct word of a
    language meets the table (lang, form, lemma) once; words it lacks are their own lemmas."""
    words = F.array_distinct(F.filter(tokenize_words(F.col(text)), lambda w: F.length(w) >= min_len))
    if table is None:
        return rows.select(*keys, F.explode(words).alias("lemma"))
    found = rows.select(*keys, F.col(lang).alias("lang"), F.explode(words).alias("word"))
    own = table.groupBy(F.col("lang").alias("s_lang"), F.col("form").alias("s_word")).agg(F.min("lemma").alias("s_lemma")).filter("s_word <> s_lemma")
    own = own.join(found.select("lang", "word").distinct(), (F.col("s_word") == F.col("word")) & F.col("s_lang").eqNullSafe(F.col("lang")), "left_semi")
    met = found.join(own, (F.col("word") == F.col("s_word")) & F.col("lang").eqNullSafe(F.col("s_lang")), "left")
    return met.select(*keys, F.coalesce("s_lemma", "word").alias("lemma")).distinct()


def bm25_index(chunks: DataFrame, sides: Column | None = None, lang: str | None = None, lemmas: DataFrame | None = None, epsilon: float = 0.25, store: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, terms) of Okapi indexes by side: (side, token, chunk_id, tf), (side, chunk_id, len, avg_len)
    and (side, token, df, idf). A negative idf becomes epsilon times the side's mean idf.

    lemmas (lang, form, lemma) with the chunks' column of languages gives words their lemmas. All three come from the
    postings; store(df, name) writes them once, so that texts are split once. build_index() adds what searches read.
    """
    return tables(chunks, sides, store, lang, lemmas, epsilon)


def length_buckets(dictionary: DataFrame) -> DataFrame:
    """Adds the folded form of each word and its length, the key of a comparison by length."""
    rows = dictionary.withColumn("folded", fold(F.col("word")))
    return rows.withColumn("flen", F.length("folded"))


def word_frequency(counts: DataFrame) -> DataFrame:
    """(lang, word, zipf) from counts (lang, word, cnt): the logarithm of occurrences in a billion words."""
    totals = counts.groupBy("lang").agg(F.sum("cnt").alias("total"))
    return counts.join(totals, "lang").select("lang", "word", F.log10(F.col("cnt") / F.col("total") * 1e9).alias("zipf"))
