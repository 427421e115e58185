"""Registered queries over documents, pages, questions and vectors, most with the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions import text as T
from ..operators import bm25 as B
from ..operators import chunks as C
from ..operators import forum as M
from ..operators import gates as G
from ..operators import growing as I
from ..operators import lexstats as L
from ..operators import nearest as N
from ..operators import pages as P
from ..operators import questions as Q
from ..operators import retrieval as R
from ..operators import scan as D
from ..operators import search as S
from ..sources import io
from ..streaming import streams as W
from . import log_queries, views
from .scratch import scratch, stored

QUERIES: dict = {}
SQL: dict[str, str] = {}
WORDS = r"[\p{L}\p{Nl}\p{No}]+"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH RECURSIVE articles AS ({views.ARTICLES}), questions AS ({views.QUESTIONS}) {sql}"
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article as one chunk."""
    return views.articles(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "url", "title", "section", "lang", F.col("body").alias("text"))


# --- chunks and articles

@query(
    "c12_chunks",
    r""", w AS (SELECT doc_id, section, list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '') AS w FROM articles WHERE trim(body) <> ''),
    s AS (SELECT doc_id, section, w, unnest(range(0, len(w), 450)) AS s FROM w) SELECT doc_id, section, (s // 450)::INT AS chunk_pos, array_to_string(w[s + 1 : s + 500], ' ') AS text FROM s""",
)
def _chunks(spark, sf_dir):
    return C.chunk_documents(views.articles(spark, sf_dir)).select("doc_id", "section", "chunk_pos", "text")


@query("c10_sections")
def _sections(spark, sf_dir):
    """Articles with their first two lines as a table of contents in front."""
    lines = F.split("body", "\n")
    body = F.when(F.size(lines) >= 2, F.concat(F.array_join(F.slice(lines, 1, 2), "\n"), F.lit("\n\n"), F.col("body"))).otherwise(F.col("body"))
    rows = views.articles(spark, sf_dir).select("doc_id", F.posexplode(C.split_sections(body)).alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.heading", F.length("s.text").alias("n_chars"))


query("c13_section_counts", "SELECT section, count(DISTINCT doc_id) AS documents, sum(ceil(len(list_filter(regexp_split_to_array(body, '\\s+'), lambda x: x <> '')) / 450.0))::BIGINT AS chunks FROM articles WHERE trim(body) <> '' GROUP BY 1")(
    lambda spark, sf_dir: C.section_counts(C.chunk_documents(views.articles(spark, sf_dir)))
)
query("c15_sides", "SELECT CASE WHEN section = 'sprzedaz' THEN 'sprzedajacy' ELSE 'kupujacy' END AS side, section, count(*) AS n FROM articles GROUP BY 1, 2")(
    lambda spark, sf_dir: C.partition_by_side(views.articles(spark, sf_dir).withColumn("section", F.concat(F.lit(" "), F.initcap("section")))).groupBy("side", "section").agg(F.count(F.lit(1)).alias("n"))
)
query("c14_merged", "SELECT count(*) AS n, max(doc_id) AS last FROM (SELECT doc_id FROM articles WHERE lang = 'en' UNION ALL SELECT doc_id + 1 + (SELECT max(doc_id) FROM articles WHERE lang = 'en') FROM articles WHERE lang <> 'en')")(
    lambda spark, sf_dir: C.merge_corpora(whole_chunks(spark, sf_dir).filter("lang = 'en'"), whole_chunks(spark, sf_dir).filter("lang <> 'en'")).agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last"))
)
query("c19_content_sha", "SELECT doc_id, sha1(title || chr(10) || body) AS sha, 'passage: ' || title || chr(10) || body AS passage FROM articles")(
    lambda spark, sf_dir: views.articles(spark, sf_dir).select("doc_id", T.content_sha(F.col("title"), F.col("body")).alias("sha"), C.passage_text(F.col("title"), F.col("body")).alias("passage"))
)
query("c18_unit_vectors", "SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS place, round(unnest(embedding)::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS value FROM embeddings")(
    lambda spark, sf_dir: read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(T.l2_normalize(F.transform("embedding", lambda x: x.cast("double")))).alias("place", "value")).select("vec_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))
)
query("c21_fingerprint")(lambda spark, sf_dir: C.fingerprint(read(spark, sf_dir, "documents"), "doc_id", ["text", "lang", "source"], stored))
query("c05_ids", "SELECT doc_id, section, row_number() OVER (ORDER BY section, doc_id) - 1 AS chunk_id FROM articles")(
    lambda spark, sf_dir: C.with_ids(views.articles(spark, sf_dir).select("doc_id", "section"), ["section", "doc_id"], stored)
)
query("c17_embeddings")(
    lambda spark, sf_dir: C.append_embeddings(
        whole_chunks(spark, sf_dir), whole_chunks(spark, sf_dir).filter("chunk_id % 2 = 0").select("chunk_id", T.content_sha(F.col("title"), F.col("text")).alias("sha"), F.array(F.lit(0.0)).alias("embedding")), R.hashed_encoder
    ).select("chunk_id", "sha", F.size("embedding").alias("dims"))
)


query("s05_frontmatter", "SELECT section, 'a-' || doc_id || '.md' AS file, '---' || chr(10) || 'url: ' || url || chr(10) || 'tytul: ' || title || chr(10) || 'agent: ' || section || chr(10) || 'podslug: ' || lang || chr(10) || '---' || chr(10) || chr(10) || body AS value FROM articles")(
    lambda spark, sf_dir: io.to_frontmatter(views.articles(spark, sf_dir).withColumn("subslug", F.col("lang")))
)
query("c09_assigned", "SELECT CASE source WHEN 'src0' THEN 'konto' WHEN 'src1' THEN 'zakupy' END AS section, count(*) AS n FROM documents WHERE source IN ('src0', 'src1') GROUP BY 1")(
    lambda spark, sf_dir: P.assign_section(
        read(spark, sf_dir, "documents").select(F.concat(F.lit("https://help.example/a/b/"), "source", F.lit("/x-"), "doc_id").alias("url")), spark.createDataFrame([("src0", "konto"), ("src1", "zakupy")], "subslug string, section string")
    )[2]
)

# --- pages

query("c01_articles")(lambda spark, sf_dir: P.extract_articles(read(spark, sf_dir, "pages"), ("article", None, None)).select("page_id", "title", "body"))
query("c02_long_articles")(lambda spark, sf_dir: P.drop_short_articles(P.extract_articles(read(spark, sf_dir, "pages"), ("article", None, None))).select("page_id", F.length("body").alias("n_chars")))
query("c03_wrong_language", "SELECT page_id, url FROM pages WHERE regexp_matches(html, 'lang=\"fr\"')")(
    lambda spark, sf_dir: P.split_wrong_language(read(spark, sf_dir, "pages").withColumns({"title": F.lit(""), "body": F.lit("")}), 'lang="fr"')[1]
)
query(
    "c04_links",
    r""", h AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS l FROM pages), e AS (SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) AS i FROM h),
    f AS (SELECT page_id, replace(link, '&amp;', '&') AS link, min(i) AS i FROM e GROUP BY 1, 2) SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS pos, link FROM f WHERE regexp_matches(link, '^/[A-Za-z]')""",
)(lambda spark, sf_dir: P.extract_article_links(read(spark, sf_dir, "pages"), "^/[A-Za-z]"))
query("c05_path_links", r""" SELECT page_id, list_transform(list_sort(list_distinct(regexp_extract_all(html, '/[a-z]+[0-9]*'))), lambda p: 'https://h.example' || p) AS links FROM pages""")(
    lambda spark, sf_dir: P.extract_path_links(read(spark, sf_dir, "pages"), "/[a-z]+[0-9]*", "https://h.example")
)
query("c06_first_category", r""", e AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS url, regexp_extract(url, '//([^/]+)', 1) AS category FROM pages) SELECT url, min(category) AS category FROM e GROUP BY 1""")(
    lambda spark, sf_dir: P.first_category_per_url(read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"), F.regexp_extract("url", "//([^/]+)", 1).alias("category")).select(F.col("target").alias("url"), "category"))
)
query(
    "c07_reachable",
    r""", edges AS (SELECT DISTINCT user_id AS src, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 40 * (event_id % 3) AS dst FROM events WHERE event_type = 'click' AND value > 40),
    r(slug) AS (SELECT 0::BIGINT UNION SELECT dst FROM r JOIN edges ON src = slug) SELECT slug FROM r""",
)(
    lambda spark, sf_dir: P.discover_reachable(
        read(spark, sf_dir, "events").filter("event_type = 'click' and value > 40").selectExpr("user_id AS src", "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + 40 * (event_id % 3) AS dst").distinct(), spark.range(1).select(F.col("id").alias("slug")), stored
    ).select("slug")
)

# --- text and corpus statistics

query("l01_dictionary", f", w AS (SELECT unnest(regexp_extract_all(lower(title || chr(10) || body), '{WORDS}')) AS word FROM articles) SELECT word, count(*) AS cnt FROM w WHERE length(word) >= 4 GROUP BY 1")(
    lambda spark, sf_dir: L.build_dictionary(whole_chunks(spark, sf_dir))
)
_IDF = f", l AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(body), '{WORDS}'), lambda x: length(x) >= 4)) AS lemma FROM articles), idf AS (SELECT lemma, count(*) AS df, ln((1 + (SELECT count(*) FROM articles)) / (1 + count(*))) AS idf FROM l GROUP BY 1)"
query("l02_idf", _IDF + " SELECT lemma, df, round(idf, 9) AS idf FROM idf")(lambda spark, sf_dir: L.idf_table(whole_chunks(spark, sf_dir))[0].withColumn("idf", F.round("idf", 9)))
_GRAMS = r"""list_concat([strip_accents(lower(w))], CASE WHEN length(w) + 1 < 3 THEN ['#' || w] ELSE list_transform(range(1, length(w)), lambda i: substr('#' || w, i, 3)) END)"""
_BM = rf""", w AS (SELECT doc_id AS chunk_id, CASE WHEN section = 'sprzedaz' THEN 'sprzedajacy' ELSE 'kupujacy' END AS side, unnest(list_filter(regexp_split_to_array(title || chr(10) || body, '\s+'), lambda x: x <> '')) AS w FROM articles),
  t AS (SELECT chunk_id, side, unnest({_GRAMS}) AS token FROM w), tf AS (SELECT side, token, chunk_id, count(*) AS tf FROM t GROUP BY 1, 2, 3), n AS (SELECT chunk_id, side, count(*) AS len FROM t GROUP BY 1, 2),
  every AS (SELECT doc_id AS chunk_id, CASE WHEN section = 'sprzedaz' THEN 'sprzedajacy' ELSE 'kupujacy' END AS side FROM articles),
  lens AS (SELECT e.chunk_id, e.side, coalesce(len, 0) AS len FROM every e LEFT JOIN n USING (chunk_id)), avgs AS (SELECT side, avg(len) AS avg_len, count(*) AS n FROM lens GROUP BY 1),
  raw AS (SELECT side, token, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN avgs USING (side) GROUP BY 1, 2),
  terms AS (SELECT side, token, df, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY side) ELSE idf END AS idf FROM raw)"""
query("l03_bm25_terms", _BM + " SELECT side, token, df, round(idf, 9) AS idf FROM terms")(lambda spark, sf_dir: _texts(spark, sf_dir).terms.withColumn("idf", F.round("idf", 9)))


def _texts(spark: SparkSession, sf_dir: str) -> D.Texts:
    """The articles with the statistics of their tokens, counted once in a session."""

    def made() -> D.Texts:
        rows = C.partition_by_side(whole_chunks(spark, sf_dir))
        return D.statistics(rows.select("chunk_id", "side", F.concat_ws("\n", "title", "text").alias("text")), stored, encode=passage_letters)

    return _once(spark, sf_dir, "texts", made)


def _index(spark: SparkSession, sf_dir: str) -> B.Bm25Index:
    """The index of a folder's articles, built once in a session."""
    return _once(spark, sf_dir, "index", lambda: B.build_index(C.partition_by_side(whole_chunks(spark, sf_dir)), F.col("side"), stored))


def _grown(spark: SparkSession, sf_dir: str) -> I.GrowingIndex:
    """The same index grown by two changes: first without the texts of a section and with a second copy of another's
    articles, then those texts are put in and the copies taken out."""

    def made() -> I.GrowingIndex:
        now = C.partition_by_side(whole_chunks(spark, sf_dir))
        copies = now.filter("section = 'platnosci'").withColumn("chunk_id", -1 - F.col("chunk_id"))
        before = now.withColumn("text", F.when(F.col("section") != "konto", F.col("text"))).unionByName(copies)
        index = I.grow(I.open_index(spark, scratch(spark)), before, sides=F.col("side"))
        return I.grow(index, now.filter("section = 'konto'"), copies.select("chunk_id"), F.col("side"))

    return _once(spark, sf_dir, "grown", made)


query("l03_grown_terms", _BM + " SELECT side, token, df, round(idf, 9) AS idf FROM terms")(lambda spark, sf_dir: I.tables(_grown(spark, sf_dir))[2].withColumn("idf", F.round("idf", 9)))


_kept: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


_FREQ = f", c AS (SELECT lang, word, count(*) AS cnt FROM (SELECT lang, unnest(regexp_extract_all(lower(body), '{WORDS}')) AS word FROM articles) GROUP BY 1, 2), freq AS (SELECT lang, word, log10(cnt / sum(cnt) OVER (PARTITION BY lang) * 1e9) AS zipf FROM c)"
query("l05_word_frequency", _FREQ + " SELECT lang, word, round(zipf, 6) AS zipf FROM freq")(lambda spark, sf_dir: _frequency(spark, sf_dir).withColumn("zipf", F.round("zipf", 6)))


def _frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = views.articles(spark, sf_dir).select("lang", F.explode(T.tokenize_words(F.col("body"))).alias("word"))
    return L.word_frequency(words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("cnt")))


query(
    "t09_text_measures",
    r""" SELECT doc_id, round(CASE WHEN body = '' THEN 0 ELSE length(regexp_replace(body, '\P{L}', '', 'g')) / length(body) END, 9)::DOUBLE AS letters, CASE WHEN body = '' THEN 0 ELSE greatest(1, round_even(length(body) / 3.6, 0)) END::INT AS tokens,
    strip_accents(lower(title)) AS lexical, length(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS n FROM articles""",
)(
    lambda spark, sf_dir: views.articles(spark, sf_dir).select(
        "doc_id", F.round(T.letter_ratio(F.col("body")), 9).alias("letters"), T.estimate_tokens(F.col("body")).alias("tokens"), T.normalize_lexical(F.col("title")).alias("lexical"), F.length(T.strip(F.regexp_replace("body", r"\s+", " "))).cast("long").alias("n")
    )
)
query("t11_redacted")(lambda spark, sf_dir: views.articles(spark, sf_dir).select("doc_id", T.redact_pii(F.col("body")).alias("text"), T.pii_tokens(F.col("body")).alias("tokens")))
query(
    "t19_source_titles",
    r""", p AS (SELECT page_id, url, regexp_extract(url, '://([^/:?#]+)', 1) AS host, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM p), w AS (SELECT *, list_filter(regexp_split_to_array(regexp_replace(coalesce(seg[-1], ''), '-[a-zA-Z0-9]{6,}$', ''), '[-_]'), lambda x: x <> '') AS words FROM s)
    SELECT page_id, CASE WHEN len(words) > 0 THEN array_to_string(list_transform(words, lambda x: upper(x[1]) || x[2:]), ' ') ELSE regexp_replace(host, '^www\.', '') END AS title, regexp_replace(host, '^www\.', '') AS domain FROM w""",
)(lambda spark, sf_dir: read(spark, sf_dir, "pages").select("page_id", T.source_title(F.col("url"), F.lit(None).cast("string")).alias("s")).select("page_id", "s.title", "s.domain"))
query("t22_thread_titles", r""", f AS (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY 1), g AS (SELECT conv_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM f) SELECT conv_id, CASE WHEN length(t) > 46 THEN substr(t, 1, 46) || '…' ELSE t END AS title FROM g""")(
    lambda spark, sf_dir: read(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", T.shorten(F.col("t")).alias("title"))
)
query("t17_verified_answers")(lambda spark, sf_dir: _answers(spark, sf_dir).select("conv_id", "turn", T.verify_answer(F.col("text"), F.col("hits")).alias("v")).select("conv_id", "turn", "v.*"))
query("t18_contexts")(lambda spark, sf_dir: _answers(spark, sf_dir).select("conv_id", "turn", T.context_block(F.transform("hits", lambda h: F.struct(h["title"].alias("title"), F.lit("").alias("heading"), h["url"].alias("text")))).alias("context")))
query("t20_renumbered")(lambda spark, sf_dir: _answers(spark, sf_dir).select("conv_id", "turn", T.renumber_citations(F.col("text"), F.col("hits")).alias("v")).select("conv_id", "turn", "v.*"))
query("t21_drafts")(lambda spark, sf_dir: _answers(spark, sf_dir).select("conv_id", "turn", T.split_draft(F.concat(F.lit("Subject: "), F.substring_index("text", " ", 3), F.lit("\n\n"), "text")).alias("v")).select("conv_id", "turn", "v.*"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of assistants with three sources, whose sentences end in markers."""
    hits = F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.struct(n.alias("n"), F.concat(F.lit("https://help.example/en/a-"), F.lit("abcde"), n).alias("url"), F.concat(F.lit("Title "), n).alias("title")))
    marked = F.concat(F.regexp_replace("text", r"\. ", " [1]. "), F.lit(" [2] [7] see https://other.example/x. [3]"))
    return read(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", marked.alias("text"), hits.alias("hits"))


# --- questions

query(
    "q01_screened",
    r""", s AS (SELECT query_id, trim(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS q FROM questions) SELECT query_id, CASE WHEN length(q) < 3 THEN 'za_krotkie' WHEN length(q) > 500 THEN 'za_dlugie' WHEN length(regexp_replace(q, '\P{L}', '', 'g')) / length(q) < 0.4 THEN 'nie_rozumiem' END AS reason FROM s""",
)(lambda spark, sf_dir: views.user_questions(spark, sf_dir).select("query_id", Q.screen_question(F.col("text")).alias("reason")))
query("q03_cleaned", f", t AS (SELECT CASE query_id % 5 WHEN 0 THEN text[:4] || ' ?' WHEN 1 THEN text || ' привет' ELSE text END AS text FROM questions) SELECT CASE WHEN regexp_matches(text, '[а-я]') THEN 'obcy_alfabet' WHEN len(list_filter(regexp_extract_all(text, '{WORDS}'), lambda w: length(w) >= 2)) <= 1 THEN 'bez_tresci' END AS reason, count(*) AS n FROM t GROUP BY 1 HAVING reason IS NOT NULL")(
    lambda spark, sf_dir: Q.clean_questions(views.user_questions(spark, sf_dir).withColumn("text", F.when(F.col("query_id") % 5 == 0, F.concat(F.substring("text", 1, 4), F.lit(" ?"))).when(F.col("query_id") % 5 == 1, F.concat("text", F.lit(" привет"))).otherwise(F.col("text"))))[2]
)
query(
    "q04_languages",
    _FREQ + f""", w AS (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda x: length(x) >= 4)) AS word FROM questions),
    s AS (SELECT query_id, count(*) AS n, round(coalesce(sum(a.zipf), 0), 9) AS a, round(coalesce(sum(b.zipf), 0), 9) AS b FROM w LEFT JOIN freq a ON a.word = w.word AND a.lang = 'fr' LEFT JOIN freq b ON b.word = w.word AND b.lang = 'en' GROUP BY 1)
    SELECT query_id, CASE WHEN n >= 2 AND a > b THEN 'fr' WHEN n >= 2 AND b > a THEN 'en' END AS detected FROM questions LEFT JOIN s USING (query_id)""",
)(lambda spark, sf_dir: Q.detect_language(views.user_questions(spark, sf_dir), _frequency(spark, sf_dir), langs=("fr", "en")))
query("q07_corrected")(lambda spark, sf_dir: _corrected(spark, sf_dir))
query("q08_unintelligible")(lambda spark, sf_dir: _corrected(spark, sf_dir).select("query_id", Q.unintelligible(F.col("corrected"), F.col("unknown")).alias("lost")))
query("q09_hard_words")(lambda spark, sf_dir: Q.hard_words(_corrected(spark, sf_dir).withColumnRenamed("corrected", "text"), "2024-01-31T00:00:00+00:00"))


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = L.build_dictionary(whole_chunks(spark, sf_dir), min_count=5)
    none = spark.createDataFrame([], "word string, zipf double")
    return Q.correct_questions(views.user_questions(spark, sf_dir), words, none, store=stored)


query(
    "q10_followups",
    f""", t AS (SELECT query_id, lower(text) AS low, regexp_extract_all(lower(text), '{WORDS}') AS w FROM questions)
    SELECT query_id, starts_with(trim(low), 'and ') OR starts_with(trim(low), 'what about') OR starts_with(trim(low), 'how about') OR starts_with(trim(low), 'what if') OR list_has_any(w, ['it', 'that', 'this', 'those', 'them', 'one']) AS followup,
      list_has_any(w, ['damaged', 'defective', 'broken', 'faulty', 'complaint', 'complaints', 'scam', 'scammed', 'return', 'refund', 'withdraw', 'invoice', 'receipt', 'unresponsive']) AS mail FROM t""",
)(lambda spark, sf_dir: views.user_questions(spark, sf_dir).select("query_id", Q.is_followup(F.col("text"), F.lit("en")).alias("followup"), Q.mail_signal(F.col("text"), F.lit("en")).alias("mail")))


@query("q15_turns")
def _turns(spark, sf_dir):
    """Turns of users with what came before them; every seventh begins with a greeting, every ninth is one."""
    turns = Q.history_window(read(spark, sf_dir, "conversations").filter("role <> 'system'"))
    said = F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("Hello, "), "text")).when(F.col("conv_id") % 9 == 0, F.lit("good morning")).otherwise(F.col("text"))
    rows = turns.filter("role = 'user'").select("conv_id", "turn", said.alias("text"), F.lit("en").alias("lang"), (F.size("history") > 0).alias("has_history"), F.when(F.col("turn") > 1, "konto").alias("prev_section"))
    return Q.classify_turn(rows).withColumn("control", Q.control_subclass(F.col("text"), F.col("lang")))


query(
    "q17_history",
    r""", h AS (SELECT conv_id, turn, list(role) OVER w AS history, last(CASE WHEN role = 'user' AND trim(coalesce(text, '')) <> '' THEN text END IGNORE NULLS) OVER v AS previous, text FROM conversations
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT conv_id, turn, array_to_string(coalesce(history, []), ',') AS history, previous, concat_ws(' ', previous, text) AS retrieval_text FROM h""",
)(lambda spark, sf_dir: Q.history_window(read(spark, sf_dir, "conversations")).select("conv_id", "turn", F.array_join(F.transform("history", lambda h: h["role"]), ",").alias("history"), "previous", "retrieval_text"))
query("q18_side_prior")(
    lambda spark, sf_dir: views.user_questions(spark, sf_dir).select("query_id", Q.side_prior(F.concat("text", F.when(F.col("query_id") % 5 == 0, " moja paczka").when(F.col("query_id") % 5 == 1, " prowizja").otherwise("")), F.when(F.col("turn") > 0, "sprzedaz"), F.lit(False)).alias("p")).select("query_id", "p.*")
)
query(
    "q19_new_questions",
    f""", i AS (SELECT DISTINCT md5(text) AS hash FROM questions WHERE conv_id % 2 = 1 AND len(list_filter(regexp_extract_all(text, '{WORDS}'), lambda w: length(w) >= 2)) > 1) SELECT hash FROM i WHERE hash NOT IN (SELECT md5(text) FROM questions WHERE conv_id % 2 = 0)""",
)(lambda spark, sf_dir: (lambda q: Q.new_by_hash(q.filter("conv_id % 2 = 1").select(F.col("text").alias("pytanie"), F.md5("text").alias("hash")), q.filter("conv_id % 2 = 0").select(F.md5("text").alias("hash"))).select("hash"))(views.user_questions(spark, sf_dir)))

# --- retrieval

_SIDE_OF = "CASE WHEN {} % 2 = 0 THEN 'kupujacy' ELSE 'sprzedajacy' END"
_ASKED = f""", asked AS (SELECT item_id AS query_id, {_SIDE_OF.format("item_id")} AS side, text FROM benchmark)"""
_LEXICAL = rf""", b AS (SELECT query_id, side, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM asked), bt AS (SELECT query_id, side, unnest({_GRAMS}) AS token FROM b),
  qt AS (SELECT query_id, side, token, count(*) AS qtf FROM bt GROUP BY 1, 2, 3),
  s AS (SELECT query_id, side, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 9) AS score FROM qt JOIN terms USING (side, token) JOIN tf USING (side, token) JOIN lens USING (side, chunk_id) JOIN avgs USING (side) GROUP BY 1, 2, 3),
  r AS (SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS pos FROM s)"""
_RANK = _BM + _ASKED + _LEXICAL
_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (length(lower({0})) - length(replace(lower({0}), c, '')))::DOUBLE)"
#: Whole rankings of every chunk of the asked side by words and by letters, fused.
_FUSED = rf""", qv AS (SELECT query_id, side, {_LETTERS.format("('query: ' || text)")} AS v FROM asked), cv AS (SELECT doc_id AS chunk_id, CASE WHEN section = 'sprzedaz' THEN 'sprzedajacy' ELSE 'kupujacy' END AS side, {_LETTERS.format("('passage: ' || title || chr(10) || body)")} AS v FROM articles),
  unit AS (SELECT * REPLACE (list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v) FROM cv),
  near AS (SELECT q.query_id, c.chunk_id, round(list_dot_product(list_transform(q.v, lambda x: x / sqrt(list_dot_product(q.v, q.v))), c.v), 9) AS score FROM qv q JOIN unit c USING (side)),
  whole AS (SELECT n.query_id, n.chunk_id, n.score AS v, coalesce(s.score, 0) AS w FROM near n LEFT JOIN s ON s.query_id = n.query_id AND s.chunk_id = n.chunk_id),
  placed AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, chunk_id) - 1 AS a, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, chunk_id) - 1 AS b FROM whole),
  sums AS (SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + a) + 1.0::DOUBLE / (60 + b), 12) AS score FROM placed), fused AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS pos FROM sums)"""
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({}), '\s+'), lambda x: x <> ''))"
#: The best candidates with their pair scores, then without repeats, in order.
_RERANKED = rf""", pairs AS (SELECT f.query_id, f.chunk_id, f.pos, a.url, a.title, a.section, a.body, {_WORDS.format("q.text")} AS qw, {_WORDS.format("(a.title || chr(10) || a.body)")} AS pw FROM fused f JOIN articles a ON a.doc_id = f.chunk_id JOIN asked q ON q.query_id = f.query_id WHERE f.pos < 12),
  rated AS (SELECT * EXCLUDE (qw, pw), len(list_intersect(qw, pw))::DOUBLE / greatest(len(qw), 1) - 1e-6 * len(pw) AS score FROM pairs),
  single AS (SELECT * REPLACE (first_pos AS pos) FROM (SELECT *, min(pos) OVER (PARTITION BY query_id, title, body) AS first_pos FROM rated QUALIFY row_number() OVER (PARTITION BY query_id, title, body ORDER BY score DESC, pos) = 1)),
  hits AS (SELECT query_id, chunk_id, url, title, section, body, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) - 1)::INT AS pos FROM single QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) <= 5)"""


def letter_profile(text):
    """A unit vector of how often each letter from a to z occurs: an encoder that SQL can follow."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(letters(texts)), dtype=object)

    return of(text)


def letters(texts) -> np.ndarray:
    counts = np.array([np.bincount(np.frombuffer((t or "").lower().encode(), np.uint8), minlength=256)[97:123] for t in texts], float).reshape(-1, 26)
    length = np.sqrt((counts**2).sum(1))
    return counts / np.where(length > 0, length, 1.0)[:, None]


def passage_letters(texts) -> np.ndarray:
    """letter_profile() of passages of titles and texts."""
    return letters(["passage: " + (t or "") for t in texts])


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's items as questions, of the buyer's and the seller's side in turn."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, lists.SIDES[0]).otherwise(lists.SIDES[1]).alias("side"), "text")


def _bm25(spark: SparkSession, sf_dir: str, depth: int = 20) -> DataFrame:
    return D.top(_benchmark(spark, sf_dir), _texts(spark, sf_dir), depth, stored).drop("near")


query("r01_bm25", _RANK + " SELECT query_id, chunk_id, round(score, 3) AS score, pos FROM r WHERE pos < 20")(lambda spark, sf_dir: _bm25(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 3).alias("score"), F.col("pos").cast("int").alias("pos")))
query("r01_grown", _RANK + " SELECT query_id, chunk_id, round(score, 3) AS score, pos FROM r WHERE pos < 20")(lambda spark, sf_dir: I.rank(_benchmark(spark, sf_dir), _grown(spark, sf_dir), 20).select("query_id", "chunk_id", F.round("score", 3).alias("score"), F.col("pos").cast("int").alias("pos")))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "vectors", lambda: stored(C.partition_by_side(whole_chunks(spark, sf_dir)).select("chunk_id", "side", letter_profile(C.passage_text(F.col("title"), F.col("text"))).alias("vector")), "vectors"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _benchmark(spark, sf_dir).withColumn("vector", letter_profile(C.query_text(F.col("text"))))


def _candidates(spark: SparkSession, sf_dir: str, k_raw: int) -> DataFrame:
    return D.fused(_asked(spark, sf_dir), _texts(spark, sf_dir), k_raw, stored)


_NEAREST = r""", p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0)
    SELECT query_id, chunk_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS pos FROM p QUALIFY pos < 10"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every fiftieth vector as a question, and all vectors."""
    every = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return every.filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), every


query("r02_vectors", _NEAREST)(lambda spark, sf_dir: R.vector_rank(*_near(spark, sf_dir), 10).withColumn("score", F.round("score", 6)))
query("r02_pruned", _NEAREST)(lambda spark, sf_dir: N.vector_top(*_near(spark, sf_dir), 10, stored).withColumn("score", F.round("score", 6)))
query(
    "r03_fused",
    _RANK + """, two AS (SELECT query_id, chunk_id, pos FROM r WHERE pos < 20 UNION ALL SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY length(body) DESC, doc_id) - 1)::INT AS pos FROM r JOIN articles ON doc_id = chunk_id WHERE pos < 20 AND chunk_id % 3 > 0),
    f AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + pos)), 12) AS score FROM two GROUP BY 1, 2) SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS pos FROM f""",
)(lambda spark, sf_dir: _fused(spark, sf_dir))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking by BM25 and, of two thirds of its articles, one by length."""
    by_words = stored(_bm25(spark, sf_dir), "ranking")
    rows = by_words.filter("chunk_id % 3 > 0").join(views.articles(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.length("body").alias("n")), "chunk_id")
    by_length = rows.select("query_id", "chunk_id", (F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "chunk_id")) - 1).alias("pos"))
    return R.rrf([by_words, by_length])


def _cut(spark: SparkSession, sf_dir: str, depth: int) -> tuple[DataFrame, DataFrame]:
    both = stored(D.top(_asked(spark, sf_dir), _texts(spark, sf_dir), depth, stored, whole=True), "both")
    return both.filter("not near").drop("near"), both.filter("near").drop("near")


query("r04_certified")(lambda spark, sf_dir: R.certified(_cut(spark, sf_dir, 50), 5, 50))
query("r04_candidates", _RANK + _FUSED + " SELECT query_id, chunk_id, score, pos FROM fused WHERE pos < 12")(lambda spark, sf_dir: _candidates(spark, sf_dir, 12))


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return R.hybrid(_asked(spark, sf_dir), lambda asked, wanted: D.fused(asked, texts, wanted, stored), max((n for n, _ in texts.sides.values()), default=0), whole_chunks(spark, sf_dir), stored)


query(
    "r06_hybrid",
    _RANK + _FUSED + """, one AS (SELECT f.query_id, f.chunk_id, f.score, f.pos, a.url FROM fused f JOIN articles a ON a.doc_id = f.chunk_id QUALIFY row_number() OVER (PARTITION BY f.query_id, a.title, a.body ORDER BY f.pos) = 1)
    SELECT query_id, chunk_id, url, score, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS pos FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 5""",
)(lambda spark, sf_dir: _hybrid(spark, sf_dir).select("query_id", "chunk_id", "url", "score", "pos"))
query("r08_reranked", _RANK + _FUSED + _RERANKED + " SELECT query_id, chunk_id, url, round(score, 9) AS score, pos FROM hits")(
    lambda spark, sf_dir: R.search_reranked(_benchmark(spark, sf_dir), [_candidates(spark, sf_dir, 12)], whole_chunks(spark, sf_dir), 5).select("query_id", "chunk_id", "url", F.round("score", 9).alias("score"), "pos")
)
_TABLE = _RANK + _FUSED + rf""", bank AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY text ORDER BY query_id) = 1),
  scored AS (SELECT q.text AS query, q.side, f.pos, a.url, sha1(a.title || chr(10) || a.body) AS sha, {_WORDS.format("q.text")} AS qw, {_WORDS.format("(a.title || chr(10) || a.body)")} AS pw FROM fused f JOIN bank q USING (query_id) JOIN articles a ON a.doc_id = f.chunk_id WHERE f.pos < 30),
  tablica AS (SELECT 'pl' AS lang, query, side, pos, url, round(len(list_intersect(qw, pw))::DOUBLE / greatest(len(qw), 1) - 1e-6 * len(pw), 9) AS score, sha FROM scored)"""


def _score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _benchmark(spark, sf_dir)
    found = _candidates(spark, sf_dir, 30).join(asked.select("query_id", "side"), "query_id")
    return R.build_score_table(asked.drop("side").withColumn("lang", F.lit("pl")), found, whole_chunks(spark, sf_dir)).withColumn("score", F.round("score", 9))


query("r09_score_table", _TABLE + " SELECT * FROM tablica")(_score_table)
query(
    "r10_replayed",
    _TABLE + """, cut AS (SELECT query, side, pos, url, score, sha FROM tablica WHERE pos < 12), one AS (SELECT * FROM (SELECT * REPLACE (min(pos) OVER (PARTITION BY query, sha) AS pos), pos AS own FROM cut) QUALIFY row_number() OVER (PARTITION BY query, sha ORDER BY score DESC, own) = 1)
    SELECT q.query_id, o.query, o.side, o.url, o.score, o.sha, (row_number() OVER (PARTITION BY q.query_id ORDER BY o.score DESC, o.pos) - 1)::INT AS pos FROM one o JOIN asked q ON q.text = o.query QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY o.score DESC, o.pos) <= 5""",
)(lambda spark, sf_dir: (lambda t: R.replay_search(t, _benchmark(spark, sf_dir).select("query_id", F.col("text").alias("query")), list(lists.SIDES), 5, 12).drop("lang"))(stored(_score_table(spark, sf_dir), "scores")))
query("r11_reconciled", _TABLE + " SELECT lang, query, side, count(*) AS old_n, count(*) FILTER (pos <> 3) AS new_n, min(pos) FILTER (pos = 3) AS first_mismatch, count(*) FILTER (pos = 3) = 0 AS same FROM tablica GROUP BY 1, 2, 3")(
    lambda spark, sf_dir: (lambda t: R.reconcile_candidates(t, t.filter("pos <> 3")))(stored(_score_table(spark, sf_dir), "scores"))
)
query("r14_sources", _RANK + ", f AS (SELECT query_id, url, min(pos) AS pos FROM r JOIN articles a ON a.doc_id = chunk_id WHERE pos < 20 GROUP BY 1, 2) SELECT query_id, array_to_string(list(url ORDER BY pos), ' ') AS urls FROM f GROUP BY 1")(
    lambda spark, sf_dir: R.result_sources(_bm25(spark, sf_dir).join(whole_chunks(spark, sf_dir), "chunk_id")).select("query_id", F.array_join(F.transform("sources", lambda s: s["url"]), " ").alias("urls"))
)
query(
    "r13_hits",
    _RANK + """, g AS (SELECT item_id AS query_id, lang AS set, url FROM benchmark b JOIN articles a ON contains(a.body, b.text)), h AS (SELECT query_id, set, url, min(pos) AS pos FROM g LEFT JOIN (SELECT r.query_id, r.pos, a.url FROM r JOIN articles a ON a.doc_id = r.chunk_id WHERE pos < 20) x USING (query_id, url) GROUP BY 1, 2, 3)
    SELECT set, count(*) AS n, round(avg(CASE WHEN pos < 1 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_1, round(avg(CASE WHEN pos < 5 THEN 1.0 ELSE 0.0 END), 4) AS hit_at_5 FROM h GROUP BY 1""",
)(lambda spark, sf_dir: R.hit_at_k(_bm25(spark, sf_dir).join(whole_chunks(spark, sf_dir).select("chunk_id", "url"), "chunk_id"), _golden(spark, sf_dir), [1, 5]))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that hold a benchmark item: joined on a run of its inner words, which stand there whole, up to five,
    then checked. Items of fewer than three words have none; they are sought in every article."""
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    run = lambda i, n: F.xxhash64(F.array_join(F.slice("w", i, n), " "))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("item")).withColumn("w", words(F.col("item"))).withColumn("n", F.least(F.lit(5), F.size("w") - 2))
    rows = whole_chunks(spark, sf_dir).select("chunk_id", "url", F.col("lang").alias("set"), "text", words(F.col("text")).alias("w"))
    found = rows.join(items.filter("n < 1").select("query_id", "item"), F.contains("text", F.col("item"))).select("query_id", "set", "url")
    for (n,) in items.filter("n >= 1").select("n").distinct().collect():  # at most five
        keys = items.filter(F.col("n") == n).select("query_id", "item", run(F.lit(2), n).alias("key"))
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(F.array().cast("array<int>"))
        runs = rows.select("chunk_id", "url", "set", "text", F.explode(F.array_distinct(F.transform(starts, lambda i: run(i, n)))).alias("key"))
        found = found.union(runs.join(keys, "key").filter(F.contains("text", F.col("item"))).select("query_id", "set", "url"))
    return found.distinct()


query("r16_sweep", ", s AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'golden' ELSE 'ood' END AS set, value AS score FROM events) SELECT t AS threshold, count(*) FILTER (set = 'golden' AND score < t) AS false_refusals, count(*) FILTER (set = 'ood' AND score < t) AS cut, count(*) FILTER (score >= t) AS judge_calls FROM s, (VALUES (5.0), (20.0), (80.0)) v(t) GROUP BY 1")(
    lambda spark, sf_dir: R.threshold_sweep(read(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("view", "click"), "golden").otherwise("ood").alias("set"), F.col("value").alias("score")), [5.0, 20.0, 80.0])
)
query("r17_distribution", " SELECT event_type AS set, min(value) AS low, quantile_cont(value, 0.5) AS median, max(value) AS high FROM events GROUP BY 1")(
    lambda spark, sf_dir: R.score_distribution(read(spark, sf_dir, "events").select(F.col("event_type").alias("set"), F.col("value").alias("score")), "set")
)


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 5).alias("fold"), F.col("label").cast("string").alias("class"))


_NEAR = r""", p AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, b.label::VARCHAR AS class, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 5 <> b.vec_id % 5),
  k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1)::INT AS pos FROM p QUALIFY pos < 5)"""
query("r15_neighbours", _NEAR + " SELECT query_id, chunk_id, pos FROM k")(lambda spark, sf_dir: R.knn_out_of_fold(_folded(spark, sf_dir), 5).select("query_id", "chunk_id", "pos"))
query("m13_knn", _NEAR + ", c AS (SELECT query_id, class, count(*) AS n, min(pos) AS pos FROM k GROUP BY 1, 2) SELECT query_id AS chunk_id, class, round(n / 5, 4) AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, pos) = 1")(
    lambda spark, sf_dir: M.knn_baseline(_folded(spark, sf_dir), 5)
)
query("r12_outcomes", f", log AS ({views.LOG}) SELECT seq AS query_id, CASE WHEN wynik = 'odmowa' AND k % 2 = 0 THEN 'sprzedajacy' ELSE 'kupujacy' END AS side, CASE WHEN wynik = 'odmowa' AND k % 2 = 0 THEN 2 ELSE 1 END AS etap, CASE WHEN wynik = 'odmowa' AND k % 2 = 1 THEN coalesce(powod, 'odmowa') END AS powod, CASE WHEN wynik = 'odmowa' AND k % 2 = 1 THEN 'sedzia' END AS powod_etap2, coalesce(wynik = 'odmowa' AND k % 2 = 0, false) AS note FROM log WHERE typ IS NULL")(
    lambda spark, sf_dir: (lambda q: R.two_stage(q.select(F.col("seq").alias("query_id"), F.lit("kupujacy").alias("side"), F.when(F.col("wynik") == "odmowa", F.coalesce("powod", F.lit("odmowa"))).alias("reason")), q.filter("wynik = 'odmowa'").select(F.col("seq").alias("query_id"), F.lit("sprzedajacy").alias("side"), F.when(F.col("k") % 2 == 1, "sedzia").alias("reason"))))(views.log(spark, sf_dir).filter("typ is null"))
)

#: Questions of the whole search: benchmark items and what users say, some as greetings, too short, or asking for a mail.
_SAID = """SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'kupujacy' WHEN 1 THEN 'sprzedajacy' ELSE 'auto' END AS side, text, false AS has_history, NULL AS previous FROM benchmark
  UNION ALL SELECT 1000000 + conv_id * 1000 + turn, CASE conv_id % 3 WHEN 0 THEN 'kupujacy' WHEN 1 THEN 'sprzedajacy' END,
    CASE conv_id % 10 WHEN 0 THEN 'Good morning' WHEN 1 THEN 'Please write a complaint: ' || substr(text, 1, 60) WHEN 2 THEN substr(text, 1, 2) WHEN 3 THEN 'Hello, ' || text ELSE text END, turn > 0, NULL FROM conversations WHERE role = 'user'"""


def _two_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    views.register(spark, sf_dir, "benchmark", "conversations")
    said = spark.sql(_SAID)
    asked = said.withColumns({"lang": F.lit("en"), "prev_section": F.lit(None).cast("string"), "previous": F.lit(None).cast("string"), "rewritten": F.lit(None).cast("string"), "mail_category": F.lit(None).cast("string"), "correct": F.lit(False)})
    chunks = C.partition_by_side(whole_chunks(spark, sf_dir))
    idf = _once(spark, sf_dir, "idf", lambda: stored(L.idf_table(whole_chunks(spark, sf_dir))[0], "idf"))
    corpus = S.Corpus(chunks, _index(spark, sf_dir), _vectors(spark, sf_dir), idf, 12.0)
    found = S.two_stage_search(asked, corpus, lambda t: letter_profile(C.query_text(t)), stored, rerank={"pl": 0.05, "en": 0.1}, covered={"pl": 0.5, "en": 0.8})
    return found.select("query_id", "tryb", "side", F.coalesce("etap", F.lit(0)).alias("etap"), "powod", "powod_etap2", "nota", "section", F.get("sources", F.lit(0)).alias("top_source"), F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"), "cechy.rerank_top1", "cechy.pokrycie")


def _stage_sql(n: int, source: str) -> str:
    """One stage over the questions of a source (query_id, side, text), its tables numbered."""
    names = "asked|b|bt|qt|s|r|qv|cv|unit|near|whole|placed|sums|fused|pairs|rated|single|hits"
    text = re.sub(rf"(?<![\w.])({names})(?= AS \()|(?<=FROM )({names})\b|(?<=JOIN )({names})\b|(?<![\w.])(s)(?=\.)", lambda m: f"{m[0]}{n}", _LEXICAL + _FUSED + _RERANKED)
    return f", asked{n} AS ({source})" + text + rf""",
  top{n} AS (SELECT query_id, arg_min(score, pos) AS top_score, arg_min(section, pos) AS section, arg_min(body, pos) AS body, arg_min(url, pos) AS url, count(*) AS n_hits, count(DISTINCT url) AS n_sources FROM hits{n} GROUP BY 1),
  say{n} AS (SELECT q.query_id, q.side, t.* EXCLUDE (query_id), q.text || ' ' || substr(t.body, 1, 200) AS answer FROM asked{n} q LEFT JOIN top{n} t USING (query_id)),
  al{n} AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(answer), '{WORDS}'), lambda x: length(x) >= 4)) AS lemma FROM say{n}), cl{n} AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(body), '{WORDS}'), lambda x: length(x) >= 4)) AS lemma FROM hits{n}),
  cov{n} AS (SELECT a.query_id, sum(CASE WHEN c.lemma IS NOT NULL THEN coalesce(idf, 12.0) ELSE 0 END) / sum(coalesce(idf, 12.0)) AS v FROM al{n} a LEFT JOIN idf USING (lemma) LEFT JOIN cl{n} c ON c.query_id = a.query_id AND c.lemma = a.lemma GROUP BY 1),
  out{n} AS (SELECT y.*, coalesce(v, 0) AS coverage, CASE WHEN n_hits IS NULL OR top_score < 0.1 THEN 'prog_rerank' WHEN top_score < 0.2 THEN 'sedzia' WHEN coalesce(v, 0) < 0.8 THEN 'pokrycie'
    WHEN top_score < 0.3 AND (contains(lower(answer), 'i do not know') OR contains(lower(answer), 'no information')) THEN 'model_nie_wie' END AS reason FROM say{n} y LEFT JOIN cov{n} USING (query_id))"""


_TWO_STAGES = (
    _BM + _IDF
    + rf""", said AS ({_SAID}), trimmed AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q0 FROM said), greeted AS (SELECT *, CASE WHEN starts_with(q0, 'Hello, ') AND len(list_filter(regexp_extract_all(lower(substr(q0, 8)), '{WORDS}'), lambda x: length(x) >= 4)) >= 2 THEN trim(regexp_replace(substr(q0, 6), '^[ ,:;\-]+', '')) ELSE text END AS q, q0 = 'Good morning' AS chat FROM trimmed),
  guarded AS (SELECT *, regexp_replace(q, '^\s+|\s+$', '', 'g') AS z FROM greeted),
  ready AS (SELECT query_id, side, q AS text, CASE WHEN chat THEN 'rozmowa' ELSE 'rag' END AS tryb, CASE WHEN chat THEN NULL WHEN length(z) < 3 THEN 'guard_za_krotkie' WHEN length(z) > 500 THEN 'guard_za_dlugie' WHEN length(regexp_replace(z, '\P{{L}}', '', 'g')) / length(z) < 0.4 THEN 'guard_nie_rozumiem' WHEN starts_with(q, 'Please write a complaint') THEN 'mail_doprecyzuj' END AS powod FROM guarded)"""
    + _stage_sql(1, "SELECT query_id, CASE WHEN side = 'sprzedajacy' THEN side ELSE 'kupujacy' END AS side, text FROM ready WHERE tryb = 'rag' AND powod IS NULL")
    + _stage_sql(2, "SELECT query_id, CASE WHEN side = 'kupujacy' THEN 'sprzedajacy' ELSE 'kupujacy' END AS side, text FROM asked1 JOIN (SELECT query_id FROM out1 WHERE reason IS NOT NULL) USING (query_id)")
    + """, pair AS (SELECT a.*, b.query_id IS NOT NULL AND b.reason IS NULL AS moved, b.side AS side2, b.reason AS reason2, b.section AS section2, b.url AS url2, b.n_sources AS n2, b.top_score AS top2, b.coverage AS cov2 FROM out1 a LEFT JOIN out2 b USING (query_id))
  SELECT r.query_id, tryb, CASE WHEN moved THEN side2 ELSE o.side END AS side, CASE WHEN moved THEN 2 WHEN o.query_id IS NOT NULL THEN 1 ELSE 0 END AS etap, coalesce(powod, CASE WHEN NOT moved THEN reason END) AS powod, CASE WHEN NOT moved THEN reason2 END AS powod_etap2, CASE WHEN moved THEN side2 END AS nota,
    CASE WHEN moved THEN section2 WHEN reason IS NULL THEN section END AS section, CASE WHEN moved THEN url2 WHEN reason IS NULL THEN url END AS top_source, CASE WHEN moved THEN n2 WHEN reason IS NULL AND o.query_id IS NOT NULL THEN n_sources ELSE 0 END::INT AS n_sources,
    round(CASE WHEN moved THEN top2 ELSE top_score END, 4) AS rerank_top1, round(CASE WHEN moved THEN cov2 WHEN reason IN ('prog_rerank', 'sedzia', 'brak_generacji') THEN NULL ELSE coverage END, 4) AS pokrycie FROM ready r LEFT JOIN pair o USING (query_id)"""
)
query("r12_two_stages", _TWO_STAGES)(_two_stages)

# --- gates

query(
    "g01_coverage",
    _IDF + f""", a AS (SELECT conv_id * 1000 + turn AS query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda x: length(x) >= 4))) AS lemma FROM conversations WHERE role = 'assistant'),
    c AS (SELECT DISTINCT conv_id * 1000 + turn + 1 AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda x: length(x) >= 4)) AS lemma FROM conversations WHERE role = 'user'),
    s AS (SELECT a.query_id, sum(CASE WHEN c.lemma IS NOT NULL THEN coalesce(idf, 12.0) ELSE 0 END) / sum(coalesce(idf, 12.0)) AS v FROM a LEFT JOIN idf USING (lemma) LEFT JOIN c ON c.query_id = a.query_id AND c.lemma = a.lemma GROUP BY 1)
    SELECT conv_id * 1000 + turn AS query_id, round(coalesce(v, 0), 9) AS coverage FROM conversations LEFT JOIN s ON s.query_id = conv_id * 1000 + turn WHERE role = 'assistant'""",
)(lambda spark, sf_dir: _coverage(spark, sf_dir).withColumn("coverage", F.round("coverage", 9)))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read(spark, sf_dir, "conversations").withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    answers = said.filter("role = 'assistant'").select("query_id", F.col("text").alias("answer"))
    contexts = said.filter("role = 'user'").select((F.col("query_id") + 1).alias("query_id"), "text")
    return G.answer_coverage(answers, contexts, L.idf_table(whole_chunks(spark, sf_dir))[0], 12.0)


query(
    "g04_gates",
    f""", log AS ({views.LOG}) SELECT seq, CASE WHEN k % 13 = 0 OR -latencja_s < (CASE WHEN lang = 'en' THEN -3.6 ELSE -5.7 END) THEN 'prog_rerank' WHEN k % 5 = 1 THEN 'sedzia' WHEN k % 7 = 0 THEN 'brak_generacji' WHEN k / 100 < (CASE WHEN lang = 'en' THEN 0.35 ELSE 0.2 END) THEN 'pokrycie'
    WHEN k % 4 = 0 AND k % 3 = 0 THEN 'model_nie_wie' WHEN k % 4 = 1 THEN 'jawna_odmowa' END AS reason FROM log WHERE typ IS NULL""",
)(lambda spark, sf_dir: _gates(spark, sf_dir).select("seq", "reason"))


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = views.log(spark, sf_dir).filter("typ is null"), F.col("k")
    said = F.when(F.col("lang") == "en", F.when(k % 4 == 0, "I do not have information").when(k % 4 == 1, "I can’t answer this question. Sorry").otherwise("An answer")).otherwise(F.when(k % 4 == 0, "Nie mam informacji").when(k % 4 == 1, "Nie mogę odpowiedzieć na to pytanie").otherwise("Tak"))
    return G.gate_reason(q.select("seq", "lang", F.when(k % 13 == 0, 0).otherwise(5).alias("n_hits"), (-F.col("latencja_s")).alias("top_score"), (k % 5 != 1).alias("judge_ok"), F.when(k % 7 == 0, "").otherwise(said).alias("answer"), (k / 100).alias("coverage"), F.when(k % 3 == 0, 0).otherwise(1).alias("n_citations")))


query("g06_features")(
    lambda spark, sf_dir: G.outcome_features(_bm25(spark, sf_dir).join(whole_chunks(spark, sf_dir), "chunk_id"), _benchmark(spark, sf_dir).select("query_id", F.lit(True).alias("judge_ok"), F.lit(0.5).alias("coverage"), F.lit(1).alias("stage"))).select("query_id", "cechy.*")
)

# --- forum classifier: the language of a document as its class

_FOLD = r"""CASE WHEN p < 70 THEN 'uczenie' WHEN p < 85 THEN 'kalibracja' ELSE 'test' END"""
_FOLDED = rf""", n AS (SELECT doc_id AS query_id, lang AS class, body AS text, trim(regexp_replace(strip_accents(lower(title)), '\s+', ' ', 'g')) AS t, title FROM articles),
  h AS (SELECT *, list_reduce(list_prepend(0, list_transform(string_split(sha1(t), ''), lambda d: instr('0123456789abcdef', d) - 1)), lambda r, d: (r * 16 + d) % 100) AS p FROM n), f AS (SELECT * EXCLUDE (p, t), {_FOLD} AS fold FROM h)"""
query("m03_folds", _FOLDED + " SELECT query_id, fold FROM f")(lambda spark, sf_dir: _bank(spark, sf_dir).select("query_id", "fold"))


def _bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.articles(spark, sf_dir).select(F.col("doc_id").alias("query_id"), F.col("lang").alias("class"), F.element_at(F.split("url", "/"), 4).alias("board"), F.col("body").alias("text"), M.assign_fold(F.col("title")).alias("fold"), F.when(F.col("section") == "sprzedaz", "sprzedajacy").otherwise("kupujacy").alias("side"))


_COUNTED = (
    _FOLDED
    + f""", e AS (SELECT class, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda x: length(x) >= 4))) AS lemma FROM f WHERE fold = 'uczenie' AND class IS NOT NULL), y AS (SELECT lemma, class, count(*) AS y FROM e GROUP BY 1, 2),
  d AS (SELECT lemma, sum(y) AS df FROM y GROUP BY 1 HAVING sum(y) >= 20), n2 AS (SELECT class, sum(y) AS n FROM y JOIN d USING (lemma) GROUP BY 1), w AS (SELECT sum(n) AS whole FROM n2),
  g AS (SELECT d.lemma, n2.class, coalesce(y.y, 0)::DOUBLE AS y, (df - coalesce(y.y, 0))::DOUBLE AS r, n2.n::DOUBLE AS n, (whole - n2.n)::DOUBLE AS m, 500.0 * df / whole AS a FROM d CROSS JOIN n2 CROSS JOIN w LEFT JOIN y ON y.lemma = d.lemma AND y.class = n2.class),
  """
)
_Z = "(ln((y + a) / greatest(n + 500 - y - a, 1e-9)) - ln((r + a) / greatest(m + 500 - r - a, 1e-9))) / sqrt(1 / (y + a) + 1 / (r + a))"
#: The weights of all lemmas, and those of each class's 200 best, with which the thresholds are set.
_WEIGHTS = _COUNTED + f"weights AS (SELECT class, lemma, round({_Z}, 4) AS z FROM g)"
_BEST = (
    _COUNTED
    + f"""raw_z AS (SELECT class, lemma, {_Z} AS z FROM g),
  weights AS (SELECT class, lemma, round(z, 4) AS z FROM raw_z QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(abs(z), 9) DESC, lemma) <= 200)"""
)
query("m04_weights", _WEIGHTS + " SELECT class, lemma, z FROM weights")(lambda spark, sf_dir: _weights(spark, sf_dir))


def _weights(spark: SparkSession, sf_dir: str, per_class: int | None = None) -> DataFrame:
    return M.train_weights(_bank(spark, sf_dir).filter("fold = 'uczenie'"), per_class=per_class, store=stored)


_POINTS = f""", l AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '{WORDS}'), lambda x: length(x) >= 4))) AS lemma FROM f), s AS (SELECT query_id, class, sum(z) AS score FROM l JOIN weights USING (lemma) GROUP BY 1, 2),
  a AS (SELECT f.query_id, f.class AS truth, f.fold, n2.class, round(coalesce(s.score, 0), 9) AS score FROM f CROSS JOIN n2 LEFT JOIN s ON s.query_id = f.query_id AND s.class = n2.class),
  points AS (SELECT query_id, truth, fold, class, score, round(score - coalesce(lead(score) OVER o, 0), 9) AS margin FROM a WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, class DESC) QUALIFY row_number() OVER o = 1)"""
_SCORED = _BEST + _POINTS
query("m05_classified", _WEIGHTS + _POINTS + " SELECT query_id, class, round(score, 4) AS score, round(margin, 4) AS margin FROM points")(
    lambda spark, sf_dir: M.classify(_bank(spark, sf_dir), _weights(spark, sf_dir), store=stored).select("query_id", "class", F.round("score", 4).alias("score"), F.round("margin", 4).alias("margin"))
)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    bank = _bank(spark, sf_dir)
    scored = M.classify(bank, stored(_weights(spark, sf_dir, 200), "weights")).withColumnRenamed("class", "predicted")
    return stored(scored.join(bank.select("query_id", "class", "fold", "board", "side"), "query_id").withColumn("right", F.coalesce(F.col("class") == F.col("predicted"), F.lit(False))), "points")


_CONFIDENCE = (
    _SCORED + """, rights AS (SELECT *, coalesce(truth = class, false) AS hit FROM points), cal AS (SELECT * FROM rights WHERE fold = 'kalibracja'), test AS (SELECT * FROM rights WHERE fold = 'test'), size AS (SELECT count(*) AS n FROM cal),
  ranked AS (SELECT t.query_id, t.truth, t.class, t.hit, (SELECT count(*) FROM cal c WHERE c.score <= t.score) / n AS score_rank, (SELECT count(*) FROM cal c WHERE c.margin <= t.margin) / n AS margin_rank FROM test t, size), confident AS (SELECT *, least(score_rank, margin_rank) AS confidence FROM ranked)"""
)
_TAUS = _SCORED + """, rights AS (SELECT *, coalesce(truth = class, false) AS hit, regexp_extract(url, 'example/([^/]+)', 1) AS board FROM points JOIN (SELECT doc_id, url FROM articles) ON doc_id = query_id), cal AS (SELECT * FROM rights WHERE @@),
  ps AS (SELECT 5 * k AS p FROM (SELECT unnest(range(2, 19)) AS k)), lists AS (SELECT list_sort(list(score)) AS s, list_sort(list(margin)) AS m, count(*) AS n FROM cal),
  grid AS (SELECT a.p::INT AS score_p, b.p::INT AS margin_p, s[round_even((a.p / 100)::DOUBLE * (n - 1), 0)::INT + 1] AS tau_score, m[round_even((b.p / 100)::DOUBLE * (n - 1), 0)::INT + 1] AS tau_margin FROM ps a, ps b, lists)"""


def _over(name: str, where: str) -> str:
    return f""", {name} AS (SELECT g.score_p, g.margin_p, g.tau_score, g.tau_margin, round(count(*) FILTER (score >= tau_score AND margin >= tau_margin) / count(*), 4) AS coverage,
  coalesce(round(count(*) FILTER (score >= tau_score AND margin >= tau_margin AND hit) / nullif(count(*) FILTER (score >= tau_score AND margin >= tau_margin), 0), 4), 0) AS precision, count(*) FILTER (score >= tau_score AND margin >= tau_margin) AS covered FROM grid g, (SELECT * FROM rights WHERE {where}) GROUP BY 1, 2, 3, 4)"""


query("m06_confidence", _CONFIDENCE + " SELECT query_id, score_rank, margin_rank, confidence FROM confident")(lambda spark, sf_dir: (lambda p: M.confidence(p.filter("fold = 'test'"), p.filter("fold = 'kalibracja'")).select("query_id", "score_rank", "margin_rank", "confidence"))(_points(spark, sf_dir)))
query("m07_precision", _CONFIDENCE + ", best AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, query_id) AS i, count(*) OVER () AS n FROM confident QUALIFY i <= greatest(1, round_even(0.3::DOUBLE * n, 0))) SELECT round(count(*) / any_value(n), 4) AS coverage, round(count(*) FILTER (hit) / count(*), 4) AS precision, count(*) AS covered, count(*) FILTER (hit) AS right FROM best")(lambda spark, sf_dir: (lambda p: M.precision_at_coverage(M.confidence(p.filter("fold = 'test'"), p.filter("fold = 'kalibracja'"))))(_points(spark, sf_dir)))
query("m08_quantiles", " SELECT event_type, value FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = round_even(0.95 * (n - 1), 0)")(
    lambda spark, sf_dir: M.nearest_rank_quantile(read(spark, sf_dir, "events"), "value", 0.95, ["event_type"])
)
_CAL = "fold = 'kalibracja'"
query("m09_grid", _TAUS.replace("@@", _CAL) + _over("cov", _CAL) + " SELECT * FROM cov")(lambda spark, sf_dir: (lambda p: M.threshold_grid(p, M.thresholds(p)))(_points(spark, sf_dir).filter("fold = 'kalibracja'")))
query("m10_envelope", _TAUS.replace("@@", _CAL) + _over("cov", _CAL) + ", b AS (SELECT *, max(precision) OVER (ORDER BY coverage DESC, precision DESC, score_p, margin_p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cov) SELECT * EXCLUDE (before) FROM b WHERE before IS NULL OR precision > before")(lambda spark, sf_dir: (lambda p: M.envelope(M.threshold_grid(p, M.thresholds(p))))(_points(spark, sf_dir).filter("fold = 'kalibracja'")))
_SWEEP = (
    _TAUS.replace("@@", "fold = 'kalibracja' AND board <> 'src9'") + _over("sc", "fold = 'kalibracja' AND board <> 'src9'") + _over("st", "fold = 'test'") + _over("so", "board = 'src9'") + _over("sl", "fold = 'uczenie' AND board = 'src1'")
    + """, sj AS (SELECT sc.*, st.coverage AS test_coverage, st.precision AS test_precision, coalesce(so.coverage, 0) AS ood, coalesce(sl.coverage, 0) AS golden FROM sc LEFT JOIN st USING (score_p, margin_p) LEFT JOIN so USING (score_p, margin_p) LEFT JOIN sl USING (score_p, margin_p)),
    sf AS (SELECT *, ood < 0.1 AS ood_ok, golden >= 0.15 AS golden_ok, precision >= 0.7 AS precision_ok, covered >= 20 AS enough FROM sj), su AS (SELECT *, CASE WHEN ood_ok AND golden_ok AND precision_ok AND enough THEN 2 WHEN precision_ok AND enough THEN 1 ELSE 0 END AS u FROM sf)
    SELECT * EXCLUDE (u), row_number() OVER (ORDER BY u DESC, CASE WHEN u > 0 THEN coverage ELSE precision END DESC, CASE WHEN u > 0 THEN precision ELSE coverage END DESC, score_p, margin_p) = 1 AS chosen, row_number() OVER (ORDER BY golden - ood DESC, score_p, margin_p) = 1 AS best_compromise FROM su"""
)
query("m11_gate_sweep", _SWEEP)(lambda spark, sf_dir: (lambda p: M.gate_sweep(*[p.filter(w) for w in ("fold = 'kalibracja' and board <> 'src9'", "fold = 'test'", "board = 'src9'", "fold = 'uczenie' and board = 'src1'")]))(_points(spark, sf_dir)))
query("m12_majority", _FOLDED + ", c AS (SELECT class, count(*) AS n FROM f WHERE fold = 'uczenie' GROUP BY 1) SELECT query_id, (SELECT class FROM c ORDER BY n DESC, class LIMIT 1) AS by_all FROM f WHERE fold = 'test'")(
    lambda spark, sf_dir: (lambda b: M.majority_baseline(b.filter("fold = 'uczenie'"), b.filter("fold = 'test'")).select("query_id", "by_all"))(_bank(spark, sf_dir))
)
_RANKS = ", ".join(f"round(s[round_even({q}::DOUBLE * (n - 1), 0)::INT + 1], 3) AS score_{name}, round(m[round_even({q}::DOUBLE * (n - 1), 0)::INT + 1], 3) AS margin_{name}" for q, name in ((0.1, "p10"), (0.5, "median"), (0.9, "p90")))
query("m14_shares", _SCORED + f", groups AS (SELECT regexp_extract(url, 'example/([^/]+)', 1) AS board, list_sort(list(score)) AS s, list_sort(list(margin)) AS m, count(*) AS n, count(*) FILTER (score >= 5 AND margin >= 5) AS k FROM points JOIN (SELECT doc_id, url FROM articles) ON doc_id = query_id GROUP BY 1) SELECT board, n, round(k / n, 4) AS share, {_RANKS} FROM groups")(lambda spark, sf_dir: M.threshold_share(_points(spark, sf_dir), 5.0, 5.0, ["board"]))
query("m15_accuracy")(lambda spark, sf_dir: M.accuracy_report(_with_baselines(spark, sf_dir)))


def _with_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the test fold with their confidence, the majority class and that of their nearest vectors; documents without a vector have none."""
    bank, points = _bank(spark, sf_dir), _points(spark, sf_dir)
    majority = M.majority_baseline(bank.filter("fold = 'uczenie'"), bank.filter("fold = 'test'")).select("query_id", F.col("by_all").alias("majority"))
    vectors = _folded(spark, sf_dir).drop("class").join(bank.select(F.col("query_id").alias("chunk_id"), "class"), "chunk_id")
    nearest = M.knn_baseline(vectors, 5).select(F.col("chunk_id").alias("query_id"), F.col("class").alias("knn"))
    rows = points.filter("fold = 'test'").join(majority, "query_id").join(nearest, "query_id", "left")
    return M.confidence(rows, points.filter("fold = 'kalibracja'"))


query("m16_top_lemmas", _WEIGHTS + " SELECT class, lemma, z FROM weights WHERE z > 0 QUALIFY row_number() OVER (PARTITION BY class ORDER BY z DESC, lemma) <= 40")(lambda spark, sf_dir: M.top_lemmas(_weights(spark, sf_dir)).drop("place"))
query("m17_sample")(lambda spark, sf_dir: M.stratified_sample(_bank(spark, sf_dir)).select("query_id", "class", "turn"))
query("m18_agreement", " SELECT 'quality' AS field, count(*) FILTER (quality = 1) AS yes, count(*) AS filled, 0 AS unfilled, round(count(*) FILTER (quality = 1) / count(*), 4) AS share, count(*) FILTER (quality = 1) / count(*) >= 0.3 AS ok FROM labels")(
    lambda spark, sf_dir: M.label_agreement(read(spark, sf_dir, "labels").select(F.lit("quality").alias("field"), F.when(F.col("quality") == 1, " T").otherwise("n").alias("answer")))
)
query("m02_inventory", " SELECT source AS key, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 4) AS share FROM documents GROUP BY 1")(
    lambda spark, sf_dir: M.inventory(views.articles(spark, sf_dir).select(F.element_at(F.split("url", "/"), 4).alias("board"), F.lit("forum").alias("zrodlo"), F.lit("kupujacy").alias("strona"), F.lit("2024-01-01").alias("data"), F.col("title").alias("pytanie"), "url"))["board"]
)
query("m02_lengths", rf""", q AS (SELECT length(title) AS c, len(list_distinct(list_filter(regexp_extract_all(lower(title), '{WORDS}'), lambda x: length(x) >= 4))) AS l FROM articles), v AS (SELECT 'chars' AS measure, list_sort(list(c)) AS x, count(*) AS n FROM q UNION ALL SELECT 'lemmas', list_sort(list(l)), count(*) FROM q)
  SELECT measure, x[round_even(0.05::DOUBLE * (n - 1), 0)::INT + 1] AS p05, x[round_even(0.5::DOUBLE * (n - 1), 0)::INT + 1] AS median, x[round_even(0.95::DOUBLE * (n - 1), 0)::INT + 1] AS p95 FROM v""")(
    lambda spark, sf_dir: M.inventory(views.articles(spark, sf_dir).select(F.lit("b").alias("board"), F.lit("forum").alias("zrodlo"), F.lit("kupujacy").alias("strona"), F.lit("2024-01-01").alias("data"), F.col("title").alias("pytanie"), "url"))["lengths"]
)
query("m01_classes", " SELECT CASE source WHEN 'src0' THEN 'a' WHEN 'src1' THEN 'b' END AS class, count(*) AS n FROM documents GROUP BY 1")(
    lambda spark, sf_dir: M.assign_class(read(spark, sf_dir, "documents").withColumnRenamed("source", "board"), spark.createDataFrame([("src0", "a", "kupujacy"), ("src1", "b", "sprzedajacy")], "board string, class string, side string")).groupBy("class").agg(F.count(F.lit(1)).alias("n"))
)

# --- streams, run to the end of what is there


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    spark.readStream.schema(schema).option("pathGlobFilter", "*events*.parquet").option("recursiveFileLookup", False).parquet(sf_dir).createOrReplaceTempView("events_stream")
    rows = spark.sql(views.LOG.replace("FROM events)", "FROM events_stream)"))
    return rows.withColumn("ts", rows.ts.cast("timestamp"))


def _finished(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    from .scratch import scratch

    at = f"{scratch(df.sparkSession)}/{name}"
    schema = df.schema
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    else:  # the whole result, replaced with every batch
        df.writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(f"{at}/out")


query("w02_daily", f", log AS ({views.LOG}) SELECT CAST(ts AS DATE) AS day, count(*) AS questions, count(*) FILTER (wynik = 'odmowa') AS refusals, round(sum(koszt_usd), 6)::DOUBLE AS cost_usd FROM log WHERE typ IS NULL GROUP BY 1")(
    lambda spark, sf_dir: _finished(W.stream_daily(_stream(spark, sf_dir)), "daily", "complete").withColumn("cost_usd", F.col("cost_usd").cast("double"))
)
query("w03_rate", f", log AS ({views.LOG}), b AS (SELECT user_id % 20 AS ip, time_bucket(INTERVAL 1 HOUR, ts) AS start FROM log) SELECT ip, start, start + INTERVAL 1 HOUR AS end, count(*) AS n FROM b GROUP BY 1, 2")(
    lambda spark, sf_dir: _finished(W.stream_rate(_stream(spark, sf_dir).withColumn("ip", F.col("user_id") % 20), "ip", "1 hour", "1 hour"), "rate", "complete").withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
)
query("w04_admit", f", log AS ({views.LOG})" + log_queries.ADMITTED + " SELECT user_id::VARCHAR AS key, seq, admitted FROM f WHERE n > 0")(lambda spark, sf_dir: _finished(W.stream_admit(_stream(spark, sf_dir), "user_id", 2, 40), "admit"))
query("w05_cooldown", f", log AS ({views.LOG})" + log_queries.COOLED + " SELECT email || '@x.example' AS address, seq, accepted FROM a")(
    lambda spark, sf_dir: _finished(W.stream_cooldown(log_queries.mails(_stream(spark, sf_dir)), 6 * 3600), "cooldown")
)
query("w05_tickets", f", log AS ({views.LOG})" + log_queries.TICKETS)(lambda spark, sf_dir: _finished(W.stream_tickets(log_queries.mails(_stream(spark, sf_dir))), "tickets").select("seq", "allowed"))
query("w06_signal")(lambda spark, sf_dir: _finished(W.stream_gate_signal(_stream(spark, sf_dir).filter("typ is null"), "user_id"), "signal"))
query("w08_dedup", " SELECT count(DISTINCT user_id * 1000 + epoch_us(ts) % 1000) AS n FROM events")(
    lambda spark, sf_dir: _finished(W.stream_dedup(_stream(spark, sf_dir).select("ts", (F.col("user_id") * 1000 + F.unix_micros("ts") % 1000).alias("h")), ["h"], "400 days"), "dedup").agg(F.count(F.lit(1)).alias("n"))
)
query("w07_rating_cases", f", log AS ({views.LOG}) SELECT r.id_zapytania, r.ocena, q.wynik, q.powod FROM log r JOIN log q ON r.typ = 'ocena' AND q.typ IS NULL AND q.id = r.id_zapytania AND q.ts <= r.ts AND q.ts >= r.ts - INTERVAL 7 DAY")(
    lambda spark, sf_dir: _finished(W.stream_rating_cases(_stream(spark, sf_dir)).filter("found").select("id_zapytania", "ocena", "wynik", "powod"), "cases")
)
query("s01_parsed_log", f", log AS ({views.LOG}) SELECT id, typ, czas, wynik, CASE WHEN seq % 5 > 0 THEN latencja_s END AS latencja_s, cache_hit, tokeny_we FROM log")(lambda spark, sf_dir: _parsed(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON lines and back; every fifth latency is no number, and blank and broken lines lie between."""
    rows = views.log(spark, sf_dir).drop("ts")
    line = F.to_json(F.struct(*[c for c in rows.columns if c not in ("latencja_s", "koszt_usd")], F.when(F.col("seq") % 5 > 0, F.col("latencja_s")).alias("latencja_s")))
    line = F.when((F.col("seq") % 5 == 0), F.regexp_replace(line, r"}$", ',"latencja_s":true}')).otherwise(line)
    lines = rows.select(F.explode(F.array(line, F.lit(""), F.lit("{broken"))).alias("value"))
    return io.parse_log(lines).select("id", "typ", "czas", "wynik", "latencja_s", "cache_hit", "tokeny_we")
