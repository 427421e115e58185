"""How the library's tables are read out of the test tables. Texts of SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Request-log events out of `events`: views and clicks are answered questions or chats, errors refusals, sign-ups
#: ratings of an earlier question, purchases mails.
LOG = """
SELECT event_id AS seq, ts, user_id,
  CASE event_type WHEN 'signup' THEN 'ocena' WHEN 'purchase' THEN 'wysylka' END AS typ,
  concat(replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T'), '+00:00') AS czas,
  CAST(event_id AS STRING) AS id,
  CASE user_id % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'pl' END AS lang,
  CASE user_id % 4 WHEN 0 THEN 'kupujacy' WHEN 1 THEN 'sprzedajacy' WHEN 2 THEN 'inna' END AS strona,
  CASE WHEN event_type IN ('view', 'click') AND k % 10 > 0 THEN CASE k % 4 WHEN 0 THEN 'konto' WHEN 1 THEN 'zakupy' WHEN 2 THEN 'platnosci' ELSE 'sprzedaz' END END AS sekcja,
  CASE event_type WHEN 'error' THEN 'odmowa' WHEN 'view' THEN CASE WHEN k % 10 > 0 THEN 'odpowiedz' ELSE 'rozmowa' END WHEN 'click' THEN CASE WHEN k % 10 > 0 THEN 'odpowiedz' ELSE 'rozmowa' END END AS wynik,
  CASE WHEN event_type = 'error' THEN CASE k % 7 WHEN 0 THEN 'prog_rerank' WHEN 1 THEN 'sedzia' WHEN 2 THEN 'pokrycie' WHEN 3 THEN 'model_nie_wie' WHEN 4 THEN 'guard_injekcja' WHEN 5 THEN 'inny_powod' END END AS powod,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN value END AS latencja_s,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN k % 5 = 0 END AS cache_hit,
  CASE WHEN event_type IN ('view', 'click', 'error') THEN concat(CASE WHEN k % 2 = 0 THEN '  Question ' ELSE 'question ' END, CAST(user_id % 40 AS STRING), ' ') END AS pytanie,
  CASE WHEN event_type IN ('view', 'click', 'error') AND k % 6 > 0 THEN 100 + k END AS tokeny_we,
  CASE WHEN event_type IN ('view', 'click', 'error') AND k % 6 > 0 THEN 2 * k END AS tokeny_wy,
  CASE WHEN event_type IN ('view', 'click', 'error') AND k % 6 > 0 THEN k * 0.25 END AS koszt_usd,
  k % 9 = 0 AS tokeny_szacowane,
  CASE WHEN event_type = 'signup' THEN CASE WHEN k % 3 = 0 THEN 'dol' ELSE 'gora' END END AS ocena,
  CASE WHEN event_type = 'signup' AND k % 8 > 0 THEN CAST(event_id - 1 - k % 5 AS STRING) END AS id_zapytania,
  CASE WHEN event_type = 'purchase' THEN k % 4 > 0 END AS sukces,
  k % 4 = 0 AS skipped, k
FROM (SELECT event_id, ts, user_id, event_type, CAST(value AS DOUBLE) AS value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events) e
"""

#: Articles out of `documents`: the first line is the title, the source the section.
ARTICLES = """
SELECT doc_id, concat('https://help.example/', source, '/', lang, '/a-', CAST(doc_id AS STRING)) AS url, split_part(coalesce(text, ''), chr(10), 1) AS title,
  CASE WHEN source IN ('src0', 'src1') THEN 'sprzedaz' WHEN source IN ('src2', 'src3', 'src4', 'src5') THEN 'konto' WHEN source IN ('src6', 'src7', 'src8') THEN 'platnosci' ELSE 'zakupy' END AS section,
  lang, coalesce(text, '') AS body
FROM documents
"""

#: Questions out of `conversations`: turns of users.
QUESTIONS = "SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user'"


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "events")
    rows = spark.sql(LOG)
    return rows.withColumn("ts", rows.ts.cast("timestamp"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "documents")
    return spark.sql(ARTICLES)


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "conversations")
    return spark.sql(QUESTIONS)
