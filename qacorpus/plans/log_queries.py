"""Registered queries over the request log, each with the SQL that checks it."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feedback, limits, logs
from ..sources import io
from . import views

QUERIES: dict = {}
SQL: dict[str, str] = {}
NOW = datetime.datetime(2024, 1, 31, tzinfo=datetime.timezone.utc)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(views.log(spark, sf_dir))
        if sql:
            SQL[name] = f"WITH RECURSIVE log AS ({views.LOG}), q AS (SELECT * FROM log WHERE typ IS NULL) {sql}"
        return f

    return add


def sources(name: str, sql: str | None = None):
    """A query that reads tables itself."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query(
    "a04_overview",
    """SELECT count(*) FILTER (typ IS NULL) AS questions, count(*) FILTER (wynik = 'odpowiedz') AS answers, count(*) FILTER (wynik = 'odmowa') AS refusals, count(*) FILTER (wynik = 'rozmowa') AS chats,
       count(DISTINCT lower(trim(pytanie))) AS distinct_questions, count(*) FILTER (typ = 'wysylka') AS mails, count(*) FILTER (typ = 'wysylka' AND sukces) AS mails_sent,
       round(count(*) FILTER (wynik = 'odpowiedz') / count(*) FILTER (wynik IN ('odpowiedz', 'odmowa')), 4) AS accuracy, round(count(*) FILTER (typ IS NULL AND cache_hit) / count(*) FILTER (typ IS NULL), 4) AS cache_share FROM log""",
)(logs.overview)

query(
    "a05_latency",
    """SELECT round(quantile_cont(latencja_s, 0.5), 3) AS median, round(quantile_cont(latencja_s, 0.9), 3) AS p90, round(quantile_cont(latencja_s, 0.95), 3) AS p95, round(avg(latencja_s), 3) AS mean,
       round(quantile_cont(latencja_s, 0.5) FILTER (cache_hit), 3) AS median_cached, round(quantile_cont(latencja_s, 0.5) FILTER (NOT cache_hit), 3) AS median_uncached FROM q""",
)(logs.latency_stats)

query(
    "a06_histogram",
    """SELECT bin::INT AS bin, label, (SELECT count(*) FROM q WHERE CASE WHEN latencja_s < 2 THEN 0 WHEN latencja_s < 5 THEN 1 WHEN latencja_s < 10 THEN 2 WHEN latencja_s < 20 THEN 3 ELSE 4 END = bin AND latencja_s IS NOT NULL) AS n
       FROM (VALUES (0, '0 do 2 s'), (1, '2 do 5 s'), (2, '5 do 10 s'), (3, '10 do 20 s'), (4, 'ponad 20 s')) t(bin, label)""",
)(logs.latency_histogram)

for _by, _key, _where in (
    ("sections", "sekcja", "wynik = 'odpowiedz'"),
    ("sides", "CASE WHEN strona IN ('kupujacy', 'sprzedajacy') THEN strona ELSE 'nieznana' END", "true"),
    ("reasons", "coalesce(powod, 'brak_danych')", "wynik = 'odmowa'"),
    ("languages", "coalesce(lang, 'nieznany')", "true"),
):
    query(f"a07_{_by}", f"SELECT {_key} AS key, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM q WHERE {_where} GROUP BY 1")(lambda df, by=_by: logs.distribution(df, by))

query(
    "a08_daily",
    """, d AS (SELECT CAST(substr(czas, 1, 10) AS DATE) AS day, count(*) AS questions, count(*) FILTER (wynik = 'odmowa') AS refusals, round(quantile_cont(latencja_s, 0.5), 3) AS median_latency, round(sum(koszt_usd), 6) AS cost_usd FROM q GROUP BY 1),
       c AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
       SELECT day, coalesce(questions, 0) AS questions, coalesce(refusals, 0) AS refusals, coalesce(median_latency, 0.0) AS median_latency, coalesce(cost_usd, 0)::DOUBLE AS cost_usd, false AS truncated FROM c LEFT JOIN d USING (day)""",
)(lambda df: logs.daily_series(df).withColumn("cost_usd", F.col("cost_usd").cast("double")))

query("a09_top_questions", "SELECT arg_min(trim(pytanie), seq) AS question, count(*) AS n FROM q GROUP BY lower(trim(pytanie)) ORDER BY n DESC, min(seq) LIMIT 15")(logs.top_questions)

query(
    "a10_ratings",
    """SELECT *, up + down AS total, round(up / (up + down), 4) AS up_share, round((up + down) / (SELECT count(*) FROM q WHERE wynik = 'odpowiedz'), 4) AS coverage
       FROM (SELECT count(*) FILTER (ocena = 'gora') AS up, count(*) FILTER (ocena = 'dol') AS down FROM log)""",
)(logs.rating_stats)

query(
    "a11_costs",
    """, c AS (SELECT *, tokeny_we IS NOT NULL AND tokeny_wy IS NOT NULL AS counted FROM q WHERE NOT coalesce(cache_hit, false)), s AS (SELECT count(*) AS n, count(*) FILTER (counted) AS m, sum(tokeny_we)::BIGINT AS i, sum(tokeny_wy)::BIGINT AS o,
       sum(koszt_usd)::DOUBLE AS k, count(*) FILTER (counted AND tokeny_szacowane) AS e FROM c)
       SELECT i AS tokens_in, o AS tokens_out, round(k, 6) AS cost_usd, round(k / m, 6) AS cost_per_request, round(m / n, 4) AS coverage, e AS estimated, round(e / m, 4) AS estimated_share FROM s""",
)(lambda df: logs.cost_stats(df.withColumn("koszt_usd", F.col("koszt_usd").cast("double"))))

query(
    "a12_range",
    """SELECT min(czas) AS first, max(czas) AS last, (max(CAST(substr(czas, 1, 10) AS DATE)) FILTER (typ IS NULL) - min(CAST(substr(czas, 1, 10) AS DATE)) FILTER (typ IS NULL) + 1)::INT AS days, false AS truncated FROM log""",
)(logs.log_range)

query(
    "a03_filtered",
    """SELECT typ, count(*) AS n FROM log WHERE lang = 'pl' AND (typ = 'wysylka' OR strona = 'kupujacy') AND CAST(substr(czas, 1, 19) AS TIMESTAMP) >= TIMESTAMP '2024-01-24' GROUP BY 1""",
)(lambda df: logs.filter_log(df, 7, "pl", "kupujacy", NOW).groupBy("typ").agg(F.count(F.lit(1)).alias("n")))

CASES = """, cases AS (
  SELECT r.seq, r.czas, r.ocena, r.id_zapytania, p.seq IS NOT NULL AS found, p.wynik, p.powod, p.sekcja, p.lang, p.strona, p.pytanie,
    CASE WHEN p.seq IS NULL THEN 'brak_sladu' WHEN r.ocena = 'gora' THEN 'ok' WHEN p.wynik = 'rozmowa' THEN 'rozmowa' WHEN p.wynik = 'odpowiedz' THEN 'tresc' WHEN p.powod LIKE 'guard_%' THEN 'guard'
      WHEN p.powod = 'prog_rerank' THEN 'retrieval' WHEN p.powod = 'sedzia' THEN 'sedzia' WHEN p.powod = 'pokrycie' THEN 'pokrycie' WHEN p.powod = 'model_nie_wie' THEN 'generacja' ELSE 'inna' END AS diagnosis
  FROM log r LEFT JOIN q p ON p.id = r.id_zapytania WHERE r.typ = 'ocena')"""
query("a15_rating_cases", CASES.replace("LIKE 'guard_%'", "LIKE 'guard@_%' ESCAPE '@'") + " SELECT * FROM cases")(feedback.rating_cases)


def _golden(df: DataFrame) -> DataFrame:
    """An expected source for every fourth question."""
    key = F.lower(F.trim("pytanie"))
    rows = logs.questions(df).filter("k % 4 = 0").select(key.alias("query"), F.concat(F.lit("https://help.example/g-"), F.lower(F.trim("pytanie"))).alias("url"))
    return rows.distinct()


def _cases(df: DataFrame) -> DataFrame:
    served = F.when(F.col("found") & (F.col("wynik") == "odpowiedz"), F.concat(F.lit("https://help.example/"), F.coalesce("sekcja", F.lit("x"))))
    return feedback.rating_cases(df).select("seq", F.col("id_zapytania").alias("request_id"), F.col("pytanie").alias("query"), "ocena", "diagnosis", served.alias("served_url"))


_REGRESSION = (
    CASES.replace("LIKE 'guard_%'", "LIKE 'guard@_%' ESCAPE '@'")
    + """, golden AS (SELECT DISTINCT lower(trim(pytanie)) AS query, 'https://help.example/g-' || lower(trim(pytanie)) AS url FROM q WHERE k % 4 = 0),
    c AS (SELECT seq, id_zapytania AS request_id, pytanie AS query, ocena, diagnosis, CASE WHEN found AND wynik = 'odpowiedz' THEN 'https://help.example/' || coalesce(sekcja, 'x') END AS served_url FROM cases WHERE trim(pytanie) <> ''),
    r AS (SELECT c.*, g.url AS golden_url, coalesce(g.url, CASE WHEN ocena = 'gora' THEN served_url END) AS source_url,
      CASE WHEN g.url IS NOT NULL THEN 'golden' WHEN ocena = 'gora' AND served_url IS NOT NULL THEN 'serwowane' END AS origin FROM c LEFT JOIN golden g ON g.query = lower(trim(c.query)))"""
)
query("a16_regression_candidates", _REGRESSION + " SELECT *, source_url IS NULL AS needs_work FROM r")(lambda df: feedback.regression_candidates(_cases(df), _golden(df)))
query("a18_golden_mismatches", _REGRESSION + " SELECT *, source_url IS NULL AS needs_work FROM r WHERE ocena = 'gora' AND golden_url <> served_url")(lambda df: feedback.golden_mismatches(_cases(df), _golden(df)))


@query(
    "a17_merge_regression",
    CASES.replace("LIKE 'guard_%'", "LIKE 'guard@_%' ESCAPE '@'")
    + """, c AS (SELECT seq, id_zapytania AS request_id, pytanie AS query, ocena, diagnosis, coalesce('id:' || nullif(id_zapytania, ''), 'q:' || lower(trim(pytanie))) AS key FROM cases WHERE pytanie IS NOT NULL),
    n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS a, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS z FROM c),
    old AS (SELECT * FROM n WHERE a = 1 AND seq % 2 = 0), f AS (SELECT * FROM n WHERE a = 1), l AS (SELECT * FROM n WHERE z = 1)
    SELECT f.seq, f.request_id, f.query, l.diagnosis, l.ocena, CASE WHEN old.seq IS NULL THEN 'added' ELSE 'updated' END AS change FROM f JOIN l USING (key) LEFT JOIN old USING (key)""",
)
def _merge(df: DataFrame) -> DataFrame:
    cases = _cases(df).filter("query is not null").drop("served_url")
    first = cases.withColumn("key", feedback.merge_key(F.col("request_id"), F.col("query"))).groupBy("key").agg(F.min_by(F.struct(*cases.columns), "seq").alias("r")).select("r.*").filter("seq % 2 = 0")
    return feedback.merge_regression(first, cases)


@query(
    "a19_request_cost",
    """, c AS (SELECT user_id AS request_id, CASE WHEN k % 6 > 0 THEN tokeny_we ELSE CASE WHEN coalesce(pytanie, '') = '' THEN 0 ELSE greatest(1, round_even(length(pytanie) / 3.6, 0)) END END AS i,
       CASE WHEN k % 6 > 0 THEN tokeny_wy ELSE greatest(1, round_even(length(czas) / 3.6, 0)) END AS o, CASE k % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 0.0 END AS pi, CASE k % 3 WHEN 0 THEN 6.0 WHEN 1 THEN 3.0 ELSE 0.0 END AS po, k % 6 = 0 AS g FROM q)
       SELECT request_id, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(i / 1e6 * pi + o / 1e6 * po), 6) AS cost_usd, count(*) AS calls, bool_or(g) AS estimated FROM c GROUP BY 1""",
)
def _costs(df: DataFrame) -> DataFrame:
    calls = logs.questions(df).select(F.col("user_id").alias("request_id"), F.concat(F.lit("m"), F.col("k") % 3).alias("model"), F.col("tokeny_we").alias("tokens_in"), F.col("tokeny_wy").alias("tokens_out"), F.array("pytanie").alias("messages"), F.col("czas").alias("text"))
    prices = df.sparkSession.createDataFrame([("m0", 2.0, 6.0), ("m1", 1.0, 3.0)], "model string, usd_in double, usd_out double")
    return logs.request_cost(calls, prices)


@query(
    "a20_gate_signal",
    """, r AS (SELECT seq, user_id % 10 AS shard, skipped FROM q WHERE NOT coalesce(cache_hit, false)),
       w AS (SELECT *, count(*) OVER v AS n, avg(skipped::INT) OVER v AS share FROM r WINDOW v AS (PARTITION BY shard ORDER BY seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
       a AS (SELECT seq, shard, round(share, 6) AS share, n = 50 AND share > 0.2 AS active FROM w)
       SELECT *, active AND NOT coalesce(lag(active) OVER (PARTITION BY shard ORDER BY seq), false) AS alert FROM a""",
)
def _signal(df: DataFrame) -> DataFrame:
    gates = F.when(F.col("skipped"), F.array(F.lit("sedzia"))).otherwise(F.array().cast("array<string>"))
    return logs.skipped_gate_signal(df.withColumns({"shard": F.col("user_id") % 10, "bramki_pominiete": gates}), ["shard"]).select("seq", "shard", F.round("share", 6).alias("share"), "active", "alert")


ADMITTED = """, o AS (SELECT seq, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS n FROM log),
       f(user_id, n, seq, times, admitted) AS (
         SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, []::BIGINT[], NULL::BOOLEAN FROM o
         UNION ALL SELECT user_id, n, seq, CASE WHEN good THEN list_append(held, us) ELSE held END, good FROM (
           SELECT *, len(held) < 40 AND len(list_filter(held, lambda x: x > us - 60000000)) < 2 AS good FROM (
             SELECT o.user_id, o.n, o.seq, o.us, list_filter(f.times, lambda x: x >= o.us - 86400000000) AS held FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1)))"""
query("a21_admit", ADMITTED + " SELECT seq, user_id, admitted FROM f WHERE n > 0")(lambda df: limits.admit_requests(df, "user_id", 2, 40).select("seq", "user_id", "admitted"))
query(
    "a22_rate_counts",
    """, c AS (SELECT seq, user_id % 20 AS ip, epoch_us(ts) AS us FROM log), w AS (SELECT seq, ip, count(*) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_minute,
       count(*) OVER (PARTITION BY ip ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS in_day FROM c) SELECT *, in_minute > 1 AS over_minute, in_day > 20 AS over_day FROM w""",
)(lambda df: limits.rate_counts(df.select("seq", (F.col("user_id") % 20).alias("ip"), "ts"), "ip", 1, 20).select("seq", "ip", "in_minute", "in_day", "over_minute", "over_day"))


query(
    "a13_report",
    """, c AS (
         SELECT 'overview' AS part, unnest(list_filter(['questions', CASE wynik WHEN 'odpowiedz' THEN 'answers' WHEN 'odmowa' THEN 'refusals' WHEN 'rozmowa' THEN 'chats' END, CASE WHEN cache_hit THEN 'cached' END], lambda x: x IS NOT NULL)) AS key FROM q
         UNION ALL SELECT 'overview', unnest(CASE WHEN sukces THEN ['mails', 'mails_sent'] ELSE ['mails'] END) FROM log WHERE typ = 'wysylka'
         UNION ALL SELECT 'latency', unnest(['all', CASE WHEN coalesce(cache_hit, false) THEN 'cached' ELSE 'uncached' END]) FROM q
         UNION ALL SELECT 'histogram', (CASE WHEN latencja_s < 2 THEN 0 WHEN latencja_s < 5 THEN 1 WHEN latencja_s < 10 THEN 2 WHEN latencja_s < 20 THEN 3 ELSE 4 END)::VARCHAR FROM q WHERE latencja_s IS NOT NULL
         UNION ALL SELECT 'sections', sekcja FROM q WHERE wynik = 'odpowiedz' UNION ALL SELECT 'sides', CASE WHEN strona IN ('kupujacy', 'sprzedajacy') THEN strona ELSE 'nieznana' END FROM q
         UNION ALL SELECT 'reasons', coalesce(powod, 'brak_danych') FROM q WHERE wynik = 'odmowa' UNION ALL SELECT 'languages', coalesce(lang, 'nieznany') FROM q
         UNION ALL SELECT 'daily', czas[:10] FROM q UNION ALL SELECT 'top', lower(trim(pytanie)) FROM q WHERE trim(pytanie) <> '' UNION ALL SELECT 'ratings', CASE ocena WHEN 'gora' THEN 'up' ELSE 'down' END FROM log WHERE typ = 'ocena'
         UNION ALL SELECT 'costs', unnest(CASE WHEN tokeny_we IS NULL OR tokeny_wy IS NULL THEN ['requests'] WHEN tokeny_szacowane THEN ['requests', 'counted', 'estimated'] ELSE ['requests', 'counted'] END) FROM q WHERE NOT coalesce(cache_hit, false)
         UNION ALL SELECT 'range', 'events' FROM log UNION ALL SELECT 'range', 'days' FROM q)
       SELECT part, key, count(*) AS n FROM c GROUP BY 1, 2""",
)(lambda df: logs.report_cells(df).select("part", "key", "n"))


def mails(df: DataFrame) -> DataFrame:
    kind = F.when(F.col("k") % 5 == 0, "failed").when(F.col("k") % 7 == 0, "partial").when(F.col("k") % 11 == 0, "limit").otherwise("ok")
    rows = df.filter("typ = 'wysylka'")
    return rows.select("seq", "ts", F.concat(F.lit("User"), F.col("user_id") % 30, F.lit("@x.example")).alias("email"), kind.alias("outcome"), (F.col("k") % 3 == 0).alias("correction"), F.concat(F.lit("T"), F.col("user_id") % 30).alias("ticket"))


MAILS = """, m AS (SELECT seq, epoch_us(ts) AS us, 'user' || (user_id % 30) AS email, CASE WHEN k % 5 = 0 THEN 'failed' WHEN k % 7 = 0 THEN 'partial' WHEN k % 11 = 0 THEN 'limit' ELSE 'ok' END AS outcome, k % 3 = 0 AS correction, row_number() OVER (PARTITION BY user_id % 30 ORDER BY ts, seq) AS n FROM log WHERE typ = 'wysylka')"""
COOLED = MAILS + """, f(email, n, seq, until, blocked, outcome) AS (
         SELECT DISTINCT email, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, false, '' FROM m
         UNION ALL SELECT email, n, seq, CASE WHEN blocked THEN until WHEN outcome IN ('failed', 'limit') THEN CASE WHEN correction THEN until END ELSE us + 21600000000 END, blocked, outcome FROM (
           SELECT m.*, f.until, NOT m.correction AND f.until IS NOT NULL AND m.us <= f.until AS blocked FROM f JOIN m ON m.email = f.email AND m.n = f.n + 1)),
       a AS (SELECT email, seq, NOT blocked AND outcome <> 'limit' AS accepted FROM f WHERE n > 0)"""
query(
    "a23_cooldown",
    COOLED + " SELECT seq, accepted FROM a",
)(lambda df: limits.address_cooldown(mails(df), 6 * 3600).select("seq", "accepted"))
TICKETS = MAILS + """, f(email, n, seq, is_open, allowed) AS (
         SELECT DISTINCT email, 0::BIGINT, NULL::BIGINT, false, NULL::BOOLEAN FROM m
         UNION ALL SELECT m.email, m.n, m.seq, CASE WHEN NOT m.correction THEN f.is_open OR m.outcome IN ('ok', 'partial') ELSE f.is_open AND m.outcome <> 'ok' END, CASE WHEN m.correction THEN f.is_open END
         FROM f JOIN m ON m.email = f.email AND m.n = f.n + 1)
       SELECT seq, allowed FROM f WHERE n > 0"""
query("a24_tickets", TICKETS)(lambda df: limits.correction_tickets(mails(df)).select("seq", "allowed"))
query(
    "a25_repeat_requests",
    """, r AS (SELECT seq, ts, lang, strona, lower(trim(pytanie)) AS question_key, k % 5 > 0 AS standalone, wynik, powod FROM q),
       s AS (SELECT seq, standalone AND coalesce(max((standalone AND (wynik = 'odpowiedz' OR (wynik = 'odmowa' AND coalesce(powod = 'prog_rerank', false))))::INT) OVER (PARTITION BY lang, question_key, strona ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM r)
       SELECT seq, hit FROM s""",
)(
    lambda df: logs.repeat_requests(
        logs.questions(df).select("seq", "ts", "lang", F.col("strona").alias("side"), F.lit(0).alias("stamp"), F.lower(F.trim("pytanie")).alias("question_key"), (F.col("k") % 5 > 0).alias("standalone"), "wynik", F.coalesce("powod", F.lit("")).alias("powod"))
    ).select("seq", "hit")
)
query(
    "a27_validation",
    """SELECT coalesce(CASE WHEN ocena NOT IN ('gora') THEN 'ocena' END, CASE WHEN length(pytanie) NOT BETWEEN 1 AND 12 THEN 'pytanie' END, CASE WHEN lang NOT IN ('pl') THEN 'lang' END) AS rejected, count(*) AS n
       FROM (SELECT CASE WHEN ocena = 'dol' THEN 'x' ELSE ocena END AS ocena, CASE WHEN length(pytanie) > 12 THEN pytanie ELSE pytanie END AS pytanie, CASE WHEN lang = 'en' THEN 'de' ELSE lang END AS lang FROM log) GROUP BY 1""",
)(
    lambda df: logs.validate_events(
        df.select(F.when(F.col("ocena") == "dol", "x").otherwise(F.col("ocena")).alias("ocena"), F.when(F.length("pytanie") > 12, F.repeat("pytanie", F.lit(100))).otherwise(F.col("pytanie")).alias("pytanie"), F.when(F.col("lang") == "en", "de").otherwise(F.col("lang")).alias("lang"))
    ).groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))
)
query("a28_client_ip", "SELECT seq, CASE WHEN k % 3 > 0 THEN '10.0.0.' || (user_id % 250) ELSE 'peer' END AS ip FROM log")(
    lambda df: df.select("seq", logs.client_ip(F.when(F.col("k") % 3 > 0, F.concat(F.lit("1.1.1.1, 10.0.0."), F.col("user_id") % 250, F.lit(" "))), F.lit("peer")).alias("ip"))
)
query("a26_log_events", "SELECT seq, czas, id, lang, strona, wynik, round(latencja_s, 3) AS latencja_s, coalesce(tokeny_we, 0) AS tokeny_we, trim(pytanie) AS pytanie FROM q")(
    lambda df: logs.build_log_events(
        logs.questions(df).withColumns({"mode": F.when(F.col("wynik") == "rozmowa", "rozmowa"), "section": F.when(F.col("wynik") == "odpowiedz", F.coalesce("sekcja", F.lit("x"))), "has_data": F.lit(True), "refusal_reason": F.col("powod"), "koszt_usd": F.col("koszt_usd").cast("double")})
    ).select("seq", "czas", "id", "lang", "strona", "wynik", "latencja_s", "tokeny_we", F.trim("pytanie").alias("pytanie"))
)
query("a26_rating_rows", "SELECT czas, ocena, id_zapytania, lang, strona, trim(pytanie) AS pytanie, NULL::VARCHAR AS wynik FROM log WHERE typ = 'ocena'")(
    lambda df: logs.build_log_events(
        logs.questions(df).withColumns({"mode": F.lit(None).cast("string"), "section": F.col("sekcja"), "has_data": F.lit(True), "refusal_reason": F.col("powod")}),
        df.filter("typ = 'ocena'").withColumn("odpowiedz", F.lit(None).cast("string")),
    ).filter("typ = 'ocena'").select("czas", "ocena", "id_zapytania", "lang", "strona", F.trim("pytanie").alias("pytanie"), "wynik")
)
query(
    "s06_export",
    """SELECT replace(substr(czas, 1, 19), 'T', ' ') AS czas, coalesce(lang, '') AS lang, CASE WHEN strona IN ('kupujacy', 'sprzedajacy') THEN strona ELSE 'nieznana' END AS strona, coalesce(wynik, '') AS wynik, cache_hit::VARCHAR AS cache_hit, pytanie FROM q""",
)(lambda df: io.csv_cells(io.export_rows(df, ["pytanie", "cache_hit", "wynik", "strona", "lang", "czas", "other"])))


@sources("a01_times", f"WITH RECURSIVE log AS ({views.LOG}) SELECT seq, CAST(substr(czas, 1, 19) AS TIMESTAMP) AS t, CAST(substr(czas, 1, 10) AS DATE) AS d FROM log WHERE seq % 3 > 0 UNION ALL SELECT seq, NULL, NULL FROM log WHERE seq % 3 = 0")
def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    czas = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("broken-"), "czas")).otherwise(F.col("czas"))
    return views.log(spark, sf_dir).select("seq", logs.event_time(czas).cast("timestamp_ntz").alias("t"), logs.event_day(czas).alias("d"))
