"""Ratings joined to their questions, what went wrong, and the regression set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import normalize_lexical, strip
from .logs import event_time, questions


def diagnose(rating: Column, found: Column, outcome: Column, reason: Column) -> Column:
    """Where a rating's question went wrong; found: whether the log has the question."""
    named = F.coalesce(*[F.when(reason == k, v) for k, v in lists.DIAGNOSES.items()], F.lit("inna"))
    return (
        F.when(~found, "brak_sladu").when(rating == "gora", "ok").when(outcome == "rozmowa", "rozmowa").when(outcome == "odpowiedz", "tresc").when(F.coalesce(reason, F.lit("")).startswith("guard_"), "guard").otherwise(named)
    )


def rating_cases(df: DataFrame, days: int | None = None, now=None) -> DataFrame:
    """Each rating with the outcome of the question it names, whatever that one's age; the last of equal ids counts.

    Ratings without an id don't go through the join, where they would be one hot key.
    """
    rated = df.filter("typ = 'ocena'")
    if days:
        rated = rated.filter(event_time(F.col("czas")) >= F.lit(now) - F.make_interval(days=F.lit(days)))
    rated = rated.select("seq", "czas", "ocena", "id_zapytania")
    fields = ["wynik", "powod", "sekcja", "lang", "strona", "pytanie"]
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    asked = questions(df).filter("id is not null").withColumn("place", F.row_number().over(last)).filter("place = 1")
    asked = asked.select(F.col("id").alias("id_zapytania"), F.lit(True).alias("found"), *fields)
    named = rated.filter("id_zapytania is not null").join(asked, "id_zapytania", "left")
    nameless = rated.filter("id_zapytania is null")
    cases = named.unionByName(nameless, allowMissingColumns=True).withColumn("found", F.coalesce("found", F.lit(False)))
    return cases.withColumn("diagnosis", diagnose(F.col("ocena"), F.col("found"), F.col("wynik"), F.col("powod")))


def golden_key(text: Column) -> Column:
    return strip(normalize_lexical(text))


def regression_candidates(cases: DataFrame, golden: DataFrame) -> DataFrame:
    """Cases (query, ocena, served_url, ...) with an expected source: the golden one (query, url), else what was served
    to a question that was rated up; needs_work where there is none or the query was redacted."""
    known = golden.select(golden_key(F.col("query")).alias("key"), F.col("url").alias("golden_url")).groupBy("key").agg(F.min("golden_url").alias("golden_url"))
    rows = cases.filter(strip(F.coalesce("query", F.lit(""))) != "").withColumn("key", golden_key(F.col("query"))).join(known, "key", "left").drop("key")
    served = F.when(F.col("ocena") == "gora", F.col("served_url"))
    url = F.coalesce("golden_url", served)
    origin = F.when(F.col("golden_url").isNotNull(), "golden").when(served.isNotNull(), "serwowane")
    return rows.withColumns({"source_url": url, "origin": origin, "needs_work": url.isNull() | F.contains("query", F.lit("[ukryte]"))})


def merge_key(request_id: Column, query: Column) -> Column:
    return F.coalesce(F.concat(F.lit("id:"), F.nullif(request_id, F.lit(""))), F.concat(F.lit("q:"), F.lower(strip(query))))


def merge_regression(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """The regression set with candidates (both: request_id, query, diagnosis, ocena, seq, ...).

    Known keys take the diagnosis and rating of their last candidate, new ones come in as their first candidate with
    those of the last. change: kept, updated or added.
    """
    rows = candidates.withColumn("key", merge_key(F.col("request_id"), F.col("query")))
    rest = [c for c in candidates.columns if c not in ("diagnosis", "ocena")]
    batch = rows.groupBy("key").agg(F.min_by(F.struct(*rest), "seq").alias("first"), F.max_by(F.struct("diagnosis", "ocena"), "seq").alias("last"))
    old = existing.withColumn("key", merge_key(F.col("request_id"), F.col("query"))).select("key", F.struct(*rest).alias("was"), F.struct("diagnosis", "ocena").alias("had"))
    both = old.join(batch, "key", "full")
    pick = F.coalesce("was", "first").alias("row")
    now = F.coalesce("last", "had").alias("now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("first").isNotNull(), "updated").otherwise("kept")
    return both.select(pick, now, change.alias("change")).select("row.*", "now.*", "change")


def golden_mismatches(cases: DataFrame, golden: DataFrame) -> DataFrame:
    found = regression_candidates(cases, golden)
    return found.filter((F.col("ocena") == "gora") & (F.col("golden_url") != F.col("served_url")))
