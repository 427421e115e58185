"""Gates between retrieval and answer, and the outcome of a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from ..functions.text import normalize_lexical
from .lexstats import lemma_sets
from .questions import _array, _by_lang, strip_py


def answer_coverage(answers: DataFrame, contexts: DataFrame, idf: DataFrame, idf_max: float | Column | None, lang: str | None = None, table: DataFrame | None = None) -> DataFrame:
    """query_id and coverage: the share of the answer's lemma weight whose lemmas occur in the question's contexts.

    answers (query_id, answer), contexts (query_id, text), idf (lemma, idf); a lemma without idf weighs idf_max; an
    answer without lemmas has 0. table (lang, form, lemma) gives lemmas by a column of languages that both have.
    """
    mine = lemma_sets(answers, ["query_id"], "answer", lang, table)
    there = lemma_sets(contexts, ["query_id"], "text", lang, table).distinct().withColumn("there", F.lit(True))
    weighted = mine.join(idf.select("lemma", "idf"), "lemma", "left").withColumn("idf", F.coalesce("idf", idf_max if isinstance(idf_max, Column) else F.lit(idf_max))).join(there, ["query_id", "lemma"], "left")
    sums = weighted.groupBy("query_id").agg(F.sum(F.when(F.col("there"), F.col("idf")).otherwise(0.0)).alias("a"), F.sum("idf").alias("b"))
    share = F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0)
    return answers.select("query_id").join(sums.select("query_id", share.alias("coverage")), "query_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def model_does_not_know(text: Column, lang: Column) -> Column:
    low = F.lower(text)
    return _by_lang(lang, lambda x: F.exists(_array(lists.DONT_KNOW[x]), lambda p: F.contains(low, p)))


def explicit_refusal(text: Column, lang: Column, window: int = 160) -> Column:
    """Whether a refusal stands in the first characters, without accents and with plain apostrophes."""
    start = normalize_lexical(F.translate(F.substring(text, 1, window), "’", "'"))
    return _by_lang(lang, lambda x: reduce(lambda a, p: a | F.contains(start, F.lit(strip_py(p))), lists.EXPLICIT_REFUSALS[x], F.lit(False)))


def gate_reason(df: DataFrame, rerank: dict[str, float] | None = None, covered: dict[str, float] | None = None) -> DataFrame:
    """Adds reason, the first gate that a stage fails, and skipped, the gates that couldn't be judged.

    Columns: lang, n_hits, top_score, judge_ok (null: passed and noted), answer, coverage (null: passed and noted),
    n_citations. rerank, covered: the least top score and coverage of "pl" and "en", whose values are used for all other
    languages and for English.
    """
    rerank, covered = rerank or lists.RERANK_THRESHOLD, covered or lists.COVERAGE_THRESHOLD
    lang = F.col("lang")
    by = lambda table: F.when(lang == "en", table["en"]).otherwise(table["pl"])
    reason = (
        F.when((F.coalesce("n_hits", F.lit(0)) == 0) | F.coalesce(F.col("top_score") < by(rerank), F.lit(True)), "prog_rerank")
        .when(~F.coalesce("judge_ok", F.lit(True)), "sedzia")
        .when(F.coalesce("answer", F.lit("")) == "", "brak_generacji")
        .when(F.coalesce(F.col("coverage") < by(covered), F.lit(False)), "pokrycie")
        .when((F.coalesce("n_citations", F.lit(0)) == 0) & model_does_not_know(F.col("answer"), lang), "model_nie_wie")
        .when(explicit_refusal(F.col("answer"), lang), "jawna_odmowa")
    )
    reached = F.coalesce("n_hits", F.lit(0)) > 0
    skipped = F.array_compact(F.array(F.when(reached & F.col("judge_ok").isNull(), "sedzia"), F.when(reached & (F.coalesce("answer", F.lit("")) != "") & F.col("coverage").isNull(), "pokrycie")))
    return df.withColumns({"reason": reason, "skipped": skipped})


def outcome_features(hits: DataFrame, stages: DataFrame) -> DataFrame:
    """query_id and cechy: best score, hits, best address, judgement, coverage, stage; of hits (query_id, url, score, pos)
    and stages (query_id, judge_ok, coverage, stage). A question without hits has 0 of them."""
    best = hits.groupBy("query_id").agg(F.round(F.max_by("score", -F.col("pos")), 4).alias("rerank_top1"), F.count(F.lit(1)).cast("int").alias("chunkow"), F.max_by("url", -F.col("pos")).alias("zrodlo_top1"))
    rows = stages.join(best, "query_id", "left")
    return rows.select(
        "query_id",
        F.struct("rerank_top1", F.coalesce("chunkow", F.lit(0)).alias("chunkow"), "zrodlo_top1", F.col("judge_ok").alias("sedzia_ok"), F.round("coverage", 4).alias("pokrycie"), F.col("stage").alias("etap")).alias("cechy"),
    )
