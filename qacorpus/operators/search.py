"""From questions to outcomes: conversation, screening, correction, search on one side, gates, then on the other side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lists
from . import gates, questions
from .bm25 import Bm25Index, Store
from .retrieval import fused_top, overlap_scorer, search_reranked

CHAT = ["powitanie", "powitanie_ponowne", "podziekowanie", "meta"]


@dataclass(frozen=True)
class Corpus:
    """What a search reads, stored once: chunks (chunk_id, side, url, title, section, text), their index and vectors
    (chunk_id, side, vector), idf (lemma, idf) with idf_max (idf None: coverage can't be judged), and for corrections a
    dictionary (word, cnt) and frequencies (word, zipf). lemmas (lang, form, lemma) is used for words and coverage alike."""

    chunks: DataFrame
    index: Bm25Index
    vectors: DataFrame
    idf: DataFrame | None = None
    idf_max: float | Column | None = None
    dictionary: DataFrame | None = None
    frequency: DataFrame | None = None
    lemmas: DataFrame | None = None


def extract_answers(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """The default answers (query_id, answer, judge_ok, n_citations): the question and the beginning of the best hit, cited
    if the hit's score is 0.3 or more; the judge lets pass what scores 0.2 or more."""
    best = hits.filter("pos = 0").select("query_id", "score", F.substring("text", 1, 200).alias("_start"))
    said = F.concat_ws(" ", "retrieval", "_start")
    return asked.join(best, "query_id").select("query_id", said.alias("answer"), (F.col("score") >= 0.2).alias("judge_ok"), F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("n_citations"))


def side_outcomes(
    asked: DataFrame, corpus: Corpus, encoder: Callable[[Column], Column], store: Store, answers: Callable[[DataFrame, DataFrame], DataFrame] = extract_answers,
    scorer: Callable[[Column, Column], Column] = overlap_scorer, k: int = 5, k_raw: int = 12, rerank: dict[str, float] | None = None, covered: dict[str, float] | None = None, skip_judge: bool = False,
) -> DataFrame:
    """One stage: questions (query_id, side, lang, retrieval) with what their side gives: reason (null: answered), skipped,
    answer, section, sources and cechy. Each is ranked by words and vectors over the whole side, fused, reranked and gated.

    answers(asked, hits) returns (query_id, answer, judge_ok, n_citations), rows or values of which may be missing: a null
    judgement passes and is noted, a null answer is none.
    """
    lang = "lang" if corpus.lemmas is not None else None
    queries = store(asked.select("query_id", "side", "lang", F.col("retrieval").alias("text"), encoder(F.col("retrieval")).alias("vector")), "queries")
    found = fused_top(queries, corpus.index, corpus.vectors, k_raw, store, lang=lang, lemmas=corpus.lemmas)
    hits = store(search_reranked(queries.select("query_id", "text"), [found], corpus.chunks.select("chunk_id", "url", "title", "section", "text"), k, scorer), "hits")
    first = lambda c: F.min_by(c, "pos")
    listed = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda x: x["url"]))
    best = hits.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_hits"), first("score").alias("top_score"), first("section").alias("section"), first("url").alias("top_url"), listed.alias("sources"))
    said = store(answers(asked, hits).select("query_id", "answer", F.lit(None).cast("boolean").alias("judge_ok") if skip_judge else "judge_ok", "n_citations"), "answers")
    rows = asked.select("query_id", "side", "lang").join(best, "query_id", "left").join(said, "query_id", "left")
    if corpus.idf is None:
        rows = rows.withColumn("coverage", F.lit(None).cast("double"))
    else:
        spoken = said.filter("answer is not null").join(asked.select("query_id", "lang"), "query_id").select("query_id", "lang", "answer")
        context = hits.join(asked.select("query_id", "lang"), "query_id").select("query_id", "lang", "text")
        rows = rows.join(gates.answer_coverage(spoken, context, corpus.idf, corpus.idf_max, lang, corpus.lemmas), "query_id", "left")
    rows = gates.gate_reason(rows, rerank, covered)
    # a stage that ends early hasn't seen the later gates, so it neither knows nor skips them
    reached = lambda *reasons: ~F.coalesce(F.col("reason").isin(*reasons), F.lit(False))
    judged, spoke, weighed = reached("prog_rerank"), reached("prog_rerank", "sedzia"), reached("prog_rerank", "sedzia", "brak_generacji")
    skipped = F.filter("skipped", lambda g: ((g == "sedzia") & judged & F.lit(not skip_judge)) | ((g == "pokrycie") & weighed))
    cechy = F.struct(
        F.round("top_score", 4).alias("rerank_top1"), F.coalesce("n_hits", F.lit(0)).alias("chunkow"), F.col("top_url").alias("zrodlo_top1"),
        F.when(judged, F.col("judge_ok")).alias("sedzia_ok"), F.when(weighed, F.round("coverage", 4)).alias("pokrycie"), F.lit(1).alias("etap"),
    )
    return rows.select("query_id", "side", "reason", skipped.alias("skipped"), F.when(spoke, F.col("answer")).alias("answer"), "section", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), cechy.alias("cechy"))


def screened(df: DataFrame, corpus: Corpus, store: Store) -> DataFrame:
    """What becomes of questions before any search: adds tryb (rozmowa, email or rag), powod (null: to be searched), class,
    text (without greeting, corrected), changed, and retrieval, the text to search.

    Columns: query_id, text, lang, has_history, prev_section, previous (the last question of the user), rewritten (a
    question made whole by a model, null: none), mail_category (a judge's, null: none), correct (whether to correct typos).
    """
    rows = questions.classify_turn(df.withColumns({"has_history": F.coalesce("has_history", F.lit(False)), "text": F.coalesce("text", F.lit(""))}))
    chat = F.coalesce(F.col("class").isin(*CHAT), F.lit(False))
    rows = store(rows.withColumns({"text": F.col("rest"), "chat": chat}).withColumn("guard", F.when(~F.col("chat"), questions.screen_question(F.col("text")))).drop("rest"), "screened")
    fixable = rows.filter(~F.col("chat") & F.col("guard").isNull() & F.coalesce("correct", F.lit(False)) & (F.col("lang") == "pl"))
    if corpus.dictionary is not None:
        frequency = corpus.frequency if corpus.frequency is not None else df.sparkSession.createDataFrame([], "word string, zipf double")
        fixed = store(questions.correct_questions(fixable.select("query_id", "text"), corpus.dictionary, frequency).select("query_id", "corrected", "changed", "unknown"), "corrected")
    else:
        fixed = fixable.select("query_id", F.col("text").alias("corrected"), F.lit(False).alias("changed"), F.array().cast("array<string>").alias("unknown"))
    rows = rows.join(fixed, "query_id", "left")
    lost = F.coalesce((F.size("unknown") > 0) & questions.unintelligible(F.col("corrected"), F.col("unknown")), F.lit(False))
    text = F.coalesce("corrected", "text")
    mail = questions.explicit_mail_request(text, F.col("lang"))
    category = F.coalesce(questions.mail_category_from_offer(text, F.col("lang")), "mail_category")
    powod = F.when(F.col("guard").isNotNull(), F.concat(F.lit("guard_"), "guard")).when(lost, "nie_zrozumialem").when(mail & category.isNull(), "mail_doprecyzuj")
    control = F.coalesce(F.col("class") == "sterowanie", F.lit(False)) & F.col("previous").isNotNull()
    whole = F.when(control, F.col("previous")).when(F.col("has_history"), F.coalesce("rewritten", text)).otherwise(text)
    rows = rows.withColumns({"powod": F.when(~F.col("chat"), powod), "_mail": mail, "_category": category, "_text": text, "_whole": whole})
    tryb = F.when(F.col("chat"), "rozmowa").when(F.col("powod").isNull() & F.col("_mail"), "email").otherwise("rag")
    style = F.when(F.col("class") == "sterowanie", questions.control_subclass(F.col("text"), F.col("lang")))
    return rows.withColumn("tryb", tryb).select(
        "query_id", "lang", "class", style.alias("styl"), "tryb", "powod", F.when(F.col("tryb") == "email", F.col("_category")).alias("kategoria"),
        F.col("_text").alias("text"), F.coalesce("changed", F.lit(False)).alias("changed"), F.col("_whole").alias("retrieval"),
    )


def two_stage_search(df: DataFrame, corpus: Corpus, encoder: Callable[[Column], Column], store: Store, **stage) -> DataFrame:
    """One row for each question of df (the columns of screened(), and side), as the service answers it.

    A turn of conversation, a refused, misunderstood or mail question ends before the search. Others are searched on the
    asked side (the buyer's for any other value); only those refused there, on the other one. Answered there: etap 2 and
    nota, the other side. Refused on both: the first reason, and the second as powod_etap2.
    Columns: query_id, tryb, class, styl, side, etap, powod, powod_etap2, nota, kategoria, text, changed, answer, section,
    sources, bramki_pominiete (of both stages, each once), cechy. stage: parameters of side_outcomes().
    query_id must be unique; a null text is empty; both stages read the same stored index.
    """
    ready = store(screened(df, corpus, store), "questions")
    sides = df.select("query_id", F.when(F.col("side").isin(*lists.SIDES), F.col("side")).otherwise(F.lit(lists.SIDES[0])).alias("side"))
    searched = ready.filter("tryb = 'rag' and powod is null").join(sides, "query_id")
    columns = ["query_id", "side", "lang", "text", "retrieval", "styl", "class"]
    first = store(side_outcomes(store(searched.select(*columns), "stage1"), corpus, encoder, store, **stage), "first")
    other = F.when(F.col("side") == lists.SIDES[0], lists.SIDES[1]).otherwise(lists.SIDES[0])
    again = searched.join(first.filter("reason is not null").select("query_id"), "query_id", "left_semi").withColumn("side", other)
    second = store(side_outcomes(store(again.select(*columns), "stage2"), corpus, encoder, store, **stage), "second")
    later = second.select("query_id", *[F.col(c).alias(f"_{c}") for c in ("side", "reason", "skipped", "answer", "section", "sources", "cechy")], F.lit(True).alias("_tried"))
    both = first.join(later, "query_id", "left")
    moved = F.coalesce("_tried", F.lit(False)) & F.col("_reason").isNull()
    pick = lambda c: F.when(moved, F.col(f"_{c}")).when(F.col("reason").isNull(), F.col(c))
    result = both.select(
        "query_id", F.when(moved, F.col("_side")).otherwise(F.col("side")).alias("side"), F.when(moved, 2).otherwise(1).alias("etap"), F.when(~moved, F.col("reason")).alias("_powod"),
        F.when(~moved, F.col("_reason")).alias("powod_etap2"), F.when(moved, F.col("_side")).alias("nota"), pick("answer").alias("answer"), pick("section").alias("section"),
        F.coalesce(pick("sources"), F.array().cast("array<string>")).alias("sources"), F.array_distinct(F.concat("skipped", F.coalesce("_skipped", F.array().cast("array<string>")))).alias("bramki_pominiete"),
        F.when(moved, F.col("_cechy").withField("etap", F.lit(2))).otherwise(F.col("cechy")).alias("cechy"),
    )
    return ready.join(result, "query_id", "left").select(
        "query_id", "tryb", "class", "styl", "side", "etap", F.coalesce("powod", "_powod").alias("powod"), "powod_etap2", "nota", "kategoria", "text", "changed", "answer", "section", "sources", "bramki_pominiete", "cechy"
    )
