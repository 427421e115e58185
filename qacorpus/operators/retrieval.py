"""Ranking of chunks for many questions at once: BM25, vectors, fusion, reranking, evaluation."""

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_sha
from .bm25 import Bm25Index, Store, asked_tokens, top_chunks
from .nearest import block_scores


def _place(by: list, order: list) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1


def bm25_rank(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], depth: int | None = None, k1: float = 1.5, b: float = 0.75, lang: str | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos) for queries (query_id, side, text): best first, ties by chunk_id, pos from 0.

    Without a depth every chunk of the side is ranked, those without a common token with score 0: exact, for corpora
    small enough to be listed for each question. With one, only chunks with a common token are, up to it; top_chunks()
    gives the same from an index by impact, without reading all postings.
    """
    postings, lengths, terms = index
    asked = asked_tokens(queries, lang, lemmas)
    weighted = asked.join(terms.select("side", "token", "idf"), ["side", "token"])
    hits = weighted.join(postings, ["side", "token"]).join(lengths, ["side", "chunk_id"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scores = hits.groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
    if depth is None:
        every = queries.select("query_id", "side").join(lengths.select("side", "chunk_id"), "side").drop("side")
        scores = every.join(scores, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    ranked = scores.withColumn("score", F.round("score", 9)).withColumn("pos", _place(["query_id"], [F.desc("score"), "chunk_id"]))
    return ranked if depth is None else ranked.filter(F.col("pos") < depth)


def vector_rank(queries: DataFrame, vectors: DataFrame, depth: int | None = None, block: int = 4096, queries_at_once: int = 1024, group: str | None = None, own: bool = True, same: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos) by inner product of queries (query_id, vector) and vectors (chunk_id, vector).

    Questions and chunks are dealt into blocks, and each pair of blocks is one matrix product in one task. group: a
    column of both; only rows with different values are compared; same: one of both that must be equal. own=False leaves
    out pairs of equal ids.
    """
    n, m = vectors.count(), queries.count()
    wide, high = max(1, -(-n // block)), max(1, -(-m // queries_at_once))
    label = F.lit(None).cast("string") if group is None and same is None else F.col(group or same).cast("string")
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    doubles = F.transform("vector", lambda x: x.cast("double")).alias("v")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = queries.filter("vector is not null").select(deal("query_id", high).alias("q"), every(wide).alias("c"), F.lit(True).alias("asks"), F.col("query_id").cast("long").alias("id"), label.alias("label"), doubles)
    right = vectors.filter("vector is not null and chunk_id >= 0").select(every(high).alias("q"), deal("chunk_id", wide).alias("c"), F.lit(False).alias("asks"), F.col("chunk_id").cast("long").alias("id"), label.alias("label"), doubles)

    of = block_scores(depth, group is not None, group is None and same is not None, own)
    found = left.union(right).groupBy("q", "c").applyInArrow(of, "query_id long, chunk_id long, score double")
    ranked = found.withColumn("pos", _place(["query_id"], [F.desc("score"), "chunk_id"]))
    return ranked if depth is None else ranked.filter(F.col("pos") < depth)


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, pos): sums of 1 / (k + pos) over rankings."""
    rows = rankings[0].select("query_id", "chunk_id", "pos")
    for r in rankings[1:]:
        rows = rows.unionByName(r.select("query_id", "chunk_id", "pos"))
    scores = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("pos"))), 12).alias("score"))
    return scores.withColumn("pos", _place(["query_id"], [F.desc("score"), "chunk_id"]))


def certified(rankings: tuple[DataFrame, DataFrame], k_raw: int, depth: int, k: int = 60) -> DataFrame:
    """(query_id, exact): whether two rankings cut at depth surely give the same best k_raw as whole ones.

    So it is if there are so many, the best k_raw are in both lists and none that a list lacks can reach the last of them. A list that is
    shorter than depth has to be whole.
    """
    rows = rankings[0].select("query_id", "chunk_id", "pos").unionByName(rankings[1].select("query_id", "chunk_id", "pos"))
    sums = rows.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (k + F.col("pos"))).alias("score"), F.count(F.lit(1)).alias("lists"))
    sums = sums.withColumn("pos", _place(["query_id"], [F.desc("score"), "chunk_id"]))
    top = F.col("pos") < k_raw
    unseen = 1.0 / (k + depth)
    row = sums.groupBy("query_id").agg(F.count_if(top).alias("n"), F.min(F.when(top, F.col("score"))).alias("last"), F.min(F.when(top, F.col("lists"))).alias("lists"), F.max(F.when(~top & (F.col("lists") == 1), F.col("score") + unseen)).alias("rival"))
    return row.select("query_id", ((F.col("n") == k_raw) & (F.col("lists") == 2) & (F.col("last") > F.coalesce("rival", F.lit(0.0)) + 1e-11) & (F.col("last") > 2 * unseen + 1e-11)).alias("exact"))


def candidates(rankings: list[DataFrame], k_raw: int, k: int = 60) -> DataFrame:
    return rrf(rankings, k).filter(F.col("pos") < k_raw)


def padded(ranking: DataFrame, queries: DataFrame, lengths: DataFrame, depth: int) -> DataFrame:
    """A ranking of chunks with a common token, as whole lists go on: by id, the side's other chunks, up to depth.

    queries (query_id, side), lengths (side, chunk_id). Of each side only the first `depth` ids can be needed.
    """
    heads = lengths.select("side", "chunk_id").withColumn("_p", F.row_number().over(Window.partitionBy("side").orderBy("chunk_id"))).filter(F.col("_p") <= depth).drop("_p")
    have = queries.select("query_id", "side").join(ranking.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    more = have.filter(F.col("_n") < depth).join(heads, "side").join(ranking.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
    place = F.col("_n") + _place(["query_id"], ["chunk_id"])
    more = more.select("query_id", "chunk_id", F.lit(0.0).alias("score"), place.cast("int").alias("pos")).filter(F.col("pos") < depth)
    return ranking.select("query_id", "chunk_id", "score", F.col("pos").cast("int").alias("pos")).unionByName(more)


def fused_top(queries: DataFrame, index: Bm25Index, vectors: DataFrame, k_raw: int, store: Store, depth: int = 1024, grow: int = 8, lang: str | None = None, lemmas: DataFrame | None = None, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos) of the best k_raw chunks of each question's side by both rankings fused, exactly as
    of whole lists.

    queries (query_id, side, text, vector), vectors (chunk_id, side, vector). Both rankings are cut at a depth; questions
    whose best k_raw that doesn't settle are ranked again `grow` times as deep, until none is left or the lists are
    whole. A question without a vector, or whose side has none, is ranked by its words. rounds: gets the depth and the
    questions of each round.
    """
    most = max(index.sizes.values(), default=0)
    vectored = vectors.groupBy("side").agg(F.count(F.lit(1)).alias("_v"))
    pending = store(queries.select("query_id", "side", "text", "vector", *([] if lang is None else [lang])), "pending")
    done: DataFrame | None = None
    left = pending.count()
    while left:
        depth = min(depth, max(most, 1))
        words = top_chunks(pending, index, depth, store, lang, lemmas) if index.exact else bm25_rank(pending, (index.postings, index.lengths, index.terms), None, lang=lang, lemmas=lemmas).filter(F.col("pos") < depth)
        words = store(padded(words, pending, index.lengths, depth), "words")
        near = store(vector_rank(pending, vectors, depth, same="side"), "near")
        fused = candidates([words, near], k_raw)
        if depth >= most:
            rows, pending, left = fused, None, 0
        else:
            sure = certified((words, near), k_raw, depth).filter("exact").select("query_id")
            lone = pending.join(vectored, "side", "left").filter("vector is null or _v is null").select("query_id") if k_raw <= depth else sure.limit(0)
            sure = store(sure.union(lone).distinct(), "sure")
            rows = fused.join(sure, "query_id", "left_semi")
            after = store(pending.join(sure, "query_id", "left_anti"), "pending")
            if rounds is not None:
                rounds.append((depth, left))
            pending, left = after, after.count()
        rows = store(rows, "fused")
        done = rows if done is None else done.unionByName(rows)
        depth *= grow
    return done if done is not None else store(candidates([queries.select("query_id", F.lit(0).cast("long").alias("chunk_id"), F.lit(0).alias("pos")).limit(0)], k_raw), "fused")


def hybrid_top(queries: DataFrame, index: Bm25Index, vectors: DataFrame, chunks: DataFrame, store: Store, k: int = 5, grow: int = 4, lang: str | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """search_hybrid() over whole lists: so many of the best fused chunks as leave k after both rounds of removing repeats."""
    return hybrid(queries, lambda asked, wanted: fused_top(asked, index, vectors, wanted, store, lang=lang, lemmas=lemmas), max(index.sizes.values(), default=0), chunks, store, k, grow)


def hybrid(queries: DataFrame, fused: Callable[[DataFrame, int], DataFrame], most: int, chunks: DataFrame, store: Store, k: int = 5, grow: int = 4) -> DataFrame:
    """hybrid_top() with any way to the best fused chunks of questions, of which a side has `most` chunks at most."""
    wanted, pending, done = grow * k, queries, None
    while True:
        hits = fused(pending, wanted).join(chunks.select("chunk_id", "url", "title", "text"), "chunk_id")
        found = store(_first(dedup_best(dedup_best(hits, ["url"]), ["title", "text"]), k), "hits")
        full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id") if wanted < most else pending.select("query_id")
        rows = found.join(full, "query_id", "left_semi")
        done = rows if done is None else done.unionByName(rows)
        pending = store(pending.join(full, "query_id", "left_anti"), "pending")
        if pending.isEmpty():
            return done
        wanted *= grow


def dedup_best(hits: DataFrame, key: list[str]) -> DataFrame:
    """Of each query's hits with one key the one with the highest score, the earlier of equals, at the place of the first."""
    first = F.min("pos").over(Window.partitionBy("query_id", *key))
    return hits.withColumns({"_place": _place(["query_id", *key], [F.desc("score"), "pos"]), "_first": first}).filter("_place = 0").drop("_place", "pos").withColumnRenamed("_first", "pos")


def _first(hits: DataFrame, k: int) -> DataFrame:
    return hits.withColumn("pos", _place(["query_id"], [F.desc("score"), "pos"])).filter(F.col("pos") < k)


def search_hybrid(rankings: list[DataFrame], chunks: DataFrame, k: int = 5) -> DataFrame:
    """Fused rankings without repeated addresses, then without repeated contents, the first k."""
    hits = rrf(rankings).join(chunks.select("chunk_id", "url", "title", "text"), "chunk_id")
    return _first(dedup_best(dedup_best(hits, ["url"]), ["title", "text"]), k)


def overlap_scorer(query: Column, passage: Column) -> Column:
    """The default pair score: how much of the question's words the passage has, less a little for its length."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, p in batches:
            out = []
            for a, b in zip(q, p):
                x, y = set((a or "").lower().split()), set((b or "").lower().split())
                out.append(len(x & y) / max(len(x), 1) - 1e-6 * len(y))
            yield pd.Series(out)

    return of(query, passage)


def hashed_encoder(passage: Column, dims: int = 64) -> Column:
    """The default encoder: how often words fall to each of `dims` places by their hash, as a unit vector."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                places = [zlib.crc32(w.encode()) % dims for w in (t or "").lower().split()]
                counts = np.bincount(places, minlength=dims).astype(float) if places else np.zeros(dims)
                out.append(counts / (np.linalg.norm(counts) or 1.0))
            yield pd.Series(out)

    return of(passage)


def rerank_pairs(queries: DataFrame, found: DataFrame, chunks: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """found (query_id, chunk_id, pos) with the scorer's score of each question and its chunk's title and text."""
    pairs = found.select("query_id", "chunk_id", "pos").join(chunks, "chunk_id").join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    return pairs.withColumn("score", scorer(F.col("question"), F.concat_ws("\n", "title", "text"))).drop("question")


def search_reranked(queries: DataFrame, by_side: list[DataFrame], chunks: DataFrame, k: int = 3, scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """The candidates of all sides, one table after the other, reranked, without repeated addresses and contents, the
    first k by score."""
    rows = None
    for number, side in enumerate(by_side):
        part = side.select("query_id", "chunk_id", (F.col("pos") + F.lit(number << 40)).alias("pos"))  # beyond all places of a ranking
        rows = part if rows is None else rows.unionByName(part)
    hits = rerank_pairs(queries, rows, chunks, scorer)
    return _first(dedup_best(dedup_best(hits, ["url"]), ["title", "text"]), k)


def build_score_table(questions: DataFrame, found: DataFrame, chunks: DataFrame, top_n: int = 30, scorer: Callable[[Column, Column], Column] = overlap_scorer) -> DataFrame:
    """(lang, query, side, pos, url, score, sha) of the best top_n candidates of each question (query_id, lang, text)
    and side, in fused order. A text in several languages keeps the first of them by name."""
    one = questions.withColumn("_place", _place(["text"], ["lang", "query_id"])).filter("_place = 0").drop("_place")
    hits = rerank_pairs(one, found.filter(F.col("pos") < top_n).join(one.select("query_id"), "query_id", "left_semi"), chunks.select("chunk_id", "url", "title", "text"), scorer)
    sided = hits.join(found.select("query_id", "chunk_id", "side"), ["query_id", "chunk_id"]).join(one.select("query_id", "lang", F.col("text").alias("query")), "query_id")
    return sided.select("lang", "query", "side", "pos", "url", "score", content_sha(F.col("title"), F.col("text")).alias("sha"))


def replay_search(table: DataFrame, asked: DataFrame, sides: list[str], k: int, k_raw: int, top_n: int = 30) -> DataFrame:
    """What a search with k_raw candidates a side would have given for questions (query_id, query), from the table."""
    if k_raw > top_n:
        raise ValueError(f"the table has {top_n} candidates a side")
    if not asked.join(table.select("query").distinct(), "query", "left_anti").isEmpty():
        raise ValueError("the table lacks a question")
    hits = asked.join(table.filter((F.col("pos") < k_raw) & F.col("side").isin(sides)), "query")
    return _first(dedup_best(dedup_best(hits, ["url"]), ["sha"]), k)


def reconcile_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """For each (lang, query, side) of either table: both lengths and the first position whose address differs."""
    key = ["lang", "query", "side", "pos"]
    both = old.select(*key, F.col("url").alias("a")).join(new.select(*key, F.col("url").alias("b")), key, "full")
    report = both.groupBy("lang", "query", "side").agg(F.count("a").alias("old_n"), F.count("b").alias("new_n"), F.min(F.when(~F.col("a").eqNullSafe(F.col("b")), F.col("pos"))).alias("first_mismatch"))
    return report.withColumn("same", F.col("first_mismatch").isNull())


def two_stage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Outcomes of questions (query_id, side, reason; null: answered) on the asked side, then, where that refused, on
    the other: the stage that answered, else the first reason, and the second's beside it."""
    later = second.select("query_id", F.col("side").alias("other"), F.col("reason").alias("reason2"), F.lit(True).alias("tried"))
    both = first.join(later, "query_id", "left")
    moved = F.col("reason").isNotNull() & F.coalesce("tried", F.lit(False)) & F.col("reason2").isNull()
    return both.select(
        "query_id", F.when(moved, F.col("other")).otherwise(F.col("side")).alias("side"), F.when(moved, 2).otherwise(1).alias("etap"),
        F.when(~moved, F.col("reason")).alias("powod"), F.when(F.col("reason").isNotNull() & ~moved, F.col("reason2")).alias("powod_etap2"), moved.alias("note"),
    )


def hit_at_k(results: DataFrame, golden: DataFrame, ks: list[int]) -> DataFrame:
    """Of each set, how many golden questions (query_id, set, url) it has and the share with their address among the
    first k results (query_id, url, pos)."""
    best = golden.join(results, ["query_id", "url"], "left").groupBy("query_id", "set", "url").agg(F.min("pos").alias("pos"))
    share = lambda k: F.round(F.avg(F.when(F.coalesce(F.col("pos") < k, F.lit(False)), 1.0).otherwise(0.0)), 4).alias(f"hit_at_{k}")
    return best.groupBy("set").agg(F.count(F.lit(1)).alias("n"), *[share(k) for k in ks])


def result_sources(hits: DataFrame) -> DataFrame:
    """query_id and its distinct addresses in order, numbered from 1, each with the last title it comes with."""
    seen = hits.groupBy("query_id", "url").agg(F.min("pos").alias("pos"), F.max_by("title", "pos").alias("title"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "url", "title"))), lambda x, i: F.struct((i + 1).alias("n"), x["url"].alias("url"), x["title"].alias("title")))
    return seen.groupBy("query_id").agg(listed.alias("sources"))


def citations_or_sources(citations: Column, sources: Column) -> Column:
    return F.when(F.size(F.coalesce(citations, F.array())) > 0, citations).otherwise(sources)


def threshold_sweep(scores: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold over scores (set: golden or ood, score; null: no hit): refused golden ones, refused others,
    and how many are left to judge."""
    grid = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    rows = scores.select("set", "score", grid).withColumn("refused", F.coalesce(F.col("score") < F.col("threshold"), F.lit(True)))
    return rows.groupBy("threshold").agg(F.count_if((F.col("set") == "golden") & F.col("refused")).alias("false_refusals"), F.count_if((F.col("set") == "ood") & F.col("refused")).alias("cut"), F.count_if(~F.col("refused")).alias("judge_calls"))


def score_distribution(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    return df.groupBy(group).agg(F.min(score).alias("low"), F.percentile(score, 0.5).alias("median"), F.max(score).alias("high"))


def knn_out_of_fold(vectors: DataFrame, k: int, fold: str = "fold") -> DataFrame:
    """Each row's k nearest rows of other folds, of vectors (chunk_id, vector, fold)."""
    return vector_rank(vectors.withColumn("query_id", F.col("chunk_id")), vectors, k, group=fold)
