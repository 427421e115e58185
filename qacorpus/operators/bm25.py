"""A BM25 index whose postings are stored by impact, and exact searches that read only what can still matter."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, char_ngrams, normalize_lexical

Store = Callable[[DataFrame, str], DataFrame]


def _folding(top: int = 0x2000) -> tuple[str, str, str]:
    """By rule, of the characters below `top`: those that fold to one other, followed by those that vanish; what the first
    fold to; and those that fold to several."""
    source, target, gone, odd = [], [], [], []
    for code in range(128, top):
        c = chr(code)
        plain = "l" if c == "ł" else "L" if c == "Ł" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain == c:
            continue
        if not plain:
            gone.append(c)
        elif len(plain) == 1:
            source.append(c)
            target.append(plain)
        else:
            odd.append(c)
    return "".join(source + gone), "".join(target), "".join(odd)


_FROM, _TO, _SEVERAL = _folding()


def is_odd(word: Column) -> Column:
    """Whether plain_word() may not do for a word: it has a character that folds to several, or one from U+2000 on."""
    return word.rlike(r"[^\x00-\x{1FFF}]") | (F.translate(word, _SEVERAL, "") != word)


def plain_word(word: Column) -> Column:
    """Lower case without accents, where is_odd() isn't; a built-in expression."""
    return F.lower(F.translate(word, _FROM, _TO))


def word_counts(rows: DataFrame, keys: list[str], text: str = "text", lang: str | None = None) -> DataFrame:
    """(*keys, lang, word, n): how often each word between white space is in a text; lang is null without such a column."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), f"{SPACE}+"), lambda w: w != "")
    label = F.lit(None).cast("string") if lang is None else F.col(lang)
    return rows.select(*keys, label.alias("lang"), F.explode(words).alias("word")).groupBy(*keys, "lang", "word").agg(F.count(F.lit(1)).alias("n"))


def lemmatised(words: DataFrame, lemmas: DataFrame) -> DataFrame:
    """words (..., lang, word) with lemma and plain: the word's lemma in its language, itself without one, and that in
    lower case without accents.

    lemmas (lang, form, lemma), of any size, meets the distinct words only; several lemmas of a form: the first in order.
    A null lang of either side matches null. Only words with characters that the built-in folding doesn't know are folded
    in Python, each once. Words keep their number of rows.
    """
    distinct = words.select("lang", "word").distinct()
    table = lemmas.groupBy(F.col("lang").alias("table_lang"), F.col("form")).agg(F.min("lemma").alias("own"))
    met = distinct.join(table, (F.col("word") == F.col("form")) & F.col("lang").eqNullSafe(F.col("table_lang")), "left")
    met = met.select("lang", "word", F.coalesce("own", "word").alias("lemma")).filter((F.col("lemma") != F.col("word")) | is_odd(F.col("word")))
    odd = is_odd(F.col("lemma"))
    special = met.filter(~odd).withColumn("plain", plain_word(F.col("lemma"))).unionByName(met.filter(odd).withColumn("plain", normalize_lexical(F.col("lemma"))))
    special = special.select(F.col("lang").alias("s_lang"), F.col("word").alias("s_word"), F.col("lemma").alias("s_lemma"), F.col("plain").alias("s_plain"))
    out = words.join(special, (F.col("word") == F.col("s_word")) & F.col("lang").eqNullSafe(F.col("s_lang")), "left")
    return out.withColumns({"lemma": F.coalesce("s_lemma", "word"), "plain": F.coalesce("s_plain", plain_word(F.col("word")))}).drop("s_lang", "s_word", "s_lemma", "s_plain")


def token_counts(rows: DataFrame, keys: list[str], text: str = "text", lang: str | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """(*keys, token, n): of each text the lemmas, folded, and the trigrams of the lemmas as they are, with their number.

    Words are counted before they are taken apart, so that a word's tokens are made once for a text. Without lemmas only
    texts that is_odd() holds of are folded in Python.
    """
    if lemmas is not None:
        found = lemmatised(word_counts(rows, keys, text, lang), lemmas)
    else:
        odd = F.coalesce(is_odd(F.col(text)), F.lit(False))
        simple = word_counts(rows.filter(~odd), keys, text).withColumn("plain", plain_word(F.col("word")))
        found = simple.unionByName(word_counts(rows.filter(odd), keys, text).withColumn("plain", normalize_lexical(F.col("word")))).withColumn("lemma", F.col("word"))
    tokens = F.concat(F.array("plain"), char_ngrams(F.col("lemma")))
    return found.select(*keys, "n", F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Bm25Index:
    """Stored tables of an Okapi index by side.

    postings (side, token, chunk_id, tf); lengths (side, chunk_id, len, avg_len); terms (side, token, df, idf).
    runs (side, token, run, top, n, chunks, impacts): the postings of a token by falling impact, in runs of at most so
    many; top is a run's greatest impact, which is what a chunk gains from one occurrence of the token in a question.
    forward (chunk_id, side, tokens, impacts): of each chunk its tokens by hash, in order. exact: no impact is negative.
    sizes: how many chunks each side has.
    """

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    runs: DataFrame
    forward: DataFrame
    exact: bool
    sizes: dict[str, int]


def with_impacts(postings: DataFrame, lengths: DataFrame, terms: DataFrame, store: Store, k1: float = 1.5, b: float = 0.75, size: int = 1024) -> Bm25Index:
    """The index of these tables, with its runs and forward lists."""
    impact = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighed = store(postings.join(lengths, ["side", "chunk_id"]).join(terms.select("side", "token", "idf"), ["side", "token"]).select("side", "token", "chunk_id", impact.alias("impact")), "impacts")
    bucketed = weighed.withColumn("bucket", F.lit(0))
    many = store(terms.filter(F.col("df") > size * 64).select("side", "token"), "common")
    if not many.isEmpty():  # postings of common tokens are dealt to ranges of impact, so that no window has all of one
        marks = F.percentile_approx("impact", F.array(*[F.lit(k / 32) for k in range(1, 32)]), 1000)
        ranges = weighed.join(many, ["side", "token"], "left_semi").groupBy("side", "token").agg(marks.alias("marks"))
        bucketed = weighed.join(ranges, ["side", "token"], "left").withColumn("bucket", F.coalesce(F.size(F.filter("marks", lambda m: m > F.col("impact"))), F.lit(0))).drop("marks")
    place = F.row_number().over(Window.partitionBy("side", "token", "bucket").orderBy(F.desc("impact"), "chunk_id")) - 1
    runs = bucketed.withColumn("part", F.floor(place / size)).groupBy("side", "token", "bucket", "part").agg(F.collect_list(F.struct("impact", "chunk_id")).alias("p"))
    runs = runs.select("side", "token", (F.col("bucket") * (1 << 20) + F.col("part")).alias("run"), F.array_max(F.transform("p", lambda x: x["impact"])).alias("top"), F.size("p").alias("n"), F.transform("p", lambda x: x["chunk_id"]).alias("chunks"), F.transform("p", lambda x: x["impact"]).alias("impacts"))
    listed = F.array_sort(F.collect_list(F.struct(F.xxhash64("token").alias("h"), "impact")))
    forward = weighed.groupBy("side", "chunk_id").agg(listed.alias("p")).select("side", "chunk_id", F.transform("p", lambda x: x["h"]).alias("tokens"), F.transform("p", lambda x: x["impact"]).alias("impacts"))
    low = terms.agg(F.min("idf")).first()[0]
    sizes = {r.side: r.n for r in lengths.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per side
    return Bm25Index(postings, lengths, terms, store(runs, "runs"), store(forward, "forward"), low is None or low >= 0, sizes)


def build_index(chunks: DataFrame, sides: Column | None, store: Store, lang: str | None = None, lemmas: DataFrame | None = None, epsilon: float = 0.25, size: int = 1024) -> Bm25Index:
    """Index of chunks (chunk_id, title, text, with lang and a table of lemmas too) by side, as bm25_index() has it."""
    postings, lengths, terms = tables(chunks, sides, store, lang, lemmas, epsilon)
    return with_impacts(postings, lengths, terms, store, size=size)


def tables(chunks: DataFrame, sides: Column | None, store: Store | None, lang: str | None = None, lemmas: DataFrame | None = None, epsilon: float = 0.25) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings, lengths, terms) by side; a negative idf becomes epsilon times the side's mean idf."""
    store = store or (lambda df, name: df)
    rows = chunks.select("chunk_id", (sides if sides is not None else F.lit("all")).alias("side"), F.concat_ws("\n", "title", "text").alias("text"), *([] if lang is None else [F.col(lang).alias("lang")]))
    postings = store(token_counts(rows, ["side", "chunk_id"], "text", None if lang is None else "lang", lemmas).select("side", "token", "chunk_id", F.col("n").alias("tf")), "postings")
    counted = postings.groupBy("chunk_id").agg(F.sum("tf").alias("len"))
    lengths = rows.select("side", "chunk_id").join(counted, "chunk_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    means = lengths.groupBy("side").agg(F.avg("len").alias("avg_len"), F.count(F.lit(1)).alias("n"))  # a row per side
    lengths = store(lengths.join(means, "side").select("side", "chunk_id", "len", "avg_len"), "lengths")
    return postings, lengths, store(idf(postings.groupBy("side", "token").agg(F.count(F.lit(1)).alias("df")), means.select("side", "n"), epsilon), "terms")


def idf(counts: DataFrame, sizes: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(side, token, df, idf) of counts (side, token, df) and sizes (side, n)."""
    raw = counts.join(sizes, "side").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.groupBy("side").agg((F.avg("raw") * epsilon).alias("floor"))
    return raw.join(floor, "side").select("side", "token", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))


def asked_tokens(queries: DataFrame, lang: str | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """(query_id, side, token, qtf) of queries (query_id, side, text)."""
    return token_counts(queries, ["query_id", "side"], "text", lang, lemmas).withColumnRenamed("n", "qtf")


#: How far rounding may lead a sum of impacts astray.
SLACK = 1e-7


def top_chunks(queries: DataFrame, index: Bm25Index, depth: int, store: Store, lang: str | None = None, lemmas: DataFrame | None = None, first: int = 1024, block: int = 4096, wide: float = 0.5, reads: dict[str, int] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos) of the best `depth` chunks with a common token, exactly as whole lists rank them.

    The first round reads the first runs of each question's most telling tokens, about `first` postings; the last of the
    best `depth` sums bounds the result from below. A chunk over the bound can't do without all tokens of a question but
    those that together weigh less than it. So the second round reads, of tokens that can't be missed, the runs from which
    a chunk can still reach the bound, and keeps what is still over it with the most that missed tokens could add. The
    third scores that in full, from the chunks' forward lists, a block of chunks and a group of questions in a task.
    For a question whose second round would read over `wide` postings for each chunk of its side, as common as its tokens
    are, the third scores all chunks of the side, which takes less. Common tokens are many runs, read only as far as their
    impacts matter. reads: gets the numbers of postings and pairs.
    """
    if not index.exact:
        raise ValueError("an impact is negative: bounds don't hold")
    asked = store(asked_tokens(queries, lang, lemmas), "asked")
    runs = index.runs
    head = runs.filter("run = 0").select("side", "token", F.col("top").alias("most"), "n")
    weights = store(asked.join(head, ["side", "token"]).withColumn("bound", F.col("qtf") * F.col("most")), "weights")
    upto = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "token").rowsBetween(Window.unboundedPreceding, -1))
    chosen = weights.withColumn("upto", F.coalesce(upto, F.lit(0))).filter(F.col("upto") < first).select("query_id", "side", "token", "qtf", F.lit(0.0).alias("least"))
    sums = _read(chosen, runs.filter("run = 0"))
    floor = sums.withColumn("p", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("partial")))).filter(F.col("p") == depth).select("query_id", (F.col("partial") - SLACK).alias("floor"))
    spare = F.sum("bound").over(Window.partitionBy("query_id").orderBy("bound", "token").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("bound").over(Window.partitionBy("query_id"))
    judged = store(weights.join(floor, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumns({"upto": spare, "whole": whole}), "judged")
    needed = judged.filter(F.col("upto") >= F.col("floor")).select("query_id", "side", "token", "qtf", ((F.col("floor") - F.col("whole") + F.col("bound")) / F.col("qtf")).alias("least"))
    size = F.coalesce(*[F.when(F.col("side") == s, F.lit(n)) for s, n in index.sizes.items()], F.lit(0)) if index.sizes else F.lit(0)
    todo = store(_met(needed, runs.select("side", "token", "top", "n")).groupBy("query_id", "side").agg(F.sum("n").alias("n")).withColumn("broad", F.col("n") > wide * size), "todo")
    broad, narrow = todo.filter("broad").select("query_id", "side"), todo.filter("not broad").select("query_id")
    rest = judged.groupBy("query_id").agg(F.first("floor").alias("floor"), F.sum(F.when(F.col("upto") < F.col("floor"), F.col("bound")).otherwise(0.0)).alias("rest"))
    able = _read(needed.join(narrow, "query_id", "left_semi"), runs).join(rest, "query_id").filter(F.col("partial") + F.col("rest") + SLACK >= F.col("floor")).select("query_id", "side", "chunk_id")
    if reads is not None:
        able = store(able, "able")
        sums = todo.agg(F.coalesce(F.sum(F.when(~F.col("broad"), F.col("n"))), F.lit(0)).alias("n"), F.count_if("broad").alias("b")).first()
        reads |= {"first": _met(chosen, runs.select("side", "token", "top", "n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "second": sums.n, "broad": sums.b, "pairs": able.count()}
    scores = _best(able, broad, asked, index, depth, block, max(1, -(-queries.count() // block))).withColumn("score", F.round("score", 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")) - 1
    return scores.withColumn("pos", place).filter(F.col("pos") < depth).select("query_id", "chunk_id", "score", "pos")


def _met(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    return wanted.join(runs, ["side", "token"]).filter(F.col("top") >= F.col("least"))


def _read(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """(query_id, side, chunk_id, partial) from the runs of wanted (query_id, side, token, qtf, least)."""
    hits = _met(wanted, runs).select("query_id", "side", "qtf", F.explode(F.arrays_zip("chunks", "impacts")).alias("x"))
    return hits.groupBy("query_id", "side", F.col("x.chunks").alias("chunk_id")).agg(F.sum(F.col("qtf") * F.col("x.impacts")).alias("partial"))


def _best(pairs: DataFrame, broad: DataFrame, asked: DataFrame, index: Bm25Index, depth: int, block: int, high: int) -> DataFrame:
    """(query_id, chunk_id, score) in full of pairs (query_id, side, chunk_id), and of all chunks with a common token of the
    side of broad questions (query_id, side): of each question and block of chunks the best `depth`, and their equals.

    Chunks are dealt into blocks of at most about `block`, questions into `high` groups; a task has one block of forward
    lists and one group of questions.
    """
    total = sum(index.sizes.values())
    wide = max(1, -(-total // block), min(-(-total // 256), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    deal = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    lists = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64("token").alias("h"), F.col("qtf").cast("double").alias("qtf")))).alias("p"))
    lists = lists.select("query_id", F.transform("p", lambda x: x["h"]).alias("tokens"), F.transform("p", lambda x: x["qtf"]).alias("weights"))
    left = pairs.select("query_id", "side", "chunk_id", deal("chunk_id", wide).alias("b"), deal("query_id", high).alias("g"))
    parts = broad.select("query_id", "side", deal("query_id", high).alias("g"))
    sides = parts.select("side", "g").distinct()
    some = left.select("b", "g", "side", "chunk_id").join(sides, ["side", "g"], "left_anti").distinct().join(index.forward, ["side", "chunk_id"])
    whole = index.forward.join(F.broadcast(sides), "side").withColumn("b", deal("chunk_id", wide))  # at most a row per side and group
    used = some.select("b", "g", "side", "chunk_id", "tokens", "impacts").unionByName(whole.select("b", "g", "side", "chunk_id", "tokens", "impacts"))
    here = left.select("b", "g", "query_id", "side").distinct().withColumn("all", F.lit(False)).unionByName(parts.select(every(wide).alias("b"), "g", "query_id", "side", F.lit(True).alias("all")))
    none = lambda kind: F.lit(None).cast(kind)
    rows = (
        left.select("b", "g", F.lit(0).alias("kind"), "side", F.col("query_id").cast("long").alias("q"), F.col("chunk_id").cast("long").alias("c"), none("array<bigint>").alias("tokens"), none("array<double>").alias("values"))
        .unionByName(used.select("b", "g", F.lit(1).alias("kind"), "side", none("long").alias("q"), F.col("chunk_id").cast("long").alias("c"), "tokens", F.col("impacts").alias("values")))
        .unionByName(here.join(lists, "query_id").select("b", "g", F.when(F.col("all"), 3).otherwise(2).alias("kind"), "side", F.col("query_id").cast("long").alias("q"), none("long").alias("c"), "tokens", F.col("weights").alias("values")))
    )

    def of(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        pick = lambda mask: table.filter(pa.array(mask))
        forward, questions, pair = pick(kind == 1), pick(kind >= 2), pick(kind == 0)
        ids = forward.column("c").to_numpy()
        sides_of = np.array(forward.column("side").to_pylist(), object)
        lens = forward.column("tokens").combine_chunks()
        flat, impact = lens.values.to_numpy(), forward.column("values").combine_chunks().values.to_numpy()
        owner = np.repeat(np.arange(len(ids)), np.diff(lens.offsets.to_numpy()))
        order = np.argsort(flat, kind="stable")
        flat, impact, owner = flat[order], impact[order], owner[order]
        place = {c: k for k, c in enumerate(ids.tolist())}
        wanted: dict[int, list[int]] = {}
        for q, c in zip(pair.column("q").to_pylist(), pair.column("c").to_pylist()):
            wanted.setdefault(q, []).append(place[c])
        out = []
        for k, q, side, words, weight in zip(*(questions.column(x).to_pylist() for x in ("kind", "q", "side")), (x.values.to_numpy() for x in questions.column("tokens")), (x.values.to_numpy() for x in questions.column("values"))):
            low, high_ = np.searchsorted(flat, words), np.searchsorted(flat, words, side="right")
            n = high_ - low
            at = np.repeat(low - np.append(0, np.cumsum(n))[:-1], n) + np.arange(int(n.sum()))
            score = np.bincount(owner[at], weights=np.repeat(weight, n) * impact[at], minlength=len(ids))
            if k == 3:
                chosen = np.flatnonzero((score != 0) & (sides_of == side))
            else:
                chosen = np.array(wanted.get(q, []), np.int64)
            if len(chosen) > depth:
                least = np.partition(score[chosen], len(chosen) - depth)[len(chosen) - depth]
                chosen = chosen[score[chosen] >= least - SLACK]
            out.append((np.full(len(chosen), q), ids[chosen], score[chosen]))
        q, c, s = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "chunk_id": pa.array(c.astype(np.int64)), "score": pa.array(s.astype(float))})

    return rows.groupBy("b", "g").applyInArrow(of, "query_id long, chunk_id long, score double")
