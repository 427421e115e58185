"""Language of words and documents by a linear-chain conditional random field (operator 8)."""

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, slices

UNKNOWN = "und"
#: Hash places of the affix and n-gram features.
PLACES = 1 << 17
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The document and the dictionary place of each word, and the dictionary: lower-case runs between white space
    without what isn't a letter. Words without letters aren't given; null counts as empty."""
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    encoded = parts.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(encoded.dictionary, r"\P{L}+", "").dictionary_encode()
    place = bare.indices.to_numpy()[encoded.indices.to_numpy()] if len(encoded.dictionary) else np.zeros(0, np.int32)
    names = bare.dictionary.to_pylist()
    letters = np.array([len(x) > 0 for x in names], bool)
    keep = letters[place] if len(names) else np.zeros(0, bool)
    fresh = np.cumsum(letters) - 1
    return doc[keep], fresh[place[keep]], [x for x in names if x]


class Features:
    """Hashed features of words: all runs of two to four characters of ^word$. Those with ^ or $ are the affixes."""

    def __init__(self, words: list[str]):
        flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.array([len(w) + 2 for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), size)
        ids, of = [], []
        rolled = flat + np.uint64(1)
        for k in (2, 3, 4):
            rolled = rolled[: max(len(flat) - k + 1, 0)] * _FACTOR + flat[k - 1 :] + np.uint64(k)
            inside = word[: len(rolled)] == word[k - 1 :]
            mixed = (rolled ^ (rolled >> np.uint64(29))) * _FACTOR
            ids.append(((mixed[inside] >> np.uint64(40)) % np.uint64(PLACES)).astype(np.int32))
            of.append(word[: len(rolled)][inside].astype(np.int32))
        self.ids, self.word = np.concatenate(ids), np.concatenate(of)
        self.words = words

    def emissions(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the feature weights of each word, by label."""
        return np.stack([np.bincount(self.word, weights[self.ids, k], len(self.words)) for k in range(weights.shape[1])], 1)


def _flags(words: list[str], lexicon: dict[str, list[int]], labels: int) -> np.ndarray:
    """1 where a word is in a label's lexicon, else 0."""
    out = np.zeros((len(words), labels))
    for i, w in enumerate(words):
        if w in lexicon:
            out[i, lexicon[w]] = 1
    return out


@dataclass
class Field:
    """labels; weights of hashed features and of being in each label's lexicon; transitions; log shares of labels."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, list[int]]
    listed: np.ndarray
    moves: np.ndarray
    prior: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        out = Features(words).emissions(self.weights)
        return out + _flags(words, self.lexicon, len(self.labels)) @ self.listed

    def marginals(self, emission: np.ndarray, sizes: np.ndarray, block: int = 64) -> np.ndarray:
        """Posterior label probabilities of each word. sizes: how many words each sequence has (1 at least).

        Forward-backward. Sequences are cut into blocks, all blocks take a step at once, and transfer matrices carry
        the messages from block to block, so a long text costs few steps.
        """
        labels = len(self.labels)
        pieces = -(-sizes // block)
        first = np.cumsum(pieces) - pieces
        number = np.arange(len(emission)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row, column = np.repeat(first, sizes) + number // block, number % block
        e = np.ones((int(pieces.sum()), block, labels))
        e[row, column] = np.exp(emission - emission.max(1, keepdims=True))
        real = np.zeros(e.shape[:2], bool)
        real[row, column] = True
        move, still = np.exp(self.moves), np.eye(labels)
        start = np.zeros(len(e), bool)
        start[first] = True
        through = np.broadcast_to(still, (len(e), labels, labels)).copy()
        for s in range(block):
            step = through @ move * e[:, s, None, :]
            if s == 0:  # the first word of a sequence has no transition before it
                step[start] = (through * e[:, s, None, :])[start]
            step /= step.max((1, 2), keepdims=True)
            through = np.where(real[:, s, None, None], step, through)
        before = np.zeros((len(e), labels))
        before[first] = np.exp(self.prior)
        after = np.ones((len(e), labels))
        last = first + pieces - 1
        for k in range(1, int(pieces.max(initial=0))):
            at = first[pieces > k] + k
            before[at] = np.einsum("bi,bij->bj", before[at - 1], through[at - 1])
            before[at] /= before[at].sum(1, keepdims=True)
            at = last[pieces > k] - k
            after[at] = np.einsum("bij,bj->bi", through[at + 1], after[at + 1])
            after[at] /= after[at].max(1, keepdims=True)
        forward = np.empty_like(e)
        now = before
        for s in range(block):
            step = now @ move * e[:, s]
            if s == 0:
                step[start] = (now * e[:, s])[start]
            step /= step.sum(1, keepdims=True)
            now = np.where(real[:, s, None], step, now)
            forward[:, s] = now
        now = after
        for s in range(block - 1, -1, -1):
            forward[:, s] *= now
            step = (now * e[:, s]) @ move.T
            step /= step.max(1, keepdims=True)
            now = np.where(real[:, s, None], step, now)
        out = forward[row, column]
        return out / out.sum(1, keepdims=True)

    def words(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """For each word of the texts: its document, itself, and its label probabilities."""
        doc, place, names = split_words(texts)
        if not len(doc):
            return doc, [], np.zeros((0, len(self.labels)))
        sizes = np.bincount(doc, minlength=len(texts))
        return doc, [names[k] for k in place], self.marginals(self.emissions(names)[place], sizes[sizes > 0])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Label and score of each text: the label with the largest mean probability over words, the first of equals."""
        doc, place, names = split_words(texts)
        labels, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if len(doc) and self.labels:
            sizes = np.bincount(doc, minlength=len(texts))
            p = self.marginals(self.emissions(names)[place], sizes[sizes > 0])
            mean = np.stack([np.bincount(doc, p[:, k], len(texts)) for k in range(len(self.labels))], 1) / np.maximum(sizes, 1)[:, None]
            best = mean.argmax(1)
            for i in np.flatnonzero(sizes):
                labels[i] = self.labels[best[i]]
                score[i] = min(mean[i, best[i]], 1.0)
        return labels, score


def train(texts: list[str], langs: list[str], shares: dict[str, float], window: int = 32, most: int = 12_000, listed: int = 1000, rounds: int = 40, rate: float = 0.3, decay: float = 1e-5, part: int = 20_000, some: int = 1000) -> Field:
    """Learns weights and transitions by gradient ascent (Adagrad) on the likelihood of windows of words.

    Texts are cut into windows; the last of a text has what words are left, so that short texts and the tails of texts
    count. To half of them the beginning of another window is joined, so that transitions learn from code-switched
    text. At most `most` windows are used, from all labels in turn. All of them take part in every round, `some` at a
    time, and their words' features `part` words at a time, which holds the memory down.
    """
    labels = sorted(shares)
    prior = np.log(np.array([shares[x] for x in labels]))
    label_of = {x: k for k, x in enumerate(labels)}
    doc, place, names = split_words(pa.array(texts, pa.large_string()))
    y_of = np.array([label_of[x] for x in langs], np.int64)
    count = np.zeros((len(names), len(labels)), np.int64)
    np.add.at(count, (place, y_of[doc]), 1)
    lexicon: dict[str, list[int]] = {}
    for k in range(len(labels)):
        for w in np.argsort(-count[:, k], kind="stable")[:listed]:
            if count[w, k] >= 3:
                lexicon.setdefault(names[w], []).append(k)
    field = Field(labels, np.zeros((PLACES, len(labels))), lexicon, np.zeros((len(labels), len(labels))), np.zeros((len(labels), len(labels))), prior)
    sizes = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
    pieces = -(-sizes // window)
    begins = np.repeat(np.cumsum(sizes) - sizes, pieces) + window * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    ends = np.repeat(np.cumsum(sizes), pieces)
    rnd = np.random.default_rng(7)
    drawn = rnd.permutation(len(begins))
    turn = np.zeros(len(begins), np.int64)
    for k in range(len(labels)):
        own = np.flatnonzero(y_of[doc[begins[drawn]]] == k)
        turn[own] = np.arange(len(own))
    drawn = drawn[np.argsort(turn, kind="stable")[:most]]
    begins, length = begins[drawn], np.minimum(ends[drawn] - begins[drawn], window)
    if not len(begins) or len(labels) < 2:
        return field
    other = rnd.permutation(len(begins))
    cut = np.where(rnd.random(len(begins)) < 0.5, np.minimum(rnd.integers(2, window - 1, len(begins)), length[other]), 0)[:, None]
    at = np.arange(window)[None, :]
    early, real = at < cut, at < cut + length[:, None]
    source = np.where(early, begins[other][:, None] + at, begins[:, None] + np.where(real, at - cut, 0))
    x, y = place[source], y_of[doc[source]]
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(y.shape)
    words = [names[w] for w in used]
    del doc, place, names, count, source
    features = [Features(words[k : k + part]) for k in range(0, len(words), part)]
    flags = _flags(words, lexicon, len(labels))
    n, wide = y.size, len(labels)
    seen = np.zeros((n, wide), np.int8)
    seen[np.arange(n), y.ravel()] = real.ravel()
    moved = np.zeros((wide, wide))
    np.add.at(moved, (y[:, :-1][real[:, 1:]], y[:, 1:][real[:, 1:]]), 1)
    past = [np.full_like(v, 1e-8) for v in (field.weights, field.listed, field.moves)]
    uniform = np.zeros(wide)
    p = np.empty((len(x), window, wide))
    for _ in range(rounds):
        emission = np.concatenate([f.emissions(field.weights) for f in features]) + flags @ field.listed
        move, expected = np.exp(field.moves), np.zeros((wide, wide))
        for at in range(0, len(x), some):
            e, there = emission[x[at : at + some]], real[at : at + some]
            e = np.exp(e - e.max(2, keepdims=True))
            forward, backward = np.empty_like(e), np.ones_like(e)
            forward[:, 0] = np.exp(uniform) * e[:, 0]
            for s in range(window):
                if s:
                    forward[:, s] = np.where(there[:, s, None], forward[:, s - 1] @ move * e[:, s], forward[:, s - 1])
                forward[:, s] /= forward[:, s].sum(1, keepdims=True)
            for s in range(window - 2, -1, -1):
                backward[:, s] = np.where(there[:, s + 1, None], (backward[:, s + 1] * e[:, s + 1]) @ move.T, backward[:, s + 1])
                backward[:, s] /= backward[:, s].max(1, keepdims=True)
            for s in range(1, window):
                joint = forward[:, s - 1, :, None] * move[None] * (e[:, s] * backward[:, s])[:, None, :]
                expected += (joint * (there[:, s, None, None] / joint.sum((1, 2), keepdims=True))).sum(0)
            forward *= backward
            p[at : at + some] = forward * (there[:, :, None] / forward.sum(2, keepdims=True))
        apart = np.subtract(seen, p.reshape(n, wide), out=p.reshape(n, wide))
        error = np.stack([np.bincount(x.ravel(), apart[:, k], len(used)) for k in range(wide)], 1)
        pulled = np.zeros((PLACES, wide))
        for k, f in enumerate(features):
            for label in range(wide):
                pulled[:, label] += np.bincount(f.ids, error[k * part + f.word, label], PLACES)
        slope = (pulled, flags.T @ error, moved - expected)
        for value, total, g in zip((field.weights, field.listed, field.moves), past, slope):
            g = g / len(x) - decay * value
            total += g * g
            value += rate * g / np.sqrt(total)
    return field


def fit(docs: DataFrame, per_label: int = 800, longest: int = 10_000, **how) -> Field:
    """Learns from documents with text and lang that aren't held out.

    The shares of languages come from all of these documents. The weights come from a bounded sample: of each language
    up to `per_label` documents, chosen by a hash of id and text; of one with more than `longest` characters a run of so
    many, at a place that the hash chooses, without the words that the run's ends may cut. Languages may be of any
    number, and their texts short; an empty table gives a field without labels.
    """
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(4, 2))
    shares = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    spread, order = F.lit(False), F.xxhash64("doc_id", "text")
    for lang, n in shares.items():  # some four times as many as needed, so that few rows are sorted
        spread = spread | ((F.col("lang") == lang) & (F.pmod(order, F.lit(n)) < 4 * per_label))
    first = Window.partitionBy("lang").orderBy("order", "doc_id")
    over = F.length("text") - longest
    run = F.substring("text", F.pmod(order, F.greatest(over + 1, F.lit(1))).cast("int") + 1, F.lit(longest))
    piece = F.when(over <= 0, F.col("text")).otherwise(F.coalesce(F.nullif(F.regexp_replace(run, r"^\S+\s|\s\S*$", F.lit("")), F.lit("")), run))
    near = known.filter(spread).select("doc_id", "lang", order.alias("order"), piece.alias("text"))
    sample = near.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_label).select("text", "lang")
    shares = {k: n / total for k, n in shares.items()}

    def of(batches):
        rows = sorted((x, t) for batch in batches for t, x in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()))
        field = train([t for _, t in rows], [x for x, _ in rows], shares, **how)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(field)], pa.binary())], names=["field"])

    # one task trains, on the bounded sample; what the driver gets has the size of the weights
    found = sample.repartition(1).mapInArrow(of, "field binary").first()
    return pickle.loads(found.field) if found else train([], [], shares, **how)


def predict(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; held_out says that its label wasn't learned from.

    A null text or one without letters gets `und` with score 0, and so does every text where nothing could be learned.
    Repeated rows get a row each. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)  # its size follows the number of languages, not the rows

    def of(batches):
        for batch in slices(batches):
            labels, score = shared.value.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(labels, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(4, 2).alias("held_out"), "text").mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, position, word, lang and probability of every word with a letter."""

    def of(batches):
        for batch in slices(batches, rows=200):
            doc, words, p = field.words(batch.column("text"))
            if len(doc):
                number = np.arange(len(doc)) - np.searchsorted(doc, doc)
                ids = batch.column("doc_id").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int64()), pa.array(words, pa.string()), pa.array([field.labels[k] for k in p.argmax(1)], pa.string()), pa.array(p.max(1))], names=["doc_id", "position", "word", "lang", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, position long, word string, lang string, p double")


def identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The documents, as they are, of which some language has a score of at least `least`; learned from themselves."""
    field = docs.sparkSession.sparkContext.broadcast(fit(docs))

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = slices([pa.RecordBatch.from_arrays([texts], names=["text"])], rows=200, volume=1 << 20)
            yield pa.array(np.concatenate([np.zeros(0), *[field.value.predict(x.column("text"))[1] for x in parts]]))

    return docs.filter(of(F.col("text")) >= F.lit(max(least, 1e-12)))
