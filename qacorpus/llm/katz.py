"""Language-model scores by Katz backoff (operator 6)."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, distinct, held_out, pack, pack_all, slices, stored, unpack, unpack_all

#: Hashes of the end of a text and of what stands before its first word: of strings that are no words.
END, START = xxhash.xxh64_intdigest(b""), xxhash.xxh64_intdigest(b" ")
#: Name of the start of a text among n-grams, which else have a bucket and a place there.
FIRST = 1 << 62
#: Counts above this aren't discounted.
TOP = 5

MESSAGE = "bucket int, chunk long, message binary"
CHUNK = "chunk long, docs array<long>, held binary, sizes binary, vocabulary binary, counts binary, tokens binary"


def _chunk(number: int, docs: list, held: list, sizes: list, words: list[np.ndarray]) -> pa.RecordBatch:
    size, flags = np.array(sizes, np.int64), np.array(held, bool)
    vocabulary, tokens = distinct(np.concatenate(words))
    counts = np.bincount(tokens, np.repeat(~flags, size), len(vocabulary)).astype(np.int64)
    blobs = [flags.tobytes(), pack(size), pack_all(_steps(vocabulary.view(np.int64))), pack(counts), pack(tokens)]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in blobs)], names=["chunk", "docs", "held", "sizes", "vocabulary", "counts", "tokens"])


def chunks(docs: DataFrame, size: int = 550_000) -> DataFrame:
    """Documents as word numbers: some `size` tokens to a row, with the 64-bit hashes of its words in order.

    The texts' A-Z become small, words lie between ASCII white space, and each text has one end token.
    """

    def of(batches):
        part, number = TaskContext.get().partitionId(), 0
        held: tuple[list, list, list, list] = ([], [], [], [])
        have = 0
        for batch in slices(batches, rows=1000, volume=1 << 20):
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(split.offsets.to_numpy()))
            flat = split.flatten()
            real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
            encoded = flat.filter(pa.array(real)).dictionary_encode()
            of_word = np.array([xxhash.xxh64_intdigest(w) for w in encoded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
            n = np.bincount(doc[real], minlength=batch.num_rows)
            tokens = np.full(int(n.sum()) + batch.num_rows, END, np.uint64)
            if len(of_word):
                word = np.ones(len(tokens), bool)
                word[np.cumsum(n + 1) - 1] = False
                tokens[word] = of_word[encoded.indices.to_numpy()]
            for column, values in zip(held, (batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), (n + 1).tolist(), [tokens])):
                column += values
            have += len(tokens)
            if have >= size:
                yield _chunk((part << 24) + number, *held)
                held, have, number = ([], [], [], []), 0, number + 1
        if have:
            yield _chunk((part << 24) + number, *held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(5, 1).alias("held_out"), "text").mapInArrow(of, CHUNK)


@dataclass
class Discounts:
    """What remains of a count: Good-Turing for counts up to TOP, or half a count less where the counts of counts
    don't allow that."""

    factor: np.ndarray | None

    @classmethod
    def of(cls, having: np.ndarray) -> Discounts:
        """having[r]: how many n-grams occur r times, up to TOP + 1."""
        for top in range(TOP, 0, -1):
            n = having[1 : top + 2].astype(float)
            if (n <= 0).any():
                continue
            r = np.arange(1, top + 1)
            common = (top + 1) * n[top] / n[0]
            factor = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common) if common < 1 else np.zeros(top)
            if ((factor > 0) & (factor < 1)).all():
                return cls(np.concatenate([[1.0], factor, np.ones(TOP - top)]))
        return cls(None)

    def reduced(self, counts: np.ndarray) -> np.ndarray:
        if self.factor is None:
            return np.maximum(counts - 0.5, 0)
        return counts * np.where(counts <= TOP, self.factor[np.minimum(counts, TOP)], 1.0)

    @property
    def top(self) -> int:
        """The largest count that is discounted."""
        return TOP + 1 if self.factor is None else int(np.flatnonzero(self.factor < 1)[-1])

    def off(self, having: np.ndarray) -> np.ndarray:
        """What is taken off all counts together. having[r - 1]: how many n-grams occur r times; last: more than TOP."""
        counts = np.arange(1, TOP + 1)
        return (counts - self.reduced(counts)) @ having[:TOP] + (0.5 * having[TOP] if self.factor is None else 0.0)


@dataclass
class Unigrams:
    tokens: int
    types: int
    discounts: Discounts
    unknown: float

    def p(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; of the one unknown word where it's 0."""
        return np.where(counts > 0, self.discounts.reduced(counts) / max(self.tokens, 1), self.unknown)


def _by_bucket(bucket: np.ndarray):
    """Each bucket that occurs and the places of its entries, in order."""
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    ordered = bucket[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return zip(ordered[first].tolist(), np.split(order, first[1:]))


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences of neighbours, small ones as small numbers from 0 on: for arrays that mostly grow."""
    d = np.diff(values.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def _summed(steps: np.ndarray) -> np.ndarray:
    z = steps.astype(np.uint64)
    return np.cumsum((z >> np.uint64(1)).astype(np.int64) ^ -(z & np.uint64(1)).astype(np.int64))


REPLY = "chunk long, bucket int, reply binary, stats array<long>"


def _replied(group: pa.Table, replies: list[bytes], stats: np.ndarray) -> pa.Table:
    """A row for each chunk of a bucket, and one with the bucket's sums, at one of many chunk numbers below 0."""
    n, bucket = group.num_rows, group.column("bucket")[0].as_py()
    columns = [[*group.column("chunk").to_pylist(), -1 - bucket % 1024], [bucket] * (n + 1), [*replies, None], [None] * n + [stats.tolist()]]
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=["chunk", "bucket", "reply", "stats"])


def _by_chunk(replies: DataFrame, name: str, many: int, last: bool = False) -> tuple[DataFrame, np.ndarray]:
    """The replies of all buckets to each chunk and the sums over buckets; stored by chunk, but for the last level, that
    is read only once."""
    listed = F.collect_list(F.struct("bucket", "reply")).alias(name)
    if last:
        table = stored(replies, name)
        told = table.filter("chunk >= 0").groupBy("chunk").agg(listed)
    else:
        sums = F.array(*[F.sum(F.col("stats")[k]) for k in range(many)]).alias("stats")
        table = bucketed(replies.groupBy("chunk").agg(listed, sums), name, "chunk")
        told = table.select("chunk", name)
    found = table.filter("chunk < 0").select(*[F.sum(F.col("stats")[k]) for k in range(many)]).first()
    return told, np.array([x or 0 for x in found], np.int64)


def _unigrams(table: DataFrame, bits: int) -> tuple[DataFrame, Unigrams]:
    """What each chunk is told of its own words, and the sums over all words. Buckets are ranges of the words' hashes."""

    def send(batches):
        for batch in batches:
            for chunk, words, counts in zip(*[batch.column(c).to_pylist() for c in ("chunk", "vocabulary", "counts")]):
                words, counts = _summed(unpack_all(words)[0]).view(np.uint64), unpack(counts)
                edge = np.searchsorted(words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(edge))
                low = words & np.uint64((1 << (64 - bits)) - 1)
                messages = [pack_all(_steps(low[edge[b] : edge[b + 1]]), counts[edge[b] : edge[b + 1]]) for b in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunk] * len(used), pa.int64()), pa.array(messages, pa.binary())], names=["bucket", "chunk", "message"])

    def merge(group: pa.Table) -> pa.Table:
        words, counts = zip(*map(unpack_all, group.column("message").to_pylist()))
        every, place = distinct(np.concatenate([_summed(x) for x in words]))
        total = np.bincount(place, np.concatenate(counts), len(every)).astype(np.int64)
        index = np.maximum(np.cumsum(total > 0) - 1, 0)
        replies = [pack_all(total[p], _steps(index[p])) for p in np.split(place, np.cumsum(list(map(len, words)))[:-1])]
        return _replied(group, replies, np.append(total.sum(), np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)))

    sent = table.select("chunk", "vocabulary", "counts").mapInArrow(send, MESSAGE)
    told, sums = _by_chunk(sent.groupBy("bucket").applyInArrow(merge, REPLY), "level1", TOP + 4)
    tokens, having = int(sums[0]), sums[2:]
    discounts = Discounts.of(np.append(0, having[: TOP + 1]))
    off = float(discounts.off(np.append(having[:TOP], having[TOP:].sum())))
    return told, Unigrams(tokens, int(having.sum()), discounts, off / tokens if tokens else 1.0)


@dataclass
class _Level:
    """What a chunk knows of its n-grams of one length once the model has answered."""

    ids: np.ndarray  # of each distinct n-gram: its bucket and its place there; the last one is the start of a text
    totals: np.ndarray  # how often training has each
    place: np.ndarray  # of each token: the n-gram that it ends, or -1 where training has none
    over: np.ndarray  # of each token: what a count after its context is divided by
    p: np.ndarray  # of each token: its probability after that context

    @property
    def counts(self) -> np.ndarray:
        """How often training has the n-gram that each token ends."""
        return np.where(self.place >= 0, self.totals[self.place], 0)


class _Chunk:
    """The tokens of a chunk and its level 1."""

    def __init__(self, row: dict, model: Unigrams, train_docs: int):
        self.held = np.frombuffer(row["held"], bool)
        self.sizes = unpack(row["sizes"])
        self.tokens = unpack(row["tokens"]).astype(np.int32)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.held_token = np.repeat(self.held, self.sizes)
        replies = [(x["bucket"], *unpack_all(x["reply"])) for x in sorted(row["level1"], key=lambda x: x["bucket"])]
        total = np.concatenate([t for _, t, _ in replies])
        self.number = np.concatenate([_name(b, _summed(k)) for b, _, k in replies])
        self.first = _Level(np.append(self.number, FIRST), np.append(total, train_docs), self.tokens, np.full(len(self.tokens), max(model.tokens, 1), np.int64), model.p(total)[self.tokens])


class _Asked:
    """The next level of a chunk: its n-grams whose contexts and endings training has, and the buckets of the model
    that know of them.

    N-grams with one context are one bucket's, unless training has it more than `hot` times: then they are dealt to
    several by their last words, and the context is asked for in each of these. How much of a context's mass is left is
    asked for only where a document that isn't learned from has it, for in all others training has every n-gram.
    """

    def __init__(self, chunk: _Chunk, below: _Level, length: int, buckets: int, hot: int):
        self.below, self.start = below, len(below.ids) - 1
        tokens, width = chunk.tokens, len(chunk.number)
        context = np.empty_like(below.place)
        context[1:] = below.place[:-1]
        context[chunk.begins] = self.start
        known = (context >= 0) & (below.totals[context] > 0)
        self.context = np.where(known, context, -1)
        ending = below.counts
        seen = known & (ending > 0)
        keys, place = distinct(context[seen] * np.int64(width) + tokens[seen])
        self.place = np.full(len(tokens), -1, np.int32)
        self.place[seen] = place
        self.of = (keys // width).astype(np.int32)  # the context of each n-gram
        word = (keys % width).astype(np.int32)
        del keys
        self.count = np.bincount(place, ~chunk.held_token[seen], len(word)).astype(np.int64)
        self.ending = np.empty(len(word), np.int64)
        self.ending[place] = ending[seen]
        self.number = chunk.number[word]
        self.over_below = np.ones(self.start + 1, np.int64)
        self.over_below[context[known]] = below.over[known]
        wanted = np.zeros(self.start + 1, bool)
        wanted[context[known & chunk.held_token]] = True
        asks = np.zeros(self.start + 1, bool)
        asks[context[known]] = True
        asked = np.flatnonzero(asks)
        fan = np.minimum(-(-below.totals // hot), buckets)
        own = _mixed(below.ids) % buckets if length == 2 else np.where(below.ids == FIRST, 0, below.ids >> 32)  # beyond two words: where the context is known
        self.bucket = ((own[self.of] + _mixed(self.number) % np.maximum(fan[self.of], 1)) % buckets).astype(np.int32)
        some = fan[asked]
        self.asks = np.repeat(asked, some)
        self.asks_bucket = (np.repeat(own[asked], some) + np.arange(int(some.sum())) - np.repeat(np.cumsum(some) - some, some)) % buckets
        self.wanted = wanted[self.asks]

    def messages(self):
        """For each bucket: the places of its n-grams, and of the contexts that are asked for there."""
        grams, asks = dict(_by_bucket(self.bucket)), dict(_by_bucket(self.asks_bucket))
        none = np.zeros(0, np.int64)
        return [(b, grams.get(b, none), asks[b]) for b in sorted(asks)]  # an n-gram's context is asked for there too

    def message(self, grams: np.ndarray, asks: np.ndarray) -> bytes:
        contexts = self.asks[asks]
        fan = np.searchsorted(self.of[grams], contexts, side="right") - np.searchsorted(self.of[grams], contexts)
        return pack_all(_steps(self.below.ids[contexts]), self.over_below[contexts], self.wanted[asks], fan, self.number[grams], self.count[grams], self.ending[grams])

    def answered(self, replies: list[dict], discounts: Discounts) -> _Level:
        """The level with its probabilities: of the n-gram where training has it, else the backoff weight times the
        probability one level below."""
        ids, totals = np.zeros(len(self.of) + 1, np.int64), np.zeros(len(self.of) + 1, np.int64)
        ids[-1], totals[-1] = FIRST, self.below.totals[-1]
        least = np.full(self.start + 1, TOP + 1, np.int64)
        by_bucket = {r["bucket"]: r["reply"] for r in replies}
        held, sums = [np.zeros(0, np.int64)], [np.zeros((TOP + 2, 0))]
        for b, grams, asks in self.messages():
            total, index, low, many, lower = unpack_all(by_bucket[b])
            totals[grams] = total
            if len(index):
                ids[grams] = _name(b, _summed(index))
            contexts = self.asks[asks]
            least[contexts] = np.minimum(least[contexts], low)
            held.append(contexts[self.wanted[asks]])
            sums.append(np.append(many.astype(float), lower).reshape(TOP + 2, -1))
        held, sums = np.concatenate(held), np.concatenate(sums, 1)
        *having, lower = [np.bincount(held, x, self.start + 1) for x in sums]
        whole = self.below.totals
        over = whole + (least > discounts.top)  # a context that nothing was taken from: one more
        kept = whole - discounts.off(np.array(having))
        weight = (1 - kept / np.maximum(over, 1)) / np.maximum(1 - lower, 1e-300)
        known = self.context >= 0
        p = np.where(known, weight[self.context], 1.0) * self.below.p
        count = np.where(self.place >= 0, totals[self.place], 0)
        over_token = np.where(known, over[self.context], 1)
        hit = count > 0
        p[hit] = discounts.reduced(count[hit]) / over_token[hit]
        return _Level(ids, totals, self.place, over_token, p)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(33)).astype(np.int64)


def _name(bucket: int, index: np.ndarray) -> np.ndarray:
    return index | bucket << 32


def _merge(below: Discounts, last: bool):
    """A bucket of the model: sums the counts of n-grams over chunks and answers each chunk. Names of the n-grams are
    for the next level."""

    def merge(group: pa.Table) -> pa.Table:
        parts = list(zip(*map(unpack_all, group.column("message").to_pylist())))
        ids = np.concatenate([_summed(x) for x in parts[0]])
        over, _, fan, word, count, ending = (np.concatenate([x.astype(np.int64) for x in p]) for p in parts[1:])
        contexts, k = distinct(ids)
        over_of = np.empty(len(contexts), np.int64)
        over_of[k] = over
        row = np.repeat(k, fan)
        words, w = distinct(word)
        keys, place = distinct(row * np.int64(max(len(words), 1)) + w)
        total = np.bincount(place, count, len(keys)).astype(np.int64)
        row = keys // max(len(words), 1)
        of_ending = np.empty(len(keys), np.int64)
        of_ending[place] = ending
        having = np.stack([np.bincount(row[total == r], minlength=len(contexts)) for r in range(1, TOP + 1)] + [np.bincount(row[total > TOP], minlength=len(contexts))])
        least = np.where(having[:TOP].any(0), having[:TOP].astype(bool).argmax(0) + 1, TOP + 1)
        lower = np.bincount(row, np.where(total > 0, below.reduced(of_ending) / over_of[row], 0.0), len(contexts))
        index = np.maximum(np.cumsum(total > 0) - 1, 0)
        replies, at, gram = [], 0, 0
        for own, want, n in zip(parts[0], parts[2], map(len, parts[4])):
            own = k[at : at + len(own)]
            some = own[want > 0]
            mine = place[gram : gram + n]
            replies.append(pack_all(total[mine], _steps(index[:0] if last else index[mine]), least[own], having[:, some].ravel(), lower[some]))
            at, gram = at + len(own), gram + n
        return _replied(group, replies, np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[: TOP + 2])

    return merge


def score(docs: DataFrame, order: int = 3, size: int = 550_000, per_bucket: int = 1_000_000, hot: int = 200_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Learned from documents whose crc32 of the id is not 1 modulo 5, those without an id among them. A null text counts
    as empty: one end token. Repeated rows count and are scored each. Without training tokens every word is the unknown
    one, with probability 1. Other columns of docs aren't read.

    P(w | h), for the order - 1 words h before w, is the discounted share of c(h, w) in c(h), or, where training lacks
    the n-gram, a(h) P(w | h') with h' = h without its first word, and P(w | h') where training lacks h. P(w) is the
    discounted share of c(w) in all tokens, or the mass that discounting left, which all unknown words share as one.
    a(h) makes the probabilities of the training words and the unknown one sum to 1 after every h. Each length of
    n-grams has its own discounts. A text has order - 1 starts in front. Words are known by
    64-bit hashes, longer n-grams by the place that their bucket gave them.

    Texts become chunks of word numbers, stored in buckets of the chunk so that they aren't shuffled again. Level by
    level a chunk sends its distinct n-grams with their training counts to buckets of the model; a bucket sums them and
    tells each chunk what it asked for; these tables stay in the shared folder, by chunk. So counts are summed before
    they are shuffled, an n-gram as common as can be is one entry of a chunk, and a context that occurs over `hot` times
    (more where there are more tokens than 10 ** 8) is dealt to several buckets by the word behind it.
    """
    table = bucketed(chunks(docs, size), "chunks", "chunk")

    def sizes(batches):
        for batch in batches:
            for n, held in zip(batch.column("sizes").to_pylist(), batch.column("held").to_pylist()):
                n = unpack(n)
                yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())], pa.int64()), pa.array([len(n) - sum(held)], pa.int64())], names=["n", "docs"])

    whole, train_docs = table.select("sizes", "held").mapInArrow(sizes, "n long, docs long").agg(F.sum("n"), F.sum("docs")).first()
    train_docs = train_docs or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((whole or 0) / per_bucket))
    hot = max(hot, int(20 * math.sqrt(whole or 0))) if whole and whole > 10**8 else hot
    words, model = _unigrams(table, max(3, math.ceil(math.log2(buckets))))
    answers, discounts = [words], [model.discounts]

    def asking(known: list[Discounts]):
        def send(batches):
            for batch in batches:
                for row in rows_of(batch):
                    chunk, last = levels(row, known)
                    asked = _Asked(chunk, last, len(known) + 1, buckets, hot)
                    found = [(b, asked.message(grams, asks)) for b, grams, asks in asked.messages()]
                    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([row["chunk"]] * len(found), pa.int64()), pa.array([m for _, m in found], pa.binary())], names=["bucket", "chunk", "message"])

        return send

    def rows_of(batch):
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}

    def levels(row: dict, known: list[Discounts]) -> tuple[_Chunk, _Level]:
        """The chunk and the highest level that the model has answered."""
        chunk = _Chunk(row, model, train_docs)
        last = chunk.first
        for n, d in enumerate(known[1:], 2):
            last = _Asked(chunk, last, n, buckets, hot).answered(row[f"level{n}"] or [], d)
        return chunk, last

    def told(columns: list[str]) -> DataFrame:
        rows = table.select(*columns)
        for k, answer in enumerate(answers):
            rows = rows.join(answer, "chunk", "left" if k else "inner")
        return rows

    for n in range(2, order + 1):
        sent = told(["chunk", "held", "sizes", "tokens"]).mapInArrow(asking(list(discounts)), MESSAGE)
        answer, sums = _by_chunk(sent.groupBy("bucket").applyInArrow(_merge(discounts[-1], n == order), REPLY), f"level{n}", TOP + 2, n == order)
        answers.append(answer)
        discounts.append(Discounts.of(sums))

    def result(batches):
        for batch in batches:
            for row in rows_of(batch):
                chunk, last = levels(row, discounts)
                count = chunk.first.counts
                base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
                add = lambda x: pa.array(np.add.reduceat(x, chunk.begins))
                columns = [pa.array(chunk.sizes), add((count > 0).astype(np.int64)), pa.array([model.tokens] * len(chunk.begins), pa.int64()), add(base), add(np.log10(last.p))]
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(chunk.held), *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told(["chunk", "docs", "held", "sizes", "tokens"]).mapInArrow(result, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
