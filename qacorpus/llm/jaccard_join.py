"""N-gram Jaccard join by chosen paths (operator 10)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, slices, stored
from .components import components

#: Leaves of more than this part of all rows, so at most this many, are joined by broadcast.
HOT = 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float, least: float, depth: int) -> int:
    """Runs after which a pair of that similarity has met with that probability, even if each run splits to the end."""
    return math.ceil(math.log(1 - recall) / math.log(1 - least**depth))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of so many lower-case words between white space.

    A shorter text is one shingle; a text without words, or null, has none.
    """
    parts = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    lengths = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten()
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), lengths)[filled]
    encoded = flat.filter(pa.array(filled)).dictionary_encode()
    of_word = np.array([xxhash.xxh64_intdigest(w) for w in encoded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64)
    word = of_word[encoded.indices.to_numpy()] if len(of_word) else np.zeros(0, np.uint64)
    ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(texts))))
    rolled = np.zeros(max(len(word) - words + 1, 0), np.uint64)
    for k in range(words):
        rolled = rolled * _STEP + word[k : k + len(rolled)]
    rolled = _mix(rolled)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= words:
            own = np.sort(rolled[a : b - words + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                short = short * _STEP + word[k]
            out.append(_mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _packed(tokens: np.ndarray) -> bytes:
    """Sorted hashes by their upper 48 bits."""
    return tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def _signatures(docs: DataFrame, words: int, places: int) -> DataFrame:
    """doc_id, the size and two halves of a digest of the shingle set, and the smallest shingle under each of `places` hashes."""
    rnd = np.random.default_rng(20240501)
    times = rnd.integers(1, 2**63, places, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rnd.integers(0, 2**63, places, dtype=np.uint64)

    def of(batches):
        for batch in slices(batches, rows=1000, volume=2 << 20):
            sets = shingle_sets(batch.column("text"), words)
            n = np.array([len(s) for s in sets], np.int64)
            full = n > 0
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            flat = np.concatenate(sets)
            low = np.zeros((len(sets), places), np.uint64)
            if len(flat):
                begin = np.cumsum(n[full]) - n[full]
                for k in range(places):
                    low[full, k] = np.minimum.reduceat(_mix(flat * times[k] + plus[k]), begin)
            low_list = pa.ListArray.from_arrays(np.arange(0, low.size + 1, places, dtype=np.int32), pa.array(low.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(halves[:, 0]), pa.array(halves[:, 1]), low_list], names=["doc_id", "n", "d1", "d2", "low"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, n long, d1 long, d2 long, low array<long>")


def _sized(rows: DataFrame, sizes: DataFrame, hot: int) -> DataFrame:
    """rows with what sizes has for their leaf, `many` among it; leaves that sizes hasn't are left out.

    Leaves of more than `hot` rows are joined by broadcast, so that no task gets all rows of one: where `hot` is a share
    of all rows, there are no more of them than that share's inverse. All others are joined by a shuffle, to which a
    hot leaf's rows go by their own numbers, and find nothing.
    """
    more = [c for c in sizes.columns if c != "leaf"]
    large = F.broadcast(sizes.filter(F.col("many") > hot).select("leaf", *[F.col(c).alias(f"hot_{c}") for c in more]))
    marked = rows.join(large, "leaf", "left").withColumn("key", F.when(F.col("hot_many").isNull(), F.col("leaf")).otherwise(F.xxhash64("tid", "run")))
    rest = sizes.filter(F.col("many") <= hot).withColumnRenamed("leaf", "key")
    both = marked.join(rest, "key", "left").withColumns({c: F.coalesce(f"hot_{c}", F.when(F.col("hot_many").isNull(), F.col(c))) for c in more})
    return both.filter("many is not null").select(*rows.columns, *more)


def _leaves(texts: DataFrame, runs: int, depth: int, small: int, hot: int) -> DataFrame:
    """(tid, run, leaf): where each distinct text ends in each run; texts that end alone aren't given.

    A run starts with one bucket. A bucket of more than `small` texts splits by the token that comes first in each set
    under the run's hash of that level, so two sets go on together with a probability of their similarity. After
    `depth` levels a bucket stays as it is, of whatever size.
    """
    steps = F.array(*[F.struct(F.lit(r).alias("run"), F.array(*[F.col("low")[r * depth + k] for k in range(depth)]).alias("token")) for r in range(runs)])
    rows = texts.select("tid", F.explode(steps).alias("s")).select("tid", "s.run", "s.token", F.xxhash64("s.run", F.col("s.token")[0]).alias("leaf"))
    out = None
    for level in range(depth):
        count = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
        shared = _sized(rows, count, hot)
        last = level == depth - 1
        ended = (shared if last else shared.filter(F.col("many") <= small)).select("tid", "run", "leaf")
        out = ended if out is None else out.union(ended)
        if not last:
            rows = shared.filter(F.col("many") > small).select("tid", "run", "token", F.xxhash64("leaf", F.col("token")[level + 1]).alias("leaf"))
    return out


def _linked(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of sets have at least that Jaccard similarity: intersections from products of 0/1 matrices."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    values, place = distinct(np.concatenate(sets))
    row = np.repeat(np.arange(m), size)
    shared = np.bincount(place, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    row, place = row[keep], column[place[keep]]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    both = np.zeros((m, m), np.float32)
    width = max(64, (8 << 20) // (4 * m))
    for at in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [at, at + width])
        part = np.zeros((m, width), np.float32)
        part[row[a:b], place[a:b] - at] = 1
        both += part @ part.T
    union = size[:, None] + size[None, :] - both
    return both >= least * union - 1e-9


def _verified(tasks: DataFrame, least: float) -> DataFrame:
    """(tid, links, root) for the texts of each pair of blocks: documents linked to it here, and the smallest text that links lead to."""

    def group(rows: list[tuple]) -> tuple[list, list, list]:
        run, low, high = rows[0][1], rows[0][3], rows[0][4]
        tid = np.array([r[5] for r in rows])
        copies = np.array([r[6] for r in rows], np.int64)
        block = np.array([r[7] for r in rows])
        linked = _linked([_unpacked(r[9]) for r in rows], least)
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= block[:, None] != block[None, :]
        if run:
            paths = np.array([[np.nan if x is None else i for i, x in enumerate(r[8][:run])] for r in rows])
            ends = np.array([[0 if x is None else x for x in r[8][:run]] for r in rows], np.int64)
            for t in range(run):  # a pair that met in an earlier run was counted there
                there = ~np.isnan(paths[:, t])
                linked &= ~((ends[:, t][:, None] == ends[:, t][None, :]) & there[:, None] & there[None, :])
        some = np.flatnonzero(linked.any(1))
        root = tid.copy()
        while len(some):
            lowest = np.where(linked[some], root[None, :], np.iinfo(np.int64).max).min(1)
            lower = np.minimum(root[some], lowest)
            if (lower == root[some]).all():
                break
            root[some] = lower
        return tid[some].tolist(), (linked[some] @ copies).tolist(), root[some].tolist()

    def of(batches):
        out: tuple[list, list, list] = ([], [], [])
        key, held = None, []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["tid", "links", "root"])

        for batch in slices(batches, 256, column=None):  # rows become Python's own a few at a time
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[:5] != key:
                    if len(held) > 1:
                        for x, y in zip(out, group(held)):
                            x += y
                    key, held = row[:5], []
                if not held or held[-1][5] != row[5]:  # a repeated row of a document brings its text again
                    held.append(row)
            if len(out[0]) > 10_000:
                yield emit()
                out = ([], [], [])
        if len(held) > 1:
            for x, y in zip(out, group(held)):
                x += y
        yield emit()

    columns = ["task", "run", "leaf", "low", "high", "tid", "copies", "block", "paths", "tokens"]
    dealt = tasks.withColumn("task", F.xxhash64("run", "leaf", "low", "high")).repartition("task").sortWithinPartitions("task", "run", "leaf", "low", "high", "tid")
    return dealt.select(*columns).mapInArrow(of, "tid long, links long, root long")


def join(docs: DataFrame, least: float = 0.8, words: int = 5, recall: float = 0.9999, depth: int = 3, small: int = 256, block: int = 1024, volume: int = 1 << 20, hot: int = HOT, copied: int = 1000) -> DataFrame:
    """doc_id, class_id and n_links of every document.

    Documents are linked if the Jaccard similarity of their shingle sets is at least `least`. class_id is the smallest
    doc_id that links lead to, n_links the number of other documents linked, equal ones included. A text without words
    (null, empty) is linked to nothing and is its own class. Repeated rows count as documents of their own and give a
    row each; rows without an id have a null class and no links. Other columns of docs aren't read.

    Equal sets become one text, named by a 64-bit digest, that carries how many documents have it. Runs of chosen
    paths find the leaves in which texts meet; a leaf whose texts all met in one earlier run is left out. A leaf of
    any size is cut into blocks of at most about `block` texts and `volume` shingles, and each pair of blocks is
    compared by itself, exactly, on sets made again from the texts: no task holds more than two blocks. Only sums and
    links to a root leave a comparison, so rows grow with the texts in leaves and not with their pairs. Leaves of over a
    share of 1 / `hot` of all rows are joined by broadcast and so is the class of texts with over 1 / `copied` of all
    documents, of which there can be no more than `hot` and `copied`: no task gets all rows of one.
    """
    runs = runs_for(recall, least, depth)
    rows = stored(_signatures(docs, words, runs * depth), "signatures")
    named = rows.filter("n > 0 and doc_id is not null")
    texts = stored(
        named.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("low").alias("low")).withColumnRenamed("d1", "tid"),
        "texts",
    )
    hot = max(1, texts.count() * runs // hot)
    leaves = _leaves(texts, runs, depth, small, hot)
    by_run = F.map_from_entries(F.collect_list(F.struct("run", "leaf")))
    paths = stored(leaves.groupBy("tid").agg(by_run.alias("by_run")).select("tid", F.array(*[F.col("by_run")[r] for r in range(runs)]).alias("paths")), "paths")
    met = paths.join(texts.select("tid", "doc_id", "copies", "n"), "tid").select("tid", "doc_id", "copies", "n", "paths", F.posexplode("paths").alias("run", "leaf")).filter("leaf is not null")
    earlier = F.lit(False)
    for t in range(runs):
        end = F.col("paths")[t]
        earlier = earlier | ((F.count(end) == F.count(F.lit(1))) & (F.min(end) == F.max(end)) & (F.lit(t) < F.col("run")))
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("n") / volume)).cast("int")
    fresh = stored(met.groupBy("run", "leaf").agg(parts.alias("blocks"), F.count(F.lit(1)).alias("many"), earlier.alias("earlier")).filter("not earlier").select("leaf", "blocks", "many"), "leaves")
    held = stored(_sized(met, fresh, hot).drop("many"), "held")

    def sets(batches):
        for batch in slices(batches, rows=1000, volume=2 << 20):
            found = shingle_sets(batch.column("text"), words)
            own = [i for i, (s, t) in enumerate(zip(found, batch.column("tid").to_pylist())) if len(s) and xxhash.xxh3_128_digest(s.tobytes())[:8] == t.to_bytes(8, "little", signed=True)]
            kept = [batch.column(c).take(pa.array(own, pa.int64())) for c in ("tid", "copies", "paths", "todo")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([_packed(found[i]) for i in own], pa.binary())], names=["tid", "copies", "paths", "todo", "tokens"])

    placed = held.withColumn("block", F.pmod(F.xxhash64("tid", "run"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    pairs = placed.select("tid", "doc_id", "copies", "run", "leaf", "paths", "block", other)
    step = F.struct("run", "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block")
    todo = pairs.groupBy("tid", "doc_id", "copies", "paths").agg(F.collect_list(step).alias("todo"))
    kinds = "todo array<struct<run:int,leaf:bigint,low:int,high:int,block:int>>"
    with_text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(todo, "doc_id").select("tid", "copies", "paths", "todo", "text")
    tokens = with_text.mapInArrow(sets, f"tid long, copies long, paths array<long>, {kinds}, tokens binary")
    tasks = tokens.select("tid", "copies", "paths", "tokens", F.explode("todo").alias("t")).select("tid", "copies", "paths", "tokens", "t.*")
    found = stored(_verified(tasks, least), "links")
    links = found.groupBy("tid").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("tid").alias("u"), F.col("root").alias("v")))
    linked = texts.select("tid", "d2", "doc_id", "copies").join(links, "tid", "left").join(label.withColumnRenamed("id", "tid"), "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    smallest = linked.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    full = stored(linked.join(smallest, "label").select(F.col("tid").alias("d1"), "d2", "copies", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    many = full.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] / copied
    large = F.broadcast(full.filter(F.col("copies") > many).select("d1", "d2", F.col("class_id").alias("hot_class"), F.col("n_links").alias("hot_links")))
    marked = named.select("doc_id", "d1", "d2").join(large, ["d1", "d2"], "left")
    hot_class = marked.filter("hot_class is not null").select("doc_id", F.col("hot_class").alias("class_id"), F.col("hot_links").alias("n_links"))
    rest = marked.filter("hot_class is null").join(full.filter(F.col("copies") <= many), ["d1", "d2"]).select("doc_id", "class_id", "n_links")
    with_class = rest.union(hot_class)
    alone = rows.filter("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return with_class.union(alone)


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The document with the smallest id of each class of join(), once; documents without an id all stay.

    Rows with one id are one document: it goes if any of them is linked to a smaller id; else the row with the smallest
    text stays, a null one before all others.
    """
    gone = join(docs, **how).filter("doc_id <> class_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text"), F.xxhash64(*docs.columns))).alias("row")
    return rest.filter("doc_id is not null").groupBy("doc_id").agg(first).select("row.*").union(rest.filter("doc_id is null"))
