"""Best-fit packing of documents into training sequences by a linear grouping scheme (operator 7)."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import slices, stored, utf8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, nth long"


def pieces(docs: DataFrame, vocabulary: bytes, ranks: bytes, end: int = 2, room: int = 1024) -> DataFrame:
    """A row per piece of each document's ids and end id: at most `room` ids, only the first piece of several shorter.

    shard is the task that made the row, nth its place among that task's pieces of the same length; both hold only
    once the rows are stored.
    """

    def of(batches):
        bpe = ByteBpe(vocabulary, ranks)
        seen = np.zeros(room + 1, np.int64)
        shard = TaskContext.get().partitionId()
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                ids = np.append(bpe.ids(text.decode()), np.uint32(end))
                data, n = ids.astype("<u4").tobytes(), len(ids)
                at = 0
                for k in range(-(-n // room)):
                    to = at + ((n - 1) % room + 1 if k == 0 else room)
                    length = to - at
                    for column, value in zip(rows, (doc, k, at, length, zlib.crc32(data[4 * at : 4 * to]), int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
                    at = to
            doc, k, at, length, crc, nth = rows
            columns = [pa.array(doc, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc)), pa.array([shard] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "shard", "nth"])

    return docs.select("doc_id", "text").mapInArrow(of, PIECES)


def _configurations(sizes: np.ndarray, room: int) -> np.ndarray:
    """All ways to put up to `room // sizes[0]` places of these ascending sizes together, as ascending size numbers, with
    -1 for no place in front."""
    found = last = np.arange(len(sizes))[:, None]
    while True:
        used = sizes[last].sum(1)
        fit = np.searchsorted(sizes, room - used, side="right")  # sizes that still go in
        many = np.maximum(fit - last[:, -1], 0)
        if not many.sum():
            return found
        at = np.repeat(np.arange(len(last)), many)
        more = last[at, -1] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        last = np.concatenate([last[at], more[:, None]], 1)
        found = np.concatenate([np.pad(found, ((0, 0), (1, 0)), constant_values=-1), last])


def _optimised(sizes: np.ndarray, need: np.ndarray, room: int, tries: int = 20_000) -> list[tuple[int, list[int]]]:
    """How often to use which configurations of sizes so that the fewest sequences hold `need` places of each size, as
    a linear programme in whole steps: simplex over all configurations, amounts rounded down."""
    ways = _configurations(sizes, room)
    m = len(sizes)
    each = room // sizes
    inverse, amount = np.diag(1.0 / each), need / each
    basis: list[np.ndarray] = [np.full(c, k) for k, c in enumerate(each)]
    for _ in range(tries):
        price = np.append(inverse.sum(0), 0.0)  # of a place of each size; the last is of no place
        gain = price[ways].sum(1)
        way = ways[int(gain.argmax())]
        if gain.max() <= 1 + 1e-9:
            break
        way = way[way >= 0]
        step = inverse @ np.bincount(way, minlength=m)
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = amount - ratio[out] * step
        amount[out] = ratio[out]
        basis[out] = way
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(int(x + 1e-6), b.tolist()) for x, b in zip(np.maximum(amount, 0), basis) if x >= 1]


def _best_fit(counts: np.ndarray, classes: list[tuple[int, list[int]]], room: int) -> list[tuple[int, list[int]]]:
    """classes with counts[n] pieces of each length n put in, the longest first, each where it leaves the least room."""
    classes = list(classes)
    spaces: list[tuple[int, int]] = sorted((room - sum(x), k) for k, (_, x) in enumerate(classes))

    def add(many: int, lengths: list[int]) -> None:
        classes.append((many, lengths))
        insort(spaces, (room - sum(lengths), len(classes) - 1))

    for n in np.flatnonzero(counts)[::-1].tolist():
        c = int(counts[n])
        while c:
            at = bisect_left(spaces, (n, -1))
            if at < len(spaces):
                space, k = spaces.pop(at)
                many, lengths = classes[k]
            else:
                space, k, lengths = room, None, []
                many = -(-c // (room // n))
            fit = space // n
            full = min(many, c // fit)
            rest = min(c - full * fit, fit - 1) if many > full else 0
            c -= full * fit + rest
            parts = [(x, lengths + [n] * y) for x, y in ((full, fit), (1 if rest else 0, rest), (many - full - (1 if rest else 0), 0)) if x]
            if k is not None:
                classes[k] = parts[0]
                insort(spaces, (room - sum(parts[0][1]), k))
                parts = parts[1:]
            for x in parts:
                add(*x)
    return classes


def _grouped(counts: np.ndarray, room: int, groups: int, small: int) -> list[tuple[int, list[int]]]:
    """The linear grouping scheme with so many groups of equal cardinality."""
    large = [(n, int(counts[n])) for n in range(small + 1, room + 1) if counts[n]]
    total = sum(c for _, c in large)
    if not total:
        return _best_fit(counts, [], room)
    share, filled = -(-total // groups), 0
    runs: list[list[list[int]]] = []  # of each group: [length, count], ascending
    for n, c in large:
        while c:
            if not runs or filled == share:
                runs.append([])
                filled = 0
            part = min(c, share - filled)
            runs[-1].append([n, part])
            filled += part
            c -= part
    by_size: dict[int, list[list[int]]] = {}
    for r in runs:  # groups of the same rounded size are one
        by_size.setdefault(r[-1][0], []).extend(r)
    sizes = sorted(by_size)
    pools = [sorted(by_size[k]) for k in sizes]
    need = np.array([sum(c for _, c in p) for p in pools], float)
    classes: list[tuple[int, list[int]]] = []
    for many, way in _optimised(np.array(sizes), need, room):
        places = [_take(pools[g], min(many, sum(c for _, c in pools[g]))) for g in way]
        ends = [np.cumsum([c for _, c in runs]) for runs in places]
        at = 0
        for to in np.unique(np.concatenate([[many], *ends])).tolist():
            held = [runs[int(np.searchsorted(e, at, side="right"))][0] for runs, e in zip(places, ends) if len(e) and at < e[-1]]
            if held and to > at:
                classes.append((int(to - at), held))
            at = to
    left = counts.copy()
    left[small + 1 :] = 0
    for p in pools:
        for n, c in p:
            left[n] += c
    return _best_fit(left, classes, room)


def plan(counts: np.ndarray, room: int = 1024, groups: tuple[int, ...] = (30, 60, 120)) -> list[tuple[int, list[int]]]:
    """How many sequences hold which lengths. counts[n]: pieces of length n, for n up to room.

    Lengths over a bound, in order, are cut into groups of equal cardinality and rounded up to their group's largest. A
    linear programme says how often each configuration of these few sizes is used; amounts are rounded down. Then each
    place takes an actual length of its group, and what is left of the large lengths and all small ones, largest first,
    go where they leave the least room. Of the plans with each number of groups and with a quarter, half and all of
    room as the bound, that with the fewest sequences is taken; with the last all lengths are small, so there are never
    more sequences than by best-fit decreasing. All of this works on counts, so its size depends on room and groups and
    not on the number of pieces.
    """
    counts = np.asarray(counts, np.int64)
    whole = [(int(counts[room]), [room])] if counts[room] else []
    rest = counts.copy()
    rest[room] = rest[0] = 0
    plans = [_grouped(rest, room, g, small) for small in (room // 4, room // 2) for g in groups] + [_grouped(rest, room, 1, room)]
    return whole + min(plans, key=lambda p: sum(many for many, _ in p))


def _take(pool: list[list[int]], many: int) -> list[tuple[int, int]]:
    """The largest `many` lengths of a pool, with their counts."""
    out = []
    while many:
        n, have = pool[-1]
        part = min(have, many)
        out.append((n, part))
        many -= part
        if part == have:
            pool.pop()
        else:
            pool[-1][1] -= part
    return out


def pack(stored_pieces: DataFrame, room: int = 1024) -> DataFrame:
    """Stored pieces with sequence_id and offset.

    Only the count of each length (at most `room` numbers) reaches the driver, where plan() turns it into places: runs
    of equal sequences, each with a range of ranks for every length it holds. A piece finds its place by its rank
    among pieces of its length: what earlier tasks have of that length, from a table of counts by task and length,
    plus its own place in its task. So no task holds all pieces, nor all of a frequent length.
    """
    each = stored_pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("many"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begin = each.select("shard", "length", before.cast("long").alias("before"))
    counts = np.zeros(room + 1, np.int64)
    for r in each.groupBy("length").agg(F.sum("many").alias("many")).collect():
        counts[r.length] = r.many
    places: dict[int, list[tuple[int, int, int]]] = {}
    given = np.zeros(room + 1, np.int64)
    sequence = 0
    for many, lengths in plan(counts, room):
        offset = 0
        for n in lengths:
            places.setdefault(n, []).append((int(given[n]), sequence, offset))
            given[n] += many
            offset += n
        sequence += many
    tables = {n: np.array(p, np.int64).T for n, p in places.items()}

    def of(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            where, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for n, at in zip(values.tolist(), np.split(order, first[1:])):
                low, ids, offsets = tables[n]
                k = np.searchsorted(low, rank[at], side="right") - 1
                where[at], offset[at] = ids[k] + rank[at] - low[k], offsets[k]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(where), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = stored_pieces.join(begin, ["shard", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(of, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: bytes, ranks: bytes, end: int = 2, room: int = 1024) -> DataFrame:
    """The packed pieces of all documents.

    A null or empty text has its end id only; repeated documents are packed once each; an empty table gives no rows.
    Columns of docs other than doc_id and text aren't read.
    """
    return pack(stored(pieces(docs, vocabulary, ranks, end, room), "pieces"), room)
