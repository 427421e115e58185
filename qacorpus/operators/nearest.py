"""Exact nearest vectors by inner product: blocks around pivots, of which a question reads those that can still matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bm25 import Store


def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists of doubles as a matrix, from their buffer."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def block_scores(depth: int | None, different: bool, equal: bool, own: bool) -> Callable[[pa.Table], pa.Table]:
    """Of a table (asks, id, label, v) the best `depth` rows that don't ask for each that asks, ties to smaller ids. different,
    equal: only rows of other labels, or of the same. own=False leaves out equal ids."""

    def of(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), vectors_of(table.column("v"))
        if not asks.any() or asks.all():
            return _found([])
        code = table.column("label").combine_chunks().dictionary_encode()
        labels = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        score = np.round(x[asks] @ x[~asks].T, 9)
        wrong = np.zeros(score.shape, bool)
        if different:
            wrong |= labels[asks][:, None] == labels[~asks][None, :]
        elif equal:
            wrong |= labels[asks][:, None] != labels[~asks][None, :]
        if not own:
            wrong |= ids[asks][:, None] == ids[~asks][None, :]
        right, out = ids[~asks], []
        for i, q in enumerate(ids[asks].tolist()):
            may = np.flatnonzero(~wrong[i])
            if depth is not None and len(may) > depth:
                s = score[i][may]
                may = may[s >= np.partition(s, len(s) - depth)[len(s) - depth]]  # with all that equal the last
            may = may[np.lexsort((right[may], -score[i][may]))][:depth]
            out.append((np.full(len(may), q), right[may], score[i][may]))
        return _found(out)

    return of


def _found(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    q, c, s = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
    return pa.table({"query_id": pa.array(q.astype(np.int64)), "chunk_id": pa.array(c.astype(np.int64)), "score": pa.array(s.astype(float))})


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """So many rows of a sample, each the farthest from those before."""
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def vector_top(queries: DataFrame, vectors: DataFrame, depth: int, store: Store, pivots: int = 64, shells: int = 16, block: int = 4096, queries_at_once: int = 1024, own: bool = True, reads: dict[str, int] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, pos): the best `depth` of vectors (chunk_id, vector) for each of queries (query_id, vector),
    exactly as vector_rank() has them, without a look at blocks that can't reach a question's list.

    Each vector goes to its nearest pivot, and there to one of `shells` by its distance r: a question's product with it is at
    most that with the pivot plus the question's length times r. A first round reads the cells of the highest bounds until
    they hold `depth` vectors twice; its last score bounds the list from below, and a second round reads the other cells
    that can reach it. Cells of over `block` vectors, however many are equal, are dealt to several tasks. Pivots are a
    chosen far apart from a bounded sample (the 8 x `pivots` smallest hashes of ids), which decides about speed only; what the
    driver sees is that sample and a row per cell. Vectors that are null, empty or hold null or non-finite components take no part; lengths must
    agree. Repeated ids count each. An empty side gives no rows. reads: gets the numbers of pairs that were multiplied, and of all.
    """
    usable = "vector IS NOT NULL AND size(vector) > 0 AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))"
    doubles = F.transform("vector", lambda x: x.cast("double")).alias("v")
    asked = store(queries.filter(usable).select(F.col("query_id").cast("long").alias("id"), doubles), "questions")
    rows = vectors.filter(usable).filter("chunk_id IS NOT NULL AND chunk_id >= 0").select(F.col("chunk_id").cast("long").alias("id"), doubles)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(8 * pivots).collect()  # bounded by the parameter
    answer = "query_id long, chunk_id long, score double"
    if not sample:
        return queries.sparkSession.createDataFrame([], f"{answer}, pos int")
    centres = _spread(np.unique(np.array([r.v for r in sample], float), axis=0), pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = vectors_of(pa.chunked_array([b.column("v")]))
            if len(x):
                near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32)), pa.array(np.sqrt(((x - centres[near]) ** 2).sum(1)))], ["id", "v", "pivot", "r"])

    placed = store(rows.mapInArrow(nearest, "id long, v array<double>, pivot int, r double"), "placed")
    far = placed.agg(F.max("r")).first()[0] or 1.0
    placed = placed.withColumn("cell", F.col("pivot") * shells + F.least(F.lit(shells - 1), F.floor(F.col("r") / F.lit(far) * shells).cast("int")))
    cells = placed.groupBy("cell").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # at most pivots x shells rows
    name, radius, n = (np.array([c[k] for c in cells], t) for k, t in (("cell", int), ("r", float), ("n", int)))
    middle = centres[name // shells]
    longest = np.sqrt((middle**2).sum(1)) + radius
    parts = -(-n // block)

    def bounds(batches: Iterator[pa.RecordBatch], second: bool) -> Iterator[pa.RecordBatch]:
        """(id, cell, part, n) of the cells that a question reads in a round."""
        for b in batches:
            x = vectors_of(pa.chunked_array([b.column("v")]))
            ids, floor = b.column("id").to_numpy(), b.column("floor").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for q, v, least in zip(ids, x, floor):
                norm = float(np.sqrt(v @ v))
                most = middle @ v + norm * radius + 1e-9 * (1 + norm * longest)  # with room for rounding
                order = np.argsort(-most, kind="stable")
                first = order[: 1 + int(np.searchsorted(np.cumsum(n[order]), 2 * depth))]
                chosen = np.setdiff1d(np.flatnonzero(most + 1e-9 >= least), first) if second else first
                out.append((np.full(len(chosen), q), chosen))
            if out:
                q, c = (np.concatenate(k) for k in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(name[c].astype(np.int32)), pa.array(parts[c].astype(np.int32)), pa.array(n[c].astype(np.int64))], ["id", "cell", "parts", "n"])

    sizes = queries.sparkSession.createDataFrame([(int(c), int(p)) for c, p in zip(name, parts)], "cell int, parts int")
    dealt = placed.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.col("parts")).cast("int"))
    high = max(1, -(-asked.count() // queries_at_once))
    group = F.pmod(F.xxhash64("id"), F.lit(high)).cast("int").alias("q")
    label = F.lit(None).cast("string").alias("label")

    def read(todo: DataFrame) -> DataFrame:
        left = todo.join(asked, "id").select(group, "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", label, "v")
        right = dealt.join(todo.select("cell", group).distinct(), "cell").select("q", "cell", "part", F.lit(False).alias("asks"), "id", label, "v")
        return left.union(right).groupBy("q", "cell", "part").applyInArrow(block_scores(depth, False, False, own), answer)

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")) - 1
    schema = "id long, cell int, parts int, n long"
    todo = store(asked.withColumn("floor", F.lit(0.0)).mapInArrow(lambda b: bounds(b, False), schema), "first")
    best = store(read(todo).withColumn("pos", place).filter(F.col("pos") < depth).drop("pos"), "best")
    floor = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) == depth, F.min("score")).alias("floor"))
    known = asked.join(floor, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    more = store(known.select("id", "v", "floor").mapInArrow(lambda b: bounds(b, True), schema), "second")
    if reads is not None:
        total = todo.union(more).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        reads |= {"pairs": total, "all": asked.count() * int(n.sum())}
    return best.union(read(more)).withColumn("pos", place).filter(F.col("pos") < depth)
