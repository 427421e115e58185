"""Nearest neighbours by a block matrix join with int8 tiles (operator 4)."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class Quantised:
    """int8 codes of vectors with what bounds an inner product: the norms of codes and of their errors."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
        self.code = np.rint(x / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        with np.errstate(over="ignore"):
            self.near = np.linalg.norm(near, axis=1)
            self.off = np.linalg.norm(x - near, axis=1)


def tile_bounds(a: Quantised, b: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products: the product of the int8 tiles, more or less the error bound.

    With a = a' + e and b = b' + f, |ab - a'b'| is at most |e| (|b'| + |f|) + |a'| |f|. Products of int8 codes are
    summed in float32, which is exact below 2**24 and so for up to 1040 dimensions at once.
    """
    product = np.zeros((len(a.x), len(b.x)))
    for k in range(0, a.x.shape[1], 1024):
        product += a.code[:, k : k + 1024].astype(np.float32) @ b.code[:, k : k + 1024].astype(np.float32).T
    with np.errstate(over="ignore", invalid="ignore"):
        product *= a.scale[:, None] * b.scale[None, :]
        error = a.off[:, None] * (b.near + b.off)[None, :] + a.near[:, None] * b.off[None, :]
        error += 1e-12 * (np.abs(product) + error) + 1e-300
        low, high = product - error, product + error
    low[np.isnan(low)], high[np.isnan(high)] = -np.inf, np.inf  # beyond the range of doubles nothing is known
    return low, high


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the dimensions."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            out += a[:, k] * b[:, k]
    return out


def best_of_block(query_ids, queries: np.ndarray, ids, rows: np.ndarray, k: int, tile: int = 1024) -> tuple[list, list, list]:
    """For each query of a block its k best rows of a block: query, row and score, in any order.

    Tile by tile, a pair survives if its upper bound reaches the k-th best that the query has: of the scores in its
    heap and of the lower bounds in this tile. Survivors are recomputed and go through the heap.
    """
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    floor = np.full(len(query_ids), -np.inf)
    a = Quantised(queries)
    for at in range(0, len(ids), tile):
        b = Quantised(rows[at : at + tile])
        own = query_ids[:, None] == ids[None, at : at + tile]
        low, high = tile_bounds(a, b)
        low[own], high[own] = -np.inf, -np.inf
        if low.shape[1] > k:
            floor = np.maximum(floor, np.partition(low, low.shape[1] - k, 1)[:, -k])
        i, j = np.nonzero((high >= floor[:, None]) & ~own)
        score = np.nan_to_num(exact(queries[i], rows[at + j]), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        for q, s, r in zip(i.tolist(), score.tolist(), ids[at + j].tolist()):
            heap = heaps[q]
            if len(heap) < k:
                heapq.heappush(heap, (s, -r))
            elif (s, -r) > heap[0]:
                heapq.heapreplace(heap, (s, -r))
        floor = np.maximum(floor, [h[0][0] if len(h) == k else -np.inf for h in heaps])
    flat = [(q, -r, s) for q, heap in zip(query_ids.tolist(), heaps) for s, r in heap]
    return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, dims and v (floats as they are, else doubles) of the rows that take part: an id and a vector without null
    or non-finite components that isn't zero. Of several rows with one id the smallest vector stands for it."""
    v = F.col(vector) if vectors.schema[vector].dataType.simpleString() == "array<float>" else F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~F.coalesce(wrong, F.lit(True))).filter(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding", block: int = 8192, queries_at_once: int = 2048) -> DataFrame:
    """query_id, rank, vec_id and score: for each id divisible by `every` its k rows with the largest inner product.

    All candidates but the query's own are compared, nearest first and ties to the smaller id; with fewer candidates
    all are given. Products beyond the range of doubles are infinite; sums of infinities of both signs count as the least. Which rows take part is said in usable(); vectors are compared with those of their own length. No
    rows give no rows, and other columns aren't read.

    Ids are dealt into blocks by a hash. Each block of queries meets each block of candidates in one task, which holds
    no more than the two and emits k rows for each query; a window then merges the blocks of a query.
    """
    rows = usable(vectors, key, vector)
    n, queries = rows.agg(F.count(F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    high, wide = max(1, math.ceil(queries / queries_at_once)), max(1, math.ceil(n / block))
    place = lambda seed, m: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = rows.filter(F.col("vec_id") % every == 0).select("dims", place(1, high).alias("q"), all_of(wide).alias("c"), F.lit(True).alias("asks"), "vec_id", "v")
    held = rows.select("dims", all_of(high).alias("q"), place(2, wide).alias("c"), F.lit(False).alias("asks"), "vec_id", "v")

    def group(table: pa.Table) -> pa.Table:
        dims = table.column("dims")[0].as_py()
        x = table.column("v").combine_chunks().values.to_numpy().astype(np.float64).reshape(-1, dims)
        asks, ids = table.column("asks").to_numpy(), table.column("vec_id").to_numpy()
        order = np.argsort(ids[~asks], kind="stable")
        q, r, s = best_of_block(ids[asks], x[asks], ids[~asks][order], x[~asks][order], k)
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(r, pa.int64()), "score": pa.array(s, pa.float64())})

    found = asked.union(held).groupBy("dims", "q", "c").applyInArrow(group, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The same by brute force, for DuckDB.
SQL = """
WITH ok AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) AS score
  FROM ok q JOIN ok c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""
