"""What the operators of this subpackage share: tables, scratch tables, text columns as UTF-8 and digests."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir, which all executors share.

    Where that setting is absent, as in tests, a local session gets a temporary folder and any other the warehouse.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}" if local else spark.conf.get("spark.sql.warehouse.dir")
        _scratch[app] = f"{base}/qacorpus-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the cluster clears its own checkpoint folder
        pass


#: Lets Spark drop the shuffle files of a write as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read back: a cut in the lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    schema = df.schema
    with _cleaned(spark):  # what comes later reads the table, not the shuffles
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def held_out(modulus: int, remainder: int, column: str = "doc_id"):
    """True where crc32(the id as text) mod modulus is remainder."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 1000, volume: int = 4 << 20, column: str | None = "text"):
    """Arrow batches cut so that none has more than so many rows or, but for single rows, so many bytes of a column
    (None: rows alone count).

    The parts are copies: some kernels misread a cast slice, whose values don't begin where its data does.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        if column is None:
            yield from (batch.take(pa.array(np.arange(k, min(k + rows, batch.num_rows)))) for k in range(0, batch.num_rows, rows))
            continue
        sizes = np.frombuffer(batch.column(column).cast(pa.large_binary()).buffers()[1], np.int64)
        offset = batch.column(column).offset
        ends = sizes[offset : offset + batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + volume, side="right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.take(pa.array(np.arange(at, to)))
            at = to


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, written once to the shared folder in buckets of a key, so that joins on the key don't shuffle it again."""
    spark = df.sparkSession
    table_name = f"qacorpus_{name}_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with _cleaned(spark):
        df.write.bucketBy(n, key).option("path", f"{scratch_dir(spark)}/{table_name}").saveAsTable(table_name)
    return spark.table(table_name)


def pack(values: np.ndarray) -> bytes:
    """An array of floats, or of integers from 0 on, in the fewest bytes a value takes, compressed."""
    if values.dtype.kind == "f":
        return b"f" + zstandard.compress(values.astype("<f8").tobytes(), 1)
    top = int(values.max(initial=0))
    size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return b"%d" % size + zstandard.compress(values.astype(f"<u{size}").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data[1:])
    return np.frombuffer(raw, "<f8") if data[:1] == b"f" else np.frombuffer(raw, f"<u{int(data[:1])}").astype(np.int64 if data[:1] != b"8" else np.uint64)


def pack_all(*arrays: np.ndarray) -> bytes:
    """Several arrays of floats, or of integers from 0 on, as one compressed message: like bytes of values together."""
    head, body = [len(arrays)], []
    for values in arrays:
        if values.dtype.kind == "f":
            kind, size = "<f8", 9
        else:
            top = int(values.max(initial=0))
            size = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            kind = f"<u{size}"
        head += [size, len(values)]
        body.append(np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b"")
    return zstandard.compress(np.array(head, "<u4").tobytes() + b"".join(body), 1)


def unpack_all(data: bytes) -> list[np.ndarray]:
    """The arrays of pack_all(): floats, or unsigned integers of 8 bytes where they need them, else signed ones."""
    raw = zstandard.decompress(data)
    (many,) = np.frombuffer(raw, "<u4", 1)
    head = np.frombuffer(raw, "<u4", 2 * many, 4).reshape(-1, 2).tolist()
    at, out = 4 + 8 * int(many), []
    for size, n in head:
        kind, size = ("<f8", 8) if size == 9 else (f"<u{size}", size)
        flat = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        out.append(flat if size == 8 else flat.astype(np.int64))
        at += n * size
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.append(True, ordered[1:] != ordered[:-1])[: len(values)]
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], place
