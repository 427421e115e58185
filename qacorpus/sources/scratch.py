"""Tables in the shared folder, for loops and for results that are read more than once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended: the cluster clears its own checkpoint folder
        pass


def scratch(spark: SparkSession) -> str:
    """A new folder within the session's own below spark.checkpoint.dir; where that is unset, below a temporary one, or the
    warehouse on a cluster. The session's folder goes when the program ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}" if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
        _folders[app] = f"{base}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return f"{_folders[app]}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/{name}"
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
