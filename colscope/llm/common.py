"""Helpers that the operators share: the shared folder, written tables, checked broadcasts, ragged arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a key table (up to about 100 bytes each) that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only where it is unset (local tests) a temporary folder is made and set."""
    try:
        found = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # the setting may be unknown to the session
        found = None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="colscope-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/colscope-{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended; leftovers are then the cluster's to sweep
        pass


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of written() tables. Only for tables whose readers have been written themselves, so that nothing is computed from them again."""
    for df in frames:
        delete(df.sparkSession, df._written_at)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, which is counted, else as it is, for a shuffle join. With `weight`, the bytes of a row, they may sum to 100 for each of these rows at most. Give it a written table, or it is computed twice."""
    if weight is not None:
        return F.broadcast(df) if (df.agg(F.sum(weight)).first()[0] or 0) <= 100 * rows else df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for each of (starts, lens), joined."""
    lens = np.asarray(lens, np.int64)
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)
    return flat[at]
