"""What the operators share: written intermediate tables, text helpers and hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the line and word contracts: \x20 and \x09-\x0D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only in local mode, as in tests, where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-cadenza-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    path = f"{shared_dir(df.sparkSession)}/cadenza-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table made by ``written`` once nothing will read it again."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that a broadcast may hold: 8 bytes each and some overhead, so tens of MB at most.
BROADCAST_IDS = 500_000


def if_few(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table of ids with a broadcast hint if it is counted to be small; else as it is, for a shuffled join."""
    return F.broadcast(ids) if ids.count() <= most else ids


def text_of(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay as they are."""
    return F.translate(c, UPPER, LOWER)


_worker_cache: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """A table that lives as long as the Python worker, until another operator asks for its own: one at a time bounds memory."""
    if owner not in _worker_cache:
        _worker_cache.clear()
        _worker_cache[owner] = {}
    return _worker_cache[owner]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64 arrays."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
