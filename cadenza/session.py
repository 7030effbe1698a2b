"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cadenza")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one task after a shuffle of a large table.
TASK_ROWS = 1 << 18


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, by ``keys`` over as many tasks as it needs to hold at most about TASK_ROWS each.

    What a task sorts and keeps then doesn't grow with the table, whatever number of shuffle partitions the session has. A table
    that gives each core less than that is left to Spark.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def spread(df: DataFrame, task_rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over tasks of about ``task_rows`` rows each, at least one for each core: for rows that take long, as a small table would be a task or two."""
    n = -(-df.count() // task_rows)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys)


#: Rows of a vocabulary or another dimension that goes to every task.
FEW_ROWS = 500_000


def few(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """``df`` for a join with a table whose rows are wide: sent to them if it has at most ``most`` rows, which is counted."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the cluster's shared folder; in a folder of our own only in local mode, as in tests, where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-cadenza-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/cadenza-{what}-{uuid.uuid4().hex}"
