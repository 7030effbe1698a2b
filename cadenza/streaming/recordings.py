"""Streams of recordings: assessment per micro-batch and running counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder, or the one file of that name, as a stream with the schema that it has now."""
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    folder, name = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def assess_stream(stream: DataFrame, job: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str, key: str = "recording_id", time: str | None = None, late: str = "10 minutes"):
    """ST-01: each micro-batch goes through the batch job; its assessments and its rejects are written to a table each, under
    the batch's id, so a repeated batch replaces itself.

    With ``time``, a column of event times, a recording whose ``key`` came before, within ``late`` of it, is assessed once, also across
    batches and restarts; one that comes later than ``late`` after the newest is left out. State is kept for ``late`` only.
    """
    if time:
        stream = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # both tables read it
        try:
            for name, rows in zip(("assessments", "rejects"), job(batch)):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_counts(stream: DataFrame, key: str, path: str, checkpoint: str):
    """ST-02: running counts per key; every micro-batch appends the changed counts with its sequence number."""
    counts = stream.groupBy(key).agg(F.count(F.lit(1)).alias("processed"))

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("seq", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
