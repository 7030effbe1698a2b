"""Counts per split, scan statistics and runs of equal neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def rows_per_split(df: DataFrame, column: str = "split") -> DataFrame:
    """AG-01: every split has a row, be it 0."""
    dim = df.sparkSession.createDataFrame([(s,) for s in SPLITS], f"{column} string")
    return dim.join(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def scan_statistics(df: DataFrame, transcript: str) -> DataFrame:
    """AG-04, FLT-04: candidates, missing and empty transcripts and what is left, in one pass."""
    t = F.col(transcript)
    empty = t.isNotNull() & (F.trim(F.regexp_replace(t, r"\s+", " ")) == "")
    return df.agg(F.count(F.lit(1)).alias("candidates"), F.count_if(t.isNull()).alias("missing"), F.count_if(empty).alias("empty"), F.count_if(t.isNotNull() & ~empty).alias("prepared"))


def count_runs(df: DataFrame, within: str, order: str, key: str) -> DataFrame:
    """AG-06: how many runs of equal neighbours each group has."""
    before = F.lag(key).over(Window.partitionBy(within).orderBy(order))
    return df.withColumn("__new", F.coalesce(before != F.col(key), F.lit(True))).groupBy(within).agg(F.count_if(F.col("__new")).alias("runs"))


def run_ids(df: DataFrame, within: str, order: str, key: str) -> DataFrame:
    """WN-03: ``run``, the number of the run that a row is in, from 0."""
    w = Window.partitionBy(within).orderBy(order)
    new = F.when(F.lag(key).over(w) != F.col(key), 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w).cast("long")).drop("__new")
