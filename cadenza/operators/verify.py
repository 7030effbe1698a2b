"""Profiles and reconciliation of feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile(features: DataFrame, embedding: str | None = None, shard: str | None = None, group: str | None = None) -> DataFrame:
    """AG-05: one row per split in a single aggregation, with the first row as ``sample_row`` (JSON).

    ``shard`` adds ``shards``, how many there are; ``embedding`` adds ``widths``, a map of vector widths to row
    counts; ``group`` adds ``group_runs``, the number of adjacent runs of that column (AG-06) within utterances.
    """
    first = F.struct("utterance_id", "index")
    row = F.to_json(F.struct("utterance_id", "index", "phoneme", "duration_ms", "frames"))
    # summed by utterance first, so that no distinct utterances are kept beside each other for a whole split
    u = features.groupBy("split", "utterance_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("frames").alias("min_frames"), F.max("frames").alias("max_frames"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        F.min(first).alias("first"), F.min_by(F.struct("phoneme", row.alias("row")), first).alias("s"),
    )
    d = u.groupBy("split").agg(
        F.sum("rows").alias("rows"), F.count("utterance_id").alias("utterances"), F.min("min_frames").alias("min_frames"), F.max("max_frames").alias("max_frames"),
        F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"), F.min_by("s", "first").alias("s"),
    ).select("split", "rows", "utterances", "min_frames", "max_frames", "min_ms", "max_ms", F.col("s.phoneme").alias("sample"), F.col("s.row").alias("sample_row"))
    if shard or embedding:
        of = {"__shard": F.col(shard)} if shard else {}
        of |= {"__width": F.size(embedding)} if embedding else {}
        n = features.groupBy("split", *[c.alias(k) for k, c in of.items()]).agg(F.count(F.lit(1)).alias("n"))  # a row for each shard and width
        if shard:
            d = d.join(n.groupBy("split").agg(F.count_distinct("__shard").alias("shards")), "split", "left")
        if embedding:
            n = n.groupBy("split", F.col("__width").alias("width")).agg(F.sum("n").alias("n"))
            d = d.join(n.groupBy("split").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("width", "n")))).alias("widths")), "split", "left")
    if group:
        before = F.lag(group).over(Window.partitionBy("split", "utterance_id").orderBy("index"))
        turns = features.select("split", F.col(group).alias("g"), before.alias("p"))
        runs = turns.groupBy("split").agg(F.count_if(F.col("p").isNull() | (F.col("g") != F.col("p"))).alias("group_runs"))
        d = d.join(runs, "split", "left")
    return d


def reconcile(features: DataFrame, aligned: DataFrame) -> DataFrame:
    """JN-15: totals of both sides, their differences and whether they match; one row."""
    f = features.agg(F.count(F.lit(1)).alias("feature_rows"), F.count_distinct("utterance_id").alias("feature_words"))
    a = aligned.agg(F.sum(F.size("phones")).alias("aligned_rows"), F.count(F.lit(1)).alias("aligned_words"))
    d = f.join(F.broadcast(a))  # one row each
    return d.select("*", (F.col("feature_rows") - F.col("aligned_rows")).alias("row_delta"), (F.col("feature_words") - F.col("aligned_words")).alias("word_delta"), ((F.col("feature_rows") == F.col("aligned_rows")) & (F.col("feature_words") == F.col("aligned_words"))).alias("matches"))


def row_differences(features: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """JN-15: keys that only one side has."""
    a = features.select(*keys).distinct().withColumn("in_features", F.lit(True))
    b = aligned.select(*keys).distinct().withColumn("in_aligned", F.lit(True))
    d = a.join(b, keys, "full_outer").select(*keys, F.coalesce("in_features", F.lit(False)).alias("in_features"), F.coalesce("in_aligned", F.lit(False)).alias("in_aligned"))
    return d.where(F.col("in_features") != F.col("in_aligned"))


def leaked_speakers(df: DataFrame, speaker: str = "speaker_id", split: str = "split") -> DataFrame:
    """SET-02: the speakers of more than one split; a null speaker is none."""
    d = df.where(F.col(speaker).isNotNull()).groupBy(speaker).agg(F.min(split).alias("__a"), F.max(split).alias("__b"))
    return d.where(F.col("__a") != F.col("__b")).select(speaker)
