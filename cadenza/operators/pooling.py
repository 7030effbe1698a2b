"""Frames pooled over spans, and errors over masked frames."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frames_in_spans(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """JN-13: half-open spans meet their frames in an equi-join on (utterance, frame); empty spans meet none."""
    each = spans.where(F.col("end") > F.col("start")).select("utterance_id", "index", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("frame"))
    return each.join(frames, ["utterance_id", "frame"])


def pool_spans(frames: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """AG-09: per span the mean vector, the population variance of all its values and the mean energy; zeros for an empty span.

    Vectors are summed as wholes on the map side; they are never exploded into one row per dimension.
    """
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    met = frames_in_spans(frames, spans).select("utterance_id", "index", "energy", array_to_vector("vector").alias("v"), total.alias("t"), square.alias("q"), F.size("vector").alias("d"))
    pooled = met.groupBy("utterance_id", "index").agg(Summarizer.mean(F.col("v")).alias("m"), F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("d").alias("d"), F.avg("energy").alias("e"), F.count(F.lit(1)).alias("n"))
    mean = F.col("t") / F.col("d")
    pooled = pooled.select("utterance_id", "index", vector_to_array("m").alias("m"), F.greatest(F.lit(0.0), F.col("q") / F.col("d") - mean * mean).alias("variance"), "e", "n")
    out = spans.join(pooled, ["utterance_id", "index"], "left")
    zero = F.array_repeat(F.lit(0.0), width)
    return out.select("utterance_id", "index", F.coalesce("m", zero).alias("mean_embedding"), F.coalesce("variance", F.lit(0.0)).alias("variance"), F.coalesce("e", F.lit(0.0)).alias("energy"), F.coalesce("n", F.lit(0)).cast("int").alias("frame_count"))


def variance(values: Column) -> Column:
    """The population variance of an array's values, 0 for an empty one."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    square = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return F.when(n > 0, F.greatest(F.lit(0.0), square / n - (total / n) * (total / n))).otherwise(0.0)


def masked_error(df: DataFrame, key: str, prediction: str, target: str, mask: str) -> DataFrame:
    """AG-22: mean squared error over masked rows; a group with nothing masked is an error."""
    mse = F.aggregate(F.zip_with(prediction, target, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(target)
    g = df.groupBy(key).agg(F.avg(F.when(F.col(mask), mse)).alias("loss"))
    return g.select(key, F.coalesce("loss", F.raise_error(F.lit("nothing is masked")).cast("double")).alias("loss"))
