"""Deterministic splits, augmentation and masks: hashes of stable keys, never random streams, so results survive repartitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators.permute import drawn

def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone."""
    return drawn(seed, *keys) / float(1 << 32)


def speaker_splits(df: DataFrame, speaker: str, fraction: float, seed: int) -> DataFrame:
    """WN-15: (speaker, split): speakers in the order of a seeded hash, the first ones are validation.

    With one speaker or a fraction of 0 all train; else max(1, min(n - 1, ceil(n * fraction))) validate.
    """
    if not 0 <= fraction < 1:
        raise ValueError("the validation fraction must be in [0, 1)")
    s = df.select(speaker).where(F.col(speaker).isNotNull()).distinct()
    s = s.withColumn("__h", F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(speaker).cast("string")).cast("binary"), 256))
    # the chosen are the smallest hashes: a top-n, so no global window
    n = s.count()
    take = 0 if n <= 1 or fraction == 0 else max(1, min(n - 1, -int(-n * fraction // 1)))
    val = s.orderBy("__h").limit(take).select(speaker, F.lit("val").alias("__v"))
    return s.join(val, speaker, "left").select(speaker, F.coalesce("__v", F.lit("train")).alias("split"))


def negative_samples(df: DataFrame, p: float, seed: int, keys: tuple[str, ...] = ("utterance_id", "index"), phone_id: str = "phoneme_id", vocabulary: int = 41) -> DataFrame:
    """WN-13: with probability p/2 another phone (target 15), with p/2 an omission (presence 0, target 0).

    Adds ``augmented`` ('', 'substitution' or 'omission'), ``new_id``, ``new_target`` and ``new_presence``.
    New ids are drawn from 2..vocabulary-1 without the original.
    """
    u = uniform(seed, *[F.col(k) for k in keys])
    pick = drawn(seed, *[F.col(k) for k in keys], part=1) % (vocabulary - 3) + 2
    other = F.when(pick >= F.col(phone_id), pick + 1).otherwise(pick)
    kind = F.when(u < p / 2, "substitution").when(u < p, "omission").otherwise("")
    d = df.withColumn("augmented", kind)
    is_sub, is_om = F.col("augmented") == "substitution", F.col("augmented") == "omission"
    return d.withColumn("new_id", F.when(is_sub, other).otherwise(F.col(phone_id)).cast("int")).withColumn("new_target", F.when(is_sub, 15.0).when(is_om, 0.0).otherwise(F.col("target"))).withColumn("new_presence", F.when(is_om, 0).otherwise(F.col("presence")))


def negative_words(dense: DataFrame, p: float, seed: int, key: str = "utterance_id", vocabulary: int = 41) -> DataFrame:
    """WN-13 on dense words: every position by its own draw; a substitution changes id and target, an omission clears
    presence, target and the position's whole acoustic vector. Adds ``augmented``, the kind at each position.
    """
    draw = lambda i: uniform(seed, F.col(key), i)
    kinds = F.transform("phoneme_ids", lambda x, i: F.when(draw(i) < p / 2, "substitution").when(draw(i) < p, "omission").otherwise(""))
    d = dense.withColumn("augmented", kinds)
    kind = lambda i: F.get(F.col("augmented"), i)

    def other(x: Column, i: Column) -> Column:
        pick = drawn(seed, F.col(key), i, part=1) % (vocabulary - 3) + 2
        return F.when(pick >= x, pick + 1).otherwise(pick).cast("int")

    each = F.size("acoustic_flat") / F.greatest(F.lit(1), F.size("phoneme_ids"))
    where = lambda i: F.floor(i / each).cast("int")
    return (
        d.withColumn("acoustic_flat", F.transform("acoustic_flat", lambda v, i: F.when(kind(where(i)) == "omission", 0.0).otherwise(v)))
        .withColumn("phoneme_ids", F.transform("phoneme_ids", lambda x, i: F.when(kind(i) == "substitution", other(x, i)).otherwise(x)))
        .withColumn("match_targets", F.transform("match_targets", lambda x, i: F.when(kind(i) == "substitution", 15.0).when(kind(i) == "omission", 0.0).otherwise(x)))
        .withColumn("presence_targets", F.transform("presence_targets", lambda x, i: F.when(kind(i) == "omission", 0).otherwise(x)))
    )


def mask_count(n: Column, ratio: float, min_masks: int) -> Column:
    """WN-14: min(n, max(min_masks if ratio > 0 else 0, rint(n * ratio)))."""
    return F.least(n, F.greatest(F.lit(min_masks if ratio > 0 else 0), F.rint(n * ratio).cast("int"))).cast("int")


def mask_positions(df: DataFrame, ratio: float, min_masks: int, seed: int, key: str = "utterance_id", n: str = "seq_len", block: int = 1) -> DataFrame:
    """WN-14: ``mask``, a sorted array of positions. Blocks of ``block`` positions are added from hashed starts until enough are masked."""
    if not 0 <= ratio <= 1 or min_masks < 0 or block < 1:
        raise ValueError("a ratio in [0, 1], min_masks of at least 0 and block of at least 1 are needed")
    k = mask_count(F.col(n), ratio, min_masks)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(n) - block))
    order = F.transform(F.array_sort(F.transform(starts, lambda i: F.struct(drawn(seed, F.col(key), i, part=2).alias("h"), i.alias("i")))), lambda x: x["i"])
    grow = F.aggregate(order, F.array().cast("array<int>"), lambda acc, s: F.when(F.size(acc) >= k, acc).otherwise(F.array_union(acc, F.sequence(s, F.least(s + block, F.col(n)) - 1))))
    return df.withColumn("mask", F.when((k > 0) & (F.col(n) > 0), F.array_sort(grow)).otherwise(F.array().cast("array<int>")))


def head_per_split(df: DataFrame, n: int, split: str, *order: str) -> DataFrame:
    """SL-01: the first n rows of every split in a fixed order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(split).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")
