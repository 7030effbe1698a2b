"""Assessment of recordings: alignment of frames to phones, overall scores, primary issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import scores as S


def _totals() -> list[Column]:
    w = F.when(F.length("phoneme") > 1, 1.5).otherwise(1.0)
    score = 0.5 * F.col("match") + 0.25 * F.col("dur") + 0.25 * F.col("presence")
    return [F.sum(w * score).alias("ws"), F.sum(w).alias("w"), F.avg("confidence").alias("c"), F.first("quality").alias("quality")]


def _severity() -> Column:
    # the overall confidence scales all phones of a recording alike, so the penalty alone ranks them
    return F.struct(S.penalty(F.col("match"), F.col("dur"), F.col("presence")).alias("penalty"), (-F.col("index")).alias("first"))


def _phone() -> Column:
    return F.struct("phoneme", "status", _severity()["penalty"].alias("penalty"))


def _worst() -> Column:
    return F.max_by(_phone(), _severity())


def _overall(digits: int) -> tuple[Column, Column]:
    q = S.quality_factor(F.col("quality"))
    score = S.clamp_score(F.round(F.col("ws") / F.greatest(F.lit(1.0), F.col("w")) * q, 9))
    return score, F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") * q)), digits)


def _issue(worst: Column) -> Column:
    return F.when(worst.isNull(), "no_signal").when(worst["status"] == "ok", "low_match").otherwise(worst["status"])


def overall(phones: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """AG-21: weighted score and mean confidence of each recording, both scaled by its quality."""
    score, confidence = _overall(digits)
    return phones.groupBy(key).agg(*_totals()).select(key, score.alias("score"), confidence.alias("confidence"))


def primary_issue(recordings: DataFrame, phones: DataFrame, key: str) -> DataFrame:
    """SL-03: the most severe phone's status, the first of equals, ``ok`` read as ``low_match``; ``no_signal`` without phones.

    Severity is scaled by the recording's overall confidence, never by a phone's own.
    """
    worst = phones.groupBy(key).agg(_worst().alias("x"))
    return recordings.select(key).join(worst, key, "left").select(key, _issue(F.col("x")).alias("issue"), F.col("x.phoneme").alias("phoneme"))


def _assessment(key: list[str]) -> list[Column]:
    """The assessment of grouped phones: ``ws``, ``w``, ``c``, ``quality`` and the worst phone ``x``, null for a recording without phones, which scores 0."""
    score, confidence = _overall(3)
    some = F.col("x").isNotNull()
    confidence = F.when(some, confidence).otherwise(0.0)
    severity = (0.65 + 0.35 * confidence) * F.col("x.penalty")
    return [*key, F.when(some, score).otherwise(0).alias("score"), confidence.alias("confidence"), _issue(F.col("x")).alias("issue"), F.col("x.phoneme").alias("issue_phone"), severity.alias("severity")]


def assessments(recordings: DataFrame, phones: DataFrame, key: str) -> DataFrame:
    """AG-21, FN-31 and SL-03 in one aggregation: score, confidence, issue, issue_phone and the issue's severity."""
    d = recordings.select(key).join(phones.groupBy(key).agg(*_totals(), _worst().alias("x")), key, "left")
    return d.select(*_assessment([key]))


def assessed(phones: DataFrame, same: list[str]) -> DataFrame:
    """``assessments`` of phone rows that carry ``same``, what they know of their recording with its ``quality``; a recording without phones is a row without ``index``."""
    some = F.col("index").isNotNull()
    worst = F.max_by(F.when(some, _phone()), F.when(some, _severity()))
    return phones.groupBy(*same).agg(*_totals()[:-1], worst.alias("x")).select(*_assessment(same))


def align_frames(phones: DataFrame, key: str = "utterance_id", frame_ms: float = 10.0) -> DataFrame:
    """WN-07, WN-08: a word's frames dealt to its phones in proportion to their weights.

    ``phones`` has key, index, phoneme and total_frames. Each phone gets at least one frame; what is
    over goes round from the first phone, what is missing is taken round from phones longer than one.
    A word with fewer frames than phones gets no spans but the reason ``too_few_frames``. Weights are
    summed in the order of phones: a sum in another order can differ in its last bit, and a length with it.
    """
    order = Window.partitionBy(key).orderBy("index")
    w = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = phones.withColumn("w", L.duration_weight(F.col("phoneme"))).withColumn("k", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(order) - 1)
    n = F.col("total_frames")
    d = d.withColumn("len0", F.greatest(F.lit(1), F.floor(F.col("w") / F.sum("w").over(w) * n)).cast("int"))
    d = d.withColumn("delta", (n - F.sum("len0").over(w)).cast("int"))
    more = F.floor(F.col("delta") / F.col("k")) + F.when(F.col("i") < F.col("delta") % F.col("k"), 1).otherwise(0)
    # taking away: round r takes a frame from each phone that is longer than r frames, in order
    rounds = F.explode(F.when((F.col("delta") < 0) & (F.col("len0") > 1), F.sequence(F.lit(1), F.col("len0") - 1)).otherwise(F.array(F.lit(0))))
    short = d.where(F.col("delta") < 0).select(key, "index", "i", "delta", "len0", rounds.alias("r"))
    turn = F.when(F.col("r") > 0, F.row_number().over(Window.partitionBy(key, F.col("r") > 0).orderBy("r", "i")))
    taken = short.withColumn("turn", turn).groupBy(key, "index").agg(F.count_if(F.col("turn") <= -F.col("delta")).cast("int").alias("taken"))
    d = d.join(taken, [key, "index"], "left")
    length = F.when(F.col("delta") >= 0, F.col("len0") + more).otherwise(F.col("len0") - F.coalesce("taken", F.lit(0)))
    d = d.withColumn("reason", F.when(n < F.col("k"), "too_few_frames")).withColumn("length", F.when(F.col("reason").isNull(), length).cast("int"))
    d = d.withColumn("end", F.sum("length").over(order).cast("int")).withColumn("start", F.col("end") - F.col("length"))
    observed = F.greatest(F.lit(0.5), F.col("length") / F.greatest(F.lit(1.0), n / F.col("k")))
    z = F.round((observed - F.col("w")) / F.greatest(F.lit(0.35), F.col("w")), 3)
    return d.withColumn("z", z + 0.0).withColumn("start_ms", F.rint(F.col("start") * frame_ms).cast("int")).withColumn("end_ms", F.rint(F.col("end") * frame_ms).cast("int"))


def span_confidence(energy: Column, mean_energy: Column) -> Column:
    """WN-08: confidence from a span's energy against itself and the mean."""
    ratio = F.when(mean_energy == 0, 1.0).otherwise(energy / (mean_energy + 1e-6))
    return F.greatest(F.lit(0.4), F.least(F.lit(0.98), F.round(0.72 + 0.18 * F.least(ratio, F.lit(1.2)), 3)))
