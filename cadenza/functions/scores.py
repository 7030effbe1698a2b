"""Heuristic phone scores, statuses and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_score(x: Column) -> Column:
    """FN-28: 0..100, half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.rint(x).cast("int")))


def match_score(variance: Column, energy: Column) -> Column:
    return clamp_score(82.0 - F.least(F.lit(28.0), variance * 120.0) + F.least(F.lit(12.0), energy * 22.0))


def duration_score(z: Column) -> Column:
    return clamp_score(92.0 - F.least(F.lit(40.0), F.abs(z) * 35.0))


def presence_score(z: Column, energy: Column) -> Column:
    return clamp_score(96.0 - F.when(energy > 0.08, 0.0).otherwise(35.0) - F.greatest(F.lit(0.0), -z * 12.0))


def phone_confidence(align_confidence: Column, energy: Column, variance: Column) -> Column:
    raw = 0.55 + 0.35 * align_confidence + 0.5 * F.least(energy, F.lit(0.2)) - 0.25 * F.least(variance, F.lit(0.2))
    return F.greatest(F.lit(0.35), F.least(F.lit(0.98), F.round(raw, 3)))


def phone_status(match: Column, duration: Column, presence: Column, z: Column, late: Column) -> Column:
    """FN-30: the first of seven labels that holds."""
    return (
        F.when(presence < 45, "possibly_missing").when(match < 58, "low_match").when(late, "late_start")
        .when((duration < 58) & (z < 0), "too_short").when((duration < 58) & (z > 0), "too_long")
        .when((presence < 70) | (match < 70), "weak").otherwise("ok")
    )


def penalty(match: Column, duration: Column, presence: Column) -> Column:
    """What a phone's scores lack, weighted."""
    return (100 - match) + 0.75 * (100 - presence) + 0.45 * (100 - duration)


def severity(match: Column, duration: Column, presence: Column, confidence: Column) -> Column:
    """FN-31: the penalty scaled by the overall confidence of the recording, one number for all its phones."""
    return (0.65 + 0.35 * confidence) * penalty(match, duration, presence)


def quality_status(rms: Column, clipping: Column, silence: Column) -> Column:
    """FN-27."""
    return F.when((rms < 0.04) | (silence > 0.75), "rejected").when((clipping > 0.08) | (silence > 0.45), "low_confidence").otherwise("ok")


def quality_factor(status: Column) -> Column:
    return F.when(status == "ok", 1.0).when(status == "rejected", 0.75).otherwise(0.92)
