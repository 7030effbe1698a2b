"""Queries of the signal operators SIG-01..SIG-08."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.plans import views as V
from cadenza.plans.registry import query
from cadenza.plans.views import r6

X = "vector"


def total(a):
    return r6(F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x))


WEIGHTED = "round(list_sum(list_transform(list_zip({0}, range(1, len({0}) + 1)), lambda z: z[1] * z[2])), 6) + 0.0"


@query("sig_01_downmix", f"WITH {V.FRAMES_SQL}, m AS (SELECT vec_id, list_transform(list_zip(vector, list_reverse(vector)), lambda z: (z[1] + z[2]) / 2) AS x FROM frames) SELECT vec_id, {WEIGHTED.format('x')} AS total FROM m")
def sig_01(spark, sf):
    stereo = F.zip_with("vector", F.reverse("vector"), lambda a, b: F.array(a, b))
    return V.frames(spark, sf).select("vec_id", total(S.downmix(stereo)).alias("total"))


RESAMPLE_SQL = "list_transform(range(0, 40), lambda i: vector[CAST(floor(least(i * 64.0::DOUBLE / 40, 63)) AS INT) + 1] + (vector[least(CAST(floor(least(i * 64.0::DOUBLE / 40, 63)) AS INT) + 1, 63) + 1] - vector[CAST(floor(least(i * 64.0::DOUBLE / 40, 63)) AS INT) + 1]) * (least(i * 64.0::DOUBLE / 40, 63) - floor(least(i * 64.0::DOUBLE / 40, 63))))"


@query("sig_02_resample", f"WITH {V.FRAMES_SQL}, m AS (SELECT vec_id, {RESAMPLE_SQL} AS x FROM frames) SELECT vec_id, {WEIGHTED.format('x')} AS total, CAST(len(x) AS INT) AS n FROM m")
def sig_02(spark, sf):
    f = V.frames(spark, sf).select("vec_id", S.resample(F.col(X), 64, 40).alias("x"))
    return f.select("vec_id", total(F.col("x")).alias("total"), F.size("x").alias("n"))


@query("sig_03_peak_normalise", f"WITH {V.FRAMES_SQL}, m AS (SELECT vec_id, list_transform(vector, lambda x: x / list_max(list_transform(vector, lambda y: abs(y)))) AS x FROM frames) SELECT vec_id, {WEIGHTED.format('x')} AS total FROM m")
def sig_03(spark, sf):
    return V.frames(spark, sf).select("vec_id", total(S.peak_normalise(F.col(X))).alias("total"))


@query("sig_04_levels", f"WITH {V.FRAMES_SQL} SELECT vec_id, round(energy, 6) AS rms, round(len(list_filter(vector, lambda x: abs(x) >= 0.25)) / 64, 6) AS clipping, round(len(list_filter(vector, lambda x: abs(x) < 0.015)) / 64, 6) AS silence FROM frames")
def sig_04(spark, sf):
    return V.frames(spark, sf).select("vec_id", r6(S.rms(F.col(X))).alias("rms"), r6(S.clipping_ratio(F.col(X), 0.25)).alias("clipping"), r6(S.silence_ratio(F.col(X))).alias("silence"))


SNR_SQL = V.FRAMES_SQL + ", p AS (SELECT vec_id, list_sum(list_transform(vector, lambda x: x * x)) / 64 + 1e-8 AS s, list_sum(list_transform(list_zip(vector[2:], vector[:-2]), lambda z: (z[1] - z[2]) ** 2)) / 64 + 1e-8 AS d FROM frames)"


@query("sig_05_snr", f"WITH {SNR_SQL} SELECT vec_id, greatest(0.0, round(10 * log10(s / d), 2)) + 0.0 AS snr FROM p")
def sig_05(spark, sf):
    return V.frames(spark, sf).select("vec_id", (S.snr(F.col(X)) + 0.0).alias("snr"))


@query("sig_06_duration", f"WITH {V.FRAMES_SQL}, m AS (SELECT vec_id, 1 + vec_id % 64 AS n FROM frames), d AS (SELECT vec_id, CAST(round_even(n / 12.0 * 1000, 0) AS INT) AS ms FROM m) SELECT vec_id, ms, CASE WHEN ms < 250 THEN 'too_short' WHEN ms > 4000 THEN 'too_long' END AS reason FROM d")
def sig_06(spark, sf):
    ms = S.duration_ms(F.slice(X, F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")), 12)
    return V.frames(spark, sf).select("vec_id", ms.alias("ms")).select("vec_id", "ms", S.length_reason(F.col("ms")).alias("reason"))


@query("sig_07_frame_energy", f"WITH {V.FRAMES_SQL}, m AS (SELECT vec_id, list_transform(range(0, 64, 6), lambda s: sqrt(list_sum(list_transform(vector[s + 1:s + 6], lambda x: x * x)) / len(vector[s + 1:s + 6]))) AS x FROM frames) SELECT vec_id, {WEIGHTED.format('x')} AS total, CAST(len(x) AS INT) AS n FROM m")
def sig_07(spark, sf):
    f = V.frames(spark, sf).select("vec_id", S.frame_energy(F.col(X), F.lit(100.0), 64).alias("x"))
    return f.select("vec_id", total(F.col("x")).alias("total"), F.size("x").alias("n"))


@query("sig_08_frame_length", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, round(greatest(10.0, duration_ms / greatest(1, frames // 3)), 6) AS frame_ms FROM phones")
def sig_08(spark, sf):
    f = S.frame_length(F.col("duration_ms"), F.floor(F.col("frames") / 3))
    return V.phones(spark, sf).select("utterance_id", F.col("index").cast("long").alias("index"), r6(f).alias("frame_ms"))
