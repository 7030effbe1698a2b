"""Signals as arrays of samples, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _sum(a) / F.size(a))


def downmix(frames: Column) -> Column:
    """SIG-01: an array of channel arrays to the mean of each frame."""
    return F.transform(frames, lambda f: _sum(f) / F.size(f))


def resample(x: Column, rate: int, target: int) -> Column:
    """SIG-02: linear interpolation to max(1, rint(n / rate * target)) samples spread evenly over the signal."""
    n = F.size(x)
    m = F.greatest(F.lit(1), F.rint(n / F.lit(float(rate)) * target).cast("int"))
    at = lambda i: i * n.cast("double") / m

    def value(i: Column) -> Column:
        p = F.least(at(i), (n - 1).cast("double"))
        a = F.floor(p).cast("int")
        b = F.least(a + 1, n - 1)
        return F.get(x, a) + (F.get(x, b) - F.get(x, a)) * (p - a)

    return F.when(F.lit(rate == target), x).otherwise(F.transform(F.sequence(F.lit(0), m - 1), value))


def peak_normalise(x: Column) -> Column:
    """SIG-03: divided by the largest magnitude; silence passes through."""
    peak = F.array_max(F.transform(x, F.abs))
    return F.when(peak > 0, F.transform(x, lambda v: v / peak)).otherwise(x)


def rms(x: Column) -> Column:
    return F.sqrt(mean(F.transform(x, lambda v: v * v)))


def share(x: Column, test) -> Column:
    return F.when(F.size(x) > 0, F.size(F.filter(x, test)) / F.size(x)).otherwise(0.0)


def clipping_ratio(x: Column, level: float = 0.985) -> Column:
    """SIG-04."""
    return share(x, lambda v: F.abs(v) >= level)


def silence_ratio(x: Column, level: float = 0.015) -> Column:
    """SIG-04."""
    return share(x, lambda v: F.abs(v) < level)


def snr(x: Column) -> Column:
    """SIG-05: signal power over the power of first differences, in dB, at least 0."""
    diff = F.transform(x, lambda v, i: F.when(i == 0, 0.0).otherwise(v - F.get(x, i - 1)))
    power = lambda a: mean(F.transform(a, lambda v: v * v)) + 1e-8
    return F.when(F.size(x) < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(10 * F.log10(power(x) / power(diff)), 2)))


def duration_ms(x: Column, rate: int) -> Column:
    """SIG-06."""
    return F.rint(F.size(x) / F.lit(float(rate)) * 1000).cast("int")


def length_reason(ms: Column, shortest: int = 250, longest: int = 4000) -> Column:
    """SIG-06: why a signal is rejected, or null."""
    return F.when(ms < shortest, "too_short").when(ms > longest, "too_long")


def frame_energy(x: Column, frame_ms: Column, rate: int) -> Column:
    """SIG-07: RMS of each window; a ragged tail is kept, an empty signal gives [0]."""
    size = F.greatest(F.lit(1), F.floor(frame_ms / 1000.0 * rate).cast("int"))
    starts = F.sequence(F.lit(0), F.size(x) - 1, size)
    return F.when(F.size(x) == 0, F.array(F.lit(0.0))).otherwise(F.transform(starts, lambda s: rms(F.slice(x, s + 1, size))))


def frame_length(duration: Column, frames: Column) -> Column:
    """SIG-08."""
    return F.greatest(F.lit(10.0), duration / F.greatest(F.lit(1), frames))
