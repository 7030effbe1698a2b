"""Recordings judged, encoded and pooled over their phones, a batch of signals at a time.

What the functions on columns do for one array (``functions.signal``, ``assess.align_frames``, ``pooling.variance``) is done here for
all signals of a batch at once, by numpy: an array's lambda takes a step of the JVM for each sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cadenza.functions.constants import DURATION_WEIGHTS
from cadenza.operators.encoder import BAND, BATCH_SAMPLES

POOLED = "quality string, mean_energy double, spans array<struct<index:int,phoneme:string,z:double,variance:double,energy:double>>"
_SPAN = pa.struct([("index", pa.int32()), ("phoneme", pa.string()), ("z", pa.float64()), ("variance", pa.float64()), ("energy", pa.float64())])
_STATUS = np.array(["ok", "low_confidence", "rejected"])


def half_up(x: np.ndarray, digits: int = 3) -> np.ndarray:
    """Spark's ``round``: half up of the shortest decimal; what lies next to a half is rounded as a decimal."""
    size = np.abs(x) * 10.0**digits
    out = np.copysign(np.floor(size + 0.5) / 10.0**digits, x)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The sums of ``values[start:end]``, 0 where that is empty."""
    cuts = np.stack([start, np.maximum(start, end)], axis=1).reshape(-1)
    return np.where(end > start, np.add.reduceat(np.append(values, values.dtype.type(0)), cuts)[::2], 0) if len(cuts) else np.zeros(0, values.dtype)


def ordered_sums(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The sums of ``count`` values from ``first``, added in their order: another order can differ in its last bit."""
    total = np.zeros(len(count))
    for i in range(int(count.max(initial=0))):
        some = np.flatnonzero(count > i)
        total[some] += values[first[some] + i]
    return total


def dealt_frames(weights: np.ndarray, first: np.ndarray, count: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """WN-07, WN-08 as ``assess.align_frames``, for many words: phone weights of all words, each word's first phone, number of phones and frames
    (no fewer than phones) to each phone's first frame, the one after its last, and z."""
    word = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(weights)) - first[word]
    total = ordered_sums(weights, first, count)
    length = np.maximum(1, np.floor(weights / total[word] * frames[word])).astype(np.int64)
    over = frames - sums(length, first, first + count)
    k = np.maximum(1, count)
    more = over // k
    rest = over - more * k
    added = np.where(over[word] >= 0, more[word] + (place < rest[word]), 0)
    for w in np.flatnonzero(over < 0):  # round r takes a frame from each phone longer than r, in order
        own, r = slice(first[w], first[w] + count[w]), 1
        lack = min(-over[w], (length[own] - 1).sum())
        while lack:
            some = np.flatnonzero(length[own] > r)[:lack]
            added[own][some] -= 1
            lack, r = lack - len(some), r + 1
    length = length + added
    end = np.cumsum(length)
    end -= (end - length)[first[word]]
    observed = np.maximum(0.5, length / np.maximum(1.0, frames / k)[word])
    return end - length, end, half_up((observed - weights) / np.maximum(0.35, weights)) + 0.0


def phone_weights(phones: pa.Array) -> np.ndarray:
    """FN-19 for an array of phones."""
    known = {p: w for w, group in DURATION_WEIGHTS.items() for p in group}
    coded = phones.dictionary_encode()
    each = np.array([*(known.get(p, 1.0) for p in coded.dictionary.to_pylist()), 1.0])
    return each[pc.fill_null(coded.indices, len(each) - 1).to_numpy(zero_copy_only=False)]


def pooled_signals(df: DataFrame, make: Callable, window: int, width: int) -> DataFrame:
    """``df`` (lexicon_phones, samples, other columns) with the signal's ``quality`` (FN-27),
    ``mean_energy`` and ``spans``: the phones with their z, the variance of their frames' numbers and their mean energy, none if there are fewer windows than phones. Samples and phones go.

    A signal is normalised to its peak, judged as it came and encoded whole; signals of like length are encoded together, nothing is shuffled.
    """
    own = [c for c in df.columns if c not in ("samples", "lexicon_phones")]
    names = [*own, "quality", "mean_energy", "spans"]

    def bands(sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of like size, at most BATCH_SAMPLES with their padding, or one row."""
        band = np.floor(np.log(np.maximum(1, sizes)) / math.log(BAND)).astype(int)
        for b in np.unique(band):
            rows = np.flatnonzero(band == b)
            step = max(1, BATCH_SAMPLES // max(1, int(sizes[rows].max())))
            yield from (rows[i : i + step] for i in range(0, len(rows), step))

    def judged(values: np.ndarray, known: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each signal's status and peak. A missing sample counts for its length only, NaN is above any number."""
        level, end, n = np.where(known, np.abs(values), 0.0), first + sizes, np.maximum(1, sizes)
        power = np.sqrt(sums(values * values, first, end) / n)
        clipped, quiet = (sums((known & hit).astype(np.int64), first, end) / n for hit in (~(level < 0.985), level < 0.015))
        status = np.where(((power < 0.04) & (sizes > 0)) | (quiet > 0.75), 2, np.where((clipped > 0.08) | (quiet > 0.45), 1, 0))
        peak = np.ones(len(sizes))
        some = np.flatnonzero(sizes > 0)
        if len(some):
            top = np.maximum.reduceat(level, first[some])
            peak[some] = np.where(top <= 0, 1.0, top)
        return status, peak

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            signals = batch.column("samples")
            sizes = pc.fill_null(pc.list_value_length(signals), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = signals.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(float)
            known = flat.is_valid().to_numpy(zero_copy_only=False)
            first = np.cumsum(sizes) - sizes
            status, peak = judged(values, known, first, sizes)
            values = values / np.repeat(peak, sizes)
            for rows in bands(sizes):
                yield made(encode, batch, rows, values, first[rows], sizes[rows], status[rows])

    def made(encode: Callable, batch: pa.RecordBatch, rows: np.ndarray, values: np.ndarray, first: np.ndarray, sizes: np.ndarray, status: np.ndarray) -> pa.RecordBatch:
        longest = max(1, int(sizes.max()))
        there = np.arange(longest) < sizes[:, None]
        padded = np.zeros((len(rows), longest))
        padded[there] = values[(first[:, None] + np.arange(longest))[there]]
        whole = sizes // window
        top = longest // window
        loud = np.sqrt((padded[:, : top * window].reshape(len(rows), top, window) ** 2).mean(axis=2))[np.arange(top) < whole[:, None]]
        frames, counts = encode(padded.astype(np.float32), sizes)
        counts = np.asarray(counts).astype(np.int64)
        inside = np.arange(frames.shape[1]) < counts[:, None]
        vectors = frames[inside].astype(float)
        total, square = vectors.sum(axis=1), (vectors * vectors).sum(axis=1)

        at = pa.array(rows)
        phones = batch.column("lexicon_phones").take(at)
        count = pc.fill_null(pc.list_value_length(phones), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        said = phones.flatten()
        short = whole < count  # as a word of too few frames: no spans
        said, count = said.filter(pa.array(~np.repeat(short, count))), np.where(short, 0, count)
        begin = np.cumsum(count) - count
        start, end, z = dealt_frames(phone_weights(said), begin, count, whole)
        word = np.repeat(np.arange(len(rows)), count)

        def within(having: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            base = np.cumsum(having) - having
            return base[word] + np.minimum(start, having[word]), base[word] + np.minimum(end, having[word])

        a, b = within(counts)
        n = np.maximum(1, (b - a) * width)
        mean = sums(total, a, b) / n
        variance = np.maximum(0.0, sums(square, a, b) / n - mean * mean)
        a, b = within(whole)
        energy = sums(loud, a, b) / np.maximum(1, b - a)
        base = np.cumsum(whole) - whole
        mean_energy = sums(loud, base, base + whole) / np.maximum(1, whole)
        each = pa.StructArray.from_arrays([pa.array(np.arange(len(word)) - begin[word], pa.int32()), said, pa.array(z), pa.array(variance), pa.array(energy)], names=[f.name for f in _SPAN])
        spans = pa.ListArray.from_arrays(pa.array(np.append(begin, len(word)), pa.int32()), each)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in own), pa.array(_STATUS[status]), pa.array(mean_energy), spans], names=names)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in own), POOLED])
    return df.mapInArrow(run, schema)
