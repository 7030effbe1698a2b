"""Batch inference with a pluggable encoder over signals of any length, and the phone scorer.

An encoder's factory is called once per Python worker. What it makes takes padded signals (n, longest) with their sizes
and gives frames (n, F, width) with the number of real frames of each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.functions.constants import CLASSES
from cadenza.functions.labels import expected_value
from cadenza.operators.reports import class_weights

#: Samples of a padded batch, and of all batches that a task fills at a time.
BATCH_SAMPLES, HELD_SAMPLES = 1 << 21, 1 << 23
#: Neighbouring length bands differ by this factor, so padding adds at most a quarter of the real samples.
BAND = 1.25


def spectral_encoder(width: int, window: int) -> Callable:
    """A deterministic stand-in for a frozen encoder: log magnitudes of the first ``width`` frequencies of each window."""

    def make():
        def encode(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            frames = x[:, : x.shape[1] // window * window].reshape(len(x), -1, window)
            return np.log1p(np.abs(np.fft.rfft(frames, axis=2))[:, :, :width]).astype(np.float32), sizes // window

        return encode

    return make


def window_encoder(window: int) -> Callable:
    """The windows of a signal as they are, so that SQL can compute what is made of them."""

    def make():
        return lambda x, sizes: (x[:, : x.shape[1] // window * window].reshape(len(x), -1, window), sizes // window)

    return make


class RaggedBatches:
    """Deals items to bands of like size as they come, and gives back a band's items when their padded size would pass ``cap``.

    An item larger than ``cap`` is a batch of its own. Of all bands at most ``held`` samples wait: beyond, the largest goes.
    """

    def __init__(self, cap: int = BATCH_SAMPLES, held: int = HELD_SAMPLES):
        self.cap, self.held = cap, held
        self.bands: dict[int, list] = {}
        self.longest: dict[int, int] = {}

    def add(self, item: object, size: int) -> Iterator[list]:
        band = int(math.log(max(1, size), BAND))
        top = max(self.longest.get(band, 0), size)
        if band in self.bands and (len(self.bands[band]) + 1) * top > self.cap:
            yield self._take(band)
        self.bands.setdefault(band, []).append(item)
        self.longest[band] = max(self.longest.get(band, 0), size)
        padded = {b: len(x) * self.longest[b] for b, x in self.bands.items()}
        if sum(padded.values()) > self.held:
            yield self._take(max(padded, key=padded.get))

    def rest(self) -> Iterator[list]:
        for band in sorted(self.bands):
            yield self._take(band)

    def _take(self, band: int) -> list:
        self.longest.pop(band)
        return self.bands.pop(band)


def encode_many(encode: Callable, signals: list[np.ndarray]) -> list[np.ndarray]:
    """The frames of each signal of one batch, without what the encoder makes of the padding."""
    sizes = np.array([len(s) for s in signals])
    padded = np.zeros((len(signals), max(1, int(sizes.max(initial=1)))), signals[0].dtype)
    for row, s in zip(padded, signals):
        row[: len(s)] = s
    frames, counts = encode(padded, sizes)
    return [f[:n] for f, n in zip(frames, counts)]


def encode_signals(df: DataFrame, samples: str, make: Callable, window: int, width: int, rate: int, cap: int = BATCH_SAMPLES) -> DataFrame:
    """UDF-01: ``encoded`` (flat, ``width`` numbers a frame), ``n_frames``, ``frame_ms`` and ``frame_energy``, the RMS of each
    whole window of ``window`` samples, of signals of any length; none is cut.

    Signals meet in batches of like length within a task, padded to the longest of their batch; nothing is shuffled.
    """
    own = df.columns
    at = own.index(samples)
    schema = df.select("*", F.array().cast("array<float>").alias("encoded"), F.lit(0).alias("n_frames"), F.array().cast("array<double>").alias("frame_energy")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, waiting = make(), RaggedBatches(cap)

        def made(items: list) -> pa.RecordBatch:
            frames = encode_many(encode, [s.astype(np.float32) for _, s in items])
            energy = [np.sqrt((s[: len(s) // window * window].reshape(-1, window) ** 2).mean(axis=1)) for _, s in items]
            rows = pa.Table.from_batches([r for r, _ in items]).combine_chunks().to_batches()[0]
            new = [pa.array([f.reshape(-1) for f in frames], pa.list_(pa.float32())), pa.array([len(f) for f in frames], pa.int32()), pa.array(energy, pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays([*rows.columns, *new], names=schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.take(pa.array([i]))  # a copy, so that the batch isn't held with it
                signal = row.column(at)[0].values
                signal = np.zeros(0) if signal is None else signal.to_numpy(zero_copy_only=False).astype(float)
                for items in waiting.add((row, signal), len(signal)):
                    yield made(items)
        for items in waiting.rest():
            yield made(items)

    out = df.mapInArrow(run, schema)
    return out.select(*own, "encoded", "n_frames", F.lit(1000.0 * window / rate).alias("frame_ms"), "frame_energy")


def fit_phone_scorer(features: DataFrame, label: str = "class_index", weight: str = "weight", iterations: int = 20):
    """ML-01: a weighted multinomial scorer on pooled features (``embedding`` arrays)."""
    data = features.withColumn("features", array_to_vector("embedding"))
    return LogisticRegression(family="multinomial", labelCol=label, weightCol=weight, maxIter=iterations, regParam=0.01).fit(data)


def weighted_classes(features: DataFrame, label: str = "class_index") -> DataFrame:
    """ML-01: the rows with ``weight``, the inverse frequency of their class scaled to mean 1 over the classes (AG-20)."""
    name = F.get(F.array(*[F.lit(c) for c in CLASSES]), F.col(label).cast("int"))
    weights = class_weights(features.withColumn("__class", name), "__class").select(F.col("class").alias("__class"), "weight")  # three rows
    return features.withColumn("__class", name).join(F.broadcast(weights), "__class").drop("__class")


def held_out_scores(features: DataFrame, group: str, label: str = "class_index", folds: int = 3, iterations: int = 20) -> DataFrame:
    """ML-01: every row scored by a model that saw no row of its ``group`` (a speaker): groups are dealt to ``folds`` folds by hash, and
    each fold is scored by the weighted model of the others, with the weights of those. A fold whose others lack a class is scored as it is.
    """
    fold = F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")
    d = features.withColumn("fold", fold)
    out = None
    for i in range(folds):
        mine = d.where(F.col("fold") == i)
        if not mine.limit(1).count() or not d.where(F.col("fold") != i).limit(1).count():
            continue
        scored = score_phones(fit_phone_scorer(weighted_classes(d.where(F.col("fold") != i), label), label, iterations=iterations), mine)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("there are no two folds with rows")
    return out


def score_phones(model, features: DataFrame) -> DataFrame:
    """ML-01: class probabilities, the predicted class and the expected score."""
    out = model.transform(features.withColumn("features", array_to_vector("embedding")))
    return out.withColumn("probs", vector_to_array("probability")).withColumn("expected_score", expected_value(F.col("probs"))).drop("features", "rawPrediction", "probability")
