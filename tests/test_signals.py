"""Signals judged, dealt and pooled a batch at a time against the functions on columns."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.functions import scores as S
from cadenza.functions import signal as G
from cadenza.functions.constants import PHONES
from cadenza.operators import assess, encoder, jobs, pooling, signals

KIND = "k long, lexicon_phones array<string>, samples array<double>"


def recordings(n=80):
    rng = np.random.default_rng(8)
    rows = [(i, [str(p) for p in rng.choice([*PHONES, "?"], int(rng.integers(0, 9)))], [float(x) for x in rng.normal(0, [0.02, 0.3, 2][i % 3], int(rng.integers(20, 400)))]) for i in range(n)]
    rows += [(n, ["AA"], [0.0] * 30), (n + 1, [], []), (n + 2, ["B", "M"], None), (n + 3, ["AA"], [0.5, None, -0.2, 0.01] * 9), (n + 4, [None, "B"], [0.004] * 21), (n + 5, ["S"] * 10, [0.9] * 21), (n + 6, ["S"], [0.3] * 16 + [float("nan")] * 4)]
    return rows


def test_a_batch_of_signals_equals_the_columns_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(signals, "BATCH_SAMPLES", 3000)
    d = spark.createDataFrame(recordings(), KIND).repartition(3).cache()
    got = signals.pooled_signals(d, encoder.spectral_encoder(2, 2), 2, 2).join(d, "k")
    x = F.col("samples")
    want = S.quality_status(G.rms(x), G.clipping_ratio(x), G.silence_ratio(x))
    assert got.count() == 87 and got.where(F.col("quality") != want).count() == 0
    assert {r["quality"] for r in got.collect()} == {"ok", "low_confidence", "rejected"}

    # spans dealt by the windows of align_frames, numbers pooled by the functions on arrays
    cases = d.select(F.col("k").alias("word"), F.coalesce(F.floor(F.size("samples") / 2), F.lit(0)).cast("int").alias("total_frames"), F.posexplode("lexicon_phones").alias("index", "phoneme"))
    spans = assess.align_frames(cases, "word").where("reason is null").select(F.col("word").alias("k"), "index", "start", "end", F.col("z").alias("want_z"))
    made = encoder.encode_signals(d.withColumn("x", G.peak_normalise(x)), "x", encoder.spectral_encoder(2, 2), 2, 2, 64)
    whole = F.coalesce(G.mean(F.col("frame_energy")), F.lit(0.0))
    own = spans.join(made, "k").select("k", "index", "want_z", pooling.variance(F.slice("encoded", F.col("start") * 2 + 1, (F.col("end") - F.col("start")) * 2)).alias("v"), G.mean(F.slice("frame_energy", F.col("start") + 1, F.col("end") - F.col("start"))).alias("e"), whole.alias("m"))
    both = own.join(got.select("k", "mean_energy", F.explode("spans").alias("p")), (F.col("p.index") == F.col("index")) & (own["k"] == got["k"])).collect()
    assert len(both) == spans.count() > 300
    for r in both:
        assert r["want_z"] == r["p"]["z"] and np.allclose([r["v"], r["e"], r["m"]], [r["p"]["variance"], r["p"]["energy"], r["mean_energy"]], rtol=1e-9, atol=1e-12, equal_nan=True)


def test_frames_are_dealt_as_by_windows(spark):
    rng = np.random.default_rng(2)
    words = [[str(p) for p in rng.choice(PHONES, int(rng.integers(1, 14)))] for _ in range(300)]
    frames = np.array([len(w) + int(rng.integers(0, 6 if i % 2 else 90)) for i, w in enumerate(words)])
    words += [["AA"] * 5 + ["B"] * 20] * 5  # some lengths of one frame at least are over
    frames = np.append(frames, [27, 28, 29, 30, 31])
    rows = [(k, i, p, int(frames[k])) for k, w in enumerate(words) for i, p in enumerate(w)]
    want = assess.align_frames(spark.createDataFrame(rows, "utterance_id long, index int, phoneme string, total_frames int")).orderBy("utterance_id", "index").collect()
    count = np.array([len(w) for w in words])
    start, end, z = signals.dealt_frames(signals.phone_weights(pa.array([r[2] for r in rows])), np.cumsum(count) - count, count, frames)
    assert any(r["delta"] < 0 for r in want)
    assert [(r["start"], r["end"], r["z"]) for r in want] == list(zip(start.tolist(), end.tolist(), z.tolist()))


def test_half_up_is_the_round_of_columns(spark):
    x = [0.0005, 0.0015, 1.0005, 2.6755, -0.0025, 1.2345, 0.4995, 123.4565, 1e-9, -3.0, 0.1 + 0.2, *np.random.default_rng(1).normal(0, 1, 500).tolist()]
    want = [r["y"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(F.round("x", 3).alias("y")).collect()]
    assert want == (signals.half_up(np.array(x)) + 0.0).tolist()


def test_signals_are_neither_shuffled_nor_walked_by_lambdas(spark):
    df = spark.range(50).select(F.col("id").alias("recording_id"), F.lit("cat").alias("asked"), F.array_repeat(F.lit(0.1), 40).alias("samples"))
    lexicon = spark.createDataFrame([("cat", ["K", "AE", "T"])], "word string, lexicon_phones array<string>")
    good, bad = jobs.assess_recordings(df, lexicon, spark.createDataFrame([], "word string, asset_path string"), encoder.spectral_encoder(2, 2), 64, 2, 2)
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "Window" not in plan and plan.count("Aggregate") == 1  # the phones of a recording are summed up, no more
    assert good.count() == 50 and bad.count() == 0


def test_recordings_of_a_small_table_use_all_cores(spark):
    from cadenza.plans.q_jobs import assessed
    from cadenza.session import table

    events = table(spark, "/root/testdata/sf0.001", "events")
    seen = spark.sparkContext.accumulator(0)
    real = encoder.spectral_encoder

    def counting(width, window):
        def make():
            seen.add(1)
            return real(width, window)()

        return make

    encoder.spectral_encoder = counting
    try:
        good, _ = assessed(spark, "/root/testdata/sf0.001", events)
        good.collect()
    finally:
        encoder.spectral_encoder = real
    assert seen.value >= spark.sparkContext.defaultParallelism


def test_a_batch_of_the_stream_uses_all_cores(spark, monkeypatch):
    from cadenza.plans.all_queries import QUERIES

    seen, real = spark.sparkContext.accumulator(0), encoder.spectral_encoder

    def counting(width, window):
        def make():
            seen.add(1)
            return real(width, window)()

        return make

    monkeypatch.setattr(encoder, "spectral_encoder", counting)
    out = QUERIES["st_01_assess_stream"](spark, "/root/testdata/sf0.001")
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    assert seen.value >= spark.sparkContext.defaultParallelism
