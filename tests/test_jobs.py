"""Composite jobs and the rules that hand-made rows tell apart."""

import itertools
import math
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import scores as S
from cadenza.operators import align, assess, encoder, jobs, reports, sampling, verify
from cadenza.operators import words as O
from cadenza.session import scratch
from cadenza.sources import corpora, sinks
from cadenza.streaming import recordings


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


PHONE = "k long, index int, phoneme string, match int, dur int, presence int, confidence double, status string, quality string"


def test_primary_issue_uses_the_overall_confidence(spark):
    # scaled by each phone's own confidence B would be worse: 0.65 + 0.35 * 0.9 against 0.65 + 0.35 * 0.4
    rows = [(1, 0, "A", 40, 100, 100, 0.4, "low_match", "ok"), (1, 1, "B", 45, 100, 100, 0.9, "weak", "ok")]
    rows += [(2, 0, "A", 90, 100, 100, 0.5, "ok", "ok"), (2, 1, "B", 90, 100, 100, 0.9, "weak", "ok")]
    phones = spark.createDataFrame(rows, PHONE)
    recordings_ = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    got = {r["k"]: (r["phoneme"], r["issue"]) for r in assess.primary_issue(recordings_, phones, "k").collect()}
    assert got == {1: ("A", "low_match"), 2: ("A", "low_match"), 3: (None, "no_signal")}
    out = {r["k"]: r for r in assess.assessments(recordings_, phones, "k").collect()}
    assert out[1]["confidence"] == 0.65 and math.isclose(out[1]["severity"], (0.65 + 0.35 * 0.65) * 60)
    assert (out[3]["score"], out[3]["confidence"], out[3]["issue"], out[3]["severity"]) == (0, 0.0, "no_signal", None)
    assert math.isclose(one(spark, S.severity(F.lit(40), F.lit(100), F.lit(100), F.lit(0.65))), out[1]["severity"])


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("a", float(x)) for x in rng.normal(50, 30, 500)] + [("b", 7.0)] * 9 + [("c", 1.0), ("c", 2.0), ("c", None)]
    got = {r["class"]: r for r in reports.percentiles(spark.createDataFrame(rows, "k string, x double"), "k", F.col("x")).collect()}
    for k in "abc":
        v = [x for c, x in rows if c == k and x is not None]
        assert np.allclose([got[k][f"p{p}"] for p in reports.PERCENTILES], np.percentile(v, reports.PERCENTILES))


def test_omission_clears_the_vector(spark):
    n, width = 200, 3
    row = (1, list(range(2, n + 2)), [50.0] * n, [1] * n, [1.0] * (n * width))
    ids = [2 + i % 39 for i in range(n)]
    df = spark.createDataFrame([(row[0], ids, *row[2:])], "utterance_id long, phoneme_ids array<int>, match_targets array<double>, presence_targets array<int>, acoustic_flat array<double>")
    r = sampling.negative_words(df, 0.6, 5).first()
    assert {"", "substitution", "omission"} == set(r["augmented"])
    for i, kind in enumerate(r["augmented"]):
        vector = r["acoustic_flat"][width * i : width * (i + 1)]
        assert vector == ([0.0] * width if kind == "omission" else [1.0] * width)
        assert r["presence_targets"][i] == (kind != "omission")
        assert r["match_targets"][i] == {"": 50.0, "substitution": 15.0, "omission": 0.0}[kind]
        assert (r["phoneme_ids"][i] != ids[i]) == (kind == "substitution") and 2 <= r["phoneme_ids"][i] <= 40


def phones(spark, n=6):
    rows = [(u, i, 9, "train", "AH", 100 + i, 1.0, False, 0.1, 0.2, 5 + i, 0.5, [float(i)] * 4) for u in range(n) for i in range(3)]
    schema = "utterance_id long, index int, speaker_id int, split string, phoneme string, duration_ms int, human_score double, omission boolean, variance double, energy double, frames int, z double, emb array<double>"
    return spark.createDataFrame(rows, schema)


def test_dense_table_checks_its_width(spark):
    path = scratch(spark, "dense")
    m = sinks.write_dense_words(phones(spark), path, embedding="emb", width=7)
    assert (m["num_utterances"], m["num_rows"], m["acoustic_dim"]) == (6, 18, 7)
    w = corpora.dense_words(spark, path, None, 6, 7).orderBy("utterance_id").first()
    assert w["acoustic_flat"] == [x for i in range(3) for x in [float(i)] * 4 + [0.1, 0.5, 0.2]] and w["seq_len"] == 3
    with pytest.raises(Exception, match="another width"):
        sinks.write_dense_words(phones(spark), scratch(spark, "dense"), embedding="emb", width=8)
    with pytest.raises(ValueError, match="no rows"):
        sinks.write_dense_words(phones(spark).limit(0), scratch(spark, "dense"))


def test_verify_features_counts_broken_rows(spark):
    p = phones(spark)
    profile, totals = jobs.verify_features(p.where("utterance_id < 5"), O.assemble_words(p), {"duration": F.col("duration_ms") < 102})
    r, t = profile.first(), totals.first()
    assert (r["rows"], r["utterances"], r["broken_rows"]) == (15, 5, 5)
    assert (t["row_delta"], t["word_delta"], t["matches"]) == (-3, -1, False)
    d = verify.profile(p.withColumn("shard", F.col("utterance_id") % 2), embedding="emb", shard="shard", group="frames").first()
    assert (d["shards"], d["widths"], d["group_runs"]) == (2, {4: 18}, 18)


def test_epoch_plan_pads_every_word_to_its_batch(spark):
    rows = [(u, 1, "train", ["AH"] * (1 + u % 5), [2] * (1 + u % 5), [60.0] * (1 + u % 5), [1] * (1 + u % 5), [0.5] * (2 + 2 * (u % 5)), 1 + u % 5) for u in range(50)]
    schema = "utterance_id long, speaker_id int, split string, phones array<string>, phoneme_ids array<int>, match_targets array<double>, presence_targets array<int>, acoustic_flat array<double>, seq_len int"
    d = jobs.epoch_plan(spark.createDataFrame(rows, schema), "split", "utterance_id", 4, 16, 1, 0, 0.5, negatives=0.3, multiplier=2).collect()
    assert len(d) == 50
    for r in d:
        n = r["seq_len"]
        same = [x for x in d if (x["bucket"], x["length_batch"]) == (r["bucket"], r["length_batch"])]
        assert len(same) <= 4 and r["width"] == max(x["seq_len"] for x in same)
        assert len(r["padded_ids"]) == r["width"] and r["padded_ids"][n:] == [0] * (r["width"] - n) and r["valid"] == [i < n for i in range(r["width"])]
        assert len(r["mask"]) == min(n, max(1, round(n * 0.5))) and all(0 <= i < n for i in r["mask"])


WORDS = {"cat": ["K", "AE", "T"], "go": ["G", "OW"], "longest": list("ABCDEFGHIJ")}
RATE, FRAME, WIDTH = 64, 4, 2


def assess_by_hand(asked, samples):
    """One recording, step by step in plain Python: (word, reason) or (word, score, issue phone)."""
    word = asked.strip().lower()
    if word not in WORDS:
        return word, "unknown_word"
    ms = round(len(samples) / RATE * 1000)
    if ms < 250 or ms > 4000:
        return word, "too_short" if ms < 250 else "too_long"
    ph, n = WORDS[word], len(samples) // FRAME
    if n < len(ph):
        return word, "too_few_frames"
    x = np.array(samples)
    rms, clip, quiet = math.sqrt((x * x).mean()), (abs(x) >= 0.985).mean(), (abs(x) < 0.015).mean()
    factor = 0.75 if rms < 0.04 or quiet > 0.75 else 0.92 if clip > 0.08 or quiet > 0.45 else 1.0
    x = x / abs(x).max() if abs(x).max() > 0 else x
    f = x[: n * FRAME].reshape(n, FRAME)
    vectors, energies = np.log1p(abs(np.fft.rfft(f, axis=1)))[:, :WIDTH].astype(np.float32).astype(float), np.sqrt((f * f).mean(axis=1))
    weight = {p: one_weight(p) for p in ph}
    lengths = [max(1, int(weight[p] / sum(weight[q] for q in ph) * n)) for p in ph]
    i = 0
    while sum(lengths) < n:
        lengths[i % len(ph)] += 1
        i += 1
    while sum(lengths) > n:
        if lengths[i % len(ph)] > 1:
            lengths[i % len(ph)] -= 1
        i += 1
    at, parts, clamp = 0, [], lambda v: max(0, min(100, round(v)))
    for p, k in zip(ph, lengths):
        var, energy = vectors[at : at + k].var(), energies[at : at + k].mean()
        at += k
        ratio = 1.0 if energies.mean() == 0 else energy / (energies.mean() + 1e-6)
        conf = max(0.4, min(0.98, round(0.72 + 0.18 * min(ratio, 1.2), 3)))
        z = round((max(0.5, k / max(1.0, n / len(ph))) - weight[p]) / max(0.35, weight[p]), 3)
        m = clamp(82 - min(28, var * 120) + min(12, energy * 22))
        d, pr = clamp(92 - min(40, abs(z) * 35)), clamp(96 - (0 if energy > 0.08 else 35) - max(0, -z * 12))
        parts.append((p, m, d, pr, conf))
    ws = sum((1.5 if len(p) > 1 else 1.0) * (0.5 * m + 0.25 * d + 0.25 * pr) for p, m, d, pr, _ in parts)
    score = clamp(round(ws / max(1.0, sum(1.5 if len(p) > 1 else 1.0 for p, *_ in parts)) * factor, 9))
    worst = max(parts, key=lambda y: (100 - y[1]) + 0.75 * (100 - y[3]) + 0.45 * (100 - y[2]))
    return word, score, worst[0]


def one_weight(p):
    from cadenza.functions.constants import DURATION_WEIGHTS

    return next((w for w, group in DURATION_WEIGHTS.items() if p in group), 1.0)


def recorded(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice([" Cat", "GO ", "longest", "zz"]), [float(v) for v in rng.normal(0, 0.3, int(rng.integers(4, 300)))]) for i in range(60)]
    rows += [(60, "cat", [0.0] * 100), (61, "cat", []), (62, None, [0.1] * 50), (63, "longest", [0.1] * 20)]
    df = spark.createDataFrame(rows, "recording_id long, asked string, samples array<double>")
    lexicon = spark.createDataFrame(list(WORDS.items()), "word string, lexicon_phones array<string>")
    return rows, df, lexicon, spark.createDataFrame([("cat", "audio/cat.wav")], "word string, asset_path string")


def test_assess_recordings_equals_plain_python(spark):
    rows, df, lexicon, assets = recorded(spark)
    good, bad = jobs.assess_recordings(df, lexicon, assets, encoder.spectral_encoder(WIDTH, FRAME), RATE, FRAME, WIDTH)
    good, bad = {r["recording_id"]: r for r in good.collect()}, {r["recording_id"]: r for r in bad.collect()}
    assert sorted([*good, *bad]) == list(range(64)) and len(good) > 20
    assert {r["reason"] for r in bad.values()} == {"unknown_word", "too_short", "too_long", "too_few_frames"}
    for i, asked, samples in rows:
        want = assess_by_hand(asked or "", samples)
        if len(want) == 2:
            assert bad[i]["reason"] == want[1]
        else:
            assert (good[i]["word"], good[i]["score"], good[i]["issue_phone"]) == want
            assert good[i]["asset_path"] == ("audio/cat.wav" if want[0] == "cat" else None)


def test_stream_writes_assessments_and_rejects(spark):
    _, df, lexicon, assets = recorded(spark)
    path = scratch(spark, "stream")
    df.write.parquet(f"{path}/in")
    job = lambda batch: jobs.assess_recordings(batch, lexicon, assets, encoder.spectral_encoder(WIDTH, FRAME), RATE, FRAME, WIDTH)
    recordings.assess_stream(recordings.stream_table(spark, f"{path}/in"), job, f"{path}/out", f"{path}/state").awaitTermination()
    good, bad = spark.read.parquet(f"{path}/out/assessments"), spark.read.parquet(f"{path}/out/rejects")
    want, _ = job(df)
    assert sorted(good.drop("batch").collect()) == sorted(want.collect()) and good.count() + bad.count() == 64


def test_transcripts_are_written_once_each(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.lab", "one"), ("a/y.lab", "two"), ("b/z.lab", None)], "rel_path string, text string")
    path = str(tmp_path / "lab")
    assert sinks.write_transcripts(rows.limit(2), path) == {"written": 2, "reused": 0}
    there = spark.read.parquet(path)
    assert sinks.write_transcripts(rows, path, there.unionByName(there)) == {"written": 1, "reused": 2}
    back = spark.read.parquet(path)
    assert sorted((r.rel_path, r.text) for r in back.collect()) == [("a/x.lab", "one"), ("a/y.lab", "two"), ("b/z.lab", None)]
    assert back.select("folder").distinct().count() == 2  # a partition for each folder


def test_prepared_manifests(spark, tmp_path):
    kind = "utterance_id string, speaker_id string, split string, reason string"
    rows = spark.createDataFrame([("u1", "s1", "train", None), ("u2", "s2", "val", None), ("u3", None, "test", None), ("u4", "s2", "train", "empty_transcript")], kind)
    kept = jobs.write_prepared(rows, str(tmp_path / "m"), disjoint=True)
    assert sorted((r.utterance_id, r.split) for r in kept.collect()) == [("u1", "train"), ("u2", "val"), ("u3", "test")]
    summary = {(r.split, r["reason"] if "reason" in r else None): r.rows for r in spark.read.json(str(tmp_path / "m-summary")).collect()}
    assert summary == {("train", None): 1, ("val", None): 1, ("test", None): 1, ("train", "empty_transcript"): 1}
    leak = rows.withColumn("reason", F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        jobs.write_prepared(leak, str(tmp_path / "n"), disjoint=True)


def test_label_spans_without_frames(spark):
    p = spark.createDataFrame([("u", "AA", 0, 10, 0)], "utterance_id string, phoneme string, start_ms int, end_ms int, total_frames int")
    got = align.label_spans(p, 0.0).first()
    assert (got["start"], got["end"], got["z"]) == (0, 1, 0.0)


def test_a_path_listed_twice_resolves_once(spark):
    df = spark.createDataFrame([("a.wav",), (None,)], "p string")
    listing = spark.createDataFrame([("raw/a.wav",), ("raw/a.wav",)], "listed string")
    assert [r.resolved for r in corpora.resolve_audio(df, listing, "p").orderBy("p").collect()] == [None, "raw/a.wav"]


def phone_vectors(spark, n=900, seed=4):
    """Vectors around three centres, the first class rare, of thirty speakers."""
    rng = np.random.default_rng(seed)
    kinds = rng.choice(3, n, p=[0.06, 0.3, 0.64])
    centres = np.array([[2.0, 0, 0], [0, 2.0, 0], [0, 0, 2.0]])
    rows = [(i, int(i % 30), int(k), [float(x) for x in centres[k] + rng.normal(0, 1.1, 3)]) for i, k in enumerate(kinds)]
    return spark.createDataFrame(rows, "k long, speaker long, class_index int, embedding array<double>")


def test_scorer_weights_are_inverse_frequencies(spark):
    d = phone_vectors(spark)
    n = {r["class_index"]: r["count"] for r in d.groupBy("class_index").count().collect()}
    inverse = {k: 1 / v for k, v in n.items()}
    got = {r["class_index"]: r["weight"] for r in encoder.weighted_classes(d).select("class_index", "weight").distinct().collect()}
    assert all(math.isclose(got[k], inverse[k] * 3 / sum(inverse.values())) for k in n)


def test_scorer_judges_speakers_that_it_has_not_seen(spark):
    d = phone_vectors(spark)
    out = encoder.held_out_scores(d, "speaker").collect()
    assert sorted(r["k"] for r in out) == list(range(900)) and {r["fold"] for r in out} == {0, 1, 2}
    assert all(len({r["fold"] for r in out if r["speaker"] == s}) == 1 for s in range(30))
    recall = lambda rows, c: np.mean([r["prediction"] == c for r in rows if r["class_index"] == c])
    assert np.mean([r["prediction"] == r["class_index"] for r in out]) > 0.75 and all(recall(out, c) > 0.7 for c in range(3))
    # without weights the rare class is lost to the frequent ones
    plain_ = encoder.score_phones(encoder.fit_phone_scorer(d.withColumn("weight", F.lit(1.0))), d).collect()
    assert recall(plain_, 0) < recall(out, 0) - 0.1
    assert all(math.isclose(sum(r["probs"]), 1, abs_tol=1e-6) and math.isclose(r["expected_score"], np.dot(r["probs"], [15, 60, 92]), rel_tol=1e-6) for r in out)
    with pytest.raises(ValueError, match="folds"):
        encoder.held_out_scores(d.where("speaker = 1"), "speaker")


def test_stream_assesses_a_repeated_recording_once(spark):
    _, df, lexicon, assets = recorded(spark)
    path = scratch(spark, "stream")
    job = lambda batch: jobs.assess_recordings(batch, lexicon, assets, encoder.spectral_encoder(WIDTH, FRAME), RATE, FRAME, WIDTH)
    at = lambda minute: F.timestamp_seconds(F.lit(60 * (1000 + minute)))

    def feed(*parts):
        for rows, minute in parts:
            rows.withColumn("ts", at(minute)).coalesce(1).write.mode("append").parquet(f"{path}/in")
            recordings.assess_stream(recordings.stream_table(spark, f"{path}/in"), job, f"{path}/out", f"{path}/state", time="ts").awaitTermination()

    one, two, three = df.where("recording_id < 20"), df.where("recording_id between 10 and 39"), df.where("recording_id >= 40")
    feed((one, 0), (two, 3), (three, 120))
    feed((df.where("recording_id = 63").withColumn("recording_id", F.lit(99).cast("long")), 1))  # two hours late
    feed((one.unionByName(two), 121))  # long after: their first coming is forgotten
    good, bad = spark.read.parquet(f"{path}/out/assessments"), spark.read.parquet(f"{path}/out/rejects")
    n = {r["recording_id"]: r["n"] for r in good.select("recording_id").unionByName(bad.select("recording_id")).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {i: 2 if i < 40 else 1 for i in range(64)}


def test_weights_are_summed_in_the_order_of_phones(spark):
    said, n = ["S", "AH", "M", "CH", "B", "L", "AH", "K"], 120
    weights = {"S": 1.35, "AH": 1.8, "M": 1.1, "CH": 1.25, "B": 0.85, "L": 1.0, "K": 0.85}
    words = list(itertools.permutations(said))[::97]
    rows = [(k, i, p, n) for k, word in enumerate(words) for i, p in reversed(list(enumerate(word)))]
    got = assess.align_frames(spark.createDataFrame(rows, "utterance_id long, index int, phoneme string, total_frames int")).orderBy("utterance_id", "index").collect()
    for k, word in enumerate(words):
        total = 0.0
        for p in word:
            total += weights[p]
        lengths = [max(1, int(weights[p] / total * n)) for p in word]
        over = n - sum(lengths)
        expected = [x + over // 8 + (i < over % 8) for i, x in enumerate(lengths)]
        assert [r["length"] for r in got[8 * k : 8 * k + 8]] == expected


def test_phones_of_a_large_table_are_dealt_over_bounded_tasks(spark, monkeypatch):
    from cadenza import session
    from cadenza.plans import views

    sf = "/root/testdata/sf0.001"
    before = views.phones(spark, sf).collect()
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    p = views.phones(spark, sf)
    rows = p.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert rows < 400 < 6000 / 4
    assert sorted(p.collect()) == sorted(before)


def test_shards_are_compressed_and_dealt_by_word(spark):
    path = scratch(spark, "shards")
    rows = spark.range(4000).select((F.col("id") / 4).cast("long").alias("utterance_id"), (F.col("id") % 4).cast("int").alias("index"))
    sinks.write_shards(rows, path, 100)
    s = corpora.feature_shards(spark, path, "utterance_id long, index int")
    assert {x.rsplit("/", 1)[-1].endswith(".json.gz") for x in s.inputFiles()} == {True}
    spread = corpora.by_word(s.repartition(16))
    assert spread.rdd.getNumPartitions() == 16
    assert spread.withColumn("p", F.spark_partition_id()).groupBy("utterance_id").agg(F.count_distinct("p").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1 or rows <> 4").count() == 0


def test_recordings_are_encoded_once_for_all_that_is_made_of_them(spark, tmp_path):
    from cadenza.operators.jobs import assess_recordings

    def make():
        encode = encoder.spectral_encoder(2, 2)()

        def counted(x, sizes):
            for _ in range(len(x)):
                (tmp_path / f"{time.time_ns()}-{uuid.uuid4().hex}").touch()
            return encode(x, sizes)

        return counted

    lexicon = spark.createDataFrame([("ab", ["A", "B"]), ("none", [])], "word string, lexicon_phones array<string>")
    assets = spark.createDataFrame([], "word string, asset_path string")
    rows = [(k, "none" if k == 9 else "ab", [math.sin(i * (k + 1)) for i in range(32)]) for k in range(10)]
    good, _ = assess_recordings(spark.createDataFrame(rows, "recording_id long, asked string, samples array<double>"), lexicon, assets, make, 64, 2, 2)
    got = {r["recording_id"]: r for r in good.collect()}
    assert len(got) == 10 and len(list(tmp_path.iterdir())) == 10
    assert got[9]["score"] == 0 and got[9]["issue"] == "no_signal" and got[9]["issue_phone"] is None


def test_phones_in_words_shuffle_documents_only(spark):
    from cadenza.plans.all_queries import QUERIES

    plan = QUERIES["jn_07_phones_in_word"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("RepartitionByExpression") == 1
