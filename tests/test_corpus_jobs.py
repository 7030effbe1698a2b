"""Corpus building from files: the sweep, both cascades, batches of signals of any length, and a feature run that is killed and taken up again."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions.scorejson import SCORES_SCHEMA
from cadenza.operators import align, encoder, features
from cadenza.sources import files, packs
from cadenza.sources.filesink import write_files

INTERVALS = "array<struct<xmin:double,xmax:double,label:string>>"


def test_containment_equals_all_pairs():
    rnd = random.Random(4)
    for _ in range(300):
        bounds = lambda n: np.array([(a, a + rnd.choice([0, 1, 1, 2, 5])) for a in (rnd.randint(0, 12) for _ in range(n))], float).reshape(-1, 2)
        w, p = bounds(rnd.randint(0, 8)), bounds(rnd.randint(0, 12))
        want = [(i, j) for i in range(len(w)) for j in range(len(p)) if p[j][0] >= w[i][0] and p[j][1] <= w[i][1]]
        assert list(zip(*(x.tolist() for x in align.containment(w, p)))) == want


def test_sweep_of_odd_rows(spark):
    rows = [
        (1, [(0.0, 1.0, "one"), (1.0, 1.0, "none"), (1.0, 2.5, "two")], [(0.0, 0.5, "ow1"), (0.5, 1.0, "sil"), (1.0, 1.0, "x"), (1.0, 2.0, None), (1.0, 2.5, "t"), (2.0, 2.6, "y")]),
        (2, None, [(0.0, 1.0, "a")]), (3, [(0.0, 1.0, "quiet")], None), (4, [], []), (5, [(0.0, 9.0, None)], [(0.0, 1.0, "SP2")]),
    ]
    d = spark.createDataFrame(rows, f"k long, w {INTERVALS}, p {INTERVALS}")
    got = {(r["k"], r["pos"]): (r["label"], [x["label"] for x in r["phones"]]) for r in align.sweep(d, "w", "p", align.silent_native).collect()}
    assert got == {(1, 0): ("one", ["OW", "X"]), (1, 1): ("none", ["X"]), (1, 2): ("two", ["X", "T"]), (3, 0): ("quiet", []), (5, 0): (None, [])}
    assert [align.silent_native(x) for x in ("<eps>", "sp1", " SIL ", "a")] == [True, True, True, False]
    assert [align.silent_scored(x) for x in ("<eps>", "sp1", "12", "a")] == [False, True, True, False]


def test_a_sweep_of_many_rows_equals_each_alone(spark, monkeypatch):
    rnd = random.Random(8)
    bound = lambda: rnd.choice([None, float("nan"), *([0.1 * rnd.randint(0, 9)] * 8), 1e9, -3.0])
    tier = lambda n: None if n == 0 else [(bound(), bound(), rnd.choice(["a1", "sil", None, "ü"])) for _ in range(n - 1)]
    rows = [(k, tier(rnd.randint(0, 7)), tier(rnd.randint(0, 12))) for k in range(200)]
    d = spark.createDataFrame(rows, f"k long, w {INTERVALS}, p {INTERVALS}").coalesce(1)
    ok = lambda x: x is not None and x == x
    want = []
    for k, w, p in rows:
        for pos, (a, b, _) in enumerate(w or []):
            inside = [t for x, y, t in p or [] if t not in ("sil", None) and all(map(ok, (a, b, x, y))) and x >= a and y <= b]
            want.append((k, pos, [t.upper().strip("1") for t in inside]))
    taken = lambda: [(r["k"], r["pos"], [x["label"] for x in r["phones"]]) for r in align.sweep(d, "w", "p", align.silent_native).collect()]
    assert taken() == want
    monkeypatch.setattr(align, "SWEEP_INTERVALS", 20)
    assert taken() == want


def grid(words, phones, names=("words", "phones")):
    out = 'Object class = "TextGrid"\nitem []:\n'
    for name, tier in zip(names, (words, phones)):
        out += f'item [1]:\nclass = "IntervalTier"\nname = "{name}"\n' + "".join(f'intervals [1]:\nxmin = {a}\nxmax = {b}\ntext = "{t}"\n' for a, b, t in tier)
    return out


def test_tiers_of_files(spark):
    texts = [("a", grid([(0, 1, 'say ""x""')], [])), ("b", "nothing"), ("c", None), ("d", grid([(0, "?", "w")], [])), ("e", grid([(0, 1, "w")], [(0, 1, "p")], ("WORD", "phones")))]
    got = {r["path"]: r for r in files.alignment_tiers(spark.createDataFrame(texts, "path string, text string")).withColumn("w", align.tier_of(F.col("tiers"), "words", ("word",))).collect()}
    assert [(t["name"], [tuple(x) for x in t["intervals"]]) for t in got["a"]["tiers"]] == [("words", [(0.0, 1.0, 'say "x"')]), ("phones", [])]
    assert {k: r["error"] for k, r in got.items()} == {"a": None, "b": files.NO_TIER, "c": files.NO_TIER, "d": "an interval without bounds", "e": None}
    assert {k: r["w"] and len(r["w"]) for k, r in got.items()} == {"a": 1, "b": None, "c": None, "d": None, "e": 1}


def test_tiers_read_at_once_equal_tiers_read_by_lines(monkeypatch):
    plain = grid([(0, 1, "a"), (1, 2.5, 'say ""x""')], [(0, 0.5, "b"), (0.5, 1, "")])
    odd = [
        plain, plain.replace("item [1]:\n", "    item [1]:  \n"), plain.replace("\n", "\r\n"), plain.rstrip("\n"), plain + "\n\n", plain.replace("xmax = 1\n", "xmax = 1 s\n"),
        plain.replace("xmin = 0.5\n", ""), plain.replace("xmin = 0.5", "xmin = ?"), plain.replace('text = "b"', 'mark = "b"'), plain.replace('"IntervalTier"', '"TextTier"', 1), plain.replace('name = "phones"\n', ""),
        plain.replace("intervals [1]:\nxmin = 0.5", "xmin = 0.5"), plain.replace('text = "b"', 'text = "b\x0bc\x85d"'), plain.replace('text = "b"', 'text = "b" "c"'), plain.replace('name = "words"', 'name = "w"" x"\nxmin = 0\nxmax = 9\nintervals: size = 2'),
        plain.replace("intervals [1]:\nxmin = 1", "a note\nintervals [1]:\nxmin = 1"), plain + 'class = "IntervalTier"\n', 'x\x0bclass = "IntervalTier"\n' + plain, "", "IntervalTier",
    ]
    as_rows = lambda found: ([(name, list(zip(*(c.to_pylist() for c in columns)))) for name, columns in found[0]], found[1])
    want = [files.file_tiers(t) for t in odd]
    assert [as_rows(files.tier_columns(t)) for t in odd] == want
    assert [x[2] for x in want[12][0][1][1]] == ["b\x0bc\x85d", ""]  # only line ends end a line
    monkeypatch.setattr(files, "_by_lines", None)
    assert as_rows(files.tier_columns(plain)) == want[0]  # the common form isn't read line by line


def test_intervals_of_files_in_large_batches(spark):
    texts = [(f"f{i}", grid([(0, 1, f"w{i}")] * (i % 3), [(0, 1, "p")])) for i in range(20)] + [("x", "nothing"), ("y", None)]
    d = spark.createDataFrame(texts, "path string, text string").coalesce(1)
    rows = [tuple(r) for r in files.alignment_intervals(d).collect()]
    want = [(f"f{i}", t, n, 0.0, 1.0, x, None) for i in range(20) for t, x, k in (("words", f"w{i}", i % 3), ("phones", "p", 1)) for n in range(k)]
    assert rows == [*want, *((p, None, None, None, None, None, files.NO_TIER) for p in "xy")]


def prepared(spark, texts, tmp_path):
    """One utterance for each text; None has no file."""
    root = f"{tmp_path}/grids"
    rows = spark.createDataFrame([(f"{k}.TextGrid", t) for k, t in texts.items() if t is not None], "rel_path string, content string")
    write_files(rows, root)
    p = spark.createDataFrame([(k, "s", "train", f"{k}.wav") for k in texts], "utterance_id string, speaker_id string, split string, audio_path string")
    return align.with_tiers(p, files.alignment_tiers(files.alignment_texts(spark, root)), root)


CAT = [(0.0, 0.1, "K"), (0.1, 0.2, "AE1"), (0.2, 0.3, "T")]


def test_native_cascade(spark, tmp_path):
    texts = {
        "good": grid([(0, 0.3, "Cat"), (0.3, 0.5, "sp")], CAT), "a b#1%é": grid([(0, 0.3, "cat")], CAT), "unknown": grid([(0, 0.3, "dog")], CAT), "short": grid([(0, 0.079, "cat")], CAT), "few": grid([(0, 0.29, "cat")], CAT),
        "other": grid([(0, 0.3, "tac")], CAT), "silent": grid([(0, 0.3, "cat")], [*CAT, (0.3, 0.3, "sil")]), "none": None, "broken": grid([(0, "x", "cat")], CAT), "tierless": grid([(0, 1, "cat")], CAT, ("x", "y")), "text": "hello",
    }
    lexicon = spark.createDataFrame([("cat", ["K", "AE", "T"]), ("tac", ["T", "AE", "K"])], "word string, lexicon_phones array<string>")
    got = {(r["utterance_id"], r["pos"]): r for r in align.aligned_native(prepared(spark, texts, tmp_path), lexicon).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        ("good", 0): None, ("a b#1%é", 0): None, ("good", 1): "skip_word_label", ("unknown", 0): "missing_cmudict", ("short", 0): "too_short", ("few", 0): "phone_count_mismatch", ("other", 0): "phone_identity_mismatch",
        ("silent", 0): None, ("none", None): "missing_textgrid", ("broken", None): "broken_textgrid", ("tierless", None): "missing_tier", ("text", None): "missing_tier",
    }
    r = got["good", 0]
    assert (r["artifact_id"], r["target_word"], r["duration_ms"], r["ipa"], r["audio_quality"]) == ("good__cat__0", "cat", 300, "kaet", {"status": "ok", "source": "native_libritts"})
    assert [tuple(x) for x in r["phone_labels"]] == [("K", 0, 0, 100, "correct", 2.0, False, "K"), ("AE", 1, 100, 200, "correct", 2.0, False, "AE"), ("T", 2, 200, 300, "correct", 2.0, False, "T")]
    assert all(x["phone_labels"] is None and x["artifact_id"] is None for x in got.values() if x["reason"])


def test_scored_cascade(spark, tmp_path):
    one, two = grid([(0, 0.3, "cat"), (0.3, 0.4, "SP")], CAT), grid([(0, 0.3, "cat"), (0.3, 0.6, "cat")], [*CAT, *[(a + 0.3, b + 0.3, t) for a, b, t in CAT]])
    word = {"text": "CAT", "phones": "K AE0 T", "ref-phones": None, "phones-accuracy": [2.0, 1.0, 0.0], "mispronunciations": [{"index": 2, "pronounced-phone": "<unk>"}, {"index": 1, "pronounced-phone": "EH"}, {"pronounced-phone": "D"}]}
    entries = {
        "good": [word, {"text": "..."}], "scores": [word | {"phones-accuracy": [2.0]}], "noscores": [word | {"phones-accuracy": None}], "nophones": [word | {"phones": None}], "count": [word | {"phones": "K AE", "phones-accuracy": [1.0, 1.0]}],
        "ref": [word | {"phones": None, "ref-phones": '["K", "AE", "T"]'}], "more": [word], "differs": [word, word | {"text": "dog"}], "nowords": None, "nofile": [word], "tierless": [word], "empty": [],
    }
    texts = {k: one for k in entries} | {"more": two, "differs": two, "nofile": None, "tierless": grid([], [], ("x", "y")), "noentry": None}
    scores = spark.createDataFrame([(k, (None, None, None if v is None else [tuple(w.get(c) for c in ("text", "accuracy", "phones", "ref-phones", "phones-accuracy")) + ([(m.get("canonical-phone"), m.get("index"), m.get("pronounced-phone")) for m in w["mispronunciations"]] if "mispronunciations" in w else None,) for w in v])) for k, v in entries.items()], f"utterance_id string, entry {SCORES_SCHEMA[len('map<string,'):-1]}")
    got = {(r["utterance_id"], r["pos"]): r for r in align.aligned_scored(prepared(spark, texts, tmp_path), scores).collect()}
    assert {k: r["reason"] for k, r in got.items()} == {
        ("good", 0): None, ("scores", 0): "phone_score_length_mismatch", ("noscores", 0): "missing_phone_scores", ("nophones", 0): "missing_phones", ("count", 0): "phone_count_mismatch", ("ref", 0): None, ("more", None): "word_count_mismatch",
        ("differs", None): "word_identity_mismatch", ("nowords", None): "missing_words", ("nofile", None): "missing_textgrid", ("tierless", None): "missing_tier", ("empty", None): "word_count_mismatch", ("noentry", None): "missing_score_entry",
    }
    assert [tuple(x)[0::1][0:1] + tuple(x)[4:] for x in got["good", 0]["phone_labels"]] == [("K", "correct", 2.0, False, None), ("AE", "accented", 1.0, False, "EH"), ("T", "wrong_or_missed", 0.0, True, "<unk>")]


# signals of any length


def test_ragged_batches_bound_their_padding():
    rnd = random.Random(2)
    sizes = [int(100 * 300 ** rnd.random()) for _ in range(5000)] + [0, 0, 1, 2, 10**6]
    waiting, seen, real, padded = encoder.RaggedBatches(cap=60_000, held=400_000), [], 0, 0
    batches = [b for s in sizes for b in waiting.add(s, s)] + list(waiting.rest())
    for b in batches:
        seen += b
        real, padded = real + sum(b), padded + len(b) * max(b)
        assert len(b) * max(b) <= 60_000 or len(b) == 1
        assert max(b) <= encoder.BAND * min(b) + 2
    assert sorted(seen) == sorted(sizes) and padded < 1.15 * real


def test_encoding_in_batches_equals_one_by_one(spark):
    rng = np.random.default_rng(7)
    rows = [(i, None if n < 0 else [float(x) for x in rng.normal(0, 1, n)], "x") for i, n in enumerate([-1, 0, 3, *rng.integers(4, 3000, 60)])]
    d = spark.createDataFrame(rows, "k long, samples array<double>, encoded string").drop("encoded")
    got = encoder.encode_signals(d.repartition(3), "samples", encoder.spectral_encoder(3, 8), 8, 3, 64, cap=5000).collect()
    assert len(got) == len(rows)
    for r in got:
        x = np.array(rows[r["k"]][1] or [])
        f = x[: len(x) // 8 * 8].reshape(-1, 8)
        assert r["n_frames"] == len(f) and r["samples"] == rows[r["k"]][1]
        assert np.allclose(np.reshape(r["encoded"], (-1, 3)), np.log1p(abs(np.fft.rfft(f.astype(np.float32), axis=1)))[:, :3], atol=1e-5)
        assert np.allclose(r["frame_energy"], np.sqrt((f**2).mean(axis=1)))


# a run of features


SPEC = {"dataset": "d", "backbone_id": "windows", "backbone_revision": "main", "embedding_source": "fallback", "alignment_source": "manual", "pooling_version": "v1", "artifact_schema_version": "v1", "sample_rate": 100}
WORD = f"utterance_id string, speaker_id string, dataset string, split string, target_word string, accent_target string, audio_path string, canonical_phones array<string>, phone_labels array<{align.LABEL}>"


def corpus(spark, tmp_path, audios=40, words=3):
    rng = np.random.default_rng(5)
    content = [(f"raw/{i}.wav" if i % 2 else f"{i}.wav", files.encode_wav(rng.normal(0, 0.2, int(rng.integers(20, 300))), 100 if i % 3 else 50)) for i in range(audios)]
    content[3] = (content[3][0], b"RIFF")
    content[4] = (content[4][0], files.encode_wav(np.zeros(5), 100))
    write_files(spark.createDataFrame(content, "rel_path string, content binary"), f"{tmp_path}/audio")
    label = lambda p, i: (p, i, 100 * i, 100 * i + 90, "correct", float(i % 3), i == 1, p)
    rows = [(f"u{a}-{w}", "s", "d", ("train", "val")[a % 5 == 0], "w", "en-US", f"{a}.wav", ["AA", "B"], [label("AA", 0), label("B", 1)]) for a in range(audios + 2) for w in range(words)]
    return spark.createDataFrame(rows, WORD)


def plain(rows):
    return sorted((str(sorted(r.asDict().items())) for r in rows))


def test_a_killed_run_is_taken_up_where_it_was(spark, tmp_path):
    aligned, audio = corpus(spark, tmp_path), f"{tmp_path}/audio"
    flag = str(tmp_path / "go")
    sizes = {"shard_rows": 20, "wave_files": 8}

    def failing():
        encode = encoder.window_encoder(10)()

        def run(x, n):
            # a signal of the last wave's length fails until the flag is there
            if not os.path.exists(flag) and poison in n:
                raise RuntimeError("the node is gone")
            return encode(x, n)

        return run

    # the audio that fails is one of the last wave's
    listing = spark.createDataFrame([(f"raw/{i}.wav" if i % 2 else f"{i}.wav",) for i in range(40)], "rel_path string")
    plan = features.planned_words(aligned, listing, 13, 5).where("resolved is not null").select("wave", "resolved").distinct().collect()
    last = max(r["wave"] for r in plan)
    names = {r["resolved"] for r in plan if r["wave"] == last} - {"raw/3.wav", "4.wav"}
    length = {r["rel_path"]: len(features.prepared_signal(open(f"{audio}/{r['rel_path']}", "rb").read(), 100, 100, 30_000)[0]) for r in listing.collect() if r["rel_path"] in names}
    poison = next(iter(length.values()))

    whole = features.precompute_features(aligned, audio, f"{tmp_path}/whole", SPEC, encoder.window_encoder(10), number="double", **sizes)
    key = whole.first()["feature_key"]
    want = spark.read.parquet(f"{tmp_path}/whole/{key}")
    reasons = {r["reason"]: r["n"] for r in want.groupBy("reason").agg(F.count_distinct("utterance_id").alias("n")).collect()}
    assert reasons == {None: 114, "undecodable": 3, "too_short": 3, "missing_audio": 6}
    assert [r["status"] for r in whole.orderBy("seq").select("seq", "status").distinct().orderBy("seq").collect()] == ["planned", "running", *["shard"] * (last + 1), "complete"]

    out = f"{tmp_path}/out"
    with pytest.raises(Exception, match="the node is gone"):
        features.precompute_features(aligned, audio, out, SPEC, failing, number="double", **sizes)
    state = spark.read.schema(features.STATES).parquet(f"{out}/ledger")
    done = {(r["split"], r["shard"]) for r in state.where("status = 'shard'").collect()}
    assert done and "complete" not in {r["status"] for r in state.collect()}
    # what was done isn't read again: its audio may be gone
    plan = features.planned_words(aligned, listing, 13, 5).where("resolved is not null").select("split", "shard", "resolved").distinct().collect()
    for name in {r["resolved"] for r in plan if (r["split"], r["shard"]) in done}:
        with open(f"{audio}/{name}", "wb") as f:
            f.write(b"gone")
    open(flag, "w").close()
    final = features.precompute_features(aligned, audio, out, SPEC, failing, number="double", **sizes)
    assert plain(spark.read.parquet(f"{out}/{key}").collect()) == plain(want.collect())
    shards = final.where("status = 'shard'")
    assert shards.count() == shards.select("split", "shard").distinct().count() == whole.where("status = 'shard'").count()
    assert shards.agg(F.sum("rows")).first()[0] == 228 and shards.agg(F.sum("skipped")).first()[0] == 12
    # a third run has nothing to do; a changed word makes just its shard anew
    again = features.precompute_features(aligned, audio, out, SPEC, failing, number="double", **sizes)
    assert again.where("status = 'shard'").count() == shards.count()
    changed = aligned.withColumn("phone_labels", F.when(F.col("utterance_id") == "u1-0", F.slice("phone_labels", 1, 1)).otherwise(F.col("phone_labels")))
    third = features.precompute_features(changed, audio, out, SPEC, failing, number="double", **sizes)
    assert third.where("status = 'shard'").count() == shards.count() + 1


def test_packed_audio_gives_the_same_shards_in_a_file_each(spark, tmp_path):
    aligned, audio = corpus(spark, tmp_path), f"{tmp_path}/audio"
    loose = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(audio)
    packs.write_packs(loose.select(F.substring_index("path", f"{audio}/", -1).alias("rel_path"), "content"), f"{tmp_path}/packs")
    rows = {}
    for name, root in (("audio", audio), ("packs", f"{tmp_path}/packs")):
        state = features.precompute_features(aligned, root, f"{tmp_path}/{name}-out", SPEC, encoder.window_encoder(10), shard_rows=20, wave_files=8, number="double", packed=name == "packs")
        home = tmp_path / f"{name}-out" / state.first()["feature_key"]
        rows[name] = plain(spark.read.parquet(str(home)).collect())
        assert {len(list(d.glob("*.parquet"))) for d in home.glob("split=*/shard=*")} == {1}
    assert len(rows["packs"]) == 240 and rows["packs"] == rows["audio"]


def test_features_of_one_word_by_hand(spark, tmp_path):
    aligned, audio = corpus(spark, tmp_path, audios=6), f"{tmp_path}/audio"
    state = features.precompute_features(aligned, audio, f"{tmp_path}/out", SPEC, encoder.window_encoder(10), number="double")
    rows = {(r["utterance_id"], r["index"]): r for r in features.features(spark, f"{tmp_path}/out", state.first()["feature_key"]).collect()}
    x, ms, reason = features.prepared_signal(open(f"{audio}/raw/1.wav", "rb").read(), 100, 100, 30_000)
    assert reason is None and ms == len(x) * 10 and abs(x).max() == 1
    f = x[: len(x) // 10 * 10].reshape(-1, 10)
    frame_ms = max(10.0, ms / len(f))
    for i in (0, 1):
        r = rows["u1-0", i]
        start = min(len(f) - 1, int(100 * i // frame_ms))
        end = min(len(f), max(start + 1, -int(-(100 * i + 90) // frame_ms)))
        assert np.allclose(r["mean_embedding"], f[start:end].mean(axis=0)) and np.isclose(r["variance"], f[start:end].var()) and r["frame_count"] == end - start
        expected = max(1.0, len(f) * (1.8, 0.85)[i] / 2.65)
        assert np.isclose(r["duration_z_score"], round((end - start - expected) / max(1.0, 0.35 * expected), 3), atol=1e-3)
        assert (r["prev_phoneme"], r["next_phoneme"], r["alignment_confidence"], r["omission_target"], r["duration_ms"]) == ((None, "B", 0.98, 0, 90), ("AA", None, 0.98, 1, 90))[i]
    empty = features.precompute_features(aligned.limit(0), audio, f"{tmp_path}/empty", SPEC, encoder.window_encoder(10))
    assert [r["status"] for r in empty.orderBy("seq").collect()] == ["planned", "running", "complete"]


def test_a_run_reads_its_words_once(spark, tmp_path):
    aligned, audio = corpus(spark, tmp_path), f"{tmp_path}/audio"
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    state = features.precompute_features(aligned.mapInArrow(counted, aligned.schema), audio, f"{tmp_path}/out", SPEC, encoder.window_encoder(10), shard_rows=20, wave_files=8, number="double")
    assert read.value == 126 and state.agg(F.sum("rows"), F.sum("skipped")).first()[:] == (228, 12)


def test_spans_pooled_together_equal_one_by_one(monkeypatch):
    monkeypatch.setattr(features, "GATHERED", 40)
    rng = np.random.default_rng(4)
    for n, width, more in ((16, 4, 0), (7, 1, 2), (1, 3, -1), (0, 2, 1)):
        frames, energy = rng.normal(0, 1, (n, width)).astype(np.float32), rng.random(n + more)
        begins = rng.integers(0, 400, 60)
        ends = begins + rng.integers(-20, 300, 60)
        start, end, mean, variance, loud = features.pooled_spans(frames, energy, 21.5, begins, ends)
        for i in range(60):
            a = max(0, min(max(1, n) - 1, int(begins[i] // 21.5)))
            b = min(max(1, n), max(a + 1, int(-(-ends[i] // 21.5))))
            part, e = frames[a:b] if n else np.zeros((1, width)), energy[a:b]
            assert (start[i], end[i]) == (a, b) and np.allclose(mean[i], part.mean(axis=0)) and np.isclose(variance[i], part.var()) and np.isclose(loud[i], e.mean() if len(e) else 0.0)
