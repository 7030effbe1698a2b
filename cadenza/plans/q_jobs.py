"""Queries of the composite jobs JOB-01..JOB-13."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import text as X
from cadenza.functions.constants import ACOUSTIC_WIDTH, ENCODER_WIDTH
from cadenza.functions.packed import summed
from cadenza.operators import align, encoder, jobs
from cadenza.operators import reports as R
from cadenza.operators import words as O
from cadenza.plans import views as V
from cadenza.plans.q_aggregates import DIM_SQL, OVERALL_SQL, SPLIT_SQL, V1_SQL, with_quality
from cadenza.plans.q_functions import ID_SQL, PENALTY_SQL, STATUS_SQL
from cadenza.plans.q_joins import IV_SQL, SIDECAR_SQL, interval_arrays, lexicon, score_words, sidecars
from cadenza.plans.q_windows import DRAW_SQL, SHUFFLE_SQL, WORDS_SQL
from cadenza.plans.registry import query
from cadenza.plans.views import r6

PHONE_ROWS = "utterance_id long, index int, split string, phoneme string, duration_ms int, human_score double"
from cadenza.session import few, scratch, spread, table
from cadenza.sources import corpora, sinks


@query("job_01_prepare_read_speech", f"WITH {V.DOCS_SQL} SELECT utterance_id, speaker_id, {SPLIT_SQL} AS split, regexp_replace(audio_path, '\\.wav$', '') || {SIDECAR_SQL} AS transcript_path, CASE WHEN {SIDECAR_SQL} IS NULL THEN 'missing_transcript' WHEN trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) = '' THEN 'empty_transcript' END AS reason FROM docs")
def job_01(spark, sf):
    d = V.doc_paths(spark, sf)
    rows = jobs.prepare_read_speech(d.select("audio_path"), sidecars(spark, sf), d.select("audio_path", "text"))
    kept = jobs.write_prepared(rows, scratch(spark, "prepared")).withColumn("reason", F.lit(None).cast("string"))
    out = ["utterance_id", "speaker_id", "split", "transcript_path", "reason"]
    return kept.select(*out).unionByName(rows.where(F.col("reason").isNotNull()).select(*out))


@query("job_02_prepare_scored", f"WITH {V.DOCS_SQL}, u AS (SELECT docs.*, labels.quality FROM docs JOIN labels USING (doc_id)), s AS (SELECT speaker_id, sha256('17:' || speaker_id) AS h FROM (SELECT DISTINCT speaker_id FROM u WHERE subset <> 'test-clean')), r AS (SELECT speaker_id, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM s) SELECT utterance_id, quality, CASE WHEN subset = 'test-clean' THEN 'test' WHEN rn <= greatest(1, least(n - 1, ceil(n * 0.1))) THEN 'val' ELSE 'train' END AS split FROM u LEFT JOIN r USING (speaker_id)")
def job_02(spark, sf):
    u = V.doc_paths(spark, sf).join(table(spark, sf, "labels"), "doc_id").withColumn("official", F.when(F.col("subset") == "test-clean", "test").otherwise("train"))
    rows = jobs.prepare_scored(u, 0.1, 17).select("utterance_id", "speaker_id", "audio_path", "text", "quality", "split")
    path, schema = scratch(spark, "scored"), "utterance_id string, speaker_id string, audio_path string, text string, quality int, split string"
    return jobs.write_prepared(rows.withColumn("reason", F.lit(None).cast("string")), path, schema, disjoint=True).select("utterance_id", "quality", "split")


@query("job_03_export_transcripts", f"WITH {V.DOCS_SQL} SELECT subset, count(*) AS n, sum(length(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'))))::BIGINT AS chars FROM docs GROUP BY 1")
def job_03(spark, sf):
    path = scratch(spark, "lab")
    sinks.write_transcripts(sinks.transcript_rows(V.doc_paths(spark, sf)), path)
    t = spark.read.parquet(path)
    return t.groupBy(F.get(F.split("rel_path", "/"), F.lit(1)).alias("subset")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


JOB_04_SQL = f"""WITH {IV_SQL}, w AS (SELECT doc_id, pos, regexp_replace(lower(trim(label)), '[^a-z'']+', '', 'g') AS word, token, len, stop FROM wi),
x AS (SELECT w.*, lex.spelled, CASE WHEN token = '' THEN '' ELSE upper(token) END AS said FROM w LEFT JOIN lex ON lex.word = w.word),
r AS (SELECT *, CASE WHEN word IN ('', 'sp', 'sil', 'spn', '<eps>') THEN 'skip_word_label' WHEN spelled IS NULL THEN 'missing_cmudict' WHEN len * 50 < 80 THEN 'too_short' WHEN length(said) <> length(spelled) THEN 'phone_count_mismatch' WHEN said <> spelled THEN 'phone_identity_mismatch' END AS reason FROM x)
SELECT doc_id || '__' || word || '__' || CAST(round_even((stop - len) * 0.05::DOUBLE * 1000, 0) AS INT) AS artifact_id, length(spelled) AS phones FROM r WHERE reason IS NULL"""


@query("job_04_aligned_native", JOB_04_SQL)
def job_04(spark, sf):
    w = align.aligned_native(interval_arrays(spark, sf), lexicon(spark, sf))
    return w.where(F.col("reason").isNull()).select("artifact_id", F.size("phone_labels").cast("long").alias("phones"))


JOB_05_SQL = f"""WITH {V.PHONES_SQL} SELECT utterance_id, CAST(index AS INT) AS index, phoneme, CASE WHEN human_score >= 1.5 THEN 'correct' WHEN human_score >= 0.5 THEN 'accented' ELSE 'wrong_or_missed' END AS class, round({V.TARGET_SQL}, 6) AS target, omission AND index % 5 <> 4 AND index % 3 = 0 AS omission, NULL AS reason FROM phones WHERE utterance_id % 11 <> 0
UNION ALL SELECT DISTINCT utterance_id, NULL, NULL, NULL, NULL, NULL, 'missing_phone_scores' FROM phones WHERE utterance_id % 11 = 0"""


@query("job_05_aligned_scored", JOB_05_SQL)
def job_05(spark, sf):
    rows = jobs.scored_phone_labels(score_words(spark, sf))
    return rows.select("utterance_id", "index", "phoneme", "class", r6(F.col("target")).alias("target"), "omission", "reason")


@query("job_06_phone_features", f"""WITH {V.SPANS_SQL}, {V.PHONES_SQL}, x AS (SELECT s.utterance_id, s.index, unnest(f.vector) AS v FROM spans s JOIN frames f ON f.utterance_id = s.utterance_id AND f.frame >= s.start AND f.frame < s."end"), b AS (SELECT utterance_id, index, var_pop(v) AS variance FROM x GROUP BY ALL),
p AS (SELECT utterance_id, index, phoneme, lag(phoneme) OVER w AS prev_phoneme, lead(phoneme) OVER w AS next_phoneme, round({V.TARGET_SQL}, 6) AS regression_target FROM phones WINDOW w AS (PARTITION BY utterance_id ORDER BY index))
SELECT utterance_id, index, phoneme, prev_phoneme, next_phoneme, regression_target, round(coalesce(variance, 0), 6) AS variance FROM spans JOIN p USING (utterance_id, index) LEFT JOIN b USING (utterance_id, index)""")
def job_06(spark, sf):
    p = V.phones(spark, sf).select("utterance_id", "index", "phoneme", "source", "human_score")
    f = jobs.phone_features(V.frames(spark, sf), V.spans(spark, sf), p, 64)
    return f.select("utterance_id", "index", "phoneme", "prev_phoneme", "next_phoneme", r6(F.col("regression_target")).alias("regression_target"), r6(F.col("variance")).alias("variance"))


@query("job_07_verify_features", f"""
WITH {V.PHONES_SQL}, written AS (SELECT * FROM phones WHERE NOT (utterance_id % 13 = 0 AND index = 0)),
bad AS (SELECT split, count(*) FILTER (human_score > 1.8 OR frames < 2) AS broken FROM written GROUP BY 1)
SELECT w.split, count(*) AS rows, count(DISTINCT utterance_id) AS utterances, any_value(broken) AS broken_rows,
  CAST((SELECT count(*) FROM written) - (SELECT count(*) FROM phones) AS BIGINT) AS row_delta,
  (SELECT count(*) FROM phones WHERE utterance_id % 13 = 0 AND index = 0) = 0 AS matches
FROM written w JOIN bad USING (split) GROUP BY w.split
""")
def job_07(spark, sf):
    path = scratch(spark, "verify")
    p = V.phones(spark, sf)
    sinks.write_shards(p.where(~((F.col("utterance_id") % 13 == 0) & (F.col("index") == 0))), path, 20_000)
    rules = {"human_score": F.col("human_score") <= 1.8, "frames": F.col("frames") >= 2}
    profile, totals = jobs.verify_features(corpora.by_word(corpora.feature_shards(spark, path, PHONE_ROWS + ", frames int")), V.words(spark, sf), rules)
    totals = totals.select("row_delta", "matches")  # one row
    return profile.select("split", "rows", "utterances", "broken_rows").join(F.broadcast(totals))


def score_and_index(score: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Phones' embeddings: score and index, then zeros."""
    v = np.zeros((len(score), ENCODER_WIDTH))
    v[:, 0], v[:, 1] = score, index
    return v


@query("job_08_dense_table", f"""
WITH {V.PHONES_SQL},
v AS (SELECT *, (frames - 25) / 20.0::DOUBLE AS z FROM phones),
w AS (SELECT utterance_id, first(split) AS split, count(*) AS seq_len, round(sum(variance + energy + z + human_score + index), 6) AS total FROM v GROUP BY 1)
SELECT utterance_id, CAST(seq_len AS INT) AS seq_len, CAST(seq_len * 771 AS INT) AS flat, total,
  CAST(sum(seq_len) OVER (PARTITION BY split ORDER BY utterance_id ROWS UNBOUNDED PRECEDING) - seq_len AS BIGINT) AS row_offset
FROM w
""")
def job_08(spark, sf):
    path = scratch(spark, "dense")
    p = V.phones(spark, sf).withColumn("z", (F.col("frames") - 25) / 20.0)
    manifest = sinks.write_dense_words(p, path, compression="zstd", embedding=(["human_score", "index"], score_and_index), width=ACOUSTIC_WIDTH)
    d = corpora.dense_words(spark, path, ["utterance_id", "split", "seq_len", "acoustic_flat"], manifest["num_utterances"], manifest["acoustic_dim"], as_bytes=True)
    sums = summed(d, "acoustic_flat", "flat", "total").withColumn("total", r6(F.col("total")))
    return O.two_level_offsets(sums, "split", "utterance_id", "seq_len", sizes=d.select("utterance_id", "split", "seq_len")).withColumnRenamed("offset", "row_offset").drop("split")


def long_sql(section: str, key: str, metrics: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, {key} AS key, '{m}' AS metric, CAST({x} AS DOUBLE) AS value FROM {source}" for m, x in metrics.items())


def percentile_part(section: str, value: str) -> str:
    return long_sql(section, "tc", {f"p{p}": f"p{p}" for p in R.PERCENTILES}, PCT.format(value))


def diagnostic_parts(score: str, target: str, omitted: str) -> list[str]:
    mean = lambda c: f"avg({score}) FILTER (tc = '{c}')"
    right, middle, wrong = mean("correct"), mean("accented"), mean("wrong_or_missed")
    flag = lambda x: f"CASE WHEN {x} THEN 1 ELSE 0 END"
    flags = {"all_correct": "bool_and(pc = 'correct')", "collapsed": f"{right} - {wrong} < 5", "weak": f"corr({score}, {target}) < 0.3", "uninformative": f"count(*) FILTER ({omitted}) = 0"}
    numbers = {"separation": f"{right} - {wrong}", "separation_correct_accented": f"{right} - {middle}", "separation_accented_wrong": f"{middle} - {wrong}"}
    told = [f"SELECT 'interpretation' AS section, '{R.MESSAGES[k]}' AS key, 'told' AS metric, 1.0::DOUBLE AS value FROM e HAVING {x}" for k, x in flags.items()]
    none = " AND ".join(f"NOT ({x})" for x in flags.values())
    told.append(f"SELECT 'interpretation' AS section, 'no collapse found' AS key, 'told' AS metric, 1.0::DOUBLE AS value FROM e HAVING {none}")
    return [long_sql("diagnostics", "'all'", numbers | {k: flag(x) for k, x in flags.items()}, "e"), *told]


CELL = "(SELECT d.class AS tc, p.class AS pc, (SELECT count(*) FROM e WHERE e.tc = d.class AND e.pc = p.class) AS n, (SELECT count(*) FROM e WHERE e.tc = d.class) AS total FROM {0} CROSS JOIN (VALUES ('wrong_or_missed'), ('accented'), ('correct')) p(class))".format(DIM_SQL)
COUNTS = "(SELECT d.class, (SELECT count(*) FROM e WHERE e.{0} = d.class) AS n, (SELECT count(*) FROM e) AS total FROM " + DIM_SQL + ")"
HIST = "(SELECT g.class, printf('%02d-%02d', g.bin, g.bin + 9) AS label, (SELECT count(*) FROM e WHERE e.tc = g.class AND CAST(floor(greatest(0, least(100 - 1e-6, e.{0})) / 10) * 10 AS INT) = g.bin) AS n FROM (SELECT class, unnest(range(0, 100, 10)) AS bin FROM (SELECT DISTINCT tc AS class FROM e)) g)"
PCT = "(SELECT tc, " + ", ".join(f"quantile_cont({{0}}, {p / 100}) AS p{p}" for p in R.PERCENTILES) + " FROM e GROUP BY 1)"


def class_part(score: str, target: str, prob: str) -> str:
    src = f"(SELECT tc, count(*) AS n, avg({score}) AS a, avg({target}) AS b, avg({prob}) AS c, count(*) FILTER (pc = 'correct') / count(*) AS d, count(*) FILTER ({score} >= 80) / count(*) AS h FROM e GROUP BY 1)"
    return long_sql("class", "tc", {"n": "n", "mean_score": "a", "mean_target": "b", "mean_prob": "c", "called_correct_rate": "d", "high_score_rate": "h"}, src)


def presence_part(section: str, prob: str, truth: str) -> str:
    return long_sql(section, "'all'", {"accuracy": f"avg(CASE WHEN ({prob} >= 0.5) = ({truth} = 1) THEN 1.0 ELSE 0.0 END)", "mean_present": f"avg({prob}) FILTER ({truth} = 1)", "mean_omitted": f"avg({prob}) FILTER ({truth} = 0)", "present": f"count(*) FILTER ({truth} = 1)", "omitted": f"count(*) FILTER ({truth} = 0)"}, "e")


def error_part(pairs: dict[str, tuple[str, str]]) -> str:
    m = {}
    for name, (p, t) in pairs.items():
        m |= {f"{name}_mae": f"avg(abs({p} - {t}))", f"{name}_rmse": f"sqrt(avg(({p} - {t}) ** 2))"}
    return long_sql("errors", "'all'", m, "e")


PARTS_1 = [
    error_part({"match": ("match_pred", "match_target"), "duration": ("duration_pred", "duration_target")}),
    long_sql("pearson", "'all'", {"r": "corr(match_pred, match_target)"}, "e"),
    presence_part("presence", "presence_prob", "presence_target"),
    long_sql("confusion", "tc || '/' || pc", {"n": "n", "rate": "n / greatest(1, total)"}, CELL),
    long_sql("target", "class", {"n": "n", "rate": "n / greatest(1, total)"}, COUNTS.format("tc")),
    long_sql("predicted", "class", {"n": "n", "rate": "n / greatest(1, total)"}, COUNTS.format("pc")),
    class_part("match_pred", "match_target", "presence_prob"),
    percentile_part("percentiles", "match_pred"),
    percentile_part("percentiles_duration", "duration_pred"),
    percentile_part("percentiles_presence", "presence_prob"),
    long_sql("histogram", "class || '/' || label", {"n": "n"}, HIST.format("match_pred")),
    *diagnostic_parts("match_pred", "match_target", "presence_target <> 1"),
]
ROUNDED = "SELECT section, key, metric, round(value, 6) + 0.0 AS value FROM ({0})"


@query("job_09_eval_report_v1", f"WITH {V1_SQL} " + ROUNDED.format(" UNION ALL ".join(PARTS_1)))
def job_09(spark, sf):
    c = F.col
    report = jobs.evaluation_v1(V.predictions(spark, sf), c("match_pred"), c("duration_pred"), c("presence_prob"), c("match_target"), c("duration_target"), c("presence_target"))
    return report.withColumn("value", r6(F.col("value")))


V2_SQL = V.PRED_SQL + f", e AS (SELECT {V.CLASS2_SQL.format('match_target')} AS tc, {V.CLASS2_SQL.format('match_pred')} AS pc, round(1 - presence_prob, 3) AS o, match_pred AS s, match_target AS t, 1 - presence_target AS om FROM pred)"
PARTS_2 = [
    error_part({"score": ("s", "t")}),
    long_sql("pearson", "'all'", {"r": "corr(s, t)"}, "e"),
    long_sql("accuracy", "'all'", {"class": "avg(CASE WHEN tc = pc THEN 1.0 ELSE 0.0 END)"}, "e"),
    presence_part("omission", "o", "om"),
    long_sql("confusion", "tc || '/' || pc", {"n": "n", "rate": "n / greatest(1, total)"}, CELL),
    class_part("s", "t", "o"),
    percentile_part("percentiles", "s"),
    percentile_part("percentiles_omission", "o"),
    long_sql("target", "class", {"n": "n", "rate": "n / greatest(1, total)"}, COUNTS.format("tc")),
    long_sql("predicted", "class", {"n": "n", "rate": "n / greatest(1, total)"}, COUNTS.format("pc")),
    long_sql("histogram", "class || '/' || label", {"n": "n"}, HIST.format("s")),
    *diagnostic_parts("s", "t", "om <> 0"),
]


@query("job_10_eval_report_v2", f"WITH {V2_SQL} " + ROUNDED.format(" UNION ALL ".join(PARTS_2)))
def job_10(spark, sf):
    c = F.col
    report = jobs.evaluation_v2(V.predictions(spark, sf), L.class_of_target(c("match_pred"), "v2"), L.class_of_target(c("match_target"), "v2"), F.round(1 - c("presence_prob"), 3), c("match_pred"), c("match_target"), 1 - c("presence_target"))
    return report.withColumn("value", r6(F.col("value")))


JOB_11_SQL = f"""
WITH {OVERALL_SQL},
x AS (SELECT utterance_id, phoneme, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY utterance_id ORDER BY {PENALTY_SQL} DESC, index) AS rn FROM scored)
SELECT o.o_orderkey AS utterance_id, coalesce(overall.score, 0) AS score,
  CASE WHEN x.status IS NULL THEN 'no_signal' WHEN x.status = 'ok' THEN 'low_match' ELSE x.status END AS issue, x.phoneme AS issue_phone
FROM orders o LEFT JOIN overall ON overall.utterance_id = o.o_orderkey LEFT JOIN x ON x.utterance_id = o.o_orderkey AND rn = 1
"""


@query("job_11_assess_recordings", JOB_11_SQL)
def job_11(spark, sf):
    p = V.phones(spark, sf).select(
        "utterance_id", "index", "phoneme", "energy", "variance", ((F.col("frames") - 25) / 20.0).alias("z"), (F.col("frames") % 10 == 0).alias("late"),
        L.alignment_confidence(F.col("source")).alias("alignment_confidence"),
    )
    recordings = table(spark, sf, "orders").select(F.col("o_orderkey").alias("utterance_id"))
    return jobs.assess_words(recordings, with_quality(p), "utterance_id").drop("confidence", "severity")


#: The signals that stand for recordings: 64 samples a second, frames of 2 samples, encoded 2 numbers wide.
SIGNAL = {"rate": 64, "frame": 2, "width": 2}
#: Vectors that go to every task.
VECTORS = 20_000


def asked_recordings(spark, sf, events):
    """Recordings of a table of events: the word asked for, and the vector of the event's user as the signal, 0.1 to 4.1 seconds long."""
    words = word_ring(spark, sf)
    n = words.count()
    signals = V.frames(spark, sf).select(F.col("vec_id").alias("signal"), "vector")
    m = signals.agg(F.max("signal") + 1).first()[0]
    length = F.pmod(F.col("event_id"), F.lit(256)) + 8
    # a vector's 64 samples over and over, as many as the longest recording asks for
    samples = F.slice(F.concat("vector", F.array_repeat(F.lit(None).cast("double"), 64)), 1, 64)
    signals = signals.select("signal", F.flatten(F.array_repeat(samples, 5)).alias("ring"))
    r = events.withColumn("slot", F.pmod("user_id", F.lit(n + 2))).withColumn("signal", F.pmod("event_id", F.lit(m)))
    r = r.join(few(words), "slot", "left").join(few(signals, VECTORS), "signal")
    asked = F.concat(F.lit(" "), F.initcap(F.coalesce("w", F.concat(F.lit("zz"), F.col("slot").cast("string")))))
    return r.select(F.col("event_id").alias("recording_id"), asked.alias("asked"), F.slice("ring", F.lit(1), length.cast("int")).alias("samples"))


def word_ring(spark, sf):
    """(slot, w): every word of the lexicon with a number from 0 in alphabetical order."""
    ranked = lexicon(spark, sf).select("word").withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("word")) - 1)  # the vocabulary of one table
    return ranked.select(F.col("slot").cast("long").alias("slot"), F.col("word").alias("w"))


def assessed(spark, sf, events):
    lex = lexicon(spark, sf)
    events = spread(events.select("event_id", "user_id"), 1 << 16, "event_id")  # a table of one file would be one task
    assets = lex.where(F.length("word") % 3 != 0).select("word", F.concat(F.lit("audio/"), "word", F.lit(".wav")).alias("asset_path"))
    make = encoder.spectral_encoder(SIGNAL["width"], SIGNAL["frame"])
    return jobs.assess_recordings(asked_recordings(spark, sf, events), lex, assets, make, **SIGNAL)


@query("job_11_from_audio")
def job_11_from_audio(spark, sf):
    good, bad = assessed(spark, sf, table(spark, sf, "events"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


@query("job_12_plan_feature_runs", f"WITH {V.EVENTS_SQL}, s AS (SELECT DISTINCT CAST(p_partkey % 150 AS VARCHAR) AS feature_key FROM part), l AS (SELECT feature_key, arg_max(CASE audio_path WHEN 'view' THEN 'planned' WHEN 'click' THEN 'running' ELSE 'complete' END, recording_id) AS status FROM events_v GROUP BY 1) SELECT s.feature_key, CASE WHEN l.status IS NULL THEN 'missing_state' WHEN l.status <> 'complete' THEN 'incomplete' WHEN s.feature_key::INT % 4 = 0 THEN 'missing_rows' END AS reason FROM s LEFT JOIN l USING (feature_key)")
def job_12(spark, sf):
    specs = table(spark, sf, "part").select((F.col("p_partkey") % 150).cast("string").alias("feature_key")).distinct()
    e = V.events(spark, sf)
    status = F.when(F.col("audio_path") == "view", "planned").when(F.col("audio_path") == "click", "running").otherwise("complete")
    states = e.select("feature_key", status.alias("status"), F.col("recording_id").alias("seq"))
    present = specs.where(F.col("feature_key").cast("int") % 4 != 0)
    return jobs.plan_runs(specs, states, present).select("feature_key", "reason")


PLAN_DRAW = "'5:' || utterance_id || ':' || index"
JOB_13_SQL = f"""WITH RECURSIVE {SHUFFLE_SQL.format(WORDS_SQL, 64, 3 * 1_000_003 + 2 * 10_007)},
l1 AS (SELECT utterance_id, split, seq_len, rn, rn // 128 AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY utterance_id) - 1 AS rn FROM words)),
l2 AS (SELECT *, (row_number() OVER (PARTITION BY split, bucket ORDER BY seq_len, rn) - 1) // 16 AS length_batch FROM l1),
l3 AS (SELECT *, max(seq_len) OVER (PARTITION BY split, bucket, length_batch) AS width FROM l2),
p AS (SELECT utterance_id, index, {ID_SQL.format('phoneme')} AS id, 1 - CAST(omission AS INT) AS presence, {DRAW_SQL.format(PLAN_DRAW, 1, 8)} / 4294967296.0::DOUBLE AS u,
  {DRAW_SQL.format(PLAN_DRAW, 9, 16)} % 38 + 2 AS pick, row_number() OVER (PARTITION BY utterance_id ORDER BY {DRAW_SQL.format(PLAN_DRAW, 17, 24)}, index) AS place, count(*) OVER (PARTITION BY utterance_id) AS n FROM phones),
k AS (SELECT *, CASE WHEN u < 0.1 THEN 'substitution' WHEN u < 0.2 THEN 'omission' ELSE '' END AS kind, place <= least(n, greatest(1, CAST(round_even(n * 0.3::DOUBLE, 0) AS INT))) AS masked FROM p),
g AS (SELECT utterance_id, list(CASE WHEN kind = 'substitution' THEN CASE WHEN pick >= id THEN pick + 1 ELSE pick END ELSE id END ORDER BY index) AS ids, string_agg(kind, ',' ORDER BY index) AS augmented,
  string_agg(CASE WHEN kind = 'omission' THEN 0 ELSE presence END, ',' ORDER BY index) AS presence, string_agg(index, ',' ORDER BY index) FILTER (masked) AS mask FROM k GROUP BY 1)
SELECT s.utterance_id, s.split, s.block, s.batch_in_block, CAST(l3.bucket AS INT) AS bucket, CAST(l3.length_batch AS INT) AS length_batch, l3.width,
  array_to_string(list_resize(g.ids, l3.width, 0), ',') AS padded_ids, g.augmented, g.presence, g.mask
FROM shuffled s JOIN l3 ON l3.utterance_id = s.utterance_id JOIN g ON g.utterance_id = s.utterance_id"""


@query("job_13_epoch_plan", JOB_13_SQL)
def job_13(spark, sf):
    w = V.words(spark, sf)
    d = jobs.epoch_plan(w, "split", "utterance_id", 16, 64, seed=3, epoch=2, mask_ratio=0.3, negatives=0.2)
    said = lambda c, name: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(name)
    return d.select("utterance_id", "split", "block", "batch_in_block", "bucket", "length_batch", "width", said("padded_ids", "padded_ids"), said("augmented", "augmented"), said("presence_targets", "presence"), said("mask", "mask"))
