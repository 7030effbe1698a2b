"""Queries of the aggregations AG-01..AG-22."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import scores as S
from cadenza.functions import text as X
from cadenza.operators import reports as R
from cadenza.operators import runs, verify
from cadenza.plans import views as V
from cadenza.plans.q_functions import PENALTY_SQL, SCORES_SQL, scored
from cadenza.plans.registry import query
from cadenza.plans.views import r6

SPLIT_SQL = "CASE subset WHEN 'test-clean' THEN 'test' WHEN 'dev-clean' THEN 'val' ELSE 'train' END"
DIM_SQL = "(VALUES ('wrong_or_missed'), ('accented'), ('correct')) d(class)"
V1_SQL = V.PRED_SQL + f", e AS (SELECT *, {V.CLASS1_SQL.format('match_target')} AS tc, CASE WHEN presence_prob < 0.5 THEN 'wrong_or_missed' ELSE {V.CLASS1_SQL.format('match_pred')} END AS pc FROM pred)"


def v1(spark, sf):
    p = V.predictions(spark, sf)
    return p.withColumn("tc", L.class_of_target(F.col("match_target"), "v1")).withColumn("pc", L.predicted_class(F.col("match_pred"), F.col("presence_prob")))


@query("ag_01_rows_per_split", f"WITH {V.DOCS_SQL}, d AS (SELECT {SPLIT_SQL} AS split FROM docs) SELECT s.split, count(d.split) AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN d USING (split) GROUP BY s.split")
def ag_01(spark, sf):
    return runs.rows_per_split(V.doc_paths(spark, sf).select(X.split_of_path(F.col("audio_path")).alias("split")))


@query("ag_02_speakers_per_split", f"WITH {V.DOCS_SQL} SELECT {SPLIT_SQL} AS split, count(DISTINCT speaker_id) AS speakers FROM docs GROUP BY 1")
def ag_02(spark, sf):
    return V.doc_paths(spark, sf).groupBy(X.split_of_path(F.col("audio_path")).alias("split")).agg(F.count_distinct("speaker_id").alias("speakers"))


REASON_SQL = "CASE WHEN frames < 8 THEN 'too_short' WHEN omission THEN 'omitted' WHEN human_score < 0.5 THEN 'low_score' END"


@query("ag_03_reasons_per_split", f"WITH {V.PHONES_SQL} SELECT split, {REASON_SQL} AS reason, count(*) AS n FROM phones WHERE {REASON_SQL} IS NOT NULL GROUP BY ALL")
def ag_03(spark, sf):
    reason = L.first_reason({"too_short": F.col("frames") < 8, "omitted": F.col("omission"), "low_score": F.col("human_score") < 0.5})
    return V.phones(spark, sf).groupBy("split", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).where(F.col("reason").isNotNull())


@query("ag_04_scan_statistics", f"WITH {V.DOCS_SQL} SELECT count(*) AS candidates, count(*) FILTER (doc_id % 2 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 <> 0) AS missing, count(*) FILTER (trim(text) = '') AS empty, count(*) FILTER (doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0) AS prepared FROM docs")
def ag_04(spark, sf):
    has = (F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0)
    return runs.scan_statistics(V.doc_paths(spark, sf).withColumn("transcript", F.when(has, F.col("text"))), "transcript")


PROFILE_SQL = """
SELECT split, count(*) AS rows, count(DISTINCT utterance_id) AS utterances, min(frames) AS min_frames, max(frames) AS max_frames,
  min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, first(phoneme ORDER BY utterance_id, index) AS sample,
  first('{"utterance_id":' || utterance_id || ',"index":' || index || ',"phoneme":"' || phoneme || '","duration_ms":' || duration_ms || ',"frames":' || frames || '}'
    ORDER BY utterance_id, index) AS sample_row,
  count(DISTINCT utterance_id % 7) AS shards, count(*) FILTER (index % 3 = 0) AS width_1, count(*) FILTER (index % 3 <> 0) AS width_2,
  count(*) FILTER (p IS NULL OR p <> source) AS group_runs
FROM (SELECT *, lag(source) OVER (PARTITION BY split, utterance_id ORDER BY index) AS p FROM phones) GROUP BY split
"""


def profiled(spark, sf):
    vector = F.when(F.col("index") % 3 == 0, F.array("variance")).otherwise(F.array("variance", "energy"))
    p = V.phones(spark, sf).withColumn("vector", vector).withColumn("shard", F.col("utterance_id") % 7)
    d = verify.profile(p, embedding="vector", shard="shard", group="source")
    width = lambda n: F.coalesce(F.try_element_at("widths", F.lit(n)), F.lit(0))
    return d.withColumn("width_1", width(1)).withColumn("width_2", width(2)).drop("widths")


@query("ag_05_feature_profile", f"WITH {V.PHONES_SQL} {PROFILE_SQL}")
def ag_05(spark, sf):
    return profiled(spark, sf)


@query("ag_06_adjacent_runs", f"WITH {V.EVENTS_SQL}, l AS (SELECT speaker_id, audio_path, lag(audio_path) OVER (PARTITION BY speaker_id ORDER BY recording_id) AS p FROM events_v) SELECT speaker_id, count(*) FILTER (p IS NULL OR p <> audio_path) AS runs FROM l GROUP BY 1")
def ag_06(spark, sf):
    return runs.count_runs(V.events(spark, sf), "speaker_id", "recording_id", "audio_path")


@query("ag_07_aligned_totals", f"WITH {V.PHONES_SQL} SELECT count(DISTINCT utterance_id) AS words, count(*) AS phones FROM phones")
def ag_07(spark, sf):
    return V.words(spark, sf).agg(F.count(F.lit(1)).alias("words"), F.sum(F.size("phones")).alias("phones"))


@query("ag_08_assemble_words", f"WITH {V.PHONES_SQL}, t AS (SELECT *, {V.TARGET_SQL} AS target FROM phones) SELECT utterance_id, string_agg(phoneme, ' ' ORDER BY index) AS phones, round(sum(target * (index + 1)), 4) AS targets, sum((1 - CAST(omission AS INT)) * (index + 1)) AS presence, round(sum(variance * (2 * index + 1) + energy * (2 * index + 2)), 4) AS acoustic, CAST(count(*) AS INT) AS seq_len FROM t GROUP BY 1")
def ag_08(spark, sf):
    dot = lambda c, zero: F.aggregate(F.transform(c, lambda x, i: x * (i + 1)), zero, lambda s, x: s + x)
    w = V.words(spark, sf)
    return w.select("utterance_id", F.array_join("phones", " ").alias("phones"), F.round(dot("match_targets", F.lit(0.0)), 4).alias("targets"), dot("presence_targets", F.lit(0)).cast("long").alias("presence"), F.round(dot("acoustic_flat", F.lit(0.0)), 4).alias("acoustic"), "seq_len")


@query("ag_09_span_pooling", f"""WITH {V.SPANS_SQL}, x AS (SELECT s.utterance_id, s.index, f.energy, unnest(f.vector) AS v, generate_subscripts(f.vector, 1) AS d FROM spans s JOIN frames f ON f.utterance_id = s.utterance_id AND f.frame >= s.start AND f.frame < s."end"),
m AS (SELECT utterance_id, index, d, avg(v) AS m FROM x GROUP BY ALL), a AS (SELECT utterance_id, index, sum(m * d) AS weighted FROM m GROUP BY ALL), b AS (SELECT utterance_id, index, var_pop(v) AS variance, avg(energy) AS energy FROM x GROUP BY ALL)
SELECT utterance_id, index, round(coalesce(weighted, 0), 5) AS weighted, round(coalesce(variance, 0), 6) AS variance, round(coalesce(energy, 0), 6) AS energy FROM spans LEFT JOIN a USING (utterance_id, index) LEFT JOIN b USING (utterance_id, index)""")
def ag_09(spark, sf):
    from cadenza.operators.pooling import pool_spans

    p = pool_spans(V.frames(spark, sf), V.spans(spark, sf), 64)
    weighted = F.aggregate(F.transform("mean_embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return p.select("utterance_id", "index", (F.round(weighted, 5) + 0.0).alias("weighted"), r6(F.col("variance")).alias("variance"), r6(F.col("energy")).alias("energy"))


@query("ag_10_class_rates", f"WITH {V1_SQL}, n AS (SELECT pc AS class, count(*) AS n FROM e GROUP BY 1) SELECT d.class, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(1, (SELECT count(*) FROM e)), 6) AS rate FROM {DIM_SQL} LEFT JOIN n USING (class)")
def ag_10(spark, sf):
    return R.class_rates(v1(spark, sf), "pc").withColumn("rate", r6(F.col("rate")))


@query("ag_11_confusion", f"WITH {V1_SQL}, n AS (SELECT tc, pc, count(*) AS n FROM e GROUP BY ALL) SELECT d.class AS true_class, p.class AS predicted_class, coalesce(n, 0) AS n, round(coalesce(n, 0) / greatest(1, sum(coalesce(n, 0)) OVER (PARTITION BY d.class)), 6) AS rate FROM {DIM_SQL} CROSS JOIN (VALUES ('wrong_or_missed'), ('accented'), ('correct')) p(class) LEFT JOIN n ON tc = d.class AND pc = p.class")
def ag_11(spark, sf):
    return R.confusion(v1(spark, sf), "tc", "pc").withColumn("rate", r6(F.col("rate")))


@query("ag_12_errors", f"WITH {V1_SQL} SELECT round(avg(abs(match_pred - match_target)), 6) AS match_mae, round(sqrt(avg((match_pred - match_target) ** 2)), 6) AS match_rmse, round(avg(abs(duration_pred - duration_target)), 6) AS duration_mae, round(sqrt(avg((duration_pred - duration_target) ** 2)), 6) AS duration_rmse FROM e")
def ag_12(spark, sf):
    e = R.errors(v1(spark, sf), {"match": (F.col("match_pred"), F.col("match_target")), "duration": (F.col("duration_pred"), F.col("duration_target"))})
    return e.select(*[r6(F.col(c)).alias(c) for c in e.columns])


@query("ag_13_pearson", f"WITH {V1_SQL} SELECT round(corr(match_pred, match_target), 6) AS r, true AS constant_is_nan FROM e")
def ag_13(spark, sf):
    e = v1(spark, sf)
    flat = R.pearson(e, F.col("match_pred"), F.lit(1.0)).select(F.isnan("r").alias("constant_is_nan"))
    return R.pearson(e, F.col("match_pred"), F.col("match_target")).select(r6(F.col("r")).alias("r")).join(F.broadcast(flat))  # one row each


@query("ag_14_percentiles", f"WITH {V1_SQL} SELECT tc AS class, " + ", ".join(f"round(quantile_cont(match_pred, {p / 100}), 6) AS p{p}" for p in R.PERCENTILES) + " FROM e GROUP BY 1")
def ag_14(spark, sf):
    p = R.percentiles(v1(spark, sf), "tc", F.col("match_pred"))
    return p.select("class", *[r6(F.col(c)).alias(c) for c in p.columns if c != "class"])


@query("ag_15_histogram", f"WITH {V1_SQL}, b AS (SELECT tc AS class, CAST(floor(greatest(0, least(100 - 1e-6, match_pred)) / 10) * 10 AS INT) AS bin FROM e), g AS (SELECT class, unnest(range(0, 100, 10)) AS bin FROM (SELECT DISTINCT class FROM b)) SELECT g.class, printf('%02d-%02d', g.bin, g.bin + 9) AS label, count(b.bin) AS n FROM g LEFT JOIN b ON b.class = g.class AND b.bin = g.bin GROUP BY g.class, g.bin")
def ag_15(spark, sf):
    return R.histogram(v1(spark, sf), "tc", F.col("match_pred"))


@query("ag_16_presence", f"WITH {V1_SQL} SELECT round(avg(CASE WHEN (presence_prob >= 0.5) = (presence_target = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(presence_prob) FILTER (presence_target = 1), 6) AS mean_present, round(avg(presence_prob) FILTER (presence_target = 0), 6) AS mean_omitted, count(*) FILTER (presence_target = 1) AS present, count(*) FILTER (presence_target = 0) AS omitted FROM e")
def ag_16(spark, sf):
    p = R.presence_stats(v1(spark, sf), F.col("presence_prob"), F.col("presence_target"))
    return p.select(*[r6(F.col(c)).alias(c) for c in ("accuracy", "mean_present", "mean_omitted")], "present", "omitted")


STATS_SQL = "SELECT tc AS class, count(*) AS n, round(avg(match_pred), 6) AS mean_score, round(avg(match_target), 6) AS mean_target, round(avg(presence_prob), 6) AS mean_prob, round(count(*) FILTER (pc = 'correct') / count(*), 6) AS called_correct_rate, round(count(*) FILTER (match_pred >= 80) / count(*), 6) AS high_score_rate FROM e GROUP BY 1"


@query("ag_17_class_stats", f"WITH {V1_SQL} {STATS_SQL}")
def ag_17(spark, sf):
    c = R.class_stats(v1(spark, sf), "tc", "pc", F.col("match_pred"), F.col("match_target"), F.col("presence_prob"))
    return c.select("class", "n", *[r6(F.col(x)).alias(x) for x in c.columns[2:]])


@query("ag_18_class_accuracy", f"WITH {V1_SQL} SELECT round(avg(CASE WHEN tc = pc THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM e")
def ag_18(spark, sf):
    return v1(spark, sf).agg(r6(F.avg(F.when(F.col("tc") == F.col("pc"), 1.0).otherwise(0.0))).alias("accuracy"))


MEANS_SQL = ", ".join(f"avg(match_pred) FILTER (tc = '{c}') AS m{i}" for i, c in enumerate(("wrong_or_missed", "accented", "correct")))


@query("ag_19_diagnostics", f"""
WITH {V1_SQL},
m AS (SELECT {MEANS_SQL}, corr(match_pred, match_target) AS r, bool_and(pc = 'correct') AS a, count(*) FILTER (presence_target <> 1) = 0 AS u FROM e)
SELECT round(m2 - m0, 6) AS separation, round(m2 - m1, 6) AS separation_correct_accented, round(m1 - m0, 6) AS separation_accented_wrong,
  a AS all_correct, r < 0.3 AS weak, m2 - m0 < 5 AS collapsed, u AS uninformative,
  coalesce(nullif(concat_ws('; ', CASE WHEN a THEN '{R.MESSAGES['all_correct']}' END, CASE WHEN m2 - m0 < 5 THEN '{R.MESSAGES['collapsed']}' END,
    CASE WHEN r < 0.3 THEN '{R.MESSAGES['weak']}' END, CASE WHEN u THEN '{R.MESSAGES['uninformative']}' END), ''), 'no collapse found') AS messages
FROM m
""")
def ag_19(spark, sf):
    d = R.diagnostics(v1(spark, sf), "tc", "pc", F.col("match_pred"), F.col("match_target"), F.col("presence_target"))
    for c in ("separation", "separation_correct_accented", "separation_accented_wrong"):
        d = d.withColumn(c, r6(F.col(c)))
    return d


@query("ag_20_class_weights", f"WITH {V1_SQL}, n AS (SELECT tc AS class, count(*) AS n FROM e GROUP BY 1), w AS (SELECT class, n, sum(n) OVER () / (3.0 * n) AS w FROM n) SELECT class, n, round(w / avg(w) OVER (), 6) AS weight FROM w")
def ag_20(spark, sf):
    return R.class_weights(v1(spark, sf), "tc").withColumn("weight", r6(F.col("weight")))


OVERALL_SQL = SCORES_SQL + """, q AS (SELECT utterance_id, CASE utterance_id % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.92::DOUBLE ELSE 0.75::DOUBLE END AS f, CASE WHEN length(phoneme) > 1 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS w, 0.5::DOUBLE * match + 0.25::DOUBLE * dur + 0.25::DOUBLE * presence AS s, confidence FROM scored),
overall AS (SELECT utterance_id, greatest(0, least(100, CAST(round_even(round(sum(w * s) / greatest(1, sum(w)) * any_value(f), 9), 0) AS INT))) AS score, round(least(1.0, greatest(0.0, avg(confidence) * any_value(f))), 9) AS confidence FROM q GROUP BY 1)"""


@query("ag_21_overall_score", f"WITH {OVERALL_SQL} SELECT * FROM overall")
def ag_21(spark, sf):
    from cadenza.operators.assess import overall

    return overall(with_quality(scored(spark, sf)), "utterance_id", digits=9)


def with_quality(p):
    k = F.col("utterance_id") % 3
    return p.withColumn("quality", F.when(k == 0, "ok").when(k == 1, "low_confidence").otherwise("rejected"))


@query("fn_31_severity", f"""
WITH {OVERALL_SQL}
SELECT s.utterance_id, s.index, round((0.65::DOUBLE + 0.35::DOUBLE * o.confidence) * {PENALTY_SQL} + 1e-8, 4) AS severity
FROM scored s JOIN overall o USING (utterance_id)
""")
def fn_31(spark, sf):
    from cadenza.operators.assess import overall

    p = with_quality(scored(spark, sf))
    confidence = overall(p, "utterance_id", digits=9).select("utterance_id", F.col("confidence").alias("overall"))
    severity = S.severity(F.col("match"), F.col("dur"), F.col("presence"), F.col("overall"))
    return p.join(confidence, "utterance_id").select("utterance_id", F.col("index").cast("long").alias("index"), F.round(severity + 1e-8, 4).alias("severity"))


@query("ag_22_masked_error", f"WITH {V.FRAMES_SQL}, e AS (SELECT utterance_id, list_sum(list_transform(list_zip(vector, list_reverse(vector)), lambda z: (z[1] - z[2]) ** 2)) / len(vector) AS mse FROM frames WHERE frame % 3 = 0) SELECT utterance_id, round(avg(mse), 6) AS loss FROM e GROUP BY 1")
def ag_22(spark, sf):
    from cadenza.operators.pooling import masked_error

    f = V.frames(spark, sf).withColumn("prediction", F.reverse("vector")).withColumn("mask", F.col("frame") % 3 == 0)
    return masked_error(f, "utterance_id", "prediction", "vector", "mask").withColumn("loss", r6(F.col("loss")))
