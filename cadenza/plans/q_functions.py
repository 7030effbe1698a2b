"""Queries of the scalar functions FN-01..FN-31."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import scores as S
from cadenza.functions import text as X
from cadenza.functions.constants import CLASSES, PHONE_SYMBOLS, PHONES
from cadenza.operators.words import acoustic_vector
from cadenza.plans import views as V
from cadenza.plans.registry import query
from cadenza.plans.views import r6
from cadenza.session import dealt, table

TOKENS_SQL = V.DOCS_SQL + ", tokens AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n\\t\\r]+')) AS token FROM docs)"


def tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "[ \\n\\t\\r]+")).alias("token"))


@query("fn_01_word_token", f"WITH {TOKENS_SQL} SELECT regexp_replace(lower(trim(token)), '[^a-z'']+', '', 'g') AS word, count(*) AS n FROM tokens GROUP BY 1")
def fn_01(spark, sf):
    return tokens(spark, sf).groupBy(X.word_token(F.col("token")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_02_strip_stress", f"WITH {V.PHONES_SQL} SELECT regexp_replace(upper(lower(phoneme) || (index % 3)), '[0-9]', '', 'g') AS phone, count(*) AS n FROM phones GROUP BY 1")
def fn_02(spark, sf):
    raw = F.concat(F.lower("phoneme"), (F.col("index") % 3).cast("string"))
    return V.phones(spark, sf).groupBy(X.strip_stress(raw).alias("phone")).agg(F.count(F.lit(1)).alias("n"))


SYMBOL_CASE = "CASE phoneme " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in PHONE_SYMBOLS.items()) + " ELSE lower(phoneme) END"


@query("fn_03_display_symbols", f"WITH {V.PHONES_SQL} SELECT utterance_id, string_agg({SYMBOL_CASE}, '' ORDER BY index) || 'xx' AS ipa FROM phones GROUP BY utterance_id")
def fn_03(spark, sf):
    return V.words(spark, sf).select("utterance_id", X.display_symbols(F.concat("phones", F.array(F.lit("XX")))).alias("ipa"))


@query("fn_04_collapse_space", f"WITH {V.DOCS_SQL} SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) AS text_md5 FROM docs")
def fn_04(spark, sf):
    return V.doc_paths(spark, sf).select("doc_id", F.md5(X.collapse_space(F.col("text")).cast("binary")).alias("text_md5"))


@query("fn_05_split_of_path", f"WITH {V.DOCS_SQL} SELECT doc_id, CASE subset WHEN 'test-clean' THEN 'test' WHEN 'dev-clean' THEN 'val' ELSE 'train' END AS split FROM docs")
def fn_05(spark, sf):
    return V.doc_paths(spark, sf).select("doc_id", X.split_of_path(F.col("audio_path")).alias("split"))


@query("fn_06_path_parts", f"WITH {V.DOCS_SQL} SELECT doc_id, utterance_id AS stem, speaker_id AS speaker, substr(audio_path, 5) AS rel, 'unknown' AS none FROM docs")
def fn_06(spark, sf):
    p = F.col("audio_path")
    return V.doc_paths(spark, sf).select("doc_id", X.file_stem(p).alias("stem"), X.speaker_of_path(p).alias("speaker"), X.relative_path(p, "raw").alias("rel"), X.speaker_of_path(F.col("utterance_id")).alias("none"))


@query("fn_07_alignment_path", f"WITH {V.DOCS_SQL} SELECT doc_id, regexp_replace(audio_path, '\\.wav$', '.TextGrid') AS path FROM docs")
def fn_07(spark, sf):
    return V.doc_paths(spark, sf).select("doc_id", X.alignment_path(F.col("audio_path")).alias("path"))


@query("fn_08_interval_ms", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, CAST(round_even(start_ms * 0.05 * 1000, 0) AS INT) AS start_ms, greatest(CAST(round_even(start_ms * 0.05 * 1000, 0) AS INT) + 1, CAST(round_even((start_ms + index % 2) * 0.05 * 1000, 0) AS INT)) AS end_ms FROM phones")
def fn_08(spark, sf):
    a, b = X.seconds_to_ms(F.col("start_ms") * 0.05, (F.col("start_ms") + F.col("index") % 2) * 0.05)
    return V.phones(spark, sf).select("utterance_id", F.col("index").cast("long").alias("index"), a.alias("start_ms"), b.alias("end_ms"))


@query("fn_09_word_id", f"WITH {V.PHONES_SQL} SELECT utterance_id || '__' || phoneme || '__' || start_ms AS id, count(*) AS n FROM phones GROUP BY 1")
def fn_09(spark, sf):
    ids = V.phones(spark, sf).select(X.word_id(F.col("utterance_id"), F.col("phoneme"), F.col("start_ms")).alias("id"))
    return dealt(ids, table(spark, sf, "lineitem").count(), "id").groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("fn_10_class_of_human_score", f"WITH {V.PHONES_SQL} SELECT human_score, CASE WHEN human_score >= 1.5 THEN 'correct' WHEN human_score >= 0.5 THEN 'accented' ELSE 'wrong_or_missed' END AS class, count(*) AS n FROM phones GROUP BY ALL")
def fn_10(spark, sf):
    return V.phones(spark, sf).groupBy("human_score", L.class_of_human_score(F.col("human_score")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_11_class_of_target", f"WITH {V.PRED_SQL} SELECT {V.CLASS1_SQL.format('match_target')} AS v1, {V.CLASS2_SQL.format('match_target')} AS v2, {V.CLASS2_SQL.format('match_pred')} AS p2, count(*) AS n FROM pred GROUP BY ALL")
def fn_11(spark, sf):
    p = V.predictions(spark, sf)
    t = F.col("match_target")
    return p.groupBy(L.class_of_target(t, "v1").alias("v1"), L.class_of_target(t, "v2").alias("v2"), L.class_of_target(F.col("match_pred"), "v2").alias("p2")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_12_predicted_class", f"WITH {V.PRED_SQL} SELECT utterance_id, index, CASE WHEN presence_prob < 0.5 THEN 'wrong_or_missed' ELSE {V.CLASS1_SQL.format('match_pred')} END AS class FROM pred")
def fn_12(spark, sf):
    return V.predictions(spark, sf).select("utterance_id", F.col("index").cast("long").alias("index"), L.predicted_class(F.col("match_pred"), F.col("presence_prob")).alias("class"))


@query("fn_13_regression_target", f"WITH {V.PHONES_SQL} SELECT human_score, round({V.TARGET_SQL}, 6) AS target, count(*) AS n FROM phones GROUP BY ALL")
def fn_13(spark, sf):
    return V.phones(spark, sf).groupBy("human_score", r6(L.regression_target(F.col("human_score"))).alias("target")).agg(F.count(F.lit(1)).alias("n"))


OMIT_SQL = "CASE index % 5 WHEN 0 THEN ' <UNK> ' WHEN 1 THEN 'unk' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE phoneme END"


@query("fn_14_is_omission", f"WITH {V.PHONES_SQL} SELECT index % 5 AS kind, coalesce(lower(trim({OMIT_SQL})) IN ('', '<unk>', 'unk', '\\'), false) AS omitted, count(*) AS n FROM phones GROUP BY ALL")
def fn_14(spark, sf):
    i = F.col("index") % 5
    said = F.when(i == 0, " <UNK> ").when(i == 1, "unk").when(i == 2, "").when(i == 3, None).otherwise(F.col("phoneme"))
    return V.phones(spark, sf).groupBy(i.cast("long").alias("kind"), X.is_omission(said).alias("omitted")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_18_alignment_confidence", f"WITH {V.PHONES_SQL} SELECT source, CASE source WHEN 'manual' THEN 0.98::DOUBLE WHEN 'mfa' THEN 0.92::DOUBLE ELSE 0.85::DOUBLE END AS confidence, count(*) AS n FROM phones GROUP BY ALL")
def fn_18(spark, sf):
    return V.phones(spark, sf).groupBy("source", L.alignment_confidence(F.col("source")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


WEIGHT_SQL = "(CASE WHEN phoneme IN ('AA','AE','AH','AO','AW','AY','EH','ER','EY','IH','IY','OW','OY','UH','UW') THEN 1.8 WHEN phoneme IN ('DH','F','S','SH','TH','V','Z','ZH','HH') THEN 1.35 WHEN phoneme IN ('CH','JH') THEN 1.25 WHEN phoneme IN ('B','D','G','K','P','T') THEN 0.85 WHEN phoneme IN ('M','N','NG') THEN 1.1 ELSE 1.0 END)::DOUBLE"
ID_SQL = f"coalesce(nullif(coalesce(list_position({V.NAMES_SQL}, {{0}}), 0), 0) + 1, 1)"


@query("fn_19_duration_weight", f"WITH {V.PHONES_SQL} SELECT phoneme, {WEIGHT_SQL} AS weight, count(*) AS n FROM phones GROUP BY ALL")
def fn_19(spark, sf):
    return V.phones(spark, sf).groupBy("phoneme", L.duration_weight(F.col("phoneme")).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_20_phoneme_id", f"WITH {V.PHONES_SQL}, q AS (SELECT CASE WHEN index % 7 = 6 THEN 'QX' ELSE phoneme END AS phone FROM phones) SELECT phone, CAST({ID_SQL.format('phone')} AS INT) AS id, count(*) AS n FROM q GROUP BY ALL")
def fn_20(spark, sf):
    p = V.phones(spark, sf).select(F.when(F.col("index") % 7 == 6, "QX").otherwise(F.col("phoneme")).alias("phone"))
    return p.groupBy("phone", L.phoneme_id(F.col("phone")).alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_21_class_codec", f"WITH {V.PRED_SQL}, c AS (SELECT {V.CLASS2_SQL.format('match_target')} AS class FROM pred) SELECT CAST(list_position(['wrong_or_missed','accented','correct'], class) - 1 AS INT) AS class_index, class AS back, count(*) AS n FROM c GROUP BY ALL")
def fn_21(spark, sf):
    c = V.predictions(spark, sf).select(L.class_index(L.class_of_target(F.col("match_target"), "v2")).alias("class_index"))
    return c.groupBy("class_index", L.class_name(F.col("class_index")).alias("back")).agg(F.count(F.lit(1)).alias("n"))


SOFT_SQL = "list_transform([vector[1], vector[2], vector[3]], lambda x: exp(x - greatest(vector[1], vector[2], vector[3])))"
PROBS_SQL = V.FRAMES_SQL + f", soft AS (SELECT vec_id, {SOFT_SQL} AS e FROM frames), probs AS (SELECT vec_id, list_transform(e, lambda x: x / (e[1] + e[2] + e[3])) AS p FROM soft)"


@query("fn_22_expected_score", f"WITH {PROBS_SQL} SELECT vec_id, round(p[1] * 15 + p[2] * 60 + p[3] * 92, 6) AS score, round(p[2] + p[3] * 2, 6) AS human FROM probs")
def fn_22(spark, sf):
    p = V.frames(spark, sf).select("vec_id", L.softmax(F.slice("vector", 1, 3)).alias("p"))
    return p.select("vec_id", r6(L.expected_value(F.col("p"))).alias("score"), r6(L.expected_human_score(F.col("p"))).alias("human"))


@query("fn_23_probabilities", f"WITH {PROBS_SQL} SELECT vec_id, round(p[1], 6) AS p0, round(p[2], 6) AS p1, round(p[3], 6) AS p2, CAST(list_position(p, list_max(p)) - 1 AS INT) AS top, round(1 / (1 + exp(-p[1])), 6) AS sig FROM probs")
def fn_23(spark, sf):
    p = V.frames(spark, sf).select("vec_id", L.softmax(F.slice("vector", 1, 3)).alias("p"))
    return p.select("vec_id", *[r6(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(3)], L.argmax(F.col("p")).alias("top"), r6(L.sigmoid(F.get("p", F.lit(0)))).alias("sig"))


@query("fn_24_acoustic_vector", f"WITH {V.FRAMES_SQL}, a AS (SELECT vec_id, list_concat(vector, [0.5, energy, -1.5]) AS v FROM frames) SELECT vec_id, CAST(len(v) AS INT) AS width, round(list_sum(v), 6) AS total, round(list_sum(v[1:64]), 6) AS embedding_total FROM a")
def fn_24(spark, sf):
    v = acoustic_vector(F.col("vector"), F.lit(0.5), F.col("energy"), F.lit(-1.5), width=67)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return V.frames(spark, sf).select("vec_id", v.alias("v")).select("vec_id", F.size("v").alias("width"), r6(add(F.col("v"))).alias("total"), r6(add(F.slice("v", 1, 64))).alias("embedding_total"))


SPEC_SQL = """WITH spec AS (SELECT p_partkey, p_name, p_brand FROM part), j AS (
SELECT p_partkey, '{"adapter_id":null,"alignment_source":"mfa","artifact_schema_version":"v1","backbone_id":"' || p_name || '-' || p_partkey || '","backbone_revision":null,"dataset":"' || p_brand
  || '","embedding_source":"frozen","pooling_version":"mean","sample_rate":16000}' AS s FROM spec)
SELECT p_partkey, substr(sha256(s), 1, 16) AS feature_key FROM j"""


@query("fn_25_feature_key", SPEC_SQL)
def fn_25(spark, sf):
    from cadenza.operators.ledger import feature_key

    backbone = F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"))
    spec = {"adapter_id": None, "alignment_source": F.lit("mfa"), "artifact_schema_version": F.lit("v1"), "backbone_id": backbone, "backbone_revision": None, "dataset": F.col("p_brand"), "embedding_source": F.lit("frozen"), "pooling_version": F.lit("mean"), "sample_rate": F.lit(16000)}
    return table(spark, sf, "part").select("p_partkey", feature_key(spec).alias("feature_key"))


@query("fn_26_row_rules", f"WITH {V.PHONES_SQL} SELECT array_to_string(list_filter([CASE WHEN NOT frames >= 5 THEN 'frames' END, CASE WHEN NOT human_score BETWEEN 0 AND 1.5 THEN 'human_score' END, CASE WHEN source NOT IN ('mfa', 'manual') THEN 'source' END], lambda x: x IS NOT NULL), ',') AS broken, count(*) AS n FROM phones GROUP BY 1")
def fn_26(spark, sf):
    rules = {"frames": F.col("frames") >= 5, "human_score": F.col("human_score").between(0, 1.5), "source": F.col("source").isin("mfa", "manual")}
    return V.phones(spark, sf).groupBy(F.array_join(L.violated(rules), ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query("fn_27_quality_status", f"WITH {V.FRAMES_SQL}, q AS (SELECT vec_id, energy / 3 AS rms, len(list_filter(vector, lambda x: abs(x) >= 0.2)) / len(vector) AS clip, len(list_filter(vector, lambda x: abs(x) < 0.05)) / len(vector) AS still FROM frames) SELECT vec_id, CASE WHEN rms < 0.04 OR still > 0.75 THEN 'rejected' WHEN clip > 0.08 OR still > 0.45 THEN 'low_confidence' ELSE 'ok' END AS status FROM q")
def fn_27(spark, sf):
    x = F.col("vector")
    ratio = lambda t: F.size(F.filter(x, t)) / F.size(x)
    return V.frames(spark, sf).select("vec_id", S.quality_status(F.col("energy") / 3, ratio(lambda v: F.abs(v) >= 0.2), ratio(lambda v: F.abs(v) < 0.05)).alias("status"))


@query("fn_28_clamp_score", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, greatest(0, least(100, CAST(round_even(frames * 3.5 - 20, 0) AS INT))) AS score FROM phones")
def fn_28(spark, sf):
    return V.phones(spark, sf).select("utterance_id", F.col("index").cast("long").alias("index"), S.clamp_score(F.col("frames") * 3.5 - 20).alias("score"))


Z_SQL = "(frames - 25) / 20.0::DOUBLE"
CLAMP = "greatest(0, least(100, CAST(round_even({0}, 0) AS INT)))"
SCORES_SQL = (
    V.PHONES_SQL
    + f""", s0 AS (SELECT *, {Z_SQL} AS z, (frames % 10 = 0) AS late, CASE source WHEN 'manual' THEN 0.98::DOUBLE WHEN 'mfa' THEN 0.92::DOUBLE ELSE 0.85::DOUBLE END AS conf0 FROM phones),
scored AS (SELECT *, {CLAMP.format("82 - least(28.0::DOUBLE, variance * 120) + least(12.0::DOUBLE, energy * 22)")} AS match, {CLAMP.format("92 - least(40.0::DOUBLE, abs(z) * 35)")} AS dur,
 {CLAMP.format("96 - CASE WHEN energy > 0.08 THEN 0.0::DOUBLE ELSE 35.0::DOUBLE END - greatest(0.0::DOUBLE, -z * 12)")} AS presence,
 greatest(0.35::DOUBLE, least(0.98::DOUBLE, round(0.55::DOUBLE + 0.35::DOUBLE * conf0 + 0.5::DOUBLE * least(energy, 0.2::DOUBLE) - 0.25::DOUBLE * least(variance, 0.2::DOUBLE), 3))) AS confidence FROM s0)"""
)


def scored(spark, sf):
    p = V.phones(spark, sf).withColumn("z", (F.col("frames") - 25) / 20.0).withColumn("late", F.col("frames") % 10 == 0).withColumn("conf0", L.alignment_confidence(F.col("source")))
    z, e, v = F.col("z"), F.col("energy"), F.col("variance")
    p = p.select("*", S.match_score(v, e).alias("match"), S.duration_score(z).alias("dur"), S.presence_score(z, e).alias("presence"), S.phone_confidence(F.col("conf0"), e, v).alias("confidence"))
    status = S.phone_status(F.col("match"), F.col("dur"), F.col("presence"), z, F.col("late"))
    return p.withColumn("status", status)


STATUS_SQL = "CASE WHEN presence < 45 THEN 'possibly_missing' WHEN match < 58 THEN 'low_match' WHEN late THEN 'late_start' WHEN dur < 58 AND z < 0 THEN 'too_short' WHEN dur < 58 AND z > 0 THEN 'too_long' WHEN presence < 70 OR match < 70 THEN 'weak' ELSE 'ok' END"
PENALTY_SQL = "((100 - match) + 0.75::DOUBLE * (100 - presence) + 0.45::DOUBLE * (100 - dur))"


@query("fn_29_phone_scores", f"WITH {SCORES_SQL} SELECT utterance_id, index, match, dur, presence, round(confidence, 3) AS confidence FROM scored")
def fn_29(spark, sf):
    return scored(spark, sf).select("utterance_id", F.col("index").cast("long").alias("index"), "match", "dur", "presence", F.round("confidence", 3).alias("confidence"))


@query("fn_30_phone_status", f"WITH {SCORES_SQL} SELECT {STATUS_SQL} AS status, count(*) AS n FROM scored GROUP BY 1")
def fn_30(spark, sf):
    return scored(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
