"""Speech-shaped views over the given tables, in Spark and in SQL; every query runs on them in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions.constants import PHONES
from cadenza.session import dealt, table

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def r6(c: Column) -> Column:
    """Rounded for comparison; a negative zero becomes zero."""
    return F.round(c, 6) + 0.0


def phones(spark: SparkSession, sf: str) -> DataFrame:
    """One row per phone: an order is a word, a line a phone."""
    lines = table(spark, sf, "lineitem")
    li = dealt(lines, lines.count(), "l_orderkey").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    # named before its window: what is grouped by word afterwards needs no shuffle of its own
    li = li.withColumnRenamed("l_orderkey", "utterance_id")
    word = Window.partitionBy("utterance_id").orderBy(*LINE_ORDER)
    dur = (F.col("l_quantity") * 10).cast("int")
    gap = F.when(F.col("l_linestatus") == "O", 60).otherwise(0)
    names = F.array(*[F.lit(p) for p in PHONES])
    return li.select(
        "utterance_id", (F.row_number().over(word) - 1).alias("index"), F.col("o_custkey").alias("speaker_id"),
        F.when(F.col("o_custkey") % 10 == 0, "test").when(F.col("o_custkey") % 10 == 1, "val").otherwise("train").alias("split"),
        F.element_at(names, (F.col("l_partkey") % 39 + 1).cast("int")).alias("phoneme"), dur.alias("duration_ms"),
        (F.sum(dur + gap).over(word) - dur).cast("int").alias("start_ms"), (F.sum(dur + gap).over(word)).cast("int").alias("end_ms"),
        (F.round(F.col("l_discount") * 20, 1) + 0.0).alias("human_score"), (F.col("l_returnflag") == "R").alias("omission"), F.col("l_returnflag").alias("flag"),
        (F.col("l_tax") + 0.0).alias("variance"), (F.col("l_discount") + 0.0).alias("energy"), F.col("l_quantity").cast("int").alias("frames"),
        F.when(F.col("l_suppkey") % 3 == 0, "manual").when(F.col("l_suppkey") % 3 == 1, "mfa").otherwise("custom_ctc").alias("source"),
        F.col("l_linenumber").alias("line"),
    )


NAMES_SQL = "[" + ",".join(f"'{p}'" for p in PHONES) + "]"
PHONES_SQL = f"""phones AS (
SELECT l_orderkey AS utterance_id, row_number() OVER w - 1 AS index, o_custkey AS speaker_id,
  CASE o_custkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split,
  {NAMES_SQL}[l_partkey % 39 + 1] AS phoneme, CAST(l_quantity * 10 AS INT) AS duration_ms,
  CAST(sum(CAST(l_quantity * 10 AS INT) + CASE WHEN l_linestatus = 'O' THEN 60 ELSE 0 END) OVER w - CAST(l_quantity * 10 AS INT) AS INT) AS start_ms,
  CAST(sum(CAST(l_quantity * 10 AS INT) + CASE WHEN l_linestatus = 'O' THEN 60 ELSE 0 END) OVER w AS INT) AS end_ms,
  round(l_discount * 20, 1) + 0.0 AS human_score, l_returnflag = 'R' AS omission, l_returnflag AS flag, l_tax + 0.0 AS variance, l_discount + 0.0 AS energy,
  CAST(l_quantity AS INT) AS frames, CASE l_suppkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'mfa' ELSE 'custom_ctc' END AS source, l_linenumber AS line
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)} ROWS UNBOUNDED PRECEDING))"""

TARGET_SQL = "CASE WHEN abs(human_score - round_even(human_score, 0)) < 1e-6 AND round_even(human_score, 0) BETWEEN 0 AND 2 THEN [15.0, 60.0, 92.0][CAST(round_even(human_score, 0) AS INT) + 1]::DOUBLE ELSE greatest(0.0, least(100.0, 15.0 + human_score / 2.0 * 77.0)) END"
CLASS1_SQL = "CASE WHEN {0} >= 72.75 THEN 'correct' WHEN {0} >= 34.25 THEN 'accented' ELSE 'wrong_or_missed' END"
CLASS2_SQL = "CASE WHEN {0} >= 76.0 THEN 'correct' WHEN {0} >= 37.5 THEN 'accented' ELSE 'wrong_or_missed' END"


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per phone: predictions and targets of both report versions."""
    p = phones(spark, sf)
    match = F.least(F.lit(100.0), F.col("frames") * 2.0)
    presence = F.round(1 - F.col("energy") * F.col("line"), 3)
    return p.select(
        "utterance_id", "index", match.alias("match_pred"), (100 - 500 * F.col("variance")).alias("duration_pred"), presence.alias("presence_prob"),
        L.regression_target(F.col("human_score")).alias("match_target"), L.regression_target(F.col("human_score")).alias("duration_target"),
        (1 - F.col("omission").cast("int")).alias("presence_target"),
    )


PRED_SQL = PHONES_SQL + f""", pred AS (
SELECT utterance_id, index, least(100.0, frames * 2.0)::DOUBLE AS match_pred, 100 - 500 * variance AS duration_pred, round(1 - energy * line, 3) AS presence_prob,
  {TARGET_SQL} AS match_target, {TARGET_SQL} AS duration_target, 1 - CAST(omission AS INT) AS presence_target FROM phones)"""


def words(spark: SparkSession, sf: str) -> DataFrame:
    """One row per word: arrays in phone order."""
    from cadenza.operators.words import assemble_words

    return assemble_words(phones(spark, sf))


def doc_paths(spark: SparkSession, sf: str) -> DataFrame:
    """One row per utterance of a read-speech corpus."""
    d = table(spark, sf, "documents")
    subset = F.when(F.col("doc_id") % 10 == 0, "test-clean").when(F.col("doc_id") % 10 == 1, "dev-clean").otherwise("train-clean")
    uid = F.concat(F.lit("utt-"), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", F.lit("raw"), subset, "source", F.concat(F.lit("ch"), (F.col("doc_id") % 3).cast("string")), F.concat(uid, F.lit(".wav")))
    return d.select("doc_id", uid.alias("utterance_id"), F.col("source").alias("speaker_id"), subset.alias("subset"), path.alias("audio_path"), "text")


DOCS_SQL = """docs AS (
SELECT doc_id, 'utt-' || doc_id AS utterance_id, source AS speaker_id, CASE doc_id % 10 WHEN 0 THEN 'test-clean' WHEN 1 THEN 'dev-clean' ELSE 'train-clean' END AS subset, text,
  'raw/' || CASE doc_id % 10 WHEN 0 THEN 'test-clean' WHEN 1 THEN 'dev-clean' ELSE 'train-clean' END || '/' || source || '/ch' || (doc_id % 3) || '/utt-' || doc_id || '.wav' AS audio_path
FROM documents)"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per frame: 25 embeddings make an utterance."""
    e = table(spark, sf, "embeddings")
    x = F.transform("embedding", lambda v: v.cast("double"))
    energy = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))
    return e.select(F.floor(F.col("vec_id") / 25).alias("utterance_id"), (F.col("vec_id") % 25).cast("int").alias("frame"), x.alias("vector"), energy.alias("energy"), "vec_id")


FRAMES_SQL = """frames AS (
SELECT vec_id // 25 AS utterance_id, CAST(vec_id % 25 AS INT) AS frame, list_transform(embedding, lambda x: x::DOUBLE) AS vector,
  sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS energy, vec_id FROM embeddings)"""
SPANS = [(0, 4), (4, 10), (10, 15), (15, 22), (22, 25), (25, 25)]


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Six half-open frame spans of each utterance, the last one empty."""
    each = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, (a, b) in enumerate(SPANS)])
    return frames(spark, sf).select("utterance_id").distinct().select("utterance_id", F.inline(each))


SPANS_SQL = FRAMES_SQL + ", spans AS (SELECT DISTINCT utterance_id, s.i AS index, s.a AS start, s.b AS \"end\" FROM frames, (VALUES " + ",".join(f"({i},{a},{b})" for i, (a, b) in enumerate(SPANS)) + ") s(i, a, b))"


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings: ids, times, audio groups by event type and durations."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("recording_id"), "ts", F.col("user_id").alias("speaker_id"), F.col("event_type").alias("audio_path"), (F.col("value") * 10).cast("int").alias("duration_ms"), F.get_json_object("props", "$.k").alias("feature_key"))


EVENTS_SQL = """events_v AS (SELECT event_id AS recording_id, ts, user_id AS speaker_id, event_type AS audio_path, CAST(trunc(value * 10) AS INT) AS duration_ms, json_extract_string(props, '$.k') AS feature_key FROM events)"""
