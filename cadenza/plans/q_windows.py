"""Queries of windows, sequences, sampling, sorting and set operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import text as X
from cadenza.operators import runs
from cadenza.operators import sampling as P
from cadenza.operators import words as O
from cadenza.operators.assess import align_frames, primary_issue
from cadenza.operators.permute import rounds_sql
from cadenza.plans import views as V
from cadenza.plans.q_aggregates import SPLIT_SQL
from cadenza.plans.q_functions import ID_SQL, SCORES_SQL, PENALTY_SQL, STATUS_SQL, WEIGHT_SQL, scored
from cadenza.plans.registry import query
from cadenza.session import table


def idx():
    return F.col("index").cast("long").alias("index")


@query("wn_01_neighbours", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, lag(phoneme) OVER w AS prev_phoneme, lead(phoneme) OVER w AS next_phoneme FROM phones WINDOW w AS (PARTITION BY utterance_id ORDER BY index)")
def wn_01(spark, sf):
    w = Window.partitionBy("utterance_id").orderBy("index")
    return V.phones(spark, sf).select("utterance_id", idx(), F.lag("phoneme").over(w).alias("prev_phoneme"), F.lead("phoneme").over(w).alias("next_phoneme"))


@query("wn_02_late_start", f"WITH {V.PHONES_SQL}, g AS (SELECT utterance_id, index, coalesce(start_ms - lag(end_ms - (end_ms - start_ms - duration_ms)) OVER (PARTITION BY utterance_id ORDER BY index) > 15.0, false) AS late FROM phones) SELECT utterance_id, index, late FROM g")
def wn_02(spark, sf):
    w = Window.partitionBy("utterance_id").orderBy("index")
    said_until = F.col("start_ms") + F.col("duration_ms")
    return V.phones(spark, sf).select("utterance_id", idx(), F.coalesce(F.col("start_ms") - F.lag(said_until).over(w) > 1.5 * 10.0, F.lit(False)).alias("late"))


@query("wn_03_audio_groups", f"WITH {V.EVENTS_SQL}, l AS (SELECT *, CASE WHEN lag(audio_path) OVER (PARTITION BY speaker_id ORDER BY recording_id) <> audio_path THEN 1 ELSE 0 END AS new FROM events_v) SELECT recording_id, sum(new) OVER (PARTITION BY speaker_id ORDER BY recording_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l")
def wn_03(spark, sf):
    return runs.run_ids(V.events(spark, sf), "speaker_id", "recording_id", "audio_path").select("recording_id", "run")


CAPPED_SQL = f"""WITH RECURSIVE {V.EVENTS_SQL}, r AS (SELECT recording_id, speaker_id, duration_ms, row_number() OVER (PARTITION BY speaker_id ORDER BY recording_id) AS rn FROM events_v),
b AS (SELECT recording_id, speaker_id, rn, CAST(0 AS BIGINT) AS batch, CAST(duration_ms AS BIGINT) AS used FROM r WHERE rn = 1
UNION ALL SELECT r.recording_id, r.speaker_id, r.rn, b.batch + CASE WHEN b.used + r.duration_ms > 6000 THEN 1 ELSE 0 END, CASE WHEN b.used + r.duration_ms > 6000 THEN 0 ELSE b.used END + r.duration_ms FROM b JOIN r ON r.speaker_id = b.speaker_id AND r.rn = b.rn + 1)
SELECT speaker_id, recording_id, batch FROM b"""


@query("wn_04_capped_batches", CAPPED_SQL)
def wn_04(spark, sf):
    e = V.events(spark, sf).select("speaker_id", "recording_id", F.col("duration_ms").cast("long").alias("duration_ms"))
    return O.capped_batches(e, "speaker_id", "recording_id", "duration_ms", 6000)


@query("wn_05_shard_index", f"WITH {V.EVENTS_SQL} SELECT recording_id, CAST((row_number() OVER (PARTITION BY audio_path ORDER BY recording_id) - 1) // 100 AS INT) AS shard FROM events_v")
def wn_05(spark, sf):
    return O.shard_index(V.events(spark, sf), "audio_path", "recording_id", 100).select("recording_id", "shard")


WORDS_SQL = V.PHONES_SQL + ", words AS (SELECT utterance_id, first(split) AS split, first(speaker_id) AS speaker_id, CAST(count(*) AS INT) AS seq_len FROM phones GROUP BY 1)"


@query("wn_06_row_offsets", f"WITH {WORDS_SQL} SELECT utterance_id, split, CAST(sum(seq_len) OVER (PARTITION BY split ORDER BY utterance_id ROWS UNBOUNDED PRECEDING) - seq_len AS BIGINT) AS row_offset FROM words")
def wn_06(spark, sf):
    w = V.phones(spark, sf).groupBy("utterance_id", "split").agg(F.count(F.lit(1)).alias("seq_len"))
    return O.two_level_offsets(w, "split", "utterance_id", "seq_len", 1024).select("utterance_id", "split", F.col("offset").alias("row_offset"))


ALIGN_SQL = f"""{V.PHONES_SQL}, a AS (SELECT utterance_id, index, phoneme, {WEIGHT_SQL} AS w, sum(frames) OVER (PARTITION BY utterance_id) AS n, count(*) OVER (PARTITION BY utterance_id) AS k FROM phones),
b AS (SELECT *, greatest(1, floor(w / sum(w) OVER (PARTITION BY utterance_id) * n)) AS len0 FROM a), c AS (SELECT *, n - sum(len0) OVER (PARTITION BY utterance_id) AS delta FROM b),
d AS (SELECT *, CAST(len0 + floor(delta / k) + CASE WHEN index < delta % k THEN 1 ELSE 0 END AS INT) AS len FROM c WHERE n >= k),
s AS (SELECT *, CAST(sum(len) OVER (PARTITION BY utterance_id ORDER BY index ROWS UNBOUNDED PRECEDING) AS INT) AS "end" FROM d)"""


def word_phones(spark, sf):
    return V.phones(spark, sf).withColumn("total_frames", F.sum("frames").over(Window.partitionBy("utterance_id")))


@query("wn_07_align_frames", f'WITH {ALIGN_SQL} SELECT utterance_id, index, "end" - len AS start, "end" FROM s')
def wn_07(spark, sf):
    return align_frames(word_phones(spark, sf)).select("utterance_id", idx(), "start", "end")


@query("wn_08_duration_z", f"WITH {ALIGN_SQL} SELECT utterance_id, index, round((greatest(0.5, len / greatest(1.0, n / k)) - w) / greatest(0.35::DOUBLE, w), 3) + 0.0 AS z, CAST(\"end\" * 10 AS INT) AS end_ms FROM s")
def wn_08(spark, sf):
    return align_frames(word_phones(spark, sf)).select("utterance_id", idx(), "z", "end_ms")


SPANS_SQL = f"""{V.PHONES_SQL}, a AS (SELECT *, {WEIGHT_SQL} AS w, sum(frames) OVER (PARTITION BY utterance_id) AS n FROM phones), b AS (SELECT utterance_id, index, w, n, greatest(0, least(n - 1, floor(start_ms / 10.0))) AS s, end_ms,
 sum(w) OVER (PARTITION BY utterance_id) AS ws FROM a), c AS (SELECT *, least(n, greatest(s + 1, ceil(end_ms / 10.0))) AS e, greatest(1.0, n * w / ws) AS x FROM b)
SELECT utterance_id, index, CAST(s AS INT) AS start, CAST(e AS INT) AS "end", round((greatest(1, e - s) - x) / greatest(1.0, 0.35::DOUBLE * x), 3) + 0.0 AS z FROM c"""


@query("wn_09_label_spans", f"WITH {SPANS_SQL}")
def wn_09(spark, sf):
    from cadenza.operators.align import label_spans

    return label_spans(word_phones(spark, sf), 10.0).select("utterance_id", idx(), "start", "end", "z")


@query("wn_10_length_batches", f"WITH {WORDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY utterance_id) - 1 AS rn FROM words), b AS (SELECT *, rn // 64 AS bucket FROM r) SELECT utterance_id, CAST(bucket AS INT) AS bucket, CAST((row_number() OVER (PARTITION BY split, bucket ORDER BY seq_len, rn) - 1) // 8 AS INT) AS batch FROM b")
def wn_10(spark, sf):
    w = V.phones(spark, sf).groupBy("utterance_id", "split").agg(F.count(F.lit(1)).alias("seq_len"))
    return O.length_batches(w, "split", "utterance_id", 8, 8).select("utterance_id", "bucket", "batch")


@query("wn_11_pad_and_mask", f"WITH {WORDS_SQL}, m AS (SELECT *, max(seq_len) OVER (PARTITION BY utterance_id // 100) AS m FROM words), i AS (SELECT utterance_id, sum({ID_SQL.format('phoneme')}) AS ids FROM phones GROUP BY 1) SELECT utterance_id, CAST(m AS INT) AS width, CAST(ids AS BIGINT) AS id_total, seq_len AS valid FROM m JOIN i USING (utterance_id)")
def wn_11(spark, sf):
    w = V.words(spark, sf).withColumn("m", F.max("seq_len").over(Window.partitionBy(F.floor(F.col("utterance_id") / 100))))
    w = w.withColumn("p", O.pad(F.col("phoneme_ids"), F.col("m"), F.lit(0))).withColumn("v", O.valid_mask(F.col("seq_len"), F.col("m")))
    return w.select("utterance_id", F.size("p").alias("width"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x).alias("id_total"), F.size(O.masked(F.col("p"), F.col("v"))).alias("valid"))


@query("wn_12_batch_count", f"WITH {WORDS_SQL}, n AS (SELECT split, count(*) AS n FROM words GROUP BY 1) SELECT split, n // 50 * 4 + ceil(n % 50 / 16.0)::BIGINT AS batches, n // 50 * 3 + n % 50 // 16 AS full_batches FROM n")
def wn_12(spark, sf):
    w = V.phones(spark, sf).select("utterance_id", "split").distinct().withColumn("u", F.col("utterance_id"))
    count = lambda drop: O.block_shuffle(w, "split", "u", 16, 50, seed=7, epoch=1, drop_last=drop).groupBy("split").agg(F.count_distinct("block", "batch_in_block").alias("n"))
    return count(False).withColumnRenamed("n", "batches").join(count(True).withColumnRenamed("n", "full_batches"), "split")


DRAW_SQL = "CAST('0x' || md5({0})[{1}:{2}] AS BIGINT)"
#: Rows with their place among ``n`` by the permutation that ``k`` names: x walks on until it is below n.
SHUFFLE_SQL = f"""{{0}}, r AS (SELECT utterance_id, split, row_number() OVER (PARTITION BY split ORDER BY utterance_id) - 1 AS rn, count(*) OVER (PARTITION BY split) AS total FROM words),
b AS (SELECT *, rn // {{1}} AS block, least({{1}}, total - rn // {{1}} * {{1}}) AS rows, CAST(ceil(total / {{1}}.0::DOUBLE) AS BIGINT) AS blocks FROM r),
t AS (SELECT 'r' AS kind, utterance_id AS id, rn % {{1}} AS i, rows AS n, CAST(ceil(sqrt(rows::DOUBLE)) AS BIGINT) AS side, ({{2}} + 1 + block) % 2147483648 AS k FROM b
  UNION ALL SELECT 'b', utterance_id, block, blocks, CAST(ceil(sqrt(blocks::DOUBLE)) AS BIGINT), {{2}} % 2147483648 FROM b),
walk AS (SELECT kind, id, n, side, k, {rounds_sql("i", "side", "k")} AS x FROM t UNION ALL SELECT kind, id, n, side, k, {rounds_sql("x", "side", "k")} FROM walk WHERE x >= n),
shuffled AS (SELECT b.*, o.x AS block_order, CAST(p.x // 16 AS INT) AS batch_in_block FROM b JOIN walk o ON o.id = b.utterance_id AND o.kind = 'b' AND o.x < o.n JOIN walk p ON p.id = b.utterance_id AND p.kind = 'r' AND p.x < p.n)"""


@query("wn_12_block_shuffle", f"WITH RECURSIVE {SHUFFLE_SQL.format(WORDS_SQL, 50, 7 * 1_000_003 + 10_007)} SELECT utterance_id, split, block, block_order, batch_in_block FROM shuffled")
def wn_12_rows(spark, sf):
    w = V.phones(spark, sf).select("utterance_id", "split").distinct()
    return O.block_shuffle(w, "split", "utterance_id", 16, 50, seed=7, epoch=1).select("utterance_id", "split", "block", "block_order", "batch_in_block")


NEGATIVE_SQL = f"""WITH {V.PHONES_SQL}, p AS (SELECT utterance_id, index, {ID_SQL.format('phoneme')} AS phoneme_id, {V.TARGET_SQL} AS target, 1 - CAST(omission AS INT) AS presence FROM phones),
d AS (SELECT *, {DRAW_SQL.format("'11:' || utterance_id || ':' || index", 1, 8)} / 4294967296.0::DOUBLE AS u, {DRAW_SQL.format("'11:' || utterance_id || ':' || index", 9, 16)} % 38 + 2 AS pick FROM p),
k AS (SELECT *, CASE WHEN u < 0.15 THEN 'substitution' WHEN u < 0.3 THEN 'omission' ELSE '' END AS augmented FROM d)
SELECT utterance_id, index, CAST(phoneme_id AS INT) AS phoneme_id, target, presence, augmented, CAST(CASE WHEN augmented = 'substitution' THEN CASE WHEN pick >= phoneme_id THEN pick + 1 ELSE pick END ELSE phoneme_id END AS INT) AS new_id,
  CASE augmented WHEN 'substitution' THEN 15.0::DOUBLE WHEN 'omission' THEN 0.0::DOUBLE ELSE target END AS new_target, CASE WHEN augmented = 'omission' THEN 0 ELSE presence END AS new_presence FROM k"""


@query("wn_13_negative_samples", NEGATIVE_SQL)
def wn_13(spark, sf):
    p = V.phones(spark, sf).select("utterance_id", "index", L.phoneme_id(F.col("phoneme")).alias("phoneme_id"), L.regression_target(F.col("human_score")).alias("target"), (1 - F.col("omission").cast("int")).alias("presence"))
    return P.negative_samples(p, 0.3, seed=11)


@query("wn_14_mask_count", f"WITH {WORDS_SQL} SELECT utterance_id, least(seq_len, greatest(1, CAST(round_even(seq_len * 0.3::DOUBLE, 0) AS INT))) AS masked FROM words")
def wn_14(spark, sf):
    w = V.phones(spark, sf).groupBy("utterance_id").agg(F.count(F.lit(1)).cast("int").alias("seq_len"))
    return P.mask_positions(w, 0.3, 1, seed=5).select("utterance_id", F.size("mask").alias("masked"))


@query("wn_15_speaker_splits", f"WITH {V.DOCS_SQL}, s AS (SELECT speaker_id, sha256('17:' || speaker_id) AS h FROM (SELECT DISTINCT speaker_id FROM docs WHERE subset <> 'test-clean')), r AS (SELECT speaker_id, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM s) SELECT speaker_id, CASE WHEN rn <= greatest(1, least(n - 1, ceil(n * 0.1))) THEN 'val' ELSE 'train' END AS split FROM r")
def wn_15(spark, sf):
    return P.speaker_splits(V.doc_paths(spark, sf).where(F.col("subset") != "test-clean"), "speaker_id", 0.1, seed=17)


@query("sl_01_head_per_split", f"WITH {V.DOCS_SQL}, r AS (SELECT utterance_id, {SPLIT_SQL} AS split, row_number() OVER (PARTITION BY {SPLIT_SQL} ORDER BY speaker_id, utterance_id) AS rn FROM docs) SELECT utterance_id, split FROM r WHERE rn <= 5")
def sl_01(spark, sf):
    d = V.doc_paths(spark, sf).withColumn("split", X.split_of_path(F.col("audio_path")))
    return P.head_per_split(d, 5, "split", "speaker_id", "utterance_id").select("utterance_id", "split")


@query("sl_02_manifest_order", f"WITH {V.DOCS_SQL} SELECT speaker_id, utterance_id FROM docs ORDER BY 1, 2")
def sl_02(spark, sf):
    return V.doc_paths(spark, sf).select("speaker_id", "utterance_id").orderBy("speaker_id", "utterance_id")


@query("sl_03_primary_issue", f"""
WITH {SCORES_SQL},
x AS (SELECT utterance_id, phoneme, {STATUS_SQL} AS status, row_number() OVER (PARTITION BY utterance_id ORDER BY {PENALTY_SQL} DESC, index) AS rn FROM scored),
w AS (SELECT o_orderkey AS utterance_id FROM orders)
SELECT w.utterance_id, CASE WHEN x.status IS NULL THEN 'no_signal' WHEN x.status = 'ok' THEN 'low_match' ELSE x.status END AS issue, x.phoneme
FROM w LEFT JOIN x ON x.utterance_id = w.utterance_id AND rn = 1
""")
def sl_03(spark, sf):
    return primary_issue(table(spark, sf, "orders").select(F.col("o_orderkey").alias("utterance_id")), scored(spark, sf), "utterance_id")


@query("sl_04_ordered_limit", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, phoneme FROM phones ORDER BY utterance_id, index LIMIT 25")
def sl_04(spark, sf):
    return V.phones(spark, sf).select("utterance_id", idx(), "phoneme").orderBy("utterance_id", "index").limit(25)


LEX_TOKENS_SQL = "bench AS (SELECT DISTINCT regexp_replace(lower(trim(t)), '[^a-z'']+', '', 'g') AS word FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS t FROM benchmark))"


@query("sl_05_vocabulary", f"WITH {LEX_TOKENS_SQL} SELECT word FROM bench WHERE word <> '' ORDER BY word")
def sl_05(spark, sf):
    t = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[ \\n]+")).alias("t"))
    return t.select(X.word_token(F.col("t")).alias("word")).where(F.col("word") != "").distinct().orderBy("word")


@query("set_01_union_of_splits", f"WITH {V.DOCS_SQL} SELECT 'reading' AS dataset, utterance_id, speaker_id FROM docs UNION ALL SELECT 'events', CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR) FROM events")
def set_01(spark, sf):
    a = V.doc_paths(spark, sf).select(F.lit("reading").alias("dataset"), "utterance_id", "speaker_id")
    b = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("speaker_id"), F.col("event_id").cast("string").alias("utterance_id"), F.lit("events").alias("dataset"))
    return a.unionByName(b)


@query("set_02_leaked_speakers", f"WITH {V.PHONES_SQL} SELECT speaker_id FROM phones WHERE split = 'train' INTERSECT SELECT speaker_id FROM phones WHERE split = 'val'")
def set_02(spark, sf):
    s = lambda x: V.phones(spark, sf).where(F.col("split") == x).select("speaker_id")
    return s("train").intersect(s("val"))


@query("set_03_split_completeness", f"WITH {V.DOCS_SQL}, o AS (SELECT DISTINCT speaker_id FROM docs WHERE subset <> 'test-clean') SELECT count(*) AS official, 0 AS missing, 0 AS extra FROM o")
def set_03(spark, sf):
    d = V.doc_paths(spark, sf).where(F.col("subset") != "test-clean")
    official, dealt = d.select("speaker_id").distinct(), P.speaker_splits(d, "speaker_id", 0.1, seed=17).select("speaker_id")
    sides = official.select(F.lit("o").alias("k")).union(official.exceptAll(dealt).select(F.lit("m"))).union(dealt.exceptAll(official).select(F.lit("e")))
    return sides.agg(F.count_if(F.col("k") == "o").alias("official"), F.count_if(F.col("k") == "m").cast("int").alias("missing"), F.count_if(F.col("k") == "e").cast("int").alias("extra"))
