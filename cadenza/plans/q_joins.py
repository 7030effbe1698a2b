"""Queries of the joins JN-01..JN-15, the filters FLT-01..FLT-07 and the nested score records FN-15..FN-17."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import scorejson as J
from cadenza.functions import text as X
from cadenza.operators import align as A
from cadenza.operators import pooling, verify
from cadenza.operators import sampling as P
from cadenza.operators import words as O
from cadenza.plans import views as V
from cadenza.plans.q_aggregates import REASON_SQL, SPLIT_SQL
from cadenza.plans.q_functions import TOKENS_SQL
from cadenza.plans.registry import query
from cadenza.plans.views import r6
from cadenza.session import spread, table
from cadenza.sources import corpora


def idx():
    return F.col("index").cast("long").alias("index")


@query("jn_01_scored_utterances", f"WITH {V.DOCS_SQL} SELECT utterance_id, speaker_id, audio_path, quality FROM docs JOIN labels USING (doc_id)")
def jn_01(spark, sf):
    d = V.doc_paths(spark, sf)
    speakers, audio = d.select("doc_id", "utterance_id", "speaker_id"), d.select("utterance_id", "audio_path")
    return corpora.scored_utterances(speakers, table(spark, sf, "labels").select("doc_id", "quality"), audio, "doc_id").select("utterance_id", "speaker_id", "audio_path", "quality")


@query("jn_02_split_of_speaker", f"WITH {V.DOCS_SQL}, s AS (SELECT speaker_id, sha256('17:' || speaker_id) AS h FROM (SELECT DISTINCT speaker_id FROM docs WHERE subset <> 'test-clean')), r AS (SELECT speaker_id, row_number() OVER (ORDER BY h) AS rn, count(*) OVER () AS n FROM s) SELECT utterance_id, CASE WHEN rn <= greatest(1, least(n - 1, ceil(n * 0.1))) THEN 'val' ELSE 'train' END AS split FROM docs LEFT JOIN r USING (speaker_id)")
def jn_02(spark, sf):
    d = V.doc_paths(spark, sf)
    splits = P.speaker_splits(d.where(F.col("subset") != "test-clean"), "speaker_id", 0.1, seed=17)
    return d.join(splits, "speaker_id", "left").select("utterance_id", F.coalesce("split", F.lit("train")).alias("split"))


SIDECAR_SQL = "CASE WHEN doc_id % 2 = 0 THEN '.normalized.txt' WHEN doc_id % 3 = 0 THEN '.original.txt' WHEN doc_id % 5 = 0 THEN '.txt' END"


def sidecars(spark, sf):
    d = V.doc_paths(spark, sf)
    stem = F.regexp_replace("audio_path", r"\.wav$", "")
    named = F.filter(F.array(*[F.when(F.col("doc_id") % m == 0, F.concat(stem, F.lit(s))) for m, s in ((2, ".normalized.txt"), (3, ".original.txt"), (5, ".txt"))]), lambda x: x.isNotNull())
    return d.select(F.explode(named).alias("path"))


@query("jn_03_transcript_sidecar", f"WITH {V.DOCS_SQL} SELECT utterance_id, regexp_replace(audio_path, '\\.wav$', '') || {SIDECAR_SQL} AS transcript_path FROM docs")
def jn_03(spark, sf):
    best = corpora.best_transcripts(sidecars(spark, sf))
    return V.doc_paths(spark, sf).withColumn("stem", F.regexp_replace("audio_path", r"\.wav$", "")).join(best, "stem", "left").select("utterance_id", "transcript_path")


@query("src_05_transcript_choice", f"WITH {V.DOCS_SQL} SELECT regexp_replace(audio_path, '\\.wav$', '') AS stem, regexp_replace(audio_path, '\\.wav$', '') || {SIDECAR_SQL} AS transcript_path FROM docs WHERE {SIDECAR_SQL} IS NOT NULL")
def src_05(spark, sf):
    return corpora.best_transcripts(sidecars(spark, sf))


@query("jn_04_missing_alignment", f"WITH {V.DOCS_SQL} SELECT utterance_id, CASE WHEN doc_id % 4 = 0 THEN 'missing_textgrid' END AS reason FROM docs")
def jn_04(spark, sf):
    d = V.doc_paths(spark, sf).withColumn("textgrid", X.alignment_path(F.col("audio_path")))
    there = d.where(F.col("doc_id") % 4 != 0).select("textgrid", F.lit(True).alias("there"))
    return d.join(there, "textgrid", "left").select("utterance_id", F.when(F.col("there").isNull(), "missing_textgrid").alias("reason"))


@query("jn_05_missing_score", f"WITH {V.DOCS_SQL} SELECT utterance_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_05(spark, sf):
    return V.doc_paths(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("utterance_id")


# Interval views: a token of a document is a word, its letters are phones of 50 ms each.
IV_SQL = V.DOCS_SQL + """, tk AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n\\t\\r]+')) AS token, generate_subscripts(string_split_regex(text, '[ \\n\\t\\r]+'), 1) - 1 AS pos FROM docs),
wl AS (SELECT doc_id, pos, CASE WHEN pos % 17 = 16 THEN 'sp' WHEN pos % 19 = 18 THEN '<eps>' ELSE token END AS label, greatest(1, length(token)) AS len, token FROM tk),
wi AS (SELECT *, CAST(sum(len) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM wl),
lex AS (SELECT word, CASE WHEN length(word) % 7 = 0 THEN reverse(upper(word)) WHEN length(word) % 5 = 0 THEN upper(word)[:-2] ELSE upper(word) END AS spelled FROM (SELECT DISTINCT regexp_replace(lower(trim(t)), '[^a-z'']+', '', 'g') AS word FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS t FROM benchmark)) WHERE word <> '')"""


def intervals(spark, sf):
    """Word and phone intervals of every document."""
    d = V.doc_paths(spark, sf)
    t = d.select("doc_id", F.posexplode(F.split("text", "[ \\n\\t\\r]+")).alias("pos", "token"))
    label = F.when(F.col("pos") % 17 == 16, "sp").when(F.col("pos") % 19 == 18, "<eps>").otherwise(F.col("token"))
    n = F.greatest(F.lit(1), F.length("token"))
    stop = F.sum(n).over(Window.partitionBy("doc_id").orderBy("pos"))
    w = t.select(F.col("doc_id").alias("utterance_id"), "pos", "token", label.alias("label"), (stop - n).alias("a"), stop.alias("b"))
    words = w.select("utterance_id", "pos", (F.col("a") * 0.05).alias("xmin"), (F.col("b") * 0.05).alias("xmax"), "label")
    letter = F.explode(F.sequence(F.lit(0), (F.col("b") - F.col("a") - 1).cast("int")))
    p = w.where(F.length("token") > 0).select("utterance_id", "a", "token", letter.alias("i"))
    phones = p.select("utterance_id", ((F.col("a") + F.col("i")) * 0.05).alias("xmin"), ((F.col("a") + F.col("i") + 1) * 0.05).alias("xmax"), F.upper(F.substring("token", F.col("i") + 1, F.lit(1))).alias("label"))
    return words, phones


#: Documents of a task that cuts them into intervals.
DOC_ROWS = 4096


def said(text):
    """A document's tokens, its word labels and the bounds of its words, in letters from its begin."""
    tokens = re.split("[ \n\t\r]+", text)
    label = ["sp" if p % 17 == 16 else "<eps>" if p % 19 == 18 else t for p, t in enumerate(tokens)]
    return tokens, label, np.cumsum([0, *(len(t) or 1 for t in tokens)])


def interval_arrays(spark, sf):
    """The same intervals with a row for each document, as its alignment file holds them: ``words`` and ``phones``."""
    interval = pa.struct([("xmin", pa.float64()), ("xmax", pa.float64()), ("label", pa.string())])

    def array(sizes, at, label):
        xmin, xmax = (pa.array(np.array(at, np.int64) * 0.05), pa.array((np.array(at, np.int64) + np.array(sizes, np.int64)) * 0.05)) if len(at) else (pa.array([], pa.float64()),) * 2
        return pa.StructArray.from_arrays([xmin, xmax, pa.array(label, pa.string())], fields=list(interval))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                tokens, label, bounds = said(b.column("text")[i].as_py())
                begin, own = bounds[:-1], np.array([len(t) for t in tokens])
                letters = "".join(tokens)
                at = np.arange(len(letters)) + np.repeat(begin - (np.cumsum(own) - own), own)
                upper = letters.upper()
                upper = list(upper) if len(upper) == len(letters) else [c.upper() for c in letters]
                lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (array(np.diff(bounds), begin, label), array(np.ones(len(at), np.int64), at, upper))]
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns[:-1], *lists], names=[*b.schema.names[:-1], "words", "phones"])

    d = V.doc_paths(spark, sf).where(F.col("text").isNotNull())
    d = d.select(F.col("doc_id").cast("string").alias("utterance_id"), "speaker_id", X.split_of_path(F.col("audio_path")).alias("split"), "audio_path", F.lit(True).alias("there"), F.lit(None).cast("string").alias("error"), "text")
    interval_type = "array<struct<xmin:double,xmax:double,label:string>>"
    # a table of one file would be one task
    return spread(d, DOC_ROWS, "utterance_id").mapInArrow(run, f"utterance_id string, speaker_id string, split string, audio_path string, there boolean, error string, words {interval_type}, phones {interval_type}")


def lexicon(spark, sf):
    t = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[ \\n]+")).alias("t"))
    w = t.select(X.word_token(F.col("t")).alias("word")).where(F.col("word") != "").distinct()
    up = F.upper("word")
    spelled = F.when(F.length("word") % 7 == 0, F.reverse(up)).when(F.length("word") % 5 == 0, F.substring(up, F.lit(1), F.length("word") - 1)).otherwise(up)
    return w.select("word", F.filter(F.split(spelled, ""), lambda x: x != "").alias("lexicon_phones"))


@query("jn_06_word_lexicon", f"WITH {IV_SQL}, w AS (SELECT doc_id AS utterance_id, pos, regexp_replace(lower(trim(label)), '[^a-z'']+', '', 'g') AS word FROM wi) SELECT utterance_id, pos, w.word, CASE WHEN lex.word IS NULL THEN 'missing_cmudict' END AS reason FROM w LEFT JOIN lex ON lex.word = w.word")
def jn_06(spark, sf):
    w, _ = intervals(spark, sf)
    w = w.select("utterance_id", F.col("pos").cast("long").alias("pos"), X.word_token(F.col("label")).alias("word"))
    return w.join(lexicon(spark, sf), "word", "left").select("utterance_id", "pos", "word", F.when(F.col("lexicon_phones").isNull(), "missing_cmudict").alias("reason"))


@query("jn_07_phones_in_word", f"WITH {IV_SQL} SELECT doc_id AS utterance_id, pos, length(token) AS n FROM wi WHERE length(token) > 0")
def jn_07(spark, sf):
    # a document's intervals stay in its row, as in its alignment file: no letter is shuffled
    d = interval_arrays(spark, sf).select(F.col("utterance_id").cast("long").alias("utterance_id"), "words", "phones")
    w = A.sweep(d, "words", "phones", lambda label: False).where(F.size("phones") > 0)
    return w.select("utterance_id", F.col("pos").cast("long").alias("pos"), F.size("phones").cast("long").alias("n"))


@query("jn_08_positional_zip", f"WITH {V.PHONES_SQL}, m AS (SELECT *, count(*) OVER (PARTITION BY utterance_id) AS n FROM phones) SELECT utterance_id, index AS pos, phoneme AS canonical, round({V.TARGET_SQL}, 6) AS target FROM m WHERE n % 2 = 0")
def jn_08(spark, sf):
    w = V.words(spark, sf).withColumn("scores", F.when(F.col("seq_len") % 2 == 0, F.col("match_targets")).otherwise(F.slice("match_targets", 1, 0)))
    z = A.zip_positions(w, "phones", "scores")
    return z.select("utterance_id", F.col("pos").cast("long").alias("pos"), F.col("pair.phones").alias("canonical"), r6(F.col("pair.scores")).alias("target"))


@query("jn_09_sequence_identity", f"WITH {V.PHONES_SQL}, a AS (SELECT utterance_id, list(phoneme ORDER BY index) AS p, list(phoneme ORDER BY phoneme, index) AS s FROM phones GROUP BY 1) SELECT utterance_id, p = s AS same FROM a")
def jn_09(spark, sf):
    return V.words(spark, sf).select("utterance_id", (F.col("phones") == F.array_sort("phones")).alias("same"))


def score_words(spark, sf):
    """A score record per word, as the JSON text that a corpus holds."""
    w = V.phones(spark, sf).groupBy("utterance_id").agg(F.array_sort(F.collect_list(F.struct("index", "phoneme", "human_score", "omission"))).alias("r"))
    k = F.col("utterance_id")
    names = F.transform("r", lambda x: x["phoneme"])
    given = F.when(k % 2 == 0, F.concat(F.lit('"'), F.array_join(names, " "), F.lit('"'))).otherwise(F.concat(F.lit('["'), F.array_join(names, '","'), F.lit('"]')))
    field = F.when(k % 7 == 0, "ref-phones").otherwise("phones")
    scores = F.when(k % 11 == 0, "").otherwise(F.concat(F.lit(',"phones-accuracy":['), F.array_join(F.transform("r", lambda x: x["human_score"].cast("string")), ","), F.lit("]")))
    entry = lambda x: F.concat(F.lit('{"canonical-phone":"'), x["phoneme"], F.lit('"'), F.when(x["index"] % 5 == 4, "").otherwise(F.concat(F.lit(',"index":'), x["index"].cast("string"))), F.lit(',"pronounced-phone":"'), F.when(x["index"] % 3 == 0, "<unk>").otherwise("AH"), F.lit('"}'))
    wrong = F.array_join(F.transform(F.filter("r", lambda x: x["omission"]), entry), ",")
    return w.select("utterance_id", F.concat(F.lit('{"'), field, F.lit('":'), given, scores, F.lit(',"mispronunciations":['), wrong, F.lit("]}")).alias("json")).select("utterance_id", F.from_json("json", J.WORD_SCHEMA).alias("w"))


@query("fn_15_canonical_phones", f"WITH {V.PHONES_SQL} SELECT utterance_id, string_agg(phoneme, ' ' ORDER BY index) AS phones FROM phones GROUP BY 1")
def fn_15(spark, sf):
    return score_words(spark, sf).select("utterance_id", F.array_join(J.canonical_phones(F.col("w")), " ").alias("phones"))


@query("fn_16_phone_scores", f"WITH {V.PHONES_SQL} SELECT utterance_id, CASE WHEN utterance_id % 11 = 0 THEN 'missing_phone_scores' END AS reason, CASE WHEN utterance_id % 11 <> 0 THEN round(sum(human_score * (index + 1)), 6) END AS total FROM phones GROUP BY 1")
def fn_16(spark, sf):
    w = score_words(spark, sf)
    total = F.aggregate(F.transform(J.phone_scores(F.col("w")), lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return w.select("utterance_id", J.word_reason(F.col("w")).alias("reason"), r6(total).alias("total"))


@query("fn_17_mispronunciations", f"WITH {V.PHONES_SQL} SELECT utterance_id, count(*) FILTER (omission AND index % 5 <> 4) AS n, coalesce(string_agg(index || ':' || CASE WHEN index % 3 = 0 THEN '<unk>' ELSE 'AH' END, ' ' ORDER BY index) FILTER (omission AND index % 5 <> 4), '') AS entries FROM phones GROUP BY 1")
def fn_17(spark, sf):
    m = J.mispronounced(F.col("w"))
    entries = F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]))
    return score_words(spark, sf).select("utterance_id", F.size(F.map_keys(m)).cast("long").alias("n"), F.array_join(entries, " ").alias("entries"))


@query("jn_10_label_mispronunciation", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, phoneme, CASE WHEN omission AND index % 5 <> 4 THEN CASE WHEN index % 3 = 0 THEN '<unk>' ELSE 'AH' END END AS pronounced, omission AND index % 5 <> 4 AND index % 3 = 0 AS omitted FROM phones")
def jn_10(spark, sf):
    w = score_words(spark, sf).withColumn("m", J.mispronounced(F.col("w")))
    p = w.select("utterance_id", "m", F.posexplode(J.canonical_phones(F.col("w"))).alias("index", "phoneme"))
    said = F.try_element_at("m", F.col("index"))
    return p.select("utterance_id", idx(), "phoneme", said.alias("pronounced"), X.is_omission(said).alias("omitted"))


EV_WORD_SQL = ", lexw AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS i FROM (SELECT DISTINCT regexp_replace(lower(trim(t)), '[^a-z'']+', '', 'g') AS word FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS t FROM benchmark)) WHERE word <> '' ORDER BY word LIMIT 10)"


def requests(spark, sf):
    """Recordings that ask for a word: ten known ones and two unknown, with spaces and capitals."""
    known = lexicon(spark, sf).orderBy("word").limit(10)
    slots = known.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("word")).alias("i"), "word")  # ten rows
    e = V.events(spark, sf).withColumn("slot", F.col("speaker_id") % 12)
    asked = e.join(F.broadcast(slots.select((F.col("i") - 1).alias("slot"), F.col("word").alias("w"))), "slot", "left")
    return asked.withColumn("asked", F.concat(F.lit(" "), F.initcap(F.coalesce("w", F.concat(F.lit("zz"), F.col("slot").cast("string"))))))


@query("jn_11_requested_words", f"WITH {V.EVENTS_SQL}{EV_WORD_SQL} SELECT recording_id, coalesce(word, 'zz' || (speaker_id % 12)) AS word, CASE WHEN word IS NULL THEN 'unknown_word' END AS reason FROM events_v LEFT JOIN lexw ON i = speaker_id % 12")
def jn_11(spark, sf):
    r = requests(spark, sf).withColumn("word", F.lower(F.trim("asked")))
    return r.join(lexicon(spark, sf), "word", "left").select("recording_id", "word", F.when(F.col("lexicon_phones").isNull(), "unknown_word").alias("reason"))


@query("jn_12_reference_audio", f"WITH {V.EVENTS_SQL}{EV_WORD_SQL} SELECT recording_id, CASE WHEN i % 3 <> 0 THEN 'audio/' || word || '.wav' END AS asset_path FROM events_v JOIN lexw ON i = speaker_id % 12")
def jn_12(spark, sf):
    r = requests(spark, sf).where(F.col("w").isNotNull())
    assets = r.where(F.col("slot") % 3 != 0).select("w").distinct().select("w", F.concat(F.lit("audio/"), F.col("w"), F.lit(".wav")).alias("asset_path"))
    return r.join(assets, "w", "left").select("recording_id", "asset_path")


@query("jn_13_frames_in_spans", f"WITH {V.SPANS_SQL} SELECT s.utterance_id, s.index, f.frame, f.vec_id FROM spans s JOIN frames f ON f.utterance_id = s.utterance_id AND f.frame >= s.start AND f.frame < s.\"end\"")
def jn_13(spark, sf):
    return pooling.frames_in_spans(V.frames(spark, sf), V.spans(spark, sf)).select("utterance_id", "index", "frame", "vec_id")


@query("jn_14_audio_path", f"WITH {V.DOCS_SQL} SELECT utterance_id, CASE doc_id % 4 WHEN 0 THEN audio_path WHEN 1 THEN audio_path WHEN 2 THEN '/abs/' || utterance_id || '.wav' END AS resolved FROM docs")
def jn_14(spark, sf):
    d = V.doc_paths(spark, sf)
    k = F.col("doc_id") % 4
    asked = d.withColumn("path", F.when(k == 0, F.col("audio_path")).when(k == 1, X.relative_path(F.col("audio_path"), "raw")).when(k == 2, F.concat(F.lit("/abs/"), F.col("utterance_id"), F.lit(".wav"))).otherwise("gone.wav"))
    return corpora.resolve_audio(asked, d.select(F.col("audio_path").alias("listed")), "path").select("utterance_id", "resolved")


@query("jn_15_reconcile", f"WITH {V.PHONES_SQL} SELECT count(*) FILTER (NOT omission) AS feature_rows, count(DISTINCT utterance_id) FILTER (NOT omission) AS feature_words, count(*) AS aligned_rows, count(DISTINCT utterance_id) AS aligned_words, count(*) FILTER (NOT omission) - count(*) AS row_delta, count(DISTINCT utterance_id) FILTER (NOT omission) - count(DISTINCT utterance_id) AS word_delta, count(*) FILTER (omission) = 0 AS matches FROM phones")
def jn_15(spark, sf):
    return verify.reconcile(V.phones(spark, sf).where(~F.col("omission")), V.words(spark, sf))


@query("jn_15_row_differences", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, false AS in_features, true AS in_aligned FROM phones WHERE omission")
def jn_15_rows(spark, sf):
    p = V.phones(spark, sf).select("utterance_id", idx(), "omission")
    return verify.row_differences(p.where(~F.col("omission")), p, ["utterance_id", "index"])


@query("flt_01_silence_words", f"WITH {IV_SQL}, w AS (SELECT label, regexp_replace(lower(trim(label)), '[^a-z'']+', '', 'g') AS t FROM wi) SELECT count(*) FILTER (t IN ('', 'sp', 'sil', 'spn', '<eps>')) AS scored, count(*) FILTER (regexp_replace(lower(trim(label)), '[0-9]', '', 'g') IN ('', 'sp', 'sil', 'spn', '<eps>')) AS native FROM w")
def flt_01(spark, sf):
    w, _ = intervals(spark, sf)
    return w.agg(F.count_if(A.is_silence_scored(F.col("label"))).alias("scored"), F.count_if(A.is_silence_native(F.col("label"))).alias("native"))


@query("flt_02_silence_phones", f"WITH {V.PHONES_SQL}, q AS (SELECT CASE index % 4 WHEN 0 THEN 'SIL' WHEN 1 THEN '<eps>' WHEN 2 THEN 'sp1' ELSE phoneme || '0' END AS label FROM phones) SELECT label, regexp_replace(lower(trim(label)), '[0-9]', '', 'g') IN ('', 'sp', 'sil', 'spn', '<eps>') AS native, regexp_replace(lower(trim(label)), '[^a-z'']+', '', 'g') IN ('', 'sp', 'sil', 'spn', '<eps>') AS scored, count(*) AS n FROM q GROUP BY ALL")
def flt_02(spark, sf):
    i = F.col("index") % 4
    p = V.phones(spark, sf).select(F.when(i == 0, "SIL").when(i == 1, "<eps>").when(i == 2, "sp1").otherwise(F.concat("phoneme", F.lit("0"))).alias("label"))
    return p.groupBy("label", A.is_silence_native(F.col("label")).alias("native"), A.is_silence_scored(F.col("label")).alias("scored")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_03_short_words", f"WITH {IV_SQL} SELECT doc_id AS utterance_id, count(*) FILTER (len * 50 >= 80) AS kept FROM wi GROUP BY 1")
def flt_03(spark, sf):
    w, _ = intervals(spark, sf)
    a, b = X.seconds_to_ms(F.col("xmin"), F.col("xmax"))
    return w.groupBy("utterance_id").agg(F.count_if(b - a >= 80).alias("kept"))


@query("flt_04_transcripts", f"WITH {V.DOCS_SQL} SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'missing_transcript' WHEN doc_id % 6 = 2 THEN 'empty_transcript' END AS reason FROM docs")
def flt_04(spark, sf):
    t = F.when(F.col("doc_id") % 6 == 1, None).when(F.col("doc_id") % 6 == 2, F.lit(" \n")).otherwise(F.concat(F.lit("a"), F.col("text")))
    d = V.doc_paths(spark, sf).withColumn("t", t)
    return d.select("doc_id", L.first_reason({"missing_transcript": F.col("t").isNull(), "empty_transcript": X.collapse_space(F.col("t")) == ""}).alias("reason"))


@query("flt_05_reason_cascade", f"""WITH {IV_SQL}, w AS (SELECT doc_id, pos, regexp_replace(lower(trim(label)), '[^a-z'']+', '', 'g') AS word, token, len FROM wi),
x AS (SELECT w.*, lex.spelled, CASE WHEN token = '' THEN '' ELSE upper(token) END AS said FROM w LEFT JOIN lex ON lex.word = w.word),
r AS (SELECT CASE WHEN word IN ('', 'sp', 'sil', 'spn', '<eps>') THEN 'skip_word_label' WHEN spelled IS NULL THEN 'missing_cmudict' WHEN len * 50 < 80 THEN 'too_short' WHEN length(regexp_replace(said, '[0-9]', 'x', 'g')) <> length(spelled) THEN 'phone_count_mismatch' WHEN said <> spelled THEN 'phone_identity_mismatch' ELSE 'ok' END AS reason FROM x)
SELECT reason, count(*) AS n FROM r GROUP BY 1""")
def flt_05(spark, sf):
    return A.aligned_native(interval_arrays(spark, sf), lexicon(spark, sf)).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_06_partition_consistency", f"WITH {V.PHONES_SQL} SELECT split, count(*) FILTER (line % 5 = 0 AND split <> 'test') AS mismatched, count(*) AS n FROM phones GROUP BY 1")
def flt_06(spark, sf):
    p = V.phones(spark, sf).withColumn("partition_split", F.when(F.col("line") % 5 == 0, "test").otherwise(F.col("split")))
    reason = L.first_reason({"split_mismatch": F.col("split") != F.col("partition_split")})
    return p.groupBy("split").agg(F.count_if(reason.isNotNull()).alias("mismatched"), F.count(F.lit(1)).alias("n"))


@query("flt_07_masked_selection", f"WITH {V.PHONES_SQL}, t AS (SELECT utterance_id, {V.TARGET_SQL} AS target, omission FROM phones) SELECT utterance_id, round(coalesce(sum(target) FILTER (NOT omission), 0), 6) AS total FROM t GROUP BY 1")
def flt_07(spark, sf):
    mask = F.transform("presence_targets", lambda x: x == 1)
    kept = O.masked(F.col("match_targets"), F.col("mask"))
    return V.words(spark, sf).withColumn("mask", mask).select("utterance_id", r6(F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("src_11_tier_choice", f"WITH {V.DOCS_SQL} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'words' WHEN 1 THEN 'word' WHEN 2 THEN 'WORDS' END AS tier, CASE WHEN doc_id % 4 = 3 THEN 'missing_tier' END AS reason FROM docs")
def src_11(spark, sf):
    k = F.col("doc_id") % 4
    names = F.when(k == 0, F.array(F.lit("word"), F.lit("words"))).when(k == 1, F.array(F.lit("Words"), F.lit("word"))).when(k == 2, F.array(F.lit("phones"), F.lit("WORDS"))).otherwise(F.array(F.lit("phones")))
    t = V.doc_paths(spark, sf).select("doc_id", F.explode(names).alias("tier"))
    return A.pick_tier(t, "doc_id", "tier", "words", ("word",))
