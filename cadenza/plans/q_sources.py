"""Queries of sources, sinks, Python workers, the scorer and streams."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import text as X
from cadenza.operators import encoder as E
from cadenza.operators import ledger
from cadenza.operators.words import ranked
from cadenza.plans import views as V
from cadenza.plans.q_joins import DOC_ROWS, IV_SQL, said
from cadenza.plans.registry import query
from cadenza.plans.views import r6
from cadenza.session import scratch, spread, table
from cadenza.sources import corpora, files, sinks
from cadenza.streaming import recordings, runs

PHONE_ROWS = "utterance_id long, index int, speaker_id long, split string, phoneme string, duration_ms int, start_ms int, end_ms int, human_score double, omission boolean, flag string, variance double, energy double, frames int, source string, line int"


@query("src_01_prepared_manifest", f"WITH {V.DOCS_SQL} SELECT utterance_id, speaker_id, audio_path FROM docs")
def src_01(spark, sf):
    path = scratch(spark, "manifest")
    row = F.to_json(F.struct("utterance_id", "speaker_id", "audio_path"))
    d = V.doc_paths(spark, sf).select(F.explode(F.array(row, F.lit(""), F.concat(F.lit("{"), row))).alias("value"))  # each row, a blank line, a broken line
    d.write.text(path)
    m = corpora.manifests(spark, path)
    return m.where(F.col("_bad").isNull()).select("utterance_id", "speaker_id", "audio_path")


@query("src_02_aligned_rows", f"WITH {V.PHONES_SQL} SELECT split, count(DISTINCT utterance_id) AS words, count(*) AS phones FROM phones GROUP BY 1")
def src_02(spark, sf):
    path = scratch(spark, "aligned")
    V.words(spark, sf).select("utterance_id", "split", "phones").write.json(path)
    a = corpora.manifests(spark, path, "utterance_id long, split string, phones array<string>")
    return a.groupBy("split").agg(F.count(F.lit(1)).alias("words"), F.sum(F.size("phones")).alias("phones"))


@query("src_03_feature_shards", f"WITH {V.PHONES_SQL} SELECT utterance_id, index, phoneme, round(human_score, 6) AS human_score FROM phones")
def src_03(spark, sf):
    path = scratch(spark, "shards")
    sinks.write_shards(V.phones(spark, sf), path, 20_000)
    s = corpora.feature_shards(spark, path, PHONE_ROWS)
    return s.select("utterance_id", F.col("index").cast("long").alias("index"), "phoneme", r6(F.col("human_score")).alias("human_score"))


@query("src_04_corpus_listing", f"WITH {V.DOCS_SQL} SELECT DISTINCT subset || '/' || speaker_id AS folder FROM docs")
def src_04(spark, sf):
    path = scratch(spark, "corpus")
    d = V.doc_paths(spark, sf).select("subset", "speaker_id", "utterance_id")
    d.repartition("subset", "speaker_id").write.partitionBy("subset", "speaker_id").text(f"{path}/raw")
    d.select("utterance_id").limit(1).write.text(f"{path}/aligned")  # derived files, which a listing leaves out
    found = corpora.audio_listing(spark, path, ("txt",))
    return found.select(F.regexp_replace(F.regexp_extract("path", r"subset=(.+)/[^/]*$", 1), "speaker_id=", "").alias("folder")).distinct()


def score_texts(words, most=1000):
    """(speaker_id, value): JSON objects of at most ``most`` of a speaker's words each, so no text grows with a speaker."""
    entry = F.concat(F.lit('"'), F.col("utterance_id").cast("string"), F.lit('":{"text":"x","words":[{"text":"x","phones":"'), F.array_join("phones", " "), F.lit('"}]}'))
    w = ranked(words.select("speaker_id", "utterance_id", entry.alias("j")), "speaker_id", "utterance_id")
    g = w.groupBy("speaker_id", F.floor(F.col("rn") / most).alias("part"))
    return g.agg(F.concat(F.lit("{"), F.array_join(F.collect_list("j"), ","), F.lit("}")).alias("value")).drop("part")


@query("src_06_score_entries", f"WITH {V.PHONES_SQL} SELECT CAST(utterance_id AS VARCHAR) AS utterance_id, string_agg(phoneme, ' ' ORDER BY index) AS phones FROM phones GROUP BY 1")
def src_06(spark, sf):
    path = scratch(spark, "scores")
    score_texts(V.words(spark, sf)).select("value").write.text(path)
    e = corpora.score_entries(spark.read.text(path))
    return e.select("utterance_id", F.get(F.col("entry.words"), F.lit(0))["phones"].alias("phones"))


@query("src_07_mapping_last_wins", "SELECT source AS key, 'utt-' || max(doc_id) || ' x' AS value FROM documents GROUP BY 1")
def src_07(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.lit("utt2spk").alias("path"), F.col("doc_id").alias("line"), F.concat_ws("\t ", "source", F.concat(F.lit("utt-"), F.col("doc_id").cast("string"), F.lit(" x"))).alias("value"))
    return corpora.mapping(rows.union(rows.select("path", "line", F.lit("  "))))


@query("src_08_audio_list", f"WITH {V.DOCS_SQL} SELECT utterance_id AS key, CASE WHEN doc_id % 2 = 0 THEN substr(audio_path, 5) ELSE '/else/' || utterance_id END AS audio_path FROM docs")
def src_08(spark, sf):
    d = V.doc_paths(spark, sf)
    given = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("audio_path", "^raw/", "")).otherwise(F.concat(F.lit("/else/"), F.col("utterance_id")))
    rows = d.select(F.lit("wav.scp").alias("path"), F.col("doc_id").alias("line"), F.concat_ws(" ", "utterance_id", given).alias("value"))
    return corpora.audio_paths(corpora.mapping(rows), "/data/raw", "/data/raw")


@query("src_09_dictionary", "SELECT lower('W' || item_id) AS word, 'AA B' || (item_id % 3 + 10) AS phones FROM benchmark")
def src_09(spark, sf):
    b = table(spark, sf, "benchmark")
    word = F.concat(F.lit("W"), F.col("item_id").cast("string"))
    first = F.concat(word, F.lit("  AA1 B"), (F.col("item_id") % 3).cast("string"))
    lines = F.array(F.lit(";;; comment"), first, F.concat(word, F.lit("(2)  ZH")), word)
    path = scratch(spark, "dictionary")
    b.select(F.explode(lines).alias("value")).write.option("encoding", "ISO-8859-1").text(path)
    d = corpora.pronouncing_dictionary(corpora.lines(spark, f"{path}/part-*", "ISO-8859-1"))
    # stress digits go from every phone; they are put back from the word for the comparison
    return d.select("word", F.concat(F.array_join("phones", " "), (F.regexp_extract("word", r"(\d+)", 1).cast("long") % 3 + 10).cast("string")).alias("phones"))


def word_grids(spark, sf):
    """(path, text): each document's words as an alignment file, made where the document is."""
    head = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\nitem []:\n    item [1]:\n        class = "IntervalTier"\n        name = "words"\n'

    def run(batches):
        for b in batches:
            for path, text in zip(b.column(0), b.column(1)):
                label, bounds = said(text.as_py())[1:]
                at = (bounds * 0.05).tolist()
                entries = [f'        intervals [{i}]:\n            xmin = {x!r}\n            xmax = {y!r}\n            text = "{t}"\n' for i, (x, y, t) in enumerate(zip(at, at[1:], [x.replace('"', "") for x in label]), 1)]
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([head + "".join(entries)])], names=["path", "text"])

    d = table(spark, sf, "documents").where(F.col("text").isNotNull()).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text")
    return spread(d, DOC_ROWS, "path").mapInArrow(run, "path string, text string")


@query("src_10_alignment_files", f"WITH {IV_SQL} SELECT 'f' || doc_id AS path, CAST(pos AS INT) AS pos, round(xmin, 6) AS xmin, replace(label, '\"', '') AS text FROM (SELECT *, (stop - len) * 0.05::DOUBLE AS xmin FROM wi)")
def src_10(spark, sf):
    return files.alignment_intervals(word_grids(spark, sf)).select("path", "pos", F.round("xmin", 6).alias("xmin"), "text")


@query("src_12_curated_lexicon", "SELECT 'w' || p_partkey AS word, p_name AS ipa, CAST(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS syllables FROM part")
def src_12(spark, sf):
    p = table(spark, sf, "part")
    syllables = F.when(F.col("p_partkey") % 2 == 0, ',"syllables":[["K"]]').otherwise("")
    j = p.select(F.concat(F.lit('{"W'), F.col("p_partkey").cast("string"), F.lit('":{"phones":["K"],"ipa":"'), "p_name", F.lit('"'), syllables, F.lit("}}")).alias("value"))
    return corpora.curated_lexicon(j).select("word", "ipa", F.size("syllables").alias("syllables"))


@query("src_13_reference_audio", "SELECT 'ref-' || c_custkey AS audio_id, c_name AS word, 'audio/' || c_mktsegment AS asset_path FROM customer")
def src_13(spark, sf):
    c = table(spark, sf, "customer")
    j = c.select(F.concat(F.lit('{"ref-'), F.col("c_custkey").cast("string"), F.lit('":{"word":"'), "c_name", F.lit('","accent_target":"en-US","asset_path":"audio/'), "c_mktsegment", F.lit('"}}')).alias("value"))
    return corpora.reference_audio(j).select("audio_id", "word", "asset_path")


WORD_SUMS_SQL = "SELECT utterance_id, round(sum(variance + energy), 6) AS total, CAST(count(*) AS INT) AS seq_len FROM phones GROUP BY 1"


def word_sums(df):
    return df.select("utterance_id", r6(F.aggregate("acoustic_flat", F.lit(0.0), lambda s, x: s + x)).alias("total"), "seq_len")


@query("src_14_dense_words", f"WITH {V.PHONES_SQL} {WORD_SUMS_SQL}")
def src_14(spark, sf):
    path = scratch(spark, "dense")
    manifest = sinks.write_dense_words(V.phones(spark, sf), path)
    return word_sums(corpora.dense_words(spark, path, ["utterance_id", "acoustic_flat", "seq_len"], manifest["num_utterances"], manifest["acoustic_dim"]))


@query("src_15_feature_source", f"""
WITH {V.PHONES_SQL}, s AS ({WORD_SUMS_SQL})
SELECT 'shards' AS source, * FROM s UNION ALL SELECT 'dense' AS source, * FROM s
""")
def src_15(spark, sf):
    shards, both = scratch(spark, "features"), scratch(spark, "features")
    sinks.write_shards(V.phones(spark, sf), f"{shards}/shards", 20_000)
    # where there is a dense table it is preferred to the shards beside it
    sinks.write_dense_words(V.phones(spark, sf), f"{both}/dense")
    sinks.write_shards(V.phones(spark, sf).limit(1), f"{both}/shards", 20_000)
    read = lambda path, kind: word_sums(corpora.read_features(spark, path, PHONE_ROWS)).withColumn("source", F.lit(kind))
    return read(shards, "shards").unionByName(read(both, "dense"))


def wav_files(spark, sf):
    """Every vector as a WAV file's bytes."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["vec_id"].astype(str), "content": [files.encode_wav(v, 64) for v in b["vector"]]})

    return V.frames(spark, sf).select("vec_id", "vector").mapInPandas(run, "path string, content binary")


@query("src_16_audio_files", f"WITH {V.FRAMES_SQL} SELECT vec_id, 64 AS n, round(list_sum(list_transform(vector, lambda x: CAST(round_even(least(1, greatest(-1, x)) * 32767, 0) AS BIGINT))) / 32768, 4) AS total FROM frames")
def src_16(spark, sf):
    a = files.decode_audio(wav_files(spark, sf)).where(F.col("error").isNull())
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    return a.select(F.col("path").cast("long").alias("vec_id"), F.size("samples").alias("n"), (F.round(total, 4) + 0.0).alias("total"))


@query("snk_01_manifest_write", f"WITH {V.DOCS_SQL} SELECT CASE subset WHEN 'test-clean' THEN 'test' WHEN 'dev-clean' THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM docs GROUP BY 1")
def snk_01(spark, sf):
    path = scratch(spark, "manifest")
    sinks.write_manifest(V.doc_paths(spark, sf).select(X.split_of_path(F.col("audio_path")).alias("split"), "utterance_id"), path)
    return spark.read.json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("snk_02_whole_words", f"WITH {V.PHONES_SQL} SELECT count(DISTINCT utterance_id) AS words, 0 AS split_words FROM phones")
def snk_02(spark, sf):
    path = scratch(spark, "shards")
    sinks.write_shards(V.phones(spark, sf), path, 10_000)
    w = corpora.by_word(corpora.feature_shards(spark, path, PHONE_ROWS)).groupBy("utterance_id").agg(F.count_distinct("shard").alias("s"))
    return w.agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("s") > 1).cast("int").alias("split_words"))


@query("snk_03_dense_table", f"WITH {V.PHONES_SQL} SELECT split, count(DISTINCT utterance_id) AS words, count(*) AS rows FROM phones GROUP BY 1")
def snk_03(spark, sf):
    path = scratch(spark, "dense")
    sinks.write_dense_words(V.phones(spark, sf), path, compression="zstd")
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("words"), F.sum("seq_len").alias("rows"))


@query("snk_04_report", f"WITH {V.PHONES_SQL} SELECT split, count(*) AS n FROM phones GROUP BY 1")
def snk_04(spark, sf):
    path = scratch(spark, "report")
    sinks.write_report(V.phones(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("split string, n long").json(path)


@query("snk_05_transcripts", f"WITH {V.DOCS_SQL} SELECT regexp_replace(audio_path, '\\.wav$', '.lab') AS rel_path, md5(trim(regexp_replace(text, '[ \\t\\n\\r\\x0b\\x0c]+', ' ', 'g'))) AS text_md5 FROM docs")
def snk_05(spark, sf):
    path = scratch(spark, "transcripts")
    sinks.write_transcripts(sinks.transcript_rows(V.doc_paths(spark, sf)), path)
    return spark.read.parquet(path).select("rel_path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("snk_06_run_ledger", f"WITH {V.EVENTS_SQL} SELECT feature_key, arg_max(audio_path, recording_id) AS status, max(recording_id) AS seq FROM events_v GROUP BY 1")
def snk_06(spark, sf):
    path = scratch(spark, "ledger")
    e = V.events(spark, sf).select("feature_key", F.col("audio_path").alias("status"), F.col("recording_id").alias("seq"))
    sinks.append_ledger(e, path)
    return ledger.current_state(spark.read.parquet(path))


@query("udf_01_encoder", f"""
WITH {V.FRAMES_SQL}, m AS (SELECT vec_id, 8 + vec_id % 57 AS n, vector FROM frames), f AS (SELECT *, n // 8 AS k FROM m)
SELECT vec_id, CAST(k AS INT) AS n_frames, 125.0::DOUBLE AS frame_ms, CAST(k AS INT) AS width,
  round(list_sum(list_transform(range(0, k), lambda i: sqrt(list_sum(list_transform(vector[8 * i + 1:8 * i + 8], lambda x: x * x)) / 8))), 6) AS energy,
  round(list_sum(list_transform(range(0, k), lambda i: ln(1 + abs(list_sum(vector[8 * i + 1:8 * i + 8]))))), 3) AS total
FROM f
""")
def udf_01(spark, sf):
    s = V.frames(spark, sf).select("vec_id", F.slice("vector", F.lit(1), (F.col("vec_id") % 57 + 8).cast("int")).alias("samples"))
    # one number a frame: the log magnitude of frequency 0, the frame's sum
    out = E.encode_signals(s, "samples", E.spectral_encoder(1, 8), 8, 1, 64)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x)
    return out.select("vec_id", "n_frames", "frame_ms", F.size("encoded").alias("width"), r6(add("frame_energy")).alias("energy"), F.round(add("encoded"), 3).alias("total"))


@query("udf_02_alignment_parser", f"WITH {IV_SQL} SELECT count(*) AS intervals, count(DISTINCT doc_id) AS files FROM wi")
def udf_02(spark, sf):
    return src_10(spark, sf).agg(F.count(F.lit(1)).alias("intervals"), F.count_distinct("path").alias("files"))


@query("udf_03_wav_decoder", "SELECT count(*) AS good, count(*) AS bad FROM embeddings")
def udf_03(spark, sf):
    w = wav_files(spark, sf)
    cut = w.select("path", F.expr("substring(content, 1, 20)").alias("content"))
    d = files.decode_audio(w.union(cut))
    return d.agg(F.count_if(F.col("error").isNull()).alias("good"), F.count_if(F.col("error").isNotNull()).alias("bad"))


@query("ml_01_phone_scorer")
def ml_01(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (F.col("label") % 3).alias("class_index"))
    e = e.where(F.col("class_index").isNotNull()).withColumn("speaker", F.floor(F.col("vec_id") / 25))
    out = E.held_out_scores(e, "speaker")
    return out.select("vec_id", "fold", "class_index", F.col("prediction").cast("int").alias("predicted"), F.round("expected_score", 4).alias("expected_score"))


@query("st_01_assess_stream")
def st_01(spark, sf):
    from cadenza.plans.q_jobs import assessed

    path = scratch(spark, "stream")
    stream = recordings.stream_table(spark, f"{sf}/events.parquet").select("event_id", "user_id")  # a batch is kept until both tables are written
    recordings.assess_stream(stream, lambda batch: assessed(spark, sf, batch), f"{path}/out", f"{path}/state").awaitTermination()
    good = spark.read.parquet(f"{path}/out/assessments").withColumn("reason", F.lit(None).cast("string"))
    return good.unionByName(spark.read.parquet(f"{path}/out/rejects"), allowMissingColumns=True).drop("batch")


@query("st_02_progress_counts", "SELECT event_type AS split, count(*) AS processed FROM events GROUP BY 1")
def st_02(spark, sf):
    path = scratch(spark, "stream")
    s = recordings.stream_table(spark, f"{sf}/events.parquet").withColumnRenamed("event_type", "split")
    recordings.progress_counts(s, "split", f"{path}/out", f"{path}/state").awaitTermination()
    return ledger.current_state(spark.read.parquet(f"{path}/out"), "split").select("split", "processed")


RUN_STATES_SQL = f"""WITH {V.EVENTS_SQL}, e AS (SELECT feature_key, recording_id AS seq, CASE audio_path WHEN 'view' THEN 'planned' WHEN 'click' THEN 'running' ELSE 'complete' END AS s, recording_id % 2 AS part, recording_id % 100 AS n FROM events_v),
l AS (SELECT feature_key, list(struct_pack(s := s, ok := 0, odd := 0, a := CASE WHEN part = 0 THEN n END, b := CASE WHEN part = 1 THEN n END) ORDER BY seq) AS x FROM e GROUP BY 1),
r AS (SELECT feature_key, list_reduce(list_prepend(struct_pack(s := '', ok := 0, odd := 0, a := 0::BIGINT, b := 0::BIGINT), x), lambda y, z:
  CASE WHEN (y.s = '' AND z.s = 'planned') OR (y.s = 'planned' AND z.s = 'running') OR (y.s = 'running' AND z.s IN ('running', 'complete')) OR (y.s = 'complete' AND z.s = 'running')
  THEN struct_pack(s := z.s, ok := y.ok + 1, odd := y.odd, a := coalesce(z.a, y.a), b := coalesce(z.b, y.b)) ELSE struct_pack(s := y.s, ok := y.ok, odd := y.odd + 1, a := y.a, b := y.b) END) AS f FROM l)
SELECT feature_key, CASE WHEN f.s = '' THEN NULL ELSE f.s END AS status, CASE WHEN f.s <> '' THEN f.a + f.b END AS rows, CAST(f.ok AS BIGINT) AS legal, CAST(f.odd AS BIGINT) AS illegal FROM r"""


@query("snk_06_run_states", RUN_STATES_SQL)
def snk_06_run_states(spark, sf):
    path = scratch(spark, "stream")
    e = recordings.stream_table(spark, f"{sf}/events.parquet")
    status = F.when(F.col("event_type") == "view", "planned").when(F.col("event_type") == "click", "running").otherwise("complete")
    n = (F.col("event_id") % 100).cast("long")
    moves = e.select(F.get_json_object("props", "$.k").alias("feature_key"), F.col("event_id").cast("long").alias("seq"), status.alias("status"), (F.col("event_id") % 2).cast("string").alias("split"), n.alias("rows"), n.alias("words"), F.col("ts").cast("timestamp").alias("ts"))
    runs.run_states(moves, f"{path}/out", f"{path}/state", stalled="30 days").awaitTermination()
    out = spark.read.schema(runs.MADE).parquet(f"{path}/out").where(F.coalesce("reason", F.lit("")) != "stalled")
    legal = F.col("reason").isNull()
    last = lambda c: F.max_by(F.when(legal, F.col(c)), F.when(legal, F.col("seq"))).alias(c)
    return out.groupBy("feature_key").agg(last("status"), last("rows"), F.count_if(legal).alias("legal"), F.count_if(~legal).alias("illegal"))
