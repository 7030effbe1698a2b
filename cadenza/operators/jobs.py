"""The composite jobs: each is a chain of operators from tables to one table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import labels as L
from cadenza.functions import scorejson as J
from cadenza.functions import scores as S
from cadenza.functions import signal as G
from cadenza.functions import text as X
from cadenza.operators import assess, ledger, pooling, reports, sampling, signals, verify, words
from cadenza.session import few, scratch
from cadenza.sources import corpora, sinks


def prepare_read_speech(listing: DataFrame, transcripts: DataFrame, texts: DataFrame) -> DataFrame:
    """JOB-01: audio files with their best transcript: split, speaker, normalised text, and a reason where one is missing.

    ``listing`` (audio_path), ``transcripts`` (path), ``texts`` (audio_path, text).
    """
    d = listing.withColumn("stem", F.regexp_replace("audio_path", r"\.[^./]+$", "")).join(corpora.best_transcripts(transcripts), "stem", "left").join(texts, "audio_path", "left")
    d = d.select("audio_path", X.file_stem(F.col("audio_path")).alias("utterance_id"), X.speaker_of_path(F.col("audio_path")).alias("speaker_id"), X.split_of_path(F.col("audio_path")).alias("split"), "transcript_path", X.collapse_space(F.col("text")).alias("normalized_text"))
    return d.withColumn("reason", L.first_reason({"missing_transcript": F.col("transcript_path").isNull(), "empty_transcript": F.coalesce("normalized_text", F.lit("")) == ""}))


def write_prepared(rows: DataFrame, path: str, schema: str = corpora.PREPARED, disjoint: bool = False) -> DataFrame:
    """JOB-01, JOB-02: what was kept (``reason`` null) to manifests by split in the order of speaker and utterance below
    ``path``, and the counts of each split and reason to ``path``-summary. Returns the manifests as they read back.

    An existing manifest is an error, and with ``disjoint`` a speaker of both train and val.
    """
    staged = scratch(rows.sparkSession, "prepared-rows")  # evaluated once
    rows.write.parquet(staged)
    rows = rows.sparkSession.read.parquet(staged)
    kept = rows.where(F.col("reason").isNull())
    if disjoint and verify.leaked_speakers(kept.where(F.col("split").isin("train", "val"))).limit(1).count():
        raise ValueError("a speaker is in both train and val")
    order = ["split", "speaker_id", "utterance_id"]
    # ranges, so that a speaker of very many rows spreads over tasks
    sinks.write_manifest(kept.drop("reason").repartitionByRange(*order).sortWithinPartitions(*order), path)
    counts = rows.groupBy("split", "reason").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("speaker_id").alias("speakers"))
    sinks.write_report(counts, f"{path}-summary")
    return corpora.manifests(rows.sparkSession, path, schema).drop("_bad")


def prepare_scored(utterances: DataFrame, fraction: float, seed: int) -> DataFrame:
    """JOB-02: official training utterances get a speaker-disjoint validation split; test stays as it is."""
    train = utterances.where(F.col("official") == "train")
    splits = sampling.speaker_splits(train, "speaker_id", fraction, seed).withColumnRenamed("split", "__s")
    d = utterances.join(splits, "speaker_id", "left")
    return d.withColumn("split", F.when(F.col("official") == "test", "test").otherwise(F.coalesce("__s", F.lit("train")))).drop("__s")


def scored_phone_labels(scored: DataFrame, word: str = "w") -> DataFrame:
    """JOB-05: score records to phone labels: class, target, pronounced phone and omission; unusable words keep one row with a reason."""
    w = F.col(word)
    d = scored.select("utterance_id", J.word_reason(w).alias("reason"), J.canonical_phones(w).alias("phones"), J.phone_scores(w).alias("s"), J.mispronounced(w).alias("m"))
    good = d.where(F.col("reason").isNull()).select("utterance_id", "m", F.posexplode(F.arrays_zip("phones", "s")).alias("index", "x"))
    said = F.try_element_at("m", F.col("index"))
    rows = good.select("utterance_id", "index", F.col("x.phones").alias("phoneme"), L.class_of_human_score(F.col("x.s")).alias("class"), L.regression_target(F.col("x.s")).alias("target"), said.alias("pronounced"), X.is_omission(said).alias("omission"), F.lit(None).cast("string").alias("reason"))
    bad = d.where(F.col("reason").isNotNull()).select("utterance_id", F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("phoneme"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("double").alias("target"), F.lit(None).cast("string").alias("pronounced"), F.lit(None).cast("boolean").alias("omission"), "reason")
    return rows.unionByName(bad)


def phone_features(frames: DataFrame, spans: DataFrame, phones: DataFrame, width: int) -> DataFrame:
    """JOB-06: pooled spans with the neighbours, targets and confidences of their phones (utterance_id, index)."""
    near = Window.partitionBy("utterance_id").orderBy("index")
    p = phones.select("*", F.lag("phoneme").over(near).alias("prev_phoneme"), F.lead("phoneme").over(near).alias("next_phoneme"), L.alignment_confidence(F.col("source")).alias("alignment_confidence"), L.regression_target(F.col("human_score")).alias("regression_target"))
    return pooling.pool_spans(frames, spans, width).join(p, ["utterance_id", "index"])


#: The key columns of report parts that have several rows.
REPORT_KEYS = {
    "confusion": ["true_class", "predicted_class"],
    "histogram": ["class", "label"],
    "interpretation": ["message"],
    **{k: ["class"] for k in ("target", "predicted", "class", "percentiles", "percentiles_duration", "percentiles_presence", "percentiles_omission")},
}


def _once(e: DataFrame) -> DataFrame:
    """A report's few columns, evaluated once for its sections: written to the shared folder, so nothing stays in memory and a lost executor takes none of it."""
    path = scratch(e.sparkSession, "report-rows")
    e.write.parquet(path)
    return e.sparkSession.read.schema(e.schema).parquet(path)


def evaluation_v1(df: DataFrame, match: Column, duration: Column, presence: Column, match_target: Column, duration_target: Column, present: Column) -> DataFrame:
    """JOB-09: the first report as (section, key, metric, value) rows."""
    e = df.select(match.alias("m"), duration.alias("d"), presence.alias("p"), match_target.alias("mt"), duration_target.alias("dt"), present.alias("pt"))
    e = e.withColumn("tc", L.class_of_target(F.col("mt"), "v1")).withColumn("pc", L.predicted_class(F.col("m"), F.col("p")))
    e = _once(e)
    parts = {
        "errors": reports.errors(e, {"match": (F.col("m"), F.col("mt")), "duration": (F.col("d"), F.col("dt"))}),
        "pearson": reports.pearson(e, F.col("m"), F.col("mt")),
        "presence": reports.presence_stats(e, F.col("p"), F.col("pt")),
        "confusion": reports.confusion(e, "tc", "pc"),
        "target": reports.class_rates(e, "tc"),
        "predicted": reports.class_rates(e, "pc"),
        "class": reports.class_stats(e, "tc", "pc", F.col("m"), F.col("mt"), F.col("p")),
        "percentiles": reports.percentiles(e, "tc", F.col("m")),
        "histogram": reports.histogram(e, "tc", F.col("m")),
        "percentiles_duration": reports.percentiles(e, "tc", F.col("d")),
        "percentiles_presence": reports.percentiles(e, "tc", F.col("p")),
        **reports.told(reports.diagnostics(e, "tc", "pc", F.col("m"), F.col("mt"), F.col("pt"))),
    }
    return reports.long_report(parts, REPORT_KEYS)


def evaluation_v2(df: DataFrame, class_pred: Column, class_target: Column, omission_prob: Column, expected: Column, score_target: Column, omitted: Column) -> DataFrame:
    """JOB-10: the second report: classes are predicted directly, omission is a probability of its own."""
    e = df.select(class_pred.alias("pc"), class_target.alias("tc"), omission_prob.alias("o"), expected.alias("s"), score_target.alias("t"), omitted.alias("om"))
    e = _once(e)
    parts = {
        "errors": reports.errors(e, {"score": (F.col("s"), F.col("t"))}),
        "pearson": reports.pearson(e, F.col("s"), F.col("t")),
        "accuracy": e.agg(F.avg(F.when(F.col("pc") == F.col("tc"), 1.0).otherwise(0.0)).alias("class")),
        "omission": reports.presence_stats(e, F.col("o"), F.col("om")),
        "confusion": reports.confusion(e, "tc", "pc"),
        "class": reports.class_stats(e, "tc", "pc", F.col("s"), F.col("t"), F.col("o")),
        "percentiles": reports.percentiles(e, "tc", F.col("s")),
        "histogram": reports.histogram(e, "tc", F.col("s")),
        "percentiles_omission": reports.percentiles(e, "tc", F.col("o")),
        "target": reports.class_rates(e, "tc"),
        "predicted": reports.class_rates(e, "pc"),
        **reports.told(reports.diagnostics(e, "tc", "pc", F.col("s"), F.col("t"), 1 - F.col("om"))),
    }
    return reports.long_report(parts, REPORT_KEYS)


def scored_phones(phones: DataFrame) -> DataFrame:
    """JOB-11: phone rows (z, energy, variance, late, alignment confidence) with their scores, confidence and status."""
    z, e, v = F.col("z"), F.col("energy"), F.col("variance")
    p = phones.select(
        "*", S.match_score(v, e).alias("match"), S.duration_score(z).alias("dur"), S.presence_score(z, e).alias("presence"),
        S.phone_confidence(F.col("alignment_confidence"), e, v).alias("confidence"),
    )
    return p.withColumn("status", S.phone_status(F.col("match"), F.col("dur"), F.col("presence"), z, F.col("late")))


def assess_words(recordings: DataFrame, phones: DataFrame, key: str) -> DataFrame:
    """JOB-11, its scoring half: phone rows (z, energy, variance, late, alignment confidence, quality) to one assessment per recording."""
    return assess.assessments(recordings, scored_phones(phones), key)


def assess_recordings(recordings: DataFrame, lexicon: DataFrame, assets: DataFrame, make_encoder: Callable, rate: int, frame: int, width: int) -> tuple[DataFrame, DataFrame]:
    """JOB-11, ST-01: recordings to (assessments, rejects).

    ``recordings`` (recording_id, asked, samples): asked words are trimmed and lower-cased and looked up in
    ``lexicon`` (word, lexicon_phones) and ``assets`` (word, asset_path; none: null). Rejected with a reason:
    ``unknown_word``, ``too_short``, ``too_long``, ``too_few_frames``. The signal is normalised to its peak,
    judged and encoded, whatever its length; frames are ``frame`` samples long and ``width`` wide, and are dealt to
    phones in proportion and pooled where they are made. Signals stay where they are: the vocabulary goes to them.
    """
    words = lexicon.join(assets, "word", "left")
    r = recordings.select("recording_id", F.lower(F.trim("asked")).alias("word"), "samples").join(few(words), "word", "left")
    r = r.withColumn("reason", F.coalesce(F.when(F.col("lexicon_phones").isNull(), "unknown_word"), G.length_reason(G.duration_ms(F.col("samples"), rate))))
    r = r.withColumn("reason", F.coalesce("reason", F.when(F.floor(F.size("samples") / frame) < F.size("lexicon_phones"), "too_few_frames")))
    good = r.where(F.col("reason").isNull()).select("recording_id", "word", "asset_path", "lexicon_phones", "samples")
    encoded = signals.pooled_signals(good, make_encoder, frame, width)
    same = ["recording_id", "word", "asset_path", "quality"]
    p = encoded.select(*same, "mean_energy", F.explode_outer("spans").alias("p")).select(*same, "mean_energy", "p.*")
    p = p.withColumns({"late": F.lit(False), "alignment_confidence": assess.span_confidence(F.col("energy"), F.col("mean_energy"))})
    out = assess.assessed(scored_phones(p), same)
    return out, r.where(F.col("reason").isNotNull()).select("recording_id", "word", "reason")


def verify_features(features: DataFrame, aligned: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """JOB-07: (profile of each split with its ``broken_rows``, one row of totals against the aligned words)."""
    broken = features.groupBy("split").agg(F.count_if(F.size(L.violated(rules)) > 0).alias("broken_rows"))
    return verify.profile(features).join(broken, "split"), verify.reconcile(features, aligned)


def plan_runs(specs: DataFrame, ledger_rows: DataFrame, present: DataFrame) -> DataFrame:
    """JOB-12: each planned feature run with its state and what it lacks: ``missing_state``, ``incomplete`` or ``missing_rows``."""
    state = ledger.current_state(ledger_rows)
    d = specs.join(state, "feature_key", "left").join(present.withColumn("__there", F.lit(True)), "feature_key", "left")
    return d.withColumn("reason", L.first_reason({"missing_state": F.col("status").isNull(), "incomplete": F.col("status") != "complete", "missing_rows": F.col("__there").isNull()})).drop("__there")


def epoch_plan(dense: DataFrame, split: str, order: str, batch: int, block_words: int, seed: int, epoch: int, mask_ratio: float, negatives: float = 0.0, multiplier: int = 8) -> DataFrame:
    """JOB-13: for every word its block and batch, its batch among words of like length, padded ids with their mask of
    real positions, ids, targets and presence after augmentation, and its masked positions.

    ``dense`` has ``phoneme_ids``, ``match_targets``, ``presence_targets``, ``acoustic_flat`` and ``seq_len``.
    """
    d = words.block_shuffle(dense, split, order, batch, block_words, seed, epoch).drop("rn")
    d = words.length_batches(d, split, order, batch, multiplier).withColumnRenamed("batch", "length_batch").drop("rn")
    if negatives:
        d = sampling.negative_words(d, negatives, seed + epoch, order)
    widest = F.max("seq_len").over(Window.partitionBy(split, "bucket", "length_batch"))  # a batch of words
    d = d.withColumn("width", widest).withColumn("padded_ids", words.pad(F.col("phoneme_ids"), F.col("width"), F.lit(0)))
    d = d.withColumn("valid", words.valid_mask(F.col("seq_len"), F.col("width")))
    return sampling.mask_positions(d, mask_ratio, 1, seed + epoch, key=order)
