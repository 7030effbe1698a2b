"""Sinks: manifests, feature shards, dense tables, reports, transcripts and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cadenza.functions import text as X
from cadenza.operators.words import Embedding, assemble_words, packed_words
from cadenza.sources.filesink import by_files, write_files


def write_manifest(df: DataFrame, path: str, overwrite: bool = False, kind: str = "json") -> None:
    """SNK-01: a folder per split; refuses to replace one unless asked, and then replaces only the splits in ``df``."""
    w = df.write.partitionBy("split").format(kind).mode("overwrite" if overwrite else "errorifexists")
    w.option("partitionOverwriteMode", "dynamic").save(path)


def write_shards(df: DataFrame, path: str, shard_rows: int, overwrite: bool = False) -> None:
    """SNK-02: JSON shards of about ``shard_rows`` rows, compressed, each read by one task; a word's rows stay together and in order."""
    n = max(1, -(-df.count() // shard_rows))
    df.repartition(n, "utterance_id").sortWithinPartitions("utterance_id", "index").write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip").json(path)


def write_dense_words(phones: DataFrame, path: str, compression: str = "snappy", block_bytes: int = 64 << 20, overwrite: bool = False, embedding: Embedding | None = None, width: int = 2) -> dict:
    """SNK-03: phone rows to one dense row per word, and the manifest counted while writing; no rows are an error.

    With ``embedding`` each phone's acoustic vector is ``width`` wide: the embedding, variance, z and energy; ``acoustic_flat`` is then
    packed (``functions.packed``), which ``corpora.dense_words`` and ``corpora.read_features`` undo.
    """
    seen = Observation()
    flat = F.octet_length("acoustic_flat") / 8 if embedding else F.size("acoustic_flat")
    each = flat / F.greatest(F.lit(1), F.col("seq_len"))
    w = (packed_words(phones, embedding, width) if embedding else assemble_words(phones)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum("seq_len").alias("rows"), F.min(each).alias("low"), F.max(each).alias("high"))
    w.write.mode("overwrite" if overwrite else "errorifexists").option("compression", compression).option("parquet.block.size", str(block_bytes)).parquet(path)
    m = seen.get
    if not m["n"]:
        raise ValueError("there are no rows to pack")
    if m["low"] != m["high"]:
        raise ValueError("acoustic vectors differ in width")
    return {"version": 1, "num_utterances": m["n"], "num_rows": m["rows"], "acoustic_dim": int(m["high"]), "dtypes": dict(w.dtypes)}


def write_report(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """SNK-04: report rows, a few by nature, as one JSON file."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def transcript_rows(df: DataFrame) -> DataFrame:
    """SNK-05: (rel_path, text): one line per utterance for an external aligner."""
    return df.select(F.regexp_replace("audio_path", r"\.[^./]+$", ".lab").alias("rel_path"), X.collapse_space(F.col("text")).alias("text"))


def write_transcripts(rows: DataFrame, path: str, existing: DataFrame | None = None) -> dict:
    """SNK-05: transcripts that aren't there yet, in a partition for each folder; how many were written and how many reused.

    Both counts are taken while writing, so the rows are evaluated once.
    """
    seen = Observation()
    there = F.lit(None).cast("boolean")
    if existing is None:
        d = rows.withColumn("__there", there)
    else:
        d = rows.join(existing.select("rel_path", F.lit(True).alias("__there")).distinct(), "rel_path", "left")
    d = d.observe(seen, F.count(F.lit(1)).alias("total"), F.count("__there").alias("reused"))
    new = d.where(F.col("__there").isNull()).drop("__there")
    folder = F.md5(F.regexp_replace("rel_path", "/[^/]*$", "").cast("binary"))
    new.withColumn("folder", folder).write.partitionBy("folder").mode("append").parquet(path)
    return {"written": seen.get["total"] - seen.get["reused"], "reused": seen.get["reused"]}


def write_labs(df: DataFrame, path: str, overwrite: bool = False) -> dict:
    """SNK-05, JOB-03: one ``.lab`` file for each utterance (audio_path, text) beside its audio's place below ``path``; how many were written and reused."""
    return write_files(by_files(transcript_rows(df)).withColumnRenamed("text", "content"), path, overwrite)


def write_aligned(rows: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """JOB-04, JOB-05: words and utterances with and without a ``reason``, evaluated once into ``path``-rows; the words that passed as
    manifests by split below ``path``, and how many rows each split and reason has as ``path``-summary. Returns all rows as they read back.
    """
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}-rows")
    done = rows.sparkSession.read.parquet(f"{path}-rows")
    kept = done.where(F.col("reason").isNull()).drop("reason", "pos", "utterance_id").withColumnRenamed("artifact_id", "utterance_id")
    write_manifest(kept, path, overwrite)
    write_report(done.groupBy("split", "reason").agg(F.count(F.lit(1)).alias("rows")), f"{path}-summary")
    return done


def append_ledger(df: DataFrame, path: str) -> None:
    """SNK-06: states are only ever appended."""
    df.write.mode("append").parquet(path)
