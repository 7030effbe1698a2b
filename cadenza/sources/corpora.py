"""Corpus inputs as tables: transcripts, mappings, dictionaries, manifests, score files and audio listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import text as X
from cadenza.functions.packed import unpacked
from cadenza.functions.scorejson import SCORES_SCHEMA
from cadenza.sources import bigjson

# Transcript suffixes, the preferred one first.
TRANSCRIPTS = (".normalized.txt", ".original.txt", ".txt")
# Folders of a corpus that hold derived files.
DERIVED = ("prepared", "aligned")
PREPARED = "utterance_id string, speaker_id string, dataset string, split string, text string, normalized_text string, audio_path string, transcript_path string"


def best_transcripts(paths: DataFrame) -> DataFrame:
    """SRC-05: (stem, transcript_path) with the preferred transcript of each stem; ``paths`` has ``path``."""
    rank = F.lit(None).cast("int")
    stem = F.col("path")
    for i, s in reversed(list(enumerate(TRANSCRIPTS))):
        here = F.endswith("path", F.lit(s))
        rank = F.when(here, i).otherwise(rank)
        stem = F.when(here, F.expr(f"substring(path, 1, length(path) - {len(s)})")).otherwise(stem)
    p = paths.select("path", rank.alias("rank"), stem.alias("stem")).where(F.col("rank").isNotNull())
    return p.groupBy("stem").agg(F.min_by("path", "rank").alias("transcript_path"))


def scored_utterances(speakers: DataFrame, scores: DataFrame, audio: DataFrame, score_key: str, key: str = "utterance_id") -> DataFrame:
    """JN-01: utterances that have a speaker, a score entry and audio."""
    return speakers.join(scores, score_key).join(audio, key)


def resolve_audio(df: DataFrame, listing: DataFrame, path: str, root: str = "raw") -> DataFrame:
    """JN-14: ``resolved``: an absolute path as it is, else the path or the path under ``root`` that is listed, else null."""
    a = listing.select(F.col("listed").alias("__a")).distinct()
    b = listing.select(F.col("listed").alias("__b")).distinct()
    d = df.join(a, F.col(path) == F.col("__a"), "left").join(b, F.concat(F.lit(f"{root}/"), F.col(path)) == F.col("__b"), "left")
    return d.withColumn("resolved", F.when(F.startswith(path, F.lit("/")), F.col(path)).otherwise(F.coalesce("__a", "__b"))).drop("__a", "__b")


def lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(path, line, value): numbered lines of whole files; decoding in the JVM keeps latin-1 intact."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.posexplode(F.split(F.decode("content", encoding), "\r?\n")).alias("line", "value"))


def mapping(numbered: DataFrame) -> DataFrame:
    """SRC-07: (key, value) of two-column lines; blank lines are skipped, the last line of a key wins."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    d = numbered.where(F.trim("value") != "").select("path", "line", F.get(parts, F.lit(0)).alias("key"), F.get(parts, F.lit(1)).alias("v")).where(F.col("v").isNotNull())
    return d.groupBy("key").agg(F.max_by("v", F.struct("path", "line")).alias("value"))


def audio_paths(mapped: DataFrame, raw_root: str, dataset_root: str) -> DataFrame:
    """SRC-08: mapping values as absolute paths, then relative to the dataset where they are below it."""
    full = F.when(F.startswith("value", F.lit("/")), F.col("value")).otherwise(F.concat_ws("/", F.lit(raw_root), "value"))
    return mapped.select("key", X.relative_path(full, dataset_root).alias("audio_path"))


def pronouncing_dictionary(numbered: DataFrame) -> DataFrame:
    """SRC-09: (word, phones): comments and one-field lines skipped, variant marks and stress stripped, the first line of a word wins."""
    parts = F.split(F.trim("value"), r"\s+")
    d = numbered.where((F.trim("value") != "") & ~F.startswith("value", F.lit(";;;"))).select("path", "line", parts.alias("p")).where(F.size("p") > 1)
    word = F.lower(F.regexp_replace(F.get("p", F.lit(0)), r"\(\d+\)$", ""))
    phones = F.transform(F.slice("p", 2, 1 << 20), X.strip_stress)
    return d.groupBy(word.alias("word")).agg(F.min_by(phones, F.struct("path", "line")).alias("phones"))


def manifests(spark: SparkSession, path: str, schema: str = PREPARED) -> DataFrame:
    """SRC-01, SRC-02: JSON lines with ``_bad`` holding a line that doesn't parse; blank lines are skipped."""
    s = T.StructType(T._parse_datatype_string(schema).fields + [T.StructField("_bad", T.StringType())])
    return spark.read.schema(s).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)


def feature_shards(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-03: ``part-*.json`` and ``.jsonl`` files with their name as ``shard``; a folder without one is an error of Spark's reader."""
    return spark.read.schema(schema).option("pathGlobFilter", "part-*.json*").json(folder).withColumn("shard", F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1))


def by_word(shards: DataFrame) -> DataFrame:
    """Rows of shards by word, over as many tasks as read them, so that a task's rows don't grow with the shards."""
    n = shards.rdd.getNumPartitions()
    return shards.repartition(n, "utterance_id") if n > shards.sparkSession.sparkContext.defaultParallelism else shards


def audio_listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("wav", "flac")) -> DataFrame:
    """SRC-04: (path, length) of all audio files below ``root``; contents are never read, derived folders are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    parts = F.split(F.substring_index("path", root.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    derived = F.exists(parts, lambda x: x.isin(*DERIVED))
    return f.where(suffix.isin(*extensions) & ~derived)


def json_texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): each file as one text."""
    return spark.read.text(path, wholetext=True)


def score_entries(texts: DataFrame) -> DataFrame:
    """SRC-06: one row per utterance of JSON objects keyed by utterance."""
    return texts.select(F.explode(F.from_json("value", SCORES_SCHEMA)).alias("utterance_id", "entry"))


def score_object(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06 for files that hold one large object each, cut into entries by many tasks; of equal keys the last one counts."""
    e = bigjson.json_entries(spark, path)
    each = e.select("path", "block", "seq", F.explode(F.from_json("value", SCORES_SCHEMA)).alias("utterance_id", "entry"))
    return each.groupBy("utterance_id").agg(F.max_by("entry", F.struct("path", "block", "seq")).alias("entry"))


def curated_lexicon(texts: DataFrame) -> DataFrame:
    """SRC-12: (word, phones, ipa, reference_audio_id, syllables, stress_pattern); keys in lower case, syllables default to none."""
    kind = "map<string,struct<phones:array<string>,ipa:string,reference_audio_id:string,syllables:array<array<string>>,stress_pattern:string>>"
    t = texts.select(F.explode(F.from_json("value", kind)).alias("w", "e"))
    return t.select(F.lower("w").alias("word"), "e.phones", "e.ipa", "e.reference_audio_id", F.coalesce("e.syllables", F.array().cast("array<array<string>>")).alias("syllables"), "e.stress_pattern")


def reference_audio(texts: DataFrame) -> DataFrame:
    """SRC-13: (audio_id, word, accent_target, asset_path)."""
    t = texts.select(F.explode(F.from_json("value", "map<string,struct<word:string,accent_target:string,asset_path:string>>")).alias("audio_id", "e"))
    return t.select("audio_id", "e.*")


def dense_words(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None, width: int | None = None, as_bytes: bool = False) -> DataFrame:
    """SRC-14: a dense word table; with ``rows`` its count must agree, with ``width`` each flat array's length.

    Packed vectors come back as arrays, unless they are wanted ``as_bytes``.
    """
    df = spark.read.parquet(path)
    if rows is not None and df.count() != rows:
        raise ValueError("the table's row count isn't the manifest's")
    if width is not None:
        kind = df.schema["acoustic_flat"].dataType
        numbers = F.octet_length("acoustic_flat") / 8 if isinstance(kind, T.BinaryType) else F.size("acoustic_flat")
        ok = numbers == F.col("seq_len") * width
        df = df.withColumn("acoustic_flat", F.when(ok, F.col("acoustic_flat")).otherwise(F.raise_error(F.lit("acoustic_flat has another length")).cast(kind)))
    df = df.select(*columns) if columns else df
    return df if as_bytes or "acoustic_flat" not in df.columns else unpacked(df, "acoustic_flat")


def read_features(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-15: the dense table of a split where there is one, else its JSON shards assembled to the same columns."""
    from cadenza.operators.words import assemble_words

    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/dense")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return unpacked(spark.read.parquet(f"{folder}/dense"), "acoustic_flat")
    return assemble_words(by_word(feature_shards(spark, f"{folder}/shards", schema)))
