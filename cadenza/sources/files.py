"""Alignment files and audio files as tables."""

from __future__ import annotations

import io
import re
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.packs import packed_files

INTERVALS = "path string, tier string, pos int, xmin double, xmax double, text string, error string"
SAMPLES = "path string, sample_rate int, channels int, samples array<float>, error string"
_NUMBER = re.compile(r"^\s*(xmin|xmax)\s*=\s*(\S+)")
_STRING = re.compile(r'^\s*(class|name|text|mark)\s*=\s*"(.*)"\s*$')
_CLASS = re.compile(r'class[ \t]*=[ \t]*"[^"\n]*"[ \t]*\n')
_HEAD = re.compile(r'[ \t]*name[ \t]*=[ \t]*"([^\n]*)"[ \t]*\n(?:[ \t]*xm(?:in|ax)[ \t]*=[^\n]*\n)*(?:[ \t]*intervals:[^\n"]*\n)?')
_TAIL = re.compile(r"(?:(?:^|\n)[ \t]*item[ \t]*\[\d*\]:?[ \t]*)?\s*\Z")
_BEGIN = [re.compile(rf"[ \t]*{x}") for x in (r"xmin[ \t]*=[ \t]*", r"xmax[ \t]*=[ \t]*", r'text[ \t]*=[ \t]*"')]
#: Rows of a batch of intervals, or more if one file has more.
BATCH_ROWS = 1 << 14


NO_TIER = "no interval tier"


def file_tiers(text: str) -> tuple[list[tuple[str | None, list[tuple[float, float, str]]]], str | None]:
    """The interval tiers of an alignment file in its long text form, empty ones too, or why it isn't one."""
    if "IntervalTier" not in text:
        return [], NO_TIER
    tiers, bounds, items = [], {}, False
    for line in re.split("\r\n?|\n", text):
        if m := _NUMBER.match(line):
            bounds[m[1]] = m[2]
        elif re.match(r"^\s*intervals\s*\[", line):
            items, bounds = True, {}
        elif m := _STRING.match(line):
            if m[1] == "class":
                items = False
                tiers.append((None, []))
            elif m[1] == "name" and tiers:
                tiers[-1] = (m[2].replace('""', '"'), tiers[-1][1])
            elif items and m[1] == "text" and tiers:
                try:
                    tiers[-1][1].append((float(bounds["xmin"]), float(bounds["xmax"]), m[2].replace('""', '"')))
                except (KeyError, ValueError):
                    return [], "an interval without bounds"
    return tiers, None


_COLUMNS = [("xmin", pa.float64()), ("xmax", pa.float64()), ("label", pa.string())]


def tier_columns(text: str) -> tuple[list[tuple[str | None, list[pa.Array]]], str | None]:
    """``file_tiers`` with a tier's intervals as columns: begins, ends, labels.

    A tier of the usual four lines for each interval is read a column at a time; a file with any other line is read line by line.
    """
    if "IntervalTier" not in text:
        return [], NO_TIER
    cuts = [m for m in _CLASS.finditer(text) if not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t")]
    before = text[: cuts[0].start()] if cuts else text
    odd = "\r" in text or re.search(r"^\s*class", before, re.M)
    tiers = [] if odd else [_usual_tier(text[m.end() : after]) for m, after in zip(cuts, [*(c.start() for c in cuts[1:]), len(text)])]
    return (tiers, None) if tiers and None not in tiers else _by_lines(text)


def _by_lines(text: str) -> tuple[list[tuple[str | None, list[pa.Array]]], str | None]:
    tiers, error = file_tiers(text)
    return [(name, [pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_COLUMNS)]) for name, rows in tiers], error


def _usual_tier(part: str) -> tuple[str, list[pa.Array]] | None:
    """What follows a tier's class, if it has but a head and entries in the usual form."""
    head = _HEAD.match(part)
    if not head:
        return None
    name, body = head[1].replace('""', '"'), part[head.end() :]
    body = body[: _TAIL.search(body, max(0, len(body) - 64)).start()]
    if not body:
        return name, [pa.array([], k) for _, k in _COLUMNS]
    lines = pc.split_pattern(pa.array([body]), "\n").values
    first, *fields = [lines.take(pa.array(np.arange(i, len(lines), 4))) for i in range(4)]
    if len(lines) % 4 or not pc.all(pc.match_substring_regex(first, r"^[ \t]*intervals[ \t]*\[[0-9]+\]:?[ \t]*$")).as_py():
        return None
    columns = []
    for at_first, lines, (_, kind) in zip(_BEGIN, fields, _COLUMNS):
        begin = at_first.match(lines[0].as_py())
        if not begin or not pc.all(pc.starts_with(lines, begin[0])).as_py():
            return None
        if pc.min(pc.binary_length(lines)).as_py() <= len(begin[0]) or kind == pa.string() and not pc.all(pc.ends_with(lines, '"')).as_py():
            return None
        if kind == pa.string():
            columns.append(pc.replace_substring(pc.utf8_slice_codeunits(lines, len(begin[0]), -1), '""', '"'))
        else:
            try:
                columns.append(pc.utf8_slice_codeunits(lines, len(begin[0])).cast(kind))
            except pa.ArrowInvalid:  # not a number
                return None
    return name, columns


def alignment_intervals(files: DataFrame) -> DataFrame:
    """SRC-10, UDF-02: ``files`` (path, text) to one row per interval; files are parsed where they are read."""

    names = [c.split()[0] for c in INTERVALS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for b in batches:
            for path, text in zip(b.column(0), b.column(1)):
                tiers, error = tier_columns(text.as_py() or "")
                for tier, columns in [(None, [pa.nulls(1, k) for _, k in _COLUMNS])] if error else tiers:
                    n = len(columns[0])
                    pos = pa.nulls(1, pa.int32()) if error else pa.array(np.arange(n, dtype=np.int32))
                    waiting.append([pa.repeat(path.cast(pa.string()), n), pa.repeat(pa.scalar(tier, pa.string()), n), pos, *columns, pa.repeat(pa.scalar(error, pa.string()), n)])
                    rows += n
                if rows >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*waiting)], names=names)
                    waiting, rows = [], 0
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*waiting)], names=names)

    return files.select("path", "text").mapInArrow(run, INTERVALS)


TIERS = "path string, tiers array<struct<name:string,intervals:array<struct<xmin:double,xmax:double,label:string>>>>, error string"


def alignment_tiers(files: DataFrame) -> DataFrame:
    """SRC-10 at the grain of files: ``files`` (path, text) to one row each, its tiers as arrays in the order of the file.

    An utterance's words and phones stay together, so nothing has to bring them together again.
    """
    def lists(sizes: list[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)

    def made(found: list[tuple]) -> pa.RecordBatch:
        tiers = [x for _, last, _ in found for x in last.items()]
        columns = [pa.concat_arrays([pa.array([], k), *(x[i] for _, x in tiers)]) for i, (_, k) in enumerate(_COLUMNS)]
        each = pa.StructArray.from_arrays(columns, names=[n for n, _ in _COLUMNS])
        tier = pa.StructArray.from_arrays([pa.array([n for n, _ in tiers], pa.string()), lists([len(x[0]) for _, x in tiers], each)], names=["name", "intervals"])
        out = [pa.array([x[0] for x in found], pa.string()), lists([len(x[1]) for x in found], tier), pa.array([x[2] for x in found], pa.string())]
        return pa.RecordBatch.from_arrays(out, names=["path", "tiers", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for b in batches:
            for path, text in zip(b.column(0), b.column(1)):
                tiers, error = tier_columns(text.as_py() or "")
                last = dict(tiers)  # of tiers with one name the last counts
                found.append((path.as_py(), last, error))
                rows += 1 + sum(len(x[0]) for x in last.values())
                if rows >= BATCH_ROWS:
                    yield made(found)
                    found, rows = [], 0
        if found:
            yield made(found)

    return files.select("path", "text").mapInArrow(run, TIERS)


def alignment_texts(spark: SparkSession, root: str) -> DataFrame:
    """SRC-10: (path, text) of all alignment files below a folder; paths as they are, without the escapes of an address."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.TextGrid").load(root)
    return found.select("path", F.decode("content", "UTF-8").alias("text"))


def packed_texts(spark: SparkSession, root: str) -> DataFrame:
    """SRC-10: (path, text) of all alignment files in the packs of a folder."""
    d = packed_files(spark, root).where(F.endswith("rel_path", F.lit(".TextGrid")))
    return d.select("path", F.decode("content", "UTF-8").alias("text"))


def alignment_files(spark: SparkSession, root: str) -> DataFrame:
    """SRC-10: the intervals of all alignment files below a folder."""
    return alignment_intervals(alignment_texts(spark, root))


def decode_wav(content: bytes) -> tuple[int, int, np.ndarray]:
    """Rate, channels and interleaved samples in -1..1 of PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        rate, channels, size, raw = w.getframerate(), w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())
    if size == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif size == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) ^ 0x800000) - 0x800000
        x = x.astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[size]).astype(np.float32) / (1 << (8 * size - 1))
    return rate, channels, x


def decode_audio(files: DataFrame) -> DataFrame:
    """SRC-16, UDF-03: ``files`` (path, content) to samples; a file that can't be decoded keeps its row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rate, channels, x = decode_wav(bytes(content or b""))
                    rows.append((path, rate, channels, x, None if len(x) else "empty"))
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    rows.append((path, None, None, None, f"{type(e).__name__}"))
            out = pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "samples", "error"])
            yield out.astype({"sample_rate": "Int32", "channels": "Int32"})

    return files.select("path", "content").mapInPandas(run, SAMPLES)


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM of samples in -1..1."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.rint(np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()
