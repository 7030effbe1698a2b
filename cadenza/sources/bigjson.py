"""The entries of one large JSON object, found by many tasks.

A file is read in blocks of pieces between commas. What a block does to a scanner depends on the state that comes in:
outside strings, inside one, or inside one after a backslash. A first pass finds for every block where each of these states
leads and how it moves the depth; chained over the blocks of a file this gives the state at the beginning of each. A
second pass cuts every block where the object's own entries part; an entry that runs over several blocks is joined
from their ends. No task reads more than its blocks, and the rows of a pass never travel but for those ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUT, IN, ESCAPED = range(3)
QUOTE, BACKSLASH, COMMA = b'"'[0], b"\\"[0], b","[0]
#: How a byte outside strings moves the depth.
STEP = np.zeros(256, np.int8)
STEP[list(b"{[")], STEP[list(b"}]")] = 1, -1
ENTRY = "path string, block long, seq long, kind string, value string"


def scan(data: np.ndarray, state: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(state after, whether each byte is outside strings, the depth's change up to and with each byte)."""
    slash = data == BACKSLASH
    # a byte is escaped if the run of backslashes right before it is odd; one before the data counts
    at = np.arange(len(data))
    start = np.maximum.accumulate(np.where(slash, -1, at)) if len(data) else at  # the last byte that isn't a backslash
    run = at - start
    before = np.concatenate([[0], run[:-1]]) if len(data) else run
    if state == ESCAPED and len(data):
        lead = int(np.argmin(slash)) if not slash.all() else len(data)
        before[: lead + 1] = np.arange(1, min(lead + 1, len(data)) + 1)[: len(before[: lead + 1])]
    quote = (data == QUOTE) & (before % 2 == 0)
    inside = (np.cumsum(quote) + (state != OUT)) % 2 == 1
    outside = ~inside & ~quote
    after = OUT if not (inside[-1] if len(data) else state != OUT) else IN
    if after == IN and len(data) and slash[-1]:
        last = run[-1] + (1 if state == ESCAPED and slash.all() else 0)
        after = ESCAPED if last % 2 else IN
    elif not len(data):
        after = state
    return after, outside, np.cumsum(np.where(outside, STEP[data], 0))


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bytes]]:
    """((path, block), bytes) of the pieces as they come, each with its comma."""
    for b in batches:
        paths, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        cuts = [0, *(i for i in range(1, len(paths)) if (paths[i], blocks[i]) != (paths[i - 1], blocks[i - 1])), len(paths)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield (paths[x], blocks[x]), "".join(f"{v}," for v in b.column(2).slice(x, y - x).to_pylist()).encode()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, value): what stands between the commas of the files, in the order of each block."""
    t = spark.read.option("lineSep", ",").text(path)
    return t.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def block_maps(read: DataFrame) -> DataFrame:
    """(path, block, after, moved): for each state that may come in, the state after the block and the depth's change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([after], pa.list_(pa.int32())), pa.array([moved], pa.list_(pa.int64()))], names=["path", "block", "after", "moved"])

        key, after, moved = None, [], []
        for here, data in block_runs(batches):
            if here != key:
                if key is not None:
                    yield row()
                key, after, moved = here, [OUT, IN, ESCAPED], [0, 0, 0]
            found = {s: scan(np.frombuffer(data, np.uint8), s) for s in set(after)}
            moved = [m + int(found[s][2][-1]) for m, s in zip(moved, after)]
            after = [found[s][0] for s in after]
        if key is not None:
            yield row()

    return read.mapInArrow(run, "path string, block long, after array<int>, moved array<long>")


def begun(maps: DataFrame) -> dict[tuple[str, int], tuple[int, int]]:
    """The (state, depth) at the beginning of each block, by composing the maps of the blocks before it; a row for each block comes to the driver."""
    out, path, state, depth = {}, None, OUT, 0
    for r in sorted(maps.collect(), key=lambda r: (r["path"], r["block"])):
        if r["path"] != path:
            path, state, depth = r["path"], OUT, 0
        out[path, r["block"]] = state, depth
        state, depth = r["after"][state], depth + r["moved"][state]
    return out


def cut_entries(read: DataFrame, begin: dict) -> DataFrame:
    """The object's entries: whole ones as ``entry`` and those at a block's ends as ``tail`` (begins one), ``head`` (ends one) or ``middle``."""
    sent = read.sparkSession.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(found: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["path", "block", "seq", "kind", "value"])

        def rest():
            return rows([(*key, seq, "tail" if seq else "middle", b"".join(held).decode())])

        key, state, depth, seq, held = None, OUT, 0, 0, []
        for here, raw in block_runs(batches):
            if here != key:
                if key is not None:
                    yield rest()
                key, seq, held = here, 0, []
                state, depth = sent.value[here]
            data = np.frombuffer(raw, np.uint8)
            state, outside, change = scan(data, state)
            now = depth + change
            step = np.where(outside, STEP[data], 0)
            part = np.flatnonzero(outside & (((data == COMMA) & (now == 1)) | ((step == 1) & (now == 1)) | ((step == -1) & (now == 0))))
            depth = int(now[-1])
            found, at = [], 0
            for p in part.tolist():
                found.append((*key, seq, "entry" if seq else "head", b"".join([*held, raw[at:p]]).decode()))
                held, at, seq = [], p + 1, seq + 1
            held.append(raw[at:])
            if found:
                yield rows(found)
        if key is not None:
            yield rest()

    return read.mapInArrow(run, ENTRY)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, seq, value): the entries of the JSON objects in the files of ``path``, each as an object of one entry, in the order of (block, seq)."""
    read = pieces(spark, path)
    cut = cut_entries(read, begun(block_maps(read))).where((F.trim(F.regexp_replace("value", r"\s", "")) != "") | (F.col("kind") != "entry"))
    whole = cut.where(F.col("kind") == "entry").select("path", "block", "seq", "value")
    # the ends of blocks, a few rows each: a head belongs to the last tail before it
    ends = cut.where(F.col("kind") != "entry").withColumn("open", F.last(F.when(F.col("kind") == "tail", F.col("block")), True).over(Window.partitionBy("path").orderBy("block", "seq")))
    joined = ends.groupBy("path", "open").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "value"))).alias("x"))
    joined = joined.select("path", F.coalesce("open", F.lit(-1).cast("long")).alias("block"), F.array_max("x.seq").alias("seq"), F.array_join("x.value", "").alias("value"))
    return whole.unionByName(joined.where(F.regexp_replace("value", r"[\s,]", "") != "")).select("path", "block", "seq", F.concat(F.lit("{"), "value", F.lit("}")).alias("value"))
