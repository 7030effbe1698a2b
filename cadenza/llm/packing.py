"""Packing token sequences as a cutting-stock problem.

Documents are tokenized once and cut into pieces of at most ``capacity`` tokens. The histogram of
piece lengths, in classes of ``grain`` tokens, is all that reaches the driver (capacity / grain
numbers). There a linear program over patterns is solved by column generation: a knapsack dynamic
program prices new patterns until none pays. The rounded patterns and their repetitions form a small
interval table; pieces, ranked within their length class, look their sequence up in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import text_of, written
from cadenza.llm.tokens import byte_bpe, read_tokenizer


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and ``end_id``, cut at multiples of ``capacity``."""
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(source.value)
        for batch in batches:
            rows: list[tuple[int | None, int, int, int, int]] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.ids(text.as_py()), np.uint32(end_id)).astype("<u4")
                raw = memoryview(ids.tobytes())
                for a in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - a)
                    rows.append((key, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)]), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("t")).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def price(duals: np.ndarray, size: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: the most valuable multiset of classes 1..size whose sizes sum to at most ``size``."""
    best, took = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        value = best[c - 1 :: -1][:c] + duals[:c]  # class w (size w) leaves c - w
        w = int(value.argmax())
        best[c], took[c] = (value[w], w + 1) if value[w] > best[c - 1] else (best[c - 1], 0)
    pattern, c = np.zeros(size, np.int64), size
    while c > 0:
        pattern[took[c] - 1] += took[c] > 0
        c -= took[c] if took[c] else 1
    return float(best[size]), pattern


def plan(demand: np.ndarray, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """(pattern, repetitions) that cover ``demand`` exactly; demand[i] pieces are of size i + 1, a bin holds len(demand).

    Column generation by the revised simplex method; stopping at ``rounds`` keeps a feasible plan.
    Repetitions are rounded down; what that leaves, less than one bin for each pattern, is packed best fit
    first. A pattern never holds more pieces of a class than are left, so the cover is exact.
    """
    size = len(demand)
    live = np.flatnonzero(demand)
    if not len(live):
        return []
    d = demand[live].astype(float)
    m = len(live)
    columns = np.zeros((m, m))
    per = np.array([size // (i + 1) for i in live], float)
    columns[np.arange(m), np.arange(m)] = per
    inverse = np.diag(1 / per)
    x = inverse @ d
    for _ in range(rounds):
        y = inverse.sum(axis=0)  # every bin costs 1
        duals = np.zeros(size)
        duals[live] = np.maximum(y, 0)
        value, pattern = price(duals, size)
        if value <= 1 + 1e-7:
            break
        a = pattern[live].astype(float)
        u = inverse @ a
        up = u > 1e-10
        if not up.any():
            break
        ratio = np.where(up, x / np.where(up, u, 1), np.inf)
        r = int(ratio.argmin())
        step = ratio[r]
        x -= step * u
        x[r] = step
        x = np.maximum(x, 0)
        columns[:, r] = a
        inverse[r] /= u[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(u[others], inverse[r])
    left = demand[live].astype(np.int64)
    out: list[tuple[np.ndarray, int]] = []
    for k in np.argsort(-x, kind="stable"):
        a = columns[:, k].astype(np.int64)
        used = a > 0
        times = min(int(x[k] + 1e-6), int((left[used] // a[used]).min()))
        if times > 0:
            left -= times * a
            out.append((_wide(a, live, size), times))
    while left.any():  # best fit of the rest: the largest piece, then ever the largest that fits, repeated while pieces last
        a, room = np.zeros(m, np.int64), size
        for i in range(m - 1, -1, -1):
            w = live[i] + 1
            n = min(int(left[i]), room // w)
            a[i], room = n, room - n * w
        used = a > 0
        times = int((left[used] // a[used]).min())
        left -= times * a
        out.append((_wide(a, live, size), times))
    return out


def _wide(a: np.ndarray, live: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[live] = a
    return out


def intervals(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(class, first rank, end rank, pieces per sequence, first sequence, first slot) for each pattern and class in it."""
    rows, rank, first = [], np.zeros(len(patterns[0][0]) if patterns else 0, np.int64), 0
    for a, times in patterns:
        slot = 0
        for i in np.flatnonzero(a)[::-1]:
            n = int(a[i])
            rows.append((int(i) + 1, int(rank[i]), int(rank[i]) + n * times, n, first, slot))
            rank[i] += n * times
            slot += n
        first += times
    return rows


def pack(pieces: DataFrame, capacity: int = 2048, grain: int = 8, block_rows: int = 200_000) -> DataFrame:
    """The pieces with ``sequence_id`` (from 0) and ``offset``: every sequence holds at most ``capacity`` tokens, gapless from 0.

    ``pieces`` has doc_id, start and length (1..capacity) and is read several times: hand in a written
    table. Pieces are ranked within their class in blocks of hashed ids, so that a very common length
    is no hot spot. Ranks follow all columns, so only rows that agree in every one are dealt by chance; no row is lost.
    """
    spark = pieces.sparkSession
    size = capacity // grain
    df = pieces.withColumn("__c", F.ceil(F.col("length") / grain).cast("int"))
    histogram = {r["__c"]: r["n"] for r in df.groupBy("__c").agg(F.count(F.lit(1)).alias("n")).collect()}
    demand = np.array([histogram.get(c, 0) for c in range(1, size + 1)])
    rows = intervals(plan(demand))
    table = spark.createDataFrame(rows or [(0, 0, 0, 1, 0, 0)], "__ic int, __from long, __to long, __per long, __seq long, __slot long")
    blocks = max(64, int(demand.sum()) // block_rows)
    df = df.withColumn("__b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(blocks)).cast("int"))
    sizes = df.groupBy("__c", "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__c", "__b", (F.sum("__n").over(Window.partitionBy("__c").orderBy("__b")) - F.col("__n")).alias("__before"))
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy("__c", "__b").orderBy(*pieces.columns)))
    ranked = ranked.join(before, ["__c", "__b"]).withColumn("__rank", F.col("__before") + F.col("__r") - 1)
    # the interval table has a row for each pattern and class in it: bounded by the number of classes, not by the data
    at = F.col("__rank") - F.col("__from")
    placed = ranked.join(F.broadcast(table), (F.col("__c") == F.col("__ic")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    placed = placed.select(*pieces.columns, (F.col("__seq") + F.floor(at / F.col("__per"))).alias("sequence_id"), (F.col("__slot") + at % F.col("__per")).alias("__slot"))
    within = Window.partitionBy("sequence_id").orderBy("__slot")
    return placed.withColumn("offset", F.sum("length").over(within) - F.col("length")).drop("__slot")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, grain: int = 8) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row per piece. Null text counts as empty: its one piece is ``end_id`` alone."""
    pieces = written(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, capacity, grain)
