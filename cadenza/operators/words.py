"""Word assembly, batching, padding and dense tables."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import labels as L
from cadenza.functions import packed
from cadenza.functions.constants import ACOUSTIC_WIDTH
from cadenza.operators.permute import permuted
from cadenza.session import scratch


def assemble_words(phones: DataFrame, embedding: str | None = None, width: int = ACOUSTIC_WIDTH) -> DataFrame:
    """AG-08: phone rows to one row per word, arrays in index order and ``seq_len``.

    With ``embedding`` (a column of vectors) and a ``z`` column, ``acoustic_flat`` holds the acoustic vectors
    of FN-24, ``width`` numbers for each phone; without, variance and energy alone.
    """
    target = L.regression_target(F.col("human_score"))
    if embedding:
        acoustic = acoustic_vector(F.col(embedding), F.col("variance"), F.col("z"), F.col("energy"), width)
    else:
        acoustic = F.array("variance", "energy")
    row = F.struct(
        "index", "phoneme", L.phoneme_id(F.col("phoneme")).alias("id"), target.alias("target"),
        (1 - F.col("omission").cast("int")).alias("presence"), "duration_ms", acoustic.alias("acoustic"),
    )
    g = phones.groupBy("utterance_id").agg(F.array_sort(F.collect_list(row)).alias("r"), F.first("speaker_id").alias("speaker_id"), F.first("split").alias("split"))
    pick = lambda name: F.transform("r", lambda x: x[name])
    return g.select(
        "utterance_id", "speaker_id", "split", pick("phoneme").alias("phones"), pick("id").alias("phoneme_ids"), pick("target").alias("match_targets"),
        pick("target").alias("duration_targets"), pick("presence").alias("presence_targets"), F.flatten(pick("acoustic")).alias("acoustic_flat"), F.size("r").alias("seq_len"),
    )


#: What makes phones' embeddings: a column of vectors, or columns and a function of their numbers that gives a vector in each row.
Embedding = str | tuple[list[str], Callable[..., np.ndarray]]
#: Bytes of packed vectors that a task makes at a time; a longer word goes alone.
PACKED_BYTES = 8 << 20


def packed_words(phones: DataFrame, embedding: Embedding, width: int = ACOUSTIC_WIDTH) -> DataFrame:
    """AG-08 with ``acoustic_flat`` packed: the acoustic vectors of FN-24 as bytes, made where a word's phones are together in order.

    What makes the vectors travels with the phones; with a function of columns these are a few numbers, so that no vector is sorted or shuffled.
    """
    columns, make = ([embedding], lambda v: v) if isinstance(embedding, str) else embedding
    many = len(columns) + 3
    names = ["phones", "phoneme_ids", "match_targets", "presence_targets"]
    values = [F.col("phoneme"), L.phoneme_id(F.col("phoneme")), L.regression_target(F.col("human_score")), 1 - F.col("omission").cast("int")]
    parts = [F.col(c).alias(f"p{i}") for i, c in enumerate([*columns, "variance", "z", "energy"])]
    at = F.row_number().over(Window.partitionBy("utterance_id").orderBy("index")).alias("at")
    rows = phones.select("utterance_id", "speaker_id", "split", *[v.alias(n) for n, v in zip(names, values)], at, *parts).sortWithinPartitions("utterance_id", "at")
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "acoustic_flat" else f for f in assemble_words(phones).schema])

    def vectors(a: pa.Array) -> np.ndarray:
        if not pa.types.is_list(a.type):
            return packed.numbers(a)
        long = pc.list_value_length(a)
        if long.null_count or pc.min_max(long).as_py() != {"min": width - 3, "max": width - 3}:
            raise ValueError("the acoustic vector has another width")
        return packed.numbers(a.flatten()).reshape(len(a), width - 3)

    def made(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        """Whole words; ``starts`` has where each begins, and the end."""
        starts = starts - starts[0]
        offsets = pa.array(starts.astype(np.int32))
        first = {c: b.column(c).take(offsets[:-1]) for c in ("utterance_id", "speaker_id", "split")}
        lists = {c: pa.ListArray.from_arrays(offsets, b.column(c)) for c in names}
        *of, variance, z, energy = (vectors(b.column(f"p{i}")) for i in range(many))
        flat, embedded = np.empty((b.num_rows, width)), make(*of)
        if embedded.shape != (b.num_rows, width - 3):
            raise ValueError("the acoustic vector has another width")
        flat[:, : width - 3] = embedded
        flat[:, width - 3], flat[:, width - 2], flat[:, width - 1] = variance, z, energy
        out = first | lists | {"duration_targets": lists["match_targets"], "acoustic_flat": packed.pack(flat, width * starts), "seq_len": pa.array(np.diff(starts).astype(np.int32))}
        return pa.RecordBatch.from_arrays([out[c] for c in schema.names], names=schema.names)

    def some(b: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin, most = 0, PACKED_BYTES // (8 * width)
        while begin < len(starts) - 1:
            stop = max(begin + 1, int(np.searchsorted(starts, starts[begin] + most, "right")) - 1)
            yield made(b.slice(starts[begin], starts[stop] - starts[begin]), starts[begin : stop + 1])
            begin = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a word whose end isn't there yet
        for b in batches:
            starts = np.flatnonzero(b.column("at").to_numpy() == 1)
            if len(starts):
                if held or starts[0]:
                    word = pa.concat_batches([*held, b.slice(0, starts[0])])
                    yield from some(word, np.array([0, word.num_rows]))
                yield from some(b, starts)
                b, held = b.slice(starts[-1]), []
            held.append(b)
        if held:
            word = pa.concat_batches(held)
            yield from some(word, np.array([0, word.num_rows]))

    return rows.mapInArrow(run, schema)


def acoustic_vector(embedding: Column, variance: Column, z: Column, energy: Column, width: int = ACOUSTIC_WIDTH) -> Column:
    """FN-24: the embedding and three scalars; another width than ``width`` is an error."""
    v = F.concat(embedding, F.array(variance, z, energy))
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.lit("the acoustic vector has another width")).cast("array<double>"))


def two_level_offsets(df: DataFrame, key: str, order: str, size: str, block_rows: int = 4096, sizes: DataFrame | None = None) -> DataFrame:
    """WN-06: ``offset``, the sum of ``size`` over the rows of ``key`` before this one in ``order``.

    ``order`` is a whole number; rows are summed within blocks of it, then over blocks, so no key's
    rows need to meet in one task. ``sizes`` (key, order, size) has the same rows where they are cheaper to read than ``df``,
    which is evaluated twice otherwise.
    """
    b = F.floor(F.col(order) / block_rows)
    inner = Window.partitionBy(key, "__b").orderBy(order)
    d = df.withColumn("__b", b)
    totals = (d if sizes is None else sizes.withColumn("__b", b)).groupBy(key, "__b").agg(F.sum(size).alias("__t"))
    before = totals.select(F.col(key).alias("__k"), F.col("__b").alias("__kb"), (F.sum("__t").over(Window.partitionBy(key).orderBy("__b")) - F.col("__t")).alias("__before"))
    d = d.withColumn("__in", F.sum(size).over(inner) - F.col(size))
    same = F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__kb"))
    return d.join(before, same).withColumn("offset", (F.col("__before") + F.col("__in")).cast("long")).drop("__b", "__k", "__kb", "__before", "__in")


def ranked(df: DataFrame, key: str, order: str, block: int = 4096) -> DataFrame:
    """``rn`` from 0 in ``order`` within ``key`` by the same two levels."""
    return two_level_offsets(df.withColumn("__one", F.lit(1).cast("long")), key, order, "__one", block).withColumnRenamed("offset", "rn").drop("__one")


def shard_index(df: DataFrame, key: str, order: str, shard_size: int) -> DataFrame:
    """WN-05."""
    return ranked(df, key, order).withColumn("shard", F.floor(F.col("rn") / shard_size).cast("int"))


def length_batches(df: DataFrame, key: str, order: str, batch: int, multiplier: int) -> DataFrame:
    """WN-10: buckets of batch * multiplier rows in order, sorted by length inside, cut into batches."""
    d = ranked(df, key, order).withColumn("bucket", F.floor(F.col("rn") / (batch * multiplier)).cast("int"))
    at = F.row_number().over(Window.partitionBy(key, "bucket").orderBy("seq_len", "rn")) - 1
    return d.withColumn("batch", F.floor(at / batch).cast("int"))


def pad(a: Column, to: Column, fill: Column) -> Column:
    """WN-11."""
    return F.concat(a, F.array_repeat(fill, to - F.size(a)))


def valid_mask(n: Column, to: Column) -> Column:
    """WN-11: true for real positions."""
    return F.transform(F.sequence(F.lit(1), to), lambda i: i <= n)


def masked(a: Column, mask: Column) -> Column:
    """FLT-07: the values where the mask is true."""
    return F.filter(a, lambda x, i: F.get(mask, i))


def block_shuffle(df: DataFrame, key: str, order: str, batch: int, block_words: int, seed: int, epoch: int, drop_last: bool = False) -> DataFrame:
    """WN-12: a deterministic shuffle of blocks and of rows inside them: ``block_order``, the block's place among its key's blocks,
    and ``batch_in_block``. A batch never crosses a block; with ``drop_last`` rows of batches that aren't full go.

    Places are keyed permutations of row numbers, so nothing is sorted for them and no block meets in one task.
    """
    size = max(batch, block_words)
    d = ranked(df, key, order)
    n = d.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each key
    d = d.join(n, F.col(key).eqNullSafe(F.col("__key"))).withColumn("block", F.floor(F.col("rn") / size).cast("long"))
    draw = F.lit(seed * 1_000_003 + epoch * 10_007)
    rows = F.least(F.lit(size), F.col("__n") - F.col("block") * size)
    d = d.withColumn("block_order", permuted(F.col("block"), F.ceil(F.col("__n") / size), draw))
    d = d.withColumn("batch_in_block", F.floor(permuted(F.col("rn") % size, rows, draw + 1 + F.col("block")) / batch).cast("int"))
    if drop_last:
        d = d.where((F.col("batch_in_block") + 1) * batch <= rows)
    return d.drop("__key", "__n")


def batch_count(rows: Column, batch: int, block_words: int, drop_last: bool = False) -> Column:
    """WN-12: how many batches a split has."""
    size = max(batch, block_words)
    full, rest = F.floor(rows / size), rows % size
    per = size // batch if drop_last else -(-size // batch)
    tail = F.floor(rest / batch) if drop_last else F.ceil(rest / batch)
    return (full * per + tail).cast("long")


def _next_start(sums: list[int], at: int, cap: int, sorted_: bool) -> int:
    """Where the batch after the one that starts at ``at`` starts; the length where it doesn't end. ``sums`` has a leading 0."""
    most = sums[at] + cap
    if sorted_:
        return max(at + 1, bisect_right(sums, most, at + 1) - 1)
    return next((j for j in range(at + 1, len(sums) - 1) if sums[j + 1] > most), len(sums) - 1)


def _known(sizes: list[int | None]) -> tuple[list[int], bool, bool]:
    """Prefix sums up to the first null, whether they only grow, and whether there is a null, after which no batch ends."""
    n = next((i for i, x in enumerate(sizes) if x is None), len(sizes))
    return [0, *accumulate(sizes[:n])], all(x >= 0 for x in sizes[:n]), n < len(sizes)


def _block_ends(sizes: list[int | None], cap: int, lowest: int) -> tuple[list[int], list[int], list[int | None], int | None]:
    """What a block of sizes does to the size used so far: the sums at which a first batch can start in it, how many
    batches start from there, the size used after them, and the sum of all where none starts. ``lowest``: of the size used so far."""
    sums, sorted_, null = _known(sizes)
    starts, tops = [], []
    for i, x in enumerate(sums[1:]):
        if not tops or x > tops[-1]:
            starts.append(i)
            tops.append(x)
            if x > cap - lowest:
                break
    found: dict[int, tuple[int, int | None]] = {len(sums) - 1: (0, None)}
    for start in starts:
        path, at = [], start
        while at not in found:
            path.append(at)
            at = _next_start(sums, at, cap, sorted_)
        n, used = found[at]
        for i in reversed(path):
            if n == 0:
                used = None if null else sums[-1] - sums[i]
            n += 1
            found[i] = (n, used)
    return tops, [found[i][0] for i in starts], [found[i][1] for i in starts], None if null else sums[-1]


def _block_batches(sizes: list[int | None], cap: int, batch: int, used: int | None, first: bool) -> list[int]:
    """The batch of each row of a block that begins in ``batch`` with ``used``."""
    out = []
    for x in sizes:
        if not first and used is not None and x is not None and used + x > cap:
            batch, used = batch + 1, 0
        first = False
        used = None if used is None or x is None else used + x
        out.append(batch)
    return out


def capped_batches(df: DataFrame, key: str, order: str, size: str, cap: int, block_rows: int = 4096) -> DataFrame:
    """WN-04: greedy batches in order; a batch starts anew where ``cap`` would be passed, so an oversize item stands alone.

    The state depends on where the last batch began. Rows are range-partitioned by key and order and cut
    into blocks of at most ``block_rows``; each block is summed up by what it does to any size that comes
    in (a few numbers, since a batch soon ends), these are chained over a key's blocks, and each block is
    then batched with what came in. So no key's rows meet in one task, and a key of any size can be done.
    """
    spark = df.sparkSession
    d = df.select(key, F.col(order).cast("long").alias(order), F.col(size).cast("long").alias("__size"))
    d = d.repartitionByRange(key, order, "__size").sortWithinPartitions(key, order, "__size").withColumn("__at", F.monotonically_increasing_id())
    rows = F.array_sort(F.collect_list(F.struct("__at", F.col(order).alias("o"), F.col("__size").alias("s"))))
    d = d.groupBy(key, F.floor(F.col("__at") / block_rows).alias("__b")).agg(F.min("__at").alias("__block"), rows.alias("r"))
    path = scratch(spark, "capped")
    d.select(key, "__block", F.transform("r", lambda x: x["o"]).alias("orders"), F.transform("r", lambda x: x["s"]).alias("sizes")).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    below = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(F.least(x, F.lit(0)), F.lit(0)))
    lowest = blocks.agg(F.sum(below)).first()[0] or 0

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_block_ends(x, cap, lowest) for x in b.column("sizes").to_pylist()]
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("__block"), *cols], names=[key, "__block", "tops", "ns", "ends", "total"])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, batch, used = None, 0, 0
        for b in batches:
            out = []
            for k, tops, ns, after, total in zip(*(b.column(c).to_pylist() for c in (key, "tops", "ns", "ends", "total")), strict=True):
                first = last != (k,)
                if first:
                    last, batch, used = (k,), 0, 0
                out.append((batch, used, first))
                if used is None:
                    continue
                at = 0 if first else bisect_right(tops, cap - used)
                if at < len(tops):
                    batch, used = batch + ns[at] - first, after[at]
                else:
                    used = None if total is None else used + total
            yield pa.RecordBatch.from_arrays([b.column("__block"), *(pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=["__block", "batch", "used", "first"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sizes = part.column("sizes").to_pylist()
                found = [_block_batches(*x) for x in zip(sizes, repeat(cap), *(part.column(c).to_pylist() for c in ("batch", "used", "first")))]
                keys = part.column(0).take(pa.array([i for i, x in enumerate(sizes) for _ in x], pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, part.column("orders").flatten(), pa.array([x for y in found for x in y], pa.int64())], names=[key, order, "batch"])

    kind = lambda **more: T.StructType([blocks.schema[key], *(T.StructField(k, t) for k, t in more.items())])
    n, many = T.LongType(), T.ArrayType(T.LongType())
    summed = blocks.mapInArrow(ends, kind(__block=n, tops=many, ns=many, ends=many, total=n))
    summed.repartition(key).sortWithinPartitions(key, "__block").mapInArrow(chain, "__block long, batch long, used long, first boolean").write.parquet(f"{path}/carried")
    carried = spark.read.parquet(f"{path}/carried")
    return blocks.join(carried, "__block").select(key, "orders", "sizes", "batch", "used", "first").mapInArrow(rows_of, kind(**{order: n, "batch": n}))
