"""Exact top-k by inner product over KD-trees, one tree per shard of vectors.

Median splits of a bounded sample deal vectors to shards, so a shard is a region. Its tree goes on
splitting at medians, and every node keeps the tight bounding box of its vectors; a box bounds the inner
product of any vector in it from above. A query walks a tree best bound first and stops when no bound can
reach its kth score. Each query first searches the shard that holds it; the kth score found there and the
shards' own boxes then tell which other shards it has to visit at all, before anything is shuffled. Each
shard's rows travel once, followed by the queries that visit it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import written

LEAF = 128
RESULT = "key long, query_id long, vec_id long, score long"
BOX = pa.schema([("shard", pa.int64()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))])


def integer_vector(c: Column, scale: int) -> Column:
    """floor(scale * x) of each component as longs; null for a vector that is null, holds a null or a value that isn't finite."""
    x = F.transform(c, lambda v: F.floor(v.cast("double") * scale).try_cast("long"))
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < 2.0**62 / scale))
    return F.when(fine, x)


class Tree:
    """A KD-tree in arrays: rows reordered so that each node is a slice, children after parents."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        n = len(ids)
        order = np.arange(n)
        self.start, self.end, self.left, self.right = [], [], [], []
        lo, hi = [], []
        todo = [(0, n, -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            node = len(self.start)
            if parent >= 0:
                (self.left if side == 0 else self.right)[parent] = node
            part = vectors[order[a:b]]
            self.start.append(a)
            self.end.append(b)
            self.left.append(-1)
            self.right.append(-1)
            low, high = part.min(axis=0), part.max(axis=0)
            lo.append(low)
            hi.append(high)
            axis = int((high - low).argmax()) if vectors.shape[1] else 0
            # rows that are all equal are one leaf, however many: they share one score
            if b - a > LEAF and high[axis] > low[axis]:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, axis], mid - a)]
                todo += [(mid, b, node, 1), (a, mid, node, 0)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that any vector in a node's box can have, for each query and node."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T

    def search(self, qid: int, query: np.ndarray, bound: np.ndarray, k: int, kth: int) -> list[tuple[int, int]]:
        """(score, id) of the best k rows with scores of at least ``kth``, the query's own row apart; ties to smaller ids."""
        best: list[tuple[int, int]] = []  # a heap of (score, -id): its top is the worst kept
        heap = [(-bound[0], 0)]
        while heap:
            upper, node = heapq.heappop(heap)
            if -upper < kth:  # equal scores may still win by a smaller id
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= kth:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            a, b = self.start[node], self.end[node]
            scores, ids = self.vectors[a:b] @ query, self.ids[a:b]
            fit = np.flatnonzero((scores >= kth) & (ids != qid))
            if len(fit) > k:
                fit = fit[np.lexsort((ids[fit], -scores[fit]))[:k]]
            for i in fit:
                item = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def _arrays(t: pa.Table, id_name: str = "id", vector_name: str = "v") -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(id_name).to_numpy()
    if not len(ids):
        return ids, np.zeros((0, 0))
    flat = t.column(vector_name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), -1)


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """Components as doubles while every product and sum is exact in them, else as longs."""
    top = max((float(np.abs(p.astype(float)).max()) if p.size else 0.0) for p in parts)
    dims = max((p.shape[1] if p.ndim == 2 else 0) for p in parts)
    kind = np.float64 if top * top * max(1, dims) < 2**52 else np.int64
    return [p.astype(kind) for p in parts]


LOWEST = -(2**62)


def _search(tree: Tree, keys: np.ndarray, qids: np.ndarray, queries: np.ndarray, kths: np.ndarray, k: int) -> pa.Table:
    rows: list[tuple[int, int, int, int]] = []
    for at in range(0, len(qids), 512):  # the bounds of 512 queries at a time
        bound = tree.bounds(queries[at : at + 512])
        for i in range(len(bound)):
            q, key = int(qids[at + i]), int(keys[at + i])
            rows += [(key, q, v, s) for s, v in tree.search(q, queries[at + i], bound[i], k, int(kths[at + i]))]
    columns = zip(*rows) if rows else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["key", "query_id", "vec_id", "score"])


#: The boxes of all shards, held by every task that deals queries, stay below so many bytes: shards grow with the table.
BOX_BYTES = 64 << 20


#: Bytes of vectors in the sample on the driver and in a shard, and the rows that a shard has at least.
SAMPLE_BYTES, SHARD_BYTES, LEAST_ROWS = 32 << 20, 64 << 20, 8_192


def plan_shards(vectors: np.ndarray, rows: int, shard_rows: int, first: int) -> tuple[list[tuple], int]:
    """Median splits of a sample that stands for ``rows`` rows: nodes (axis, threshold, left, right, shard, parts), and the next shard.

    A leaf of the sample that can't be split but stands for more rows than a shard holds has several
    parts: rows that are all equal are dealt to them by their ids.
    """
    nodes: list[tuple] = []
    each = rows / max(1, len(vectors))
    todo = [(np.arange(len(vectors)), -1, 0)]
    links: dict[tuple[int, int], int] = {}
    shard = first
    while todo:
        at, parent, side = todo.pop()
        node = len(nodes)
        if parent >= 0:
            links[parent, side] = node
        part = vectors[at]
        spread = part.max(axis=0) - part.min(axis=0) if len(at) and part.shape[1] else np.zeros(1)
        axis = int(spread.argmax())
        if len(at) * each > shard_rows and len(at) > 1 and spread[axis] > 0:
            x = part[:, axis]
            # the largest value goes right, so that both sides have rows
            threshold = min(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2], x[x < x.max()].max())
            nodes.append((axis, float(threshold), 0, 0, -1, 1))
            todo += [(at[x > threshold], node, 1), (at[x <= threshold], node, 0)]
        else:
            parts = max(1, int(-(-len(at) * each // shard_rows)))
            nodes.append((0, 0.0, 0, 0, shard, parts))
            shard += parts
    linked = [(n[0], n[1], links.get((i, 0), i), links.get((i, 1), i), n[4], n[5]) for i, n in enumerate(nodes)]
    return linked, shard


def route(nodes: list[tuple], ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The shard of each vector."""
    axis, threshold, left, right, shard, parts = (np.array(c) for c in zip(*nodes))
    at = np.zeros(len(vectors), np.int64)
    while True:
        inner = np.flatnonzero(shard[at] < 0)
        if not len(inner):
            break
        here = at[inner]
        goes = vectors[inner, axis[here]] <= threshold[here]
        at[inner] = np.where(goes, left[here], right[here])
    return shard[at] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[at]


def _dealt(base: DataFrame, nodes: dict[int, list[tuple]]) -> DataFrame:
    """``base`` with ``shard``; vectors of a length that the sample lacks have shards of their own after all others."""
    own = base.columns
    schema = base.select("*", F.lit(0).cast("long").alias("shard")).schema
    after = max((n[4] + n[5] for x in nodes.values() for n in x), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, d = b.column(own.index("id")).to_numpy(), b.column(own.index("d")).to_numpy()
            shard = after + d.astype(np.int64)
            for length in np.unique(d):
                if int(length) in nodes:
                    mine = np.flatnonzero(d == length)
                    flat = b.column(own.index("v")).take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False)
                    shard[mine] = route(nodes[int(length)], ids[mine], flat.reshape(len(mine), -1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int64())], names=schema.names)

    return base.mapInArrow(run, schema)


def _reached(queries: DataFrame, boxes: list, schema: str) -> DataFrame:
    """Each query once for every shard but its own whose box can hold a score of at least its kth."""
    by_length: dict[int, tuple] = {}
    for d in {len(r["lo"]) for r in boxes}:
        same = [r for r in boxes if len(r["lo"]) == d]
        by_length[d] = np.array([r["shard"] for r in same]), np.array([r["lo"] for r in same]), np.array([r["hi"] for r in same])
    shared = queries.sparkSession.sparkContext.broadcast(by_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column(2).value_lengths().to_numpy()
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                shards, lo, hi = shared.value[int(d)]
                for a in range(0, len(rows), 64):
                    part = b.take(pa.array(rows[a : a + 64]))
                    q = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    q, low, high = _exact(q, lo, hi)
                    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
                    fit = (bound >= part.column(3).to_numpy()[:, None]) & (part.column(4).to_numpy()[:, None] != shards[None, :])
                    i, s = np.nonzero(fit)
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(i)) for c in part.columns[:4]), pa.array(shards[s], pa.int64())], names=["key", "id", "v", "kth", "shard"])

    return queries.mapInArrow(run, schema)


def _visits(rows: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """What queries find in the shards that they visit: in each (shard, copy) the rows come first and make a tree, then its queries."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = rows.select("shard", "copy", F.lit(0).alias("kind"), none("long", "key"), "id", "v", none("long", "kth"))
    asked = pairs.select("shard", "copy", F.lit(1).alias("kind"), "key", "id", "v", "kth")
    stream = held.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, tree = None, [], [], None
        for b in batches:
            where = b.column(0).to_numpy() * (1 << 20) + b.column(1).to_numpy()
            kind = b.column(2).to_numpy()
            cuts = np.flatnonzero(np.diff(where) | np.diff(kind)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                part = b.slice(x, y - x)
                v = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(y - x, -1)
                if kind[x] == 0:
                    if where[x] != at:
                        at, ids, vectors = where[x], [], []
                    ids.append(part.column(4).to_numpy())
                    vectors.append(v)
                    tree = None
                    continue
                if where[x] != at:
                    continue
                tree = tree or Tree(np.concatenate(ids), np.concatenate(vectors))
                held_, q = _exact(tree.vectors, v)
                low, high = tree.lo.astype(held_.dtype), tree.hi.astype(held_.dtype)
                tree.vectors, tree.lo, tree.hi = held_, low, high
                yield from _search(tree, part.column(3).to_numpy(), part.column(4).to_numpy(), q, part.column(6).to_numpy(), k).to_batches()

    return stream.mapInArrow(run, RESULT)


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, shard_rows: int | None = None, shard_queries: int = 16_384, sample_rows: int = 65_536) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products with all other rows.

    Components become floor(scale * x). Ties go to the smaller id; fewer than k rows come back only if
    there are no more. Vectors that are null or hold null or non-finite components take no part, nor do
    components of 2^62 / scale or more, nor rows with a null id; vectors of different lengths aren't
    compared. Rows that share an id are candidates each, but none for a query with that id; query rows
    that share an id and a vector are one query, with another vector they have ten rows each. ``is_query``
    may use any column of ``vectors``; its other columns are left out.

    The ``sample_rows`` rows with the smallest hashes of their ids, or fewer so that they hold at most SAMPLE_BYTES, place the
    splits between shards and nothing else. Unless ``shard_rows`` says how many rows a shard has, it holds a fair share for every
    core, but at least LEAST_ROWS and at most SHARD_BYTES: a query visits shards, so there should be few.
    A shard visited by more than ``shard_queries`` queries has copies.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    base = base.where(F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("d", F.size("v")).withColumn("key", F.xxhash64("id", "v"))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("d").cast("long")).alias("all")).first()
    width = 8 * max(1, -(-(size["all"] or 0) // max(1, size["n"])))
    fair = size["n"] // (2 * vectors.sparkSession.sparkContext.defaultParallelism)
    shard_rows = max(shard_rows or max(LEAST_ROWS, min(fair, SHARD_BYTES // width)), -(-16 * (size["all"] or 0) // BOX_BYTES))
    sample = base.select("d", "v").orderBy(F.xxhash64("id", F.lit(2)), "id").limit(min(sample_rows, max(1, SAMPLE_BYTES // width))).toArrow()
    nodes, after = {}, 0
    lengths = sample.column("d").to_numpy()
    for d in sorted(set(lengths.tolist())):
        same = sample.filter(pa.array(lengths == d)).column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        nodes[d], after = plan_shards(same, max(1, size["n"] * len(same) // len(lengths)), shard_rows, after)
    rows = written(_dealt(base, nodes), "kd-rows")

    def home(t: pa.Table) -> pa.Table:
        ids, v = _arrays(t)
        (exact,) = _exact(v)
        tree = Tree(ids, exact)
        mine = np.flatnonzero(np.asarray(t.column("q").combine_chunks()))
        keys = t.column("key").to_numpy()[mine]
        once = mine[np.unique(keys, return_index=True)[1]]
        found = _search(tree, t.column("key").to_numpy()[once], ids[once], exact[once], np.full(len(once), LOWEST), k)
        box = pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "lo": [v.min(axis=0).tolist()], "hi": [v.max(axis=0).tolist()]}, schema=BOX)
        return pa.concat_tables([found, box], promote_options="default")

    first = written(rows.groupBy("shard").applyInArrow(home, f"{RESULT}, shard long, lo array<long>, hi array<long>"), "kd-home")
    found = first.where(F.col("shard").isNull()).select("key", "query_id", "vec_id", "score")
    kth = found.groupBy("key").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(LOWEST)).alias("kth"))
    asked = rows.where("q").select("key", "id", "v", "shard").dropDuplicates(["key", "id"]).join(kth, "key", "left")
    asked = asked.select("key", "id", "v", F.coalesce("kth", F.lit(LOWEST)).alias("kth"), F.col("shard").alias("own"))
    boxes = first.where(F.col("shard").isNotNull()).select("shard", "lo", "hi").collect()  # at most BOX_BYTES
    pairs = written(_reached(asked, boxes, "key long, id long, v array<long>, kth long, shard long"), "kd-pairs")
    # as many rows as shards
    copies = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / shard_queries).alias("copies"))
    held = rows.select("shard", "id", "v").join(F.broadcast(copies), "shard").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    sent = pairs.join(F.broadcast(copies), "shard").withColumn("copy", F.pmod(F.xxhash64("key"), F.col("copies")))
    every = found.unionByName(_visits(held, sent, k))
    best = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
