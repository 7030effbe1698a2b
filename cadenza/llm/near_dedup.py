"""Near-duplicate documents by b-bit MinHash.

1. Each document's set of word shingles is hashed to 64 bits; exact copies of a set collapse to one
   node, so copies never meet each other again. Nodes have numbers of their own, since rows with
   unlike sets can share an id; at the end a component's number becomes its smallest document id.
2. ``bands x rows`` minima per node give band buckets. Nodes that share a bucket get a signature: the
   low ``BITS`` bits of ``MINIMA`` minima, packed into longs.
3. In every bucket each member meets the bucket's leader only (a star). Pairs whose collision-corrected
   similarity, estimated from bit counts, is clearly below the threshold go; the rest is confirmed on full sets.
4. Members of one bucket that are still in different components are compared in a join whose
   condition holds the bit-count estimate, so only likely pairs are emitted, each from the first bucket
   that it shares. While that would need too many comparisons, further leaders take a round each: a
   leader that has met all members leaves its bucket. No pair of a bucket goes uncompared unless both
   ends are already joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, if_few, mix64, text_of, worker_cache, written
from cadenza.llm.components import components

BITS, MINIMA = 4, 512
PER_LONG, LONGS = 64 // BITS, MINIMA * BITS // 64
#: Pairs estimated this far below the threshold go: 4.9 standard deviations of an estimate from 512 minima at 0.85.
MARGIN = 0.08
#: Up to so many documents, small tables are read back in a few tasks instead of one for each shuffle partition.
FEW_DOCS, DOCS_PER_TASK = 1_000_000, 8_000
CACHE_WORDS = 500_000


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; a bounded cache lives as long as the worker."""
    known = worker_cache("near-dedup")
    if len(known) > CACHE_WORDS:
        known.clear()
    get, out = known.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = known[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's k-word shingles.

    Words are runs without ASCII white space, A-Z lower-cased. With fewer than k words the whole
    sequence is the one shingle (its length is part of the hash); without words the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of the n hash functions."""
    seed = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix64(seed[:n]) & np.uint64(0xFFFFFFFF) | np.uint64(1)).astype(np.uint32), mix64(seed[n:]).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set that isn't empty."""
    x = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):  # blocks that stay in the processor's cache
        y = x[at : at + 2048][None, :] * a[:, None]
        y += b[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        y ^= y >> np.uint32(13)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int, rows: int) -> DataFrame:
    """(id, n, s1, s2, bands, t): set size, two hashes of the set, band hashes (none for an empty set), the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(bands * rows)
        base = (np.arange(bands, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, s1, s2, band = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                s1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
                s2.append(int(mix64(s + np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                h = base
                if len(s):
                    m = minima(s, a, b).astype(np.uint64).reshape(bands, rows)
                    for r in range(rows):
                        h = mix64(h * np.uint64(31) + m[:, r])
                band.append(h.view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _lists(band), batch.column(2)], names=["id", "n", "s1", "s2", "bands", "t"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text_col)).alias("text"), text_hash(F.col(text_col)).alias("t"))
    return rows_in.mapInArrow(run, "id long, n long, s1 long, s2 long, bands array<long>, t long")


def text_hash(text: Column) -> Column:
    """Tells rows that share an id apart."""
    return F.xxhash64(text_of(text))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def sets_of(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, sig, s): set size, packed low bits of minima, and the full shingle set for confirming."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = multipliers(MINIMA)
        shift = (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))[None, :]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), k) for t in part.column(1)]
                sig = [((minima(s, a, b).astype(np.uint64) & np.uint64(2**BITS - 1)).reshape(LONGS, PER_LONG) << shift).sum(axis=1, dtype=np.uint64).view(np.int64) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), _lists(sig), _lists([s.view(np.int64) for s in sets])], names=["id", "n", "sig", "s"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(F.col(text_col)).alias("t")).mapInArrow(run, "id long, n long, sig array<long>, s array<long>")


def estimate(sa: Column, sb: Column) -> Column:
    """Similarity from two packed signatures: the share of equal fields, corrected for chance collisions."""
    low = F.lit(sum(1 << (BITS * i) for i in range(PER_LONG)))
    differ = None
    for i in range(LONGS):
        x = F.get(sa, F.lit(i)).bitwiseXOR(F.get(sb, F.lit(i)))
        any_bit = x
        for bit in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(x, bit))
        n = F.bit_count(any_bit.bitwiseAND(low))
        differ = n if differ is None else differ + n
    equal = 1 - differ / F.lit(float(MINIMA))
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * |A and B| >= percent * |A or B|, on full sets."""
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")).hint("merge"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum")).where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 6, most_pairs: int = 64, free_pairs: int = 20_000_000, with_hash: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept): one row per row of ``docs``; with ``with_hash`` also ``text_hash``.

    Two documents are linked if the Jaccard similarity of their k-word shingle sets is at least
    ``percent`` / 100; a component's id is the smallest document id in it, and that document is kept.
    Documents without words have an empty set and link with nothing. Rows that share an id get the
    label of their own set each. A null id is labelled null and kept. With 32 bands of 6 rows a pair at
    the threshold of 0.85 shares no band with a chance of 3e-7 (at 0.8, with 40 bands: 5e-6).
    The last step makes at most ``free_pairs`` comparisons, or ``most_pairs`` per document if that is
    more; beyond that further star rounds come first. This bounds work, it drops nothing.
    """
    sigs = written(signatures(docs, id_col, text_col, k, bands, rows), "nd-sig")
    n_docs = sigs.count()
    few = lambda df: df.coalesce(max(4, n_docs // DOCS_PER_TASK)) if n_docs <= FEW_DOCS else df
    # exact copies of a set: one node. Empty sets stay alone.
    nodes = few(sigs.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "t")).alias("r"), F.min_by("bands", "id").alias("bands")))
    # numbered in the order of ids: early documents are often the originals, which as leaders meet the same members in all buckets
    nodes = nodes.select(F.col("r.id").alias("doc"), F.col("r.t").alias("t"), "s1", "s2", "n", "bands").repartitionByRange("doc", "t").sortWithinPartitions("doc", "t")
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "*"), "nd-nodes")
    buckets = nodes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = few(buckets.groupBy("bucket").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("m"))).where(F.col("m") > 1).select("bucket", "leader")
    members = written(few(buckets.join(shared.hint("merge"), "bucket")), "nd-members")
    # few documents share a bucket; then only their ids travel, and the texts stay where they are
    busy = members.select("id").distinct().join(nodes.select("id", "doc", "t"), "id")
    busy = if_few(written(few(busy.select(F.col("doc").alias("__nd_id"), F.col("t").alias("__nd_hash"), F.col("id").alias("__nd_node"))), "nd-busy"))
    mine = docs.select(F.col(id_col).cast("long").alias("__nd_id"), text_hash(F.col(text_col)).alias("__nd_hash"), F.col(text_col).alias("__nd_text")).join(busy, ["__nd_id", "__nd_hash"])
    # a row each, should rows share an id and a text
    sets = written(few(sets_of(mine, "__nd_node", "__nd_text", k).dropDuplicates(["id"])), "nd-sets")
    percent_of = percent / 100
    sized = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    likely = lambda x, y: estimate(x, y) >= percent_of - MARGIN
    end = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    links: DataFrame | None = None
    while True:
        # every member meets its bucket's leader
        star = few(members.where(F.col("id") != F.col("leader")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
        cand = few(star.join(end("a").hint("merge"), "a")).join(end("b").hint("merge"), "b")
        cand = few(cand.where(sized(F.col("na"), F.col("nb")) & likely(F.col("sa"), F.col("sb"))).select("a", "b"))
        found = written(few(confirm(cand, sets, percent)), "nd-links")
        links = found if links is None else links.union(found)
        comp = components(links, few)
        # what is left: buckets whose members, the leader apart, are in more than one component
        labelled = written(few(members.where(F.col("id") != F.col("leader")).join(comp.withColumnRenamed("node", "id"), "id", "left").select("bucket", "band", "id", F.coalesce("component", "id").alias("c"))), "nd-labelled")
        forget(members)
        per = labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("id").alias("leader"), F.count(F.lit(1)).cast("double").alias("m"))
        open_ = written(few(per.where(F.col("c0") != F.col("c1"))), "nd-open")
        total = open_.agg(F.sum(F.col("m") * F.col("m") / 2)).first()[0] or 0
        if not total:
            break
        members = labelled.join(open_.select("bucket", "leader").hint("merge"), "bucket")
        if total > max(free_pairs, most_pairs * n_docs):
            members = written(few(members.drop("c")), "nd-members")
            continue
        x = few(members.join(nodes.select("id", "bands").join(sets.select("id", "n", "sig"), "id").hint("merge"), "id"))
        side = lambda c: x.select("bucket", F.col("band").alias(f"i{c}"), *[F.col(y).alias(z + c) for y, z in (("id", ""), ("c", "c"), ("n", "n"), ("sig", "s"), ("bands", "b"))])
        first = ~F.arrays_overlap(F.slice("ba", F.lit(1), F.col("ia")), F.slice("bb", F.lit(1), F.col("ia")))
        meet = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & sized(F.col("na"), F.col("nb")) & likely(F.col("sa"), F.col("sb")) & first
        cand = written(few(side("a").alias("l").join(side("b").alias("r").hint("merge"), meet).select("a", "b")), "nd-cand")
        found = written(few(confirm(cand, sets, percent)), "nd-links")
        if found.limit(1).count():
            comp = components(links.union(found), few)
        break
    forget(sets)
    # a component's number becomes its smallest document id
    tops = if_few(written(few(comp.join(nodes.select(F.col("id").alias("node"), "doc"), "node").groupBy("component").agg(F.min("doc").alias("top"))), "nd-tops"))
    tops = few(comp.join(tops, "component")).select("node", "top")
    roots = few(nodes.select("s1", "s2", "n", "doc", F.col("id").alias("node")).join(tops, "node", "left").select("s1", "s2", "n", F.coalesce("top", "doc").alias("root")))
    out = sigs.select("id", "n", "s1", "s2", "t").join(roots.hint("merge"), ["s1", "s2", "n"], "left")
    own = F.coalesce("root", "id")
    more = [F.col("t").alias("text_hash")] if with_hash else []
    return few(out.select("id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"), *more))
