"""Line deduplication by a sharded minimal perfect hash.

One pass counts line keys (hash pairs only, combined on the map side); a key that is in one row alone
needs no entry. The others are dealt to shards; each shard becomes one minimal perfect hash that indexes
a fingerprint, a count and a keeper array. Documents probe these arrays: the count found there decides
whether a line is repeated, the keeper where it stays. Lines are never joined.

An index of at most ``most_bytes`` is broadcast and probed as documents stream by. A larger one stays
where it is: hashes of long lines travel to the shards, only the places of dropped lines come back, and
documents are read once more to drop them. Neither way rewrites documents or gathers the index.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ASCII_SPACE, ascii_lower, forget, if_few, mix64, text_of, written

GAMMA = 2.0


class PerfectHash:
    """Minimal perfect hash over distinct (h1, h2) pairs: a cascade of bit arrays with ranks.

    At each level a key that is alone in its slot stays there; the others go on to the next level.
    A key's index is the number of taken slots before its own, so n keys get 0..n-1.
    """

    def __init__(self, h1: np.ndarray, h2: np.ndarray):
        self.sizes: list[int] = []
        bits: list[np.ndarray] = []
        left = np.arange(len(h1))
        while len(left):
            m = (int(GAMMA * len(left)) | 63) + 1
            slot = self._slot(h1[left], h2[left], len(self.sizes), m)
            alone = np.bincount(slot, minlength=m) == 1
            bits.append(alone)
            self.sizes.append(m)
            left = left[~alone[slot]]
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.bits = np.packbits(flat)
        # rank before every block of 64 slots
        per = flat.reshape(-1, 64).sum(axis=1) if len(flat) else np.zeros(0, int)
        self.rank = np.concatenate([[0], np.cumsum(per)]).astype(np.int64)

    @staticmethod
    def _slot(h1: np.ndarray, h2: np.ndarray, level: int, m: int) -> np.ndarray:
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
        return (mix64(h1.view(np.uint64) ^ mix64(h2.view(np.uint64) + seed)) % np.uint64(m)).astype(np.int64)

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The index of each key, -1 where no slot is taken; a stranger may get any index."""
        out = np.full(len(h1), -1, np.int64)
        left, base = np.arange(len(h1)), 0
        for level, m in enumerate(self.sizes):
            if not len(left):
                break
            at = base + self._slot(h1[left], h2[left], level, m)
            hit = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            found, word = at[hit], at[hit] >> 6
            # the slots taken in the same block before this one
            block = self.bits.reshape(-1, 8)[word]
            taken = np.unpackbits(block, axis=1)
            before = (taken * (np.arange(64)[None, :] < (found & 63)[:, None])).sum(axis=1)
            out[left[hit]] = self.rank[word] + before
            left, base = left[~hit], base + m
        return out


def build_shard(pdf):
    """One shard: the hash, then its arrays in index order."""
    h1, h2 = pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64)
    mph = PerfectHash(h1, h2)
    at = mph.index(h1, h2)
    fingerprint, count, keeper = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    fingerprint[at], count[at], keeper[at] = h2, pdf["n"].to_numpy(np.int64), pdf["keeper"].to_numpy(np.int64)
    blob = pickle.dumps((mph.sizes, mph.bits, mph.rank, fingerprint, count, keeper), protocol=5)
    return pdf.iloc[:1][["shard"]].assign(blob=[blob])


class Shard:
    def __init__(self, blob: bytes):
        mph = PerfectHash.__new__(PerfectHash)
        mph.sizes, mph.bits, mph.rank, self.fingerprint, self.count, self.keeper = pickle.loads(blob)
        self.mph = mph

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is held, its count and its keeper."""
        at = self.mph.index(h1, h2)
        held = at >= 0
        held[held] = self.fingerprint[at[held]] == h2[held]
        at = np.where(held, at, 0)
        return held, np.where(held, self.count[at], 0), np.where(held, self.keeper[at], 0)


def line_keys(lines):
    """The key of each line of an array column."""
    return F.transform(lines, lambda x: ascii_lower(F.trim(x, F.lit(ASCII_SPACE))))


def counted_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, n, keeper) of each key of min_chars or more that more than one row holds."""
    long_keys = F.array_distinct(F.filter(line_keys(F.split(text_of(F.col(text_col)), "\n")), lambda k: F.length(k) >= min_chars))
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.explode(long_keys).alias("k"))
    hashed = keys.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), "k").alias("h2"), "id")
    return hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") > 1)


def build_index(keys: DataFrame, shard_keys: int = 65_536) -> tuple[DataFrame, int]:
    """(shard, blob) and the number of shards: keys dealt by hash to shards of about shard_keys, each a perfect hash and its arrays."""
    shards = max(1, -(-keys.count() // shard_keys))
    dealt = keys.withColumn("keeper", F.coalesce("keeper", F.lit(NOBODY))).withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(build_shard, "shard long, blob binary"), shards


def _dropped(shard: Shard, h1: np.ndarray, h2: np.ndarray, own: np.ndarray, min_docs: int) -> np.ndarray:
    """Which lines go: their key is counted often enough and the row isn't its keeper."""
    found, count, keeper = shard.probe(h1, h2)
    return found & (count >= min_docs) & ((keeper != own) | (own == NOBODY))


def _probe(docs: DataFrame, blobs: dict[int, bytes], shards: int, min_docs: int) -> DataFrame:
    """Sets __ld_drop where a line of the row goes; the whole index is at hand."""
    blob = docs.sparkSession.sparkContext.broadcast(blobs)
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Shard(v) for k, v in blob.value.items()}
        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns)]
            ids, h1a, h2a = (columns[names.index(n)] for n in ("__ld_id", "__ld_h1", "__ld_h2"))
            offsets = h1a.offsets.to_numpy(zero_copy_only=False)
            offsets = offsets - offsets[0]
            h1, h2 = h1a.flatten().to_numpy(zero_copy_only=False), h2a.flatten().to_numpy(zero_copy_only=False)
            own = np.repeat(ids.to_numpy(zero_copy_only=False), np.diff(offsets))
            drop = np.zeros(len(h1), bool)
            asked = np.flatnonzero(h1 != 0) if len(h1) else np.zeros(0, np.int64)
            to = h1[asked] % shards  # numpy's % is pmod
            for k, shard in held.items():
                mine = asked[to == k]
                drop[mine] = _dropped(shard, h1[mine], h2[mine], own[mine], min_docs)
            columns[names.index("__ld_drop")] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(drop))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def _probe_shards(probes: DataFrame, index: DataFrame, shards: int, min_docs: int, copies: int = 16) -> DataFrame:
    """(id, t, pos) of the dropped lines among ``probes`` (id, t, pos, h1, h2).

    Each shard leads the stream of its probes, so a task holds one shard and one batch. A very common
    line sends all its probes to one shard; shards therefore have copies, dealt by the rows' ids.
    """
    to = F.pmod("h1", F.lit(shards)).alias("shard")
    asked = probes.select(to, F.pmod(F.xxhash64("id", "t"), F.lit(copies)).alias("copy"), F.lit(None).cast("binary").alias("blob"), "id", "t", "pos", "h1", "h2")
    none = [F.lit(None).cast(k).alias(n) for n, k in (("id", "long"), ("t", "long"), ("pos", "int"), ("h1", "long"), ("h2", "long"))]
    led = index.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))).alias("copy"), "blob", *none)
    stream = led.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("blob").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = -1, None
        for b in batches:
            t = b.to_pydict() if b.column(2).null_count < b.num_rows else None
            key = b.column(0).to_numpy() * copies + b.column(1).to_numpy()
            ids, h1, h2 = (b.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (3, 6, 7))
            leads = np.flatnonzero(np.asarray(b.column(2).is_valid()))
            keep = np.zeros(b.num_rows, bool)
            bounds = [0, *leads.tolist(), b.num_rows]
            for x, y in zip(bounds, bounds[1:]):
                if t is not None and y > x and t["blob"][x] is not None:
                    at, shard = int(key[x]), Shard(t["blob"][x])
                    x += 1
                if y <= x or shard is None:
                    continue
                mine = np.arange(x, y)[key[x:y] == at]  # probes of a shard without keys follow another's
                keep[mine] = _dropped(shard, h1[mine], h2[mine], ids[mine], min_docs)
            yield b.filter(pa.array(keep)).select(["id", "t", "pos"])

    return stream.mapInArrow(run, "id long, t long, pos int")


#: Stands for a null id: such a row is no key's keeper.
NOBODY = -(2**63)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, shard_keys: int = 65_536, most_bytes: int = 64 << 20) -> DataFrame:
    """The documents with ``kept_text``, ``n_lines`` (before) and ``n_dropped`` added.

    Lines end at \\n. A key is the line without ASCII white space at its ends, A-Z lower-cased; keys of
    at least ``min_chars`` code points in at least ``min_docs`` rows lose every line, except in the row
    with the largest id that holds the key (all its lines stay; rows that share that id all keep them).
    Null or empty text is one empty line. A row whose id is null counts as a document and never keeps
    a repeated line. Columns of the input named like an output column are replaced.
    """
    keys = written(counted_keys(docs, id_col, text_col, min_chars), "line-keys")
    index, shards = build_index(keys, shard_keys)
    index = written(index, "line-index")
    forget(keys)
    return apply_index(docs, index, shards, id_col, text_col, min_chars, min_docs, most_bytes)


def apply_index(docs: DataFrame, index: DataFrame, shards: int, id_col: str, text_col: str, min_chars: int, min_docs: int, most_bytes: int) -> DataFrame:
    own = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    text = text_of(F.col(text_col))
    lines = F.split(text, "\n")
    me = F.coalesce(F.col(id_col).cast("long"), F.lit(NOBODY))
    # a key too short is asked for with 0, which is never looked up
    hash_of = lambda make: F.transform("__ld_keys", lambda k: F.when(F.length(k) >= min_chars, make(k)).otherwise(F.lit(0)))
    first, second = hash_of(F.xxhash64), hash_of(lambda k: F.xxhash64(F.lit(1), k))
    if (index.agg(F.sum(F.length("blob"))).first()[0] or 0) <= most_bytes:
        blobs = {r["shard"]: bytes(r["blob"]) for r in index.collect()}
        df = docs.select(*own, me.alias("__ld_id"), line_keys(lines).alias("__ld_keys"))
        df = df.select(*own, "__ld_id", first.alias("__ld_h1"), second.alias("__ld_h2"), F.array().cast("array<boolean>").alias("__ld_drop"))
        df = _probe(df, blobs, shards, min_docs)
        gone = F.col("__ld_drop")
        goes = lambda i: F.get(gone, i)
        n_dropped = F.size(F.filter(gone, lambda d: d))
    else:
        mark = F.xxhash64(text)  # rows that share an id and a text lose the same lines
        df = docs.select(me.alias("id"), mark.alias("t"), line_keys(lines).alias("__ld_keys"))
        df = df.select("id", "t", F.posexplode(F.arrays_zip(first.alias("h1"), second.alias("h2"))).alias("pos", "h"))
        probes = df.select("id", "t", "pos", "h.h1", "h.h2").where(F.col("h1") != 0)
        places = _probe_shards(probes, index, shards, min_docs).groupBy("id", "t").agg(F.sort_array(F.collect_set("pos")).alias("__ld_pos"))
        places = if_few(written(places.select(F.col("id").alias("__ld_id"), F.col("t").alias("__ld_t"), "__ld_pos"), "line-places"), 100_000)
        df = docs.select(*own, me.alias("__ld_me"), mark.alias("__ld_mark"))
        df = df.join(places, (F.col("__ld_me") == F.col("__ld_id")) & (F.col("__ld_mark") == F.col("__ld_t")), "left")
        gone = F.coalesce("__ld_pos", F.array().cast("array<int>"))
        goes = lambda i: F.array_contains(gone, i)
        n_dropped = F.size(gone)
    kept = F.array_join(F.filter(lines, lambda _, i: ~goes(i)), "\n")
    return df.select(*own, F.when(n_dropped > 0, kept).otherwise(text).alias("kept_text"), F.size(lines).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
