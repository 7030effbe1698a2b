"""Alignment of two tokenizers' tokens by byte ranges, with the document counts of linked ids.

Byte offsets where a token of both ends cut a text into groups. A chunk of a text's bytes gives a fragment: the open
prefix (tokens up to its first common end), the closed groups between its first and last common end, and the open
suffix (tokens after the last). Fragments compose: the left suffix and the right prefix close a group, or stay open
while a side has no common end. Composition is associative, so chunks of a very long text are aligned by any tasks and
their open ends meet in a tree of small groups; closed groups stay where they are made.

A text of up to ``long_bytes`` is one chunk. A longer one is cut for encoding before spaces that follow other characters
(no token of either file reaches across one) and for alignment at multiples of ``chunk_bytes``, wherever these fall.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, if_few, text_of, worker_cache, written
from cadenza.llm.tokens import ByteBpe, read_tokenizer

SPACE_MARK = "▁"
#: Texts that go through numpy together; pairs that a task counts before it sends them on.
ROWS, HELD_PAIRS = 64, 2_000_000
#: Pairs whose counts are broadcast (20 bytes each); the rest, all of them rare, are joined.
HEAD_PAIRS = 1_000_000
#: Fragments that one group of the tree composes.
FAN = 16


class TokenBytes:
    """The bytes of every id of a vocabulary, as one array with offsets."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.start[ids], size) + at]


class Encoders:
    """Both tokenizers: a byte-level file (A) and a piece file (B)."""

    def __init__(self, source: str, model: bytes):
        self.a = ByteBpe(source)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece holds a space after another character, so texts can't be cut before spaces")
        if max(len(pieces), len(self.a.token_bytes())) > 1 << 20:
            raise ValueError("an id needs more than the 20 bits that a pair gives it")
        self.bytes_a = TokenBytes(self.a.token_bytes())
        self.bytes_b = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The ids of both, and which texts both of them spell byte by byte (empty ones don't count); the others have no ids."""
        whole = [(" " + t).encode() for t in texts]
        a = [self.a.ordinary_ids(" " + t) for t in texts]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        size = np.array([len(w) for w in whole])
        fit = np.array([len(w) > 1 and self.bytes_a.size[x].sum() == len(w) == self.bytes_b.size[y].sum() for w, x, y in zip(whole, a, b)], bool)
        for i in np.flatnonzero(fit):
            w = np.frombuffer(whole[i], np.uint8)
            fit[i] = np.array_equal(self.bytes_a.joined(a[i]), w) and np.array_equal(self.bytes_b.joined(b[i]), w)
        none = np.zeros(0, np.int64)
        return [x if ok else none for x, ok in zip(a, fit)], [y if ok else none for y, ok in zip(b, fit)], np.where(fit, size, 0)


def encoders(source: str, model: bytes) -> Encoders:
    made, key = worker_cache("token-align"), (hash(source), hash(model))
    if key not in made:
        made[key] = Encoders(source, model)
    return made[key]


class Aligned:
    """Tokens of both sides by their ends: groups, links and the text of the groups."""

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.b, self.ends_a, self.ends_b = a, b, ends_a, ends_b
        self.common = np.intersect1d(ends_a, ends_b, assume_unique=True)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, end) of every pair whose bytes overlap: each stretch between neighbouring ends of either side is one."""
        end = np.union1d(self.ends_a, self.ends_b)
        return self.a[np.searchsorted(self.ends_a, end)], self.b[np.searchsorted(self.ends_b, end)], end

    def rendered(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``a1,a2|b1;a3|b2,b3;``, and where each group's end among them."""
        of_a, of_b = np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)
        groups = np.arange(len(self.common) + 1)
        first_a, first_b = np.searchsorted(of_a, groups), np.searchsorted(of_b, groups)
        at_a, at_b = np.arange(len(of_a)) + first_b[of_a], np.arange(len(of_b)) + first_a[of_b + 1]
        ids, sep = np.empty(len(of_a) + len(of_b), np.int64), np.full(len(of_a) + len(of_b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = self.a, self.b
        sep[at_a[first_a[1:] - 1]], sep[at_b[first_b[1:] - 1]] = ord("|"), ord(";")
        tens = 10 ** np.arange(len(str(max(ids.max(initial=0), 1))) - 1, -1, -1)
        marks = np.column_stack([(ids[:, None] // tens % 10 + ord("0")).astype(np.uint8), sep])
        used = np.column_stack([(ids[:, None] >= tens) | (tens == 1), np.ones(len(ids), bool)])
        return marks[used], np.cumsum(used.sum(axis=1))[at_b[first_b[1:] - 1]]


def distinct_links(a: np.ndarray, b: np.ndarray, of: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each of n texts its distinct linked id pairs and how often each comes, as three list columns."""
    key = (of.astype(np.int64) << 40) | (a.astype(np.int64) << 20) | b
    distinct, times = np.unique(key, return_counts=True)
    offsets = pa.array(np.searchsorted(distinct >> 40, np.arange(n + 1)), pa.int32())
    low = (1 << 20) - 1
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in ((distinct >> 20) & low, distinct & low, times))


LINKS = "a array<int>, b array<int>, times array<int>"
TOTALS = "n_a long, n_b long, n_groups long, n_links long"


def align_short(docs: DataFrame, sent) -> DataFrame:
    """(doc_id, key, totals, groups_sha256, links) of texts that are one chunk each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        enc = encoders(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                a, b, size = enc.encode(part.column(1).to_pylist())
                n, bounds = len(size), np.cumsum(size)
                flat_a, flat_b = np.concatenate(a), np.concatenate(b)
                found = Aligned(flat_a, np.cumsum(enc.bytes_a.size[flat_a]), flat_b, np.cumsum(enc.bytes_b.size[flat_b]))
                la, lb, end = found.links()
                of = np.searchsorted(bounds, end)
                text, stops = found.rendered()
                n_groups = np.diff(np.searchsorted(found.common, bounds, "right"), prepend=0)
                stop = np.concatenate([[0], stops])[np.cumsum(n_groups)]
                digest = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(np.r_[0, stop[:-1]], stop)]
                totals = [[len(x) for x in a], [len(x) for x in b], n_groups, np.bincount(of, minlength=n)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(range(key, key + n), pa.int64()), *(pa.array(x, pa.int64()) for x in totals), pa.array(digest, pa.string()), *distinct_links(la, lb, of, n)],
                    names=["doc_id", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
                )
                key += n

    return docs.mapInArrow(run, f"doc_id long, key long, {TOTALS}, groups_sha256 string, {LINKS}")


def cut_long(docs: DataFrame, part_bytes: int) -> DataFrame:
    """(doc_id, key, part, at, text): space+text in parts of some ``part_bytes``, cut before spaces after other characters; ``at`` is a part's first byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (1 << 62) | (TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                whole, rows, begin, at = " " + text.as_py(), [], 0, 0
                last = len(whole) - 1  # a space that ends the text isn't a part: B adds none to nothing
                while begin < len(whole):
                    stop = whole.find(" ", begin + part_bytes, last)
                    while 0 <= stop and (whole[stop - 1].isspace() or whole[stop - 1] == SPACE_MARK):
                        stop = whole.find(" ", stop + 1, last)
                    stop = len(whole) if stop < 0 else stop
                    rows.append((len(rows), at, whole[begin + 1 : stop]))
                    at += len(whole[begin:stop].encode())
                    begin = stop
                part, ats, texts = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()] * len(rows), pa.int64()), pa.array([key] * len(rows), pa.int64()), pa.array(part, pa.int64()), pa.array(ats, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "key", "part", "at", "text"])
                key += 1

    return docs.mapInArrow(run, "doc_id long, key long, part long, at long, text string")


#: A closed row has ``body`` and links, an open one a fragment's ends; ``pos`` is the byte where its last group or its prefix ends.
PIECE = f"key long, chunk long, part long, pos long, ok boolean, body binary, {TOTALS}, {LINKS}, cut boolean, pa array<int>, pb array<int>, sa array<int>, sb array<int>"
PIECE_NAMES = [c.split()[0] for c in PIECE.split(", ")]


def closed_row(key: int, chunk: int, part: int, pos: int, found: Aligned) -> dict:
    """Whole groups of one text, rendered, with their links."""
    la, lb, _ = found.links()
    a, b, times = (x[0].as_py() for x in distinct_links(la, lb, np.zeros(len(la), np.int64), 1))
    return {"key": key, "chunk": chunk, "part": part, "pos": pos, "ok": True, "body": found.rendered()[0].tobytes(), "n_a": len(found.a), "n_b": len(found.b), "n_groups": len(found.common), "n_links": len(la), "a": a, "b": b, "times": times}


def open_row(key: int, chunk: int, part: int, pos: int, cut: bool, pa_, pb, sa=(), sb=()) -> dict:
    return {"key": key, "chunk": chunk, "part": part, "pos": pos, "ok": True, "cut": cut, "pa": list(map(int, pa_)), "pb": list(map(int, pb)), "sa": list(map(int, sa)), "sb": list(map(int, sb))}


def chunk_rows(key: int, part: int, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray, chunk_bytes: int) -> Iterator[dict]:
    """The fragment of each chunk: its closed groups if it has any, and its open ends. A token is in the chunk of its last byte."""
    in_a, in_b = (ends_a - 1) // chunk_bytes, (ends_b - 1) // chunk_bytes
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    for chunk in np.union1d(in_a, in_b).tolist():
        low, high = chunk * chunk_bytes, (chunk + 1) * chunk_bytes
        mine = common[(common > low) & (common <= high)]
        x, y = slice(*np.searchsorted(in_a, [chunk, chunk + 1])), slice(*np.searchsorted(in_b, [chunk, chunk + 1]))
        ids_a, e_a, ids_b, e_b = a[x], ends_a[x], b[y], ends_b[y]
        if not len(mine):
            yield open_row(key, chunk, part, -1, False, ids_a, ids_b)
            continue
        first, last = mine[0], mine[-1]
        yield open_row(key, chunk, part, int(first), True, ids_a[e_a <= first], ids_b[e_b <= first], ids_a[e_a > last], ids_b[e_b > last])
        if first < last:
            inner_a, inner_b = (e_a > first) & (e_a <= last), (e_b > first) & (e_b <= last)
            yield closed_row(key, chunk, part, int(last), Aligned(ids_a[inner_a], e_a[inner_a], ids_b[inner_b], e_b[inner_b]))


def fragments(parts: DataFrame, sent, chunk_bytes: int) -> DataFrame:
    """The fragments of all chunks of long texts; a part that the tokenizers don't spell gives one row with ``ok`` false."""
    schema = parts.sparkSession.createDataFrame([], PIECE).schema
    arrow = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoders(*sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                (a,), (b,), size = enc.encode([row["text"]])
                if not size[0]:
                    yield pa.RecordBatch.from_pylist([{"key": row["key"], "chunk": 0, "part": row["part"], "ok": False}], arrow)
                    continue
                rows = chunk_rows(row["key"], row["part"], a, row["at"] + np.cumsum(enc.bytes_a.size[a]), b, row["at"] + np.cumsum(enc.bytes_b.size[b]), chunk_bytes)
                yield pa.RecordBatch.from_pylist(list(rows), arrow)

    return parts.select("key", "part", "at", "text").mapInArrow(run, schema)


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[name]


def compose(rows: list[dict], size_a: np.ndarray, size_b: np.ndarray, top: bool) -> list[dict]:
    """The fragments of one text in order, as one open row and the groups that their composition closes; the top's prefix is a group too."""
    out, left = [], None

    def close(key, pos, a, b):
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        out.append(closed_row(key, 0, 0, pos, Aligned(a, np.cumsum(size_a[a]), b, np.cumsum(size_b[b]))))

    for r in rows:
        if left is None:
            left = dict(r)
        elif not r["cut"]:
            a, b = ("sa", "sb") if left["cut"] else ("pa", "pb")
            left[a], left[b] = [*left[a], *r["pa"]], [*left[b], *r["pb"]]
        else:
            if left["cut"]:
                close(r["key"], r["pos"], [*left["sa"], *r["pa"]], [*left["sb"], *r["pb"]])
            else:
                left.update(pa=[*left["pa"], *r["pa"]], pb=[*left["pb"], *r["pb"]], pos=r["pos"], cut=True)
            left["sa"], left["sb"] = r["sa"], r["sb"]
    if top:
        close(left["key"], left["pos"], left["pa"], left["pb"])
        return out
    return [left, *out]


def composed(opened: DataFrame, chunks: int, sizes) -> DataFrame:
    """All groups closed by composing open ends in a tree, FAN chunks at a time."""
    names = ["key", "chunk", "part", "pos", "cut", "pa", "pb", "sa", "sb"]
    level, closed = opened.select(*names), None

    def step(top: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = pdf.sort_values(["chunk", "part"]).to_dict("records")
            made = compose(rows, *sizes.value, top)
            return pd.DataFrame([{**dict.fromkeys(PIECE_NAMES), **r, "chunk": int(rows[0]["chunk"]) // FAN, "ok": True} for r in made], columns=PIECE_NAMES, dtype=object)

        return run

    while True:
        chunks = -(-chunks // FAN)
        top = chunks <= 1
        made = written(level.groupBy("key", F.floor(F.col("chunk") / FAN).alias("__up")).applyInPandas(step(top), PIECE), "align-level")
        new = made.where(F.col("body").isNotNull())
        closed = new if closed is None else closed.unionByName(new)
        if top:
            return closed
        level = made.where(F.col("body").isNull()).select(*names)


def digests(closed: DataFrame) -> DataFrame:
    """(key, totals, groups_sha256): a text's closed rows stream through one digest in the order of their bytes; none is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, *totals, sha.hexdigest())], names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])

        key, sha, totals = None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["key"] != key:
                    if key is not None:
                        yield row()
                    key, sha, totals = r["key"], hashlib.sha256(), [0, 0, 0, 0]
                else:
                    sha.update(b";")
                sha.update(r["body"][:-1])
                totals = [x + r[c] for x, c in zip(totals, ("n_a", "n_b", "n_groups", "n_links"))]
        if key is not None:
            yield row()

    rows = closed.select("key", "pos", "body", "n_a", "n_b", "n_groups", "n_links")
    return rows.repartition("key").sortWithinPartitions("key", "pos").mapInArrow(run, f"key long, {TOTALS}, groups_sha256 string")


def pair_documents(short: DataFrame, long: DataFrame | None) -> DataFrame:
    """(a, b, n): how many documents hold each pair linked; counts of short texts are summed in each task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array(keys >> 20, pa.int32()), pa.array(keys & ((1 << 20) - 1), pa.int32()), pa.array(n)], names=["a", "b", "n"])

        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            x, times = np.unique((batch.column(0).flatten().to_numpy().astype(np.int64) << 20) | batch.column(1).flatten().to_numpy(), return_counts=True)
            keys, back = np.unique(np.r_[keys, x], return_inverse=True)
            n = np.bincount(back, np.r_[n, times]).astype(np.int64)
            if len(keys) > HELD_PAIRS:
                yield row()
                keys, n = keys[:0], n[:0]
        yield row()

    found = short.select("a", "b").mapInArrow(run, "a int, b int, n long")
    if long is not None:
        each = long.select("key", F.explode(F.arrays_zip("a", "b")).alias("x")).select("key", "x.a", "x.b").distinct()
        found = found.unionByName(each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    return found.groupBy("a", "b").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with ``best``: whether n is the largest of its a."""
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def split_counts(counts: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(head, tail): the pairs of largest n, ``most`` at the most, and the others if there are any."""
    if counts.count() <= most:
        return counts, None
    size = F.floor(F.log2(F.col("n"))).cast("int")
    held, least = 0, 64
    for r in sorted(counts.groupBy(size.alias("p")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["p"]):  # 64 rows at most
        held += r["k"]
        if held > most:
            break
        least = r["p"]
    return counts.where(size >= least), counts.where(size < least)


def looked_up(rows: DataFrame, head: DataFrame) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum`` over those of their links that ``head`` holds, and ``rest``, the others."""
    found = head.toPandas().sort_values(["a", "b"])  # bounded by split_counts
    sent = rows.sparkSession.sparkContext.broadcast(((found["a"].to_numpy(np.int64) << 20) | found["b"].to_numpy(np.int64), found["n"].to_numpy(np.int64), found["best"].to_numpy(bool)))
    own = [c for c in rows.columns if c not in ("a", "b", "times")]
    rest = "array<struct<a:int,b:int,times:int>>"
    schema = rows.select(*own, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), F.array().cast(rest).alias("rest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = sent.value
        for batch in batches:
            lists = [batch.column(batch.num_columns - k) for k in (3, 2, 1)]
            size = lists[0].value_lengths().to_numpy()
            a, b, times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            of, pair = np.repeat(np.arange(len(size)), size), (a << 20) | b
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            n_best, total = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            np.add.at(n_best, of[known], times[known] * best[at[known]])
            np.add.at(total, of[known], times[known] * n[at[known]])
            left = pa.StructArray.from_arrays([pa.array(x[~known], pa.int32()) for x in (a, b, times)], names=["a", "b", "times"])
            offsets = pa.array(np.searchsorted(of[~known], np.arange(len(size) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(own))), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(offsets, left)], names=schema.names)

    return rows.select(*own, "a", "b", "times").mapInArrow(run, schema)


def align_tokens(docs: DataFrame, tokenizer: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = 1 << 16, part_bytes: int = 1 << 16, chunk_bytes: int = 1 << 14, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): one row per row of ``docs``.

    ``tokenizer`` is a byte-level file (A, encodes space+text), ``pieces`` a piece file (B, encodes text). Texts that are
    null or empty, or that either file doesn't spell byte by byte as space+text, have no tokens: zeros and ''. Rows that share an id or a text
    count each, also as documents of a pair; a null id stays null. Other columns of ``docs`` aren't read. Of a long text no task holds more than
    its parts, but one without a space to cut before is encoded whole.
    """
    spark = docs.sparkSession
    with open(pieces, "rb") as f:
        source, model = read_tokenizer(tokenizer), f.read()
    sent = spark.sparkContext.broadcast((source, model))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(F.col(text_col)).alias("text"))
    size = F.octet_length("text")
    short = written(align_short(d.where(size <= long_bytes), sent), "align-short")
    parts = written(cut_long(d.where(size > long_bytes), part_bytes), "align-parts")
    ends = parts.agg(F.max(F.col("at") + F.octet_length("text") + 1)).first()[0]
    closed = None
    if ends:
        enc = Encoders(source, model)
        sizes = spark.sparkContext.broadcast((enc.bytes_a.size, enc.bytes_b.size))
        made = written(fragments(parts.repartition("key", "part"), sent, chunk_bytes), "align-fragments")
        bad = if_few(written(made.where(~F.col("ok")).select("key").distinct(), "align-bad"))
        made = made.join(bad, "key", "left_anti")
        closed = made.where(F.col("body").isNotNull()).unionByName(composed(made.where(F.col("body").isNull()), -(-ends // chunk_bytes), sizes))
    counts = written(with_best(written(pair_documents(short, closed), "align-counts")), "align-best")
    head, tail = split_counts(counts, head_pairs)
    out = looked_up(short, head)
    if closed is not None:
        whole = parts.where(F.col("part") == 0).select("doc_id", "key")
        sums = looked_up(closed.select("key", "a", "b", "times"), head)
        sums = sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.flatten(F.collect_list("rest")).alias("rest")) if tail is not None else sums.groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"), F.first("rest").alias("rest"))
        long = whole.join(digests(closed), "key", "left").join(sums, "key", "left")
        long = long.select(*[F.col(c) if c in ("doc_id", "key", "rest") else F.coalesce(c, F.lit("")).alias(c) if c == "groups_sha256" else F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in out.columns])
        out = out.unionByName(long)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if tail is None:
        return out.select(*names)
    out = written(out, "align-open")
    more = out.select("key", F.explode("rest").alias("x")).select("key", "x.*").join(tail, ["a", "b"])
    more = more.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    out = out.join(more, "key", "left")
    return out.select(*[(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) if (m := {"n_best": "more_best", "count_sum": "more_sum"}.get(c)) else F.col(c) for c in names])
