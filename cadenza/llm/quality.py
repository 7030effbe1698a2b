"""Quality rules: base counts of every text, then a hashed n-gram log-likelihood ratio against the raw corpus.

Tokens (words without ASCII punctuation, and each punctuation mark) give 1- to ``ORDERS``-grams, hashed to ``BUCKETS``
buckets. Two multinomials are counted over all documents: the trusted target (documents labelled good) and the
raw corpus. A text's score is the mean over its n-grams of log p_target - log p_raw, so length doesn't move it.
The threshold comes from the trusted documents of a held-out fifth, which the target isn't counted from, and
decides every document alike.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import if_few, mix64, text_of, worker_cache, written

BUCKETS, ORDERS = 1 << 16, 2
#: Texts that go through numpy together.
ROWS = 64
#: A byte is white space (0), a punctuation mark (2) or part of a word (1).
KIND = np.ones(256, np.uint8)
KIND[list(string.punctuation.encode())] = 2
KIND[list(b" \t\n\x0b\x0c\r")] = 0
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
#: Words are hashed as polynomials of their bytes' values, so that sums of prefixes give every word at once.
BASE, VALUE = np.uint64(0x9FB21C651E98DF25), mix64(np.arange(1, 257, dtype=np.uint64))
WINDOW = 5
#: Scores are counted in steps of a thousandth between these ends to find the threshold.
STEP, LEAST, MOST = 1e-3, -25.0, 25.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 to n - 1 modulo 2**64, and their inverses; a worker keeps the longest so far."""
    kept = worker_cache("quality")
    if len(kept.get("up", ())) < n:
        kept["up"], kept["down"] = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (BASE, np.uint64(pow(int(BASE), -1, 2**64))))
    return kept["up"][:n], kept["down"]


class Block:
    """Some texts as one array of bytes, whose words are found and hashed together."""

    def __init__(self, texts: list[str]):
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.coded, self.n = coded, len(texts)
        self.data = b"\n".join(coded) + b"\n"
        self.bounds = np.cumsum([0, *(len(c) + 1 for c in coded)])
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.kind = KIND[self.bytes]
        up, self.down = powers(len(self.bytes))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[self.bytes] * up)])

    def words(self, marks: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash, text) of every word; with ``marks`` each punctuation mark is a word of its own."""
        before, after = np.r_[np.uint8(0), self.kind[:-1]], np.r_[self.kind[1:], np.uint8(0)]
        solid = self.kind > 0
        if marks:
            alone = self.kind == 2
            start, end = solid & (alone | (before != 1)), solid & (alone | (after != 1))
        else:
            start, end = solid & (before == 0), solid & (after == 0)
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        h = mix64((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64))
        return s, e, h, np.searchsorted(self.bounds, s, "right") - 1

    def per_text(self, what: np.ndarray) -> np.ndarray:
        """How many bytes of each text hold."""
        total = np.r_[0, np.cumsum(what)]
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def grams(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of n neighbouring words of one text, and where they begin."""
    g = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for i in range(n):
        g = mix64(g * np.uint64(0x9E3779B97F4A7C15) + h[i : len(g) + i])
    whole = np.flatnonzero(of[: len(g)] == of[n - 1 :])
    return g[whole], whole


def ngram_buckets(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the buckets of all n-grams of these texts, repeats included, and the text that each is from."""
    _, _, h, of = block.words(marks=True)
    for n in range(1, ORDERS + 1):
        g, at = grams(h, of, n)
        yield (g % np.uint64(BUCKETS)).astype(np.int64), of[at]


def base_counts(block: Block) -> list[np.ndarray]:
    """COUNTS of each text. Words are runs without ASCII white space, compared as they stand."""
    s, e, h, of = block.words(marks=False)
    n_words = np.bincount(of, minlength=block.n)
    chars = block.per_text((block.kind > 0) & (block.bytes & 0xC0 != 0x80))
    symbols = block.per_text(SYMBOL[block.bytes])
    lines = [[x for x in c.split(b"\n") if x and not x.isspace()] for c in block.coded]
    repeated = [len(x) - len(set(x)) for x in lines]
    # hashes find the windows that may be repeated, their words decide
    g, at = grams(h, of, WINDOW)
    key = mix64(g + of[at].astype(np.uint64))
    in_order = np.sort(key)
    twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
    at = at[np.isin(key, twice)] if len(twice) else at[:0]
    said = [(of[i], *(block.data[s[j] : e[j]] for j in range(i, i + WINDOW))) for i in at]
    times = Counter(said)
    edges = np.zeros(len(h) + 1, np.int64)
    again = np.array([i for i, x in zip(at, said) if times[x] > 1], np.int64)
    edges[again] += 1
    np.subtract.at(edges, again + WINDOW, 1)
    inside = np.cumsum(edges[:-1]) > 0
    return [n_words, chars, symbols, np.array(repeated, np.int64), np.bincount(of[inside], minlength=block.n)]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(id, held_out): ids that ``labels`` (doc_id, quality) calls good and never bad; a fifth by hash is held out of the target."""
    good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__q_id")).agg(F.min("quality").alias("q"))
    return good.where(F.col("q") == 1).select("__q_id", (F.crc32(F.col("__q_id").cast("string").cast("binary")) % 5 == 0).alias("__q_held"))


def fit_ratio(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_target - log p_raw of each bucket, add-one smoothed, counted over all documents.

    A task sends its counts once: at most BUCKETS rows, whatever its size.
    """
    d = docs.select(F.col(id_col).cast("long").alias("__q_id"), text_of(F.col(text_col)).alias("t")).join(trusted, "__q_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                mine = part.column(1).to_numpy(zero_copy_only=False)
                for bucket, of in ngram_buckets(Block(part.column(0).to_pylist())):
                    raw += np.bincount(bucket, minlength=BUCKETS)
                    target += np.bincount(bucket[mine[of]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counts = d.select("t", F.coalesce(~F.col("__q_held"), F.lit(False)).alias("mine")).mapInArrow(run, "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.any():
        return np.zeros(BUCKETS)  # nothing to compare with: every text scores 0
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def scored(docs: DataFrame, ratio: np.ndarray, text_col: str = "text") -> DataFrame:
    """The rows without their text, with COUNTS and ``score``, the mean ratio of a text's n-grams (0 without any)."""
    names = (*COUNTS, "score")
    own = [c for c in docs.columns if c not in names and c != text_col]
    df = docs.select(*own, text_of(F.col(text_col)).alias("__q_text"))
    schema = df.drop("__q_text").select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS], F.lit(0.0).alias("score")).schema
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = sent.value
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                block = Block(part.column(part.num_columns - 1).to_pylist())
                total, n = np.zeros(block.n), np.zeros(block.n, np.int64)
                for bucket, of in ngram_buckets(block):
                    total += np.bincount(of, r[bucket], block.n)
                    n += np.bincount(of, minlength=block.n)
                made = [*(pa.array(c, pa.int64()) for c in base_counts(block)), pa.array(total / np.maximum(n, 1))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(part.num_columns - 1)), *made], names=schema.names)

    return df.mapInArrow(run, schema)


def threshold(scores: DataFrame, lose: float) -> float:
    """The highest step below which at most the share ``lose`` of these scores lies; LEAST if there are none.

    Scores are counted by step, so at most (MOST - LEAST) / STEP rows reach the driver.
    """
    at = F.floor(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.col("score"))) / STEP).cast("long")
    steps = sorted((r["at"], r["n"]) for r in scores.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())
    total, below = sum(n for _, n in steps), 0
    for step, n in steps:
        if below + n > lose * total:
            return step * STEP
        below += n
    return LEAST


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lose: float = 0.002, least_words: int = 10, repeat_percent: int = 20) -> DataFrame:
    """(id_col, COUNTS, base_failed, score, threshold, kept): one row per row of ``docs``.

    ``base_failed``: fewer than ``least_words`` words, or more than ``repeat_percent`` % of them in repeated
    windows. ``kept``: not failed, and the score is not below the threshold, under which at most the share
    ``lose`` of the held-out trusted documents lies. Null text counts as empty: all counts 0, failed. A null id is
    never trusted. Rows that share an id each count and are judged on their own. Without trusted documents all
    scores are 0 and the base rules alone decide; an empty table gives an empty result.
    """
    trusted = if_few(written(trusted_ids(labels), "q-trusted"))
    out = written(scored(docs.select(F.col(id_col), F.col(text_col).alias("__q_in")), fit_ratio(docs, trusted, id_col, text_col), "__q_in"), "q-scores")
    held = out.join(trusted.where("__q_held"), F.col(id_col).cast("long") == F.col("__q_id"), "left_semi")
    at = threshold(held, lose)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return out.select(id_col, *COUNTS, failed.alias("base_failed"), "score", F.lit(at).alias("threshold"), (~failed & (F.col("score") >= at)).alias("kept"))
