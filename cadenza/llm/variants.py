"""Spelling variants: words one code point apart, found by pairs of trie nodes.

Words are numbered in a forward trie (a node is a prefix) and a reversed one (a node is a suffix). Both tries come
from sorted words: a word shares nodes with the one before it as far as their common prefix goes, the rest are new.
Sorted blocks number their own nodes; what a block shares with the one before it is resolved from each block's first
and last word, so no task sees the whole dictionary.

A word of length L gives integer pairs (prefix node, suffix node): L + 1 that split it, and L that skip a code
point. Two words that skip into the same pair differ by one replacement; a word that skips into another's split
has one code point more. A pair's group holds one split and at most one skip for each letter of the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import forget, text_of, written

RUNS = re.compile("[a-zÀ-ÿ]+")
#: A run is altered where this divides its hash.
ALTER = 97
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 300_000


def spelled(doc_id: str, text: str, least: int) -> Iterator[tuple[str, int]]:
    """The words of one text with at least ``least`` code points, with their counts, after the alterations of its id."""
    lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(RUNS.findall(lowered)).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), start)
        if h % ALTER == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame, id_col: str, text_col: str, least: int, rare: int) -> DataFrame:
    """(word, n) of all words found at least ``rare`` times; counts are summed in each task before they travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        for b in batches:
            for i, t in zip(b.column(0), b.column(1)):
                for w, n in spelled(i.as_py(), t.as_py(), least):
                    held[w] = held.get(w, 0) + n
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = {}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(text_of(F.col(id_col)).alias("i"), text_of(F.col(text_col)).alias("t")).where(F.col("t") != "")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rare)


def numbered(words: DataFrame, key: Column, node: str) -> DataFrame:
    """``words`` with ``node``: the trie nodes of every prefix of ``key``, the shortest first; equal prefixes get equal numbers.

    Numbers grow with the order of keys: a key's last number is larger than that of every smaller key.
    """
    own = words.columns
    block = words.select("*", key.alias("__key")).repartitionByRange("__key").sortWithinPartitions("__key")
    schema = block.select("*", F.lit(0).alias("__block"), F.array().cast("array<long>").alias("__path")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before, path, made = TaskContext.get().partitionId(), "", [], 0
        for b in batches:
            paths = []
            for k in b.column(b.num_columns - 1).to_pylist():
                same = 0
                for x, y in zip(before, k):
                    if x != y:
                        break
                    same += 1
                path = path[:same] + list(range(made + 1, made + 1 + len(k) - same))
                made += len(k) - same
                before = k
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([at] * len(paths), pa.int32()), pa.array(paths, pa.list_(pa.int64()))], names=schema.names)

    local = written(block.mapInArrow(run, schema), "variant-trie")
    return local.join(F.broadcast(_resolved(local)), "__block").select(*own, F.transform("__path", lambda j: F.coalesce(F.get("shared", (j - 1).cast("int")), j + F.col("base"))).alias(node))


def _resolved(local: DataFrame) -> DataFrame:
    """(block, base, shared): a block's node j is ``shared[j]`` of an earlier block if there is one, else base + j. A row for each block."""
    end = F.struct("__key", "__path")
    ends = local.groupBy("__block").agg(F.min(end).alias("first"), F.max(end).alias("last"), F.max(F.array_max("__path")).alias("made"))
    rows, base, before, known = [], 0, "", []
    for r in sorted(ends.collect(), key=lambda r: r["__block"]):  # one row for each task of the sort
        same = 0
        for x, y in zip(before, r["first"]["__key"]):
            if x != y:
                break
            same += 1
        shared = known[:same]
        rows.append((r["__block"], base, shared))
        before = r["last"]["__key"]
        known = [shared[j - 1] if j <= len(shared) else base + j for j in r["last"]["__path"]]
        base += r["made"]
    return local.sparkSession.createDataFrame(rows, "__block int, base long, shared array<long>")


def near_words(tries: DataFrame) -> DataFrame:
    """(id, n_near, best): for each word with near words their number and the most frequent (n, -id); ids order as words do.

    ``tries`` has id, word, n, ahead and back: the nodes of its prefixes and suffixes.
    """
    size = F.size("ahead")
    node = lambda path, length: F.coalesce(F.get(path, length - 1), F.lit(0).cast("long"))  # noqa: E731 # the root is 0
    # of equal neighbours, skipping any gives the same word: only the first counts as a deletion
    first = lambda i: (i == 0) | (F.substring(F.col("word"), i, F.lit(1)) != F.substring(F.col("word"), i + 1, F.lit(1)))
    split = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(node("ahead", i).alias("p"), node("back", size - i).alias("s"), F.lit(True).alias("whole"), F.lit(True).alias("first")))
    skip = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(node("ahead", i).alias("p"), node("back", size - 1 - i).alias("s"), F.lit(False).alias("whole"), first(i).alias("first")))
    each = tries.select("id", "n", F.explode(F.concat(split, skip)).alias("x")).select("x.*", "id", "n")
    groups = each.groupBy("p", "s").agg(F.collect_list(F.struct("id", "n", "whole", "first")).alias("g")).where(F.size("g") > 1)
    # a deletion joins a whole word with one that skips; two that skip are a replacement
    near = lambda x, y: (x["id"] != y["id"]) & F.when(x["whole"], y["first"]).when(y["whole"], x["first"]).otherwise(True)
    met = groups.select(F.explode("g").alias("x"), "g").select("x.id", F.filter("g", lambda y: near(F.col("x"), y)).alias("near")).where(F.size("near") > 0)
    best = F.array_max(F.transform("near", lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("order"))))
    return met.select("id", F.size("near").cast("long").alias("k"), best.alias("best")).groupBy("id").agg(F.sum("k").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): the end of each chain of ``forms`` (id, form). A form has at least twice the count, so chains are short; each round doubles the steps."""
    known = written(forms.select("id", F.col("form").alias("root")), "variant-roots")
    while True:
        on = known.select(F.col("id").alias("root"), F.col("root").alias("next"))
        further = written(known.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        forget(known)
        known = further
        if not known.where("moved").limit(1).count():
            return known.select("id", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5, rare: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for every word of at least ``least`` code points found ``rare`` times.

    Words are runs of a-z and U+00C0 to U+00FF, A-Z lower-cased, with one code point deleted where 97 divides
    crc32("<id>:<run>"). ``form``: the near word (one code point inserted, deleted or replaced) with the largest
    n, the smallest of equals, if its n is at least twice the word's. ``root``: the end of the forms.
    Null texts hold no words; a null id is hashed as an empty one; rows that share an id or a text count each.
    No words: an empty table. Other columns of ``docs`` aren't read.
    """
    counts = word_counts(docs, id_col, text_col, least, rare)
    ahead = numbered(counts, F.col("word"), "ahead")
    both = numbered(ahead, F.reverse("word"), "back")
    tries = written(both.select(F.element_at("ahead", -1).alias("id"), "word", "n", "ahead", "back"), "variant-words")
    near = near_words(tries)
    words = tries.select("id", "word", "n").join(near, "id", "left")
    own = F.col("best.n") >= 2 * F.col("n")
    words = written(words.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(own, -F.col("best.order")).alias("form_id"), F.when(own, F.col("best.n")).alias("form_n")), "variant-near")
    ends = roots(words.where(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("form")))
    name = lambda c: words.select(F.col("id").alias(f"{c}_id"), F.col("word").alias(c))
    out = words.join(ends.withColumnRenamed("root", "root_id"), "id", "left").join(name("form"), "form_id", "left").join(name("root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
