"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

A pretoken's bytes are the initial symbols of a doubly linked list; a heap holds the adjacent pairs
that have a merge rank. The lowest rank (leftmost first) is popped until none is left: the count is
the number of initial symbols minus the number of merges. Counts of pretokens are kept in a bounded
table for as long as the worker lives.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of, worker_cache
from cadenza.llm.tokens import PATTERN, byte_symbols, check_byte_level, read_tokenizer

#: Pretokens that are kept, and the longest of them.
CACHE_PRETOKENS, CACHE_CHARS = 1_000_000, 64
#: Texts longer than this are split as a stream, so their pretokens are never all held at once.
STREAM_CHARS = 1_000_000
SPLIT = regex.compile(PATTERN)


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left when no adjacent pair has a rank."""
    n = len(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    rank = ranks.get
    heap = [(r, i) for i in range(n - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        # an entry is stale if its left symbol has gone or either symbol has changed since
        if j < 0 or not symbols[i] or rank((symbols[i], symbols[j])) != r:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        k = after[j]
        after[i] = k
        if k >= 0:
            before[k] = i
            if (r := rank((symbols[i], symbols[k]))) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
            heapq.heappush(heap, (r, h))
        merges += 1
    return n - merges


class TokenCounter(dict):
    """pretoken -> number of tokens, filled as pretokens come."""

    def __init__(self, source: str):
        spec = json.loads(source)
        check_byte_level(spec)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.symbol = {b: c for c, b in byte_symbols().items()}
        names = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def __missing__(self, pretoken: str) -> int:
        symbol = self.symbol
        n = merged_count([symbol[b] for b in pretoken.encode("utf-8", "surrogatepass")], self.ranks)
        if len(pretoken) <= CACHE_CHARS:
            self[pretoken] = n
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text; an added token's string inside it is one token."""
        total, at = 0, 0
        for m in self.special.finditer(text) if self.special else ():
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> int:
        if len(self) > CACHE_PRETOKENS:
            self.clear()
        if len(text) > STREAM_CHARS:
            return sum(self[m.group()] for m in SPLIT.finditer(text))
        return sum(map(self.__getitem__, SPLIT.findall(text)))


def count_tokens(docs: DataFrame, tokenizer: str, text_col: str = "text", limit: int = 512) -> DataFrame:
    """The rows with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit) added.

    ``tokenizer`` is the path of a byte-level BPE file. No begin, end or other special tokens are added;
    nothing is cut or padded. Null text counts as empty: 0 tokens. Input columns of those names are replaced.
    """
    out = ("n_bytes", "n_tokens", "over_limit")
    own = [c for c in docs.columns if c not in out]
    source = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer))
    text = text_of(F.col(text_col))
    df = docs.select(*own, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("__tc_text"))
    schema = df.drop("__tc_text").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, key = worker_cache("token-count"), hash(source.value)
        if key not in made:
            made[key] = TokenCounter(source.value)
        counter = made[key]
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), pa.array(n, pa.int64())], names=schema.names)

    return df.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
