"""Toxic spans by a linear-chain conditional random field.

Fitting: a bounded sample of labelled documents gives token labels by distant supervision (a token of
a toxic document is toxic if one of its features is far more frequent in toxic than in clean
documents); windows around such tokens and windows of clean text train the chain. Scoring: every
token of every whole text gets its forward-backward marginal; the largest marginal of a document,
calibrated on the sample, is its score, and runs of tokens above one half are its offending spans.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of, worker_cache

TOKEN = re.compile(r"[^\W_]+")
#: Lengths of the beginnings and ends of a word that are features besides the whole word.
HEADS, TAILS = range(3, 11), range(5, 7)
CACHE_WORDS = 500_000
TOKENS_AT_ONCE = 500_000


def words_of(text: str) -> list[str]:
    """The tokens of a text, each lower-cased by itself: a letter whose lower case is longer moves no other token."""
    return [w.lower() for w in TOKEN.findall(text)]


def features(word: str) -> list[str]:
    """The features of a lower-cased token: itself, its beginnings and its ends."""
    n = len(word)
    return ["=" + word, *("^" + word[:i] for i in HEADS if i <= n), *(word[-i:] + "$" for i in TAILS if i <= n)]


@dataclass
class ToxicityModel:
    """Weights of the toxic label's features, the chain's transitions and the calibration of scores.

    States are 0 (clean) and 1 (toxic). ``trans[i, j]`` is the log-potential of going from i to j.
    """

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    offset: float = 0.0

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features(word))


def marginals(emissions: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Toxic log-odds of every token by the forward-backward recursions, for many sequences at once.

    ``emissions`` holds the sequences one after the other. Both recursions carry the log-ratio of the
    two states, so one step is a handful of array operations over all sequences still running.
    """
    order = np.argsort(-lengths, kind="stable")
    n, starts = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(steps), side="left")  # sequences longer than t
    out = np.zeros(len(emissions))

    def push(r: np.ndarray, to_1: tuple[float, float], to_0: tuple[float, float]) -> np.ndarray:
        return np.logaddexp(to_1[0], to_1[1] + r) - np.logaddexp(to_0[0], to_0[1] + r)

    fwd = np.zeros(0)
    for t in range(steps):
        k = alive[t]
        at = starts[:k] + t
        fwd = emissions[at] if t == 0 else emissions[at] + push(fwd[:k], (trans[0, 1], trans[1, 1]), (trans[0, 0], trans[1, 0]))
        out[at] = fwd
    back = np.zeros(len(n))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = starts[:k] + t
        out[at] += back[:k]
        back[:k] = push(emissions[at] + back[:k], (trans[1, 0], trans[1, 1]), (trans[0, 0], trans[0, 1]))
    return out


def _tagged(docs: list[tuple[list[str], int]]) -> tuple[set[str], list[list[int]]]:
    """The words with a telling feature and the token labels that follow from them."""
    count = {0: Counter(), 1: Counter()}
    known: dict[str, list[str]] = {}
    for words, toxic in docs:
        own: set[str] = set()
        for w in set(words):
            if w not in known:
                known[w] = features(w)
            own.update(known[w])
        count[toxic].update(own)
    total = {t: sum(1 for _, x in docs if x == t) for t in (0, 1)}
    share = total[1] / max(1, len(docs))
    strong: set[str] = set()
    for f, a in count[1].items():
        b = count[0][f]
        rate = (a / max(1, total[1])) / ((b + 0.5) / max(1, total[0]))
        if a >= 3 and rate >= 10:
            gain = a * math.log(a / ((a + b) * share)) + (b * math.log(b / ((a + b) * (1 - share))) if b else 0.0)
            if gain >= 10:
                strong.add(f)
    telling = {w for w, own in known.items() if any(f in strong for f in own)}
    return telling, [[int(toxic and w in telling) for w in words] for words, toxic in docs]


def _train(sequences: list[tuple[list[str], list[int]]], l2: float, rounds: int, max_features: int) -> ToxicityModel:
    """Maximum likelihood of the labelled windows by Adam on the exact gradient (forward-backward expectations)."""
    seen = Counter(f for words, _ in sequences for w in words for f in features(w))
    names = [f for f, _ in seen.most_common(max_features)]
    at = {f: i for i, f in enumerate(names)}
    lengths = np.array([len(w) for w, _ in sequences])
    y = np.array([t for _, tags in sequences for t in tags], float)
    own = [[at[f] for f in features(w) if f in at] for words, _ in sequences for w in words]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col = np.array([i for x in own for i in x], np.int64)
    starts = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[starts] = False
    cur = np.flatnonzero(inner)
    prev = cur - 1
    theta = np.zeros(len(names) + 3)  # weights, bias, stay-toxic and enter-toxic transitions
    theta[len(names)] = -3.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    pairs = np.array([(y[prev] * y[cur]).sum(), ((1 - y[prev]) * y[cur]).sum()])
    for step in range(1, rounds + 1):
        w, bias = theta[: len(names)], theta[len(names)]
        trans = np.array([[0.0, theta[-1]], [0.0, theta[-2]]])
        e = bias + np.bincount(row, w[col], len(y))
        odds = marginals(e, lengths, trans)
        p = 1 / (1 + np.exp(-odds))
        # expected transitions: the pair marginal from each side's message without the other
        fwd, back = _messages(e, lengths, trans)
        joint = np.stack([np.zeros(len(cur)), fwd[prev] + trans[1, 0], e[cur] + back[cur] + trans[0, 1], fwd[prev] + e[cur] + back[cur] + trans[1, 1]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        grad = np.concatenate([np.bincount(col, (y - p)[row], len(names)) - l2 * w, [(y - p).sum(), pairs[0] - joint[3].sum(), pairs[1] - joint[2].sum()]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel({f: float(x) for f, x in zip(names, theta) if abs(x) > 1e-3}, float(theta[len(names)]), np.array([[0.0, theta[-1]], [0.0, theta[-2]]]))


def _messages(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-ratios (own emission included) and backward log-ratios of every token."""
    total = marginals(e, lengths, trans)
    starts = np.cumsum(lengths) - lengths
    fwd = np.array(e)
    for t in range(1, int(lengths.max()) if len(lengths) else 0):
        at = starts[lengths > t] + t
        r = fwd[at - 1]
        fwd[at] = e[at] + np.logaddexp(trans[0, 1], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[1, 0] + r)
    return fwd, total - fwd


def fit(rows: list[tuple[str, int]], window: int = 8, l2: float = 0.5, rounds: int = 120, max_features: int = 50_000, clean_places: int = 4) -> ToxicityModel:
    """Fit on (text, 0/1) rows; see ``fit_toxicity`` for where they come from. Without both labels nothing is toxic.

    A toxic text gives windows of ``window`` tokens on each side of all its telling tokens, a clean one gives
    one such window and the surroundings of up to ``clean_places`` telling tokens, spread over its length.
    """
    # copies of one text count once, or they would make its rare words telling
    one: dict[str, str] = {}  # equal words are one object
    docs = [([one.setdefault(w, w) for w in words_of(text)], toxic) for text, toxic in dict.fromkeys(rows)]
    docs = [d for d in docs if d[0]]
    if not any(t for _, t in docs) or all(t for _, t in docs):
        return ToxicityModel()
    telling, labels = _tagged(docs)
    sequences, width = [], 2 * window + 1
    for i, ((words, toxic), tags) in enumerate(zip(docs, labels)):
        if toxic:
            upto = 0
            for t in (t for t, x in enumerate(tags) if x):
                if t >= upto:
                    a = max(upto, t - window)
                    upto = min(len(words), t + window + 1)
                    sequences.append((words[a:upto], tags[a:upto]))
        else:  # one window of clean text at a place that depends on the row alone, and every token that looks telling
            a = (i * 7919) % max(1, len(words) - width)
            sequences.append((words[a : a + width], [0] * len(words[a : a + width])))
            odd = [t for t, w in enumerate(words) if w in telling]
            sequences += [(words[max(0, t - 1) : t + 2], [0] * len(words[max(0, t - 1) : t + 2])) for t in odd[:: -(-len(odd) // clean_places) or 1]]
    model = _train(sequences, l2, rounds, max_features)
    known: dict[str, float] = {}
    held = [_emissions(words, model, known) for words, _ in docs]
    lengths = np.array([len(x) for x in held])
    best = np.maximum.reduceat(marginals(np.concatenate(held), lengths, model.trans), np.cumsum(lengths) - lengths)
    model.slope, model.offset = _calibrate(best, np.array([t for _, t in docs], float))
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by damped Newton steps; the slope stays positive."""
    x = np.clip(x, -20, 20)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x).sum() - 0.01 * (a - 1), (y - p).sum() - 0.01 * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    return (float(a), float(b)) if a > 0.05 else (1.0, 0.0)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 1_000, max_clean: int = 3_000, max_chars: int = 20_000) -> ToxicityModel:
    """Fit on at most ``max_toxic`` and ``max_clean`` labelled rows, each of at most ``max_chars`` characters.

    The rows are those with the smallest hashes of their ids among the labelled rows whose
    crc32(id as text) mod 5 is not 0. Null texts, ids and labels take no part.
    """
    text = F.col(text_col).cast("string")
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where((F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0) & F.col("y").isin(0, 1)).distinct()
    # ids and lengths alone meet the labels; the texts of the few chosen rows are read after that
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n")).where(F.col("n").between(1, max_chars)).join(known, "id")
    first = lambda y, n: rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n).select("id", "y")
    chosen = F.broadcast(first(1, max_toxic).union(first(0, max_clean)))  # at most max_toxic + max_clean rows
    found = docs.select(F.col(id_col).alias("id"), text.alias("t")).where(F.length("t").between(1, max_chars)).join(chosen, "id").select("id", "t", "y")
    return fit([(r["t"], r["y"]) for r in sorted(found.collect(), key=lambda r: (r["id"], r["t"], r["y"]))])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", key: str = "") -> DataFrame:
    """The rows with ``score`` (0..1), ``predicted`` (score >= 0.5) and ``spans`` (start, end, p) added.

    Every whole text is scored; null counts as empty, and an empty text gets the lowest score.
    Spans are code point offsets of runs of tokens whose marginal is at least one half, with their
    largest marginal; rows that aren't predicted toxic have none. Input columns of those names are replaced.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted", "spans")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = key or uuid.uuid4().hex  # another model, another table of words
    df = docs.select(*own, text_of(F.col(text_col)).alias("__tx"))
    kind = "array<struct<start:int,end:int,p:double>>"
    schema = docs.select(*own, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(None).cast(kind).alias("spans")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = worker_cache(f"toxicity-{key}")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score, spans = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            at, held, tokens = 0, [], 0
            for i, x in enumerate(texts):
                held.append(_emissions(words_of(x.as_py()), m, known))
                tokens += len(held[-1])
                if i + 1 == batch.num_rows or tokens > TOKENS_AT_ONCE:
                    _score(held, at, texts, m, score, spans)
                    at, held, tokens = i + 1, [], 0
            arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
            predicted = pa.array((score >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(score), predicted, pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], names=schema.names)

    return df.mapInArrow(run, schema)


def _emissions(words: list[str], model: ToxicityModel, cache: dict[str, float]) -> np.ndarray:
    if len(cache) > CACHE_WORDS:
        cache.clear()
    get = cache.get
    out = [get(w) for w in words]
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                out[i] = cache[w] = model.emission(w)
    return np.array(out, float)


def _score(held: list[np.ndarray], at: int, texts, model: ToxicityModel, score: np.ndarray, spans: list) -> None:
    lengths = np.array([len(x) for x in held])
    odds = marginals(np.concatenate(held), lengths, model.trans)
    ends = np.cumsum(lengths)
    for i, (n, end) in enumerate(zip(lengths, ends)):
        own = odds[end - n : end]
        top = own.max() if n else -20.0
        s = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.slope * max(-20.0, min(20.0, top)) + model.offset))))
        score[at + i] = s
        if s >= 0.5 and n:
            spans[at + i] = _spans(texts[at + i].as_py(), own)


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    """Runs of tokens with a marginal of at least one half, as offsets of the text itself."""
    out: list[dict] = []
    before = False
    for m, o in zip(TOKEN.finditer(text), odds):
        if o >= 0:
            p = float(1 / (1 + math.exp(-min(30.0, o))))
            if before:
                out[-1]["end"], out[-1]["p"] = m.end(), max(out[-1]["p"], p)
            else:
                out.append({"start": m.start(), "end": m.end(), "p": p})
        before = o >= 0
    return out
