"""N-best SentencePiece segmentation: forward Viterbi scores guide a backward A-star search.

The lattice of a text has an edge for every vocabulary piece that matches at a place. A byte-pair model
file holds no probabilities but an order of merges, so a segmentation's score is the multiset of merges
that make its pieces, compared from the earliest merge on: of two segmentations the better one makes
more of the earliest merge in which they differ, or as many further to the left. Such scores add up and
keep their order under sums, as Viterbi and A-star need, and the best segmentation is the one that
merging itself arrives at.

The forward pass finds the best score from the start to every place; that is exactly what a backward
partial path still needs, so the backward search pops complete segmentations in order of what they lose
against the best. No piece but a run of spaces goes on after a space that follows another character, so
the lattice falls into units (spaces and the characters after them). Units that a worker hasn't met run
through the forward and backward recursions together in numpy, by length; their best segmentation and
the earliest merge that their second best goes without stay in a bounded table. The n best of a text
touch only the units that lose least, and the search runs over those.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import text_of, worker_cache

SPACE = "▁"
#: Units of a worker's table (two generations of it are held) and characters of the texts that go through it at a time.
CACHE_UNITS, CHARS_AT_ONCE = 330_000, 2_400_000
#: Units of one array; longer units, and those whose merges need more base-4 digits than fit into a long, are searched one by one.
UNITS_AT_ONCE, ARRAY_CHARS, DIGITS = 1_024, 24, 31
#: Units longer than this are cut where no piece goes across; what is left in one part beyond SPARSE_CHARS uses sparse scores.
WHOLE_CHARS, SPARSE_CHARS = 64, 2_000
#: The earliest missing merge of a segmentation that loses nothing, and of one that doesn't exist.
TIE, NONE = 2**31 - 1, -1
#: A sparse score counts merges in units of this, less the places where they are made.
ONE = 1 << 32


class Score:
    """A sparse multiset of merges: by rank, ``ONE`` for each less the sum of their places; ordered by the lowest rank with a difference."""

    __slots__ = ("at",)

    def __init__(self, at: dict[int, int]):
        self.at = at

    def _with(self, other: Score, sign: int) -> Score:
        out = dict(self.at)
        for r, c in other.at.items():
            c = out.get(r, 0) + sign * c
            if c:
                out[r] = c
            else:
                out.pop(r, None)
        return Score(out)

    def __add__(self, other: Score) -> Score:
        return self._with(other, 1)

    def __sub__(self, other: Score) -> Score:
        return self._with(other, -1)

    def __lt__(self, other: Score) -> bool:
        first = min(self.lead(), other.lead())
        mine, theirs = self.at.get(first, 0), other.at.get(first, 0)
        if mine != theirs:
            return mine < theirs
        rest = (self - other).at
        return bool(rest) and rest[min(rest)] < 0

    def lead(self) -> int:
        return min(self.at) if self.at else TIE


class Lattice:
    """The vocabulary of a byte-pair model file and the segmentations under its merge order."""

    def __init__(self, model: bytes, n: int):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.get_piece_size()
        self.n = n
        self.text = [sp.id_to_piece(i) for i in range(size)]
        self.id_of_byte = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.bytes = [p.replace(SPACE, " ").encode() for p in self.text]
        for b, i in self.id_of_byte.items():
            self.bytes[i] = bytes([b])
        # all pieces' bytes one after another: where each begins and its length
        self.spelled, self.long = np.frombuffer(b"".join(self.bytes), np.uint8), np.array([len(b) for b in self.bytes], np.int32)
        self.begin = np.cumsum(self.long, dtype=np.int32) - self.long
        self.unknown = sp.unk_id()
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {self.text[i]: sp.get_score(i) for i in plain}
        # merges in their order; pieces with one score share a rank
        steps = {s: r for r, s in enumerate(sorted({-s for p, s in scores.items() if len(p) > 1}))}
        if any(s != round(s) for s in steps):
            raise ValueError("only byte-pair model files have an order of merges")
        rank = {p: steps[-s] for p, s in scores.items() if len(p) > 1}
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece goes on after an inner space; units would cut it")
        self.piece: dict[str, int] = {}
        self.rank, self.split = np.full(size, TIE, np.int32), np.zeros(size, np.int32)
        for i in plain:
            p = self.text[i]
            at = _last_merge(p, rank)
            if at:  # a piece that merging can't make is no edge
                self.piece[p], self.split[i], self.rank[i] = i, at, rank.get(p, TIE)
        self.ranks, self.splits = self.rank.tolist(), self.split.tolist()
        self.longest = max(map(len, self.piece))
        #: Every beginning of a piece, with the id of the piece that it is or -1.
        self.prefixes: dict[str, int] = {p[:i]: -1 for p in self.piece for i in range(1, len(p) + 1)} | self.piece
        self._merges: dict[int, list[tuple[int, int]]] = {}
        self._tables()
        #: Best segmentation and the earliest merge that the second best goes without, by unit.
        self.best: dict[str, tuple[bytes, int]] = {}
        self.old: dict[str, tuple[bytes, int]] = {}
        self.lists: dict[str, list[tuple[Score, bytes]]] = {}

    def _tables(self) -> None:
        """The tree of beginnings as arrays: a hash table of (node, character) pairs, the node each leads to, the piece at each node."""
        letters = sorted({c for p in self.piece for c in p})
        known = re.escape("".join(c for c in letters if c != SPACE))
        # a character without a piece is a unit
        self.unit = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{SPACE}{known}]")
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.letters = len(letters) + 1
        node = {p: i + 1 for i, p in enumerate(self.prefixes)}
        at = {c: i + 1 for i, c in enumerate(letters)}
        pairs = {(node[p[:-1]] if len(p) > 1 else 0) * self.letters + at[p[-1]]: k for p, k in node.items()}
        self.slots = 1 << (4 * len(pairs)).bit_length()
        self.keys, self.to = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int64)
        keys, to = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        slot = self._slot(keys)
        while len(keys):  # one of those that meet in an empty slot stays, the others go on to the next
            empty = self.keys[slot] < 0
            self.keys[slot[empty]], self.to[slot[empty]] = keys[empty], to[empty]
            more = self.keys[slot] != keys
            keys, to, slot = keys[more], to[more], slot[more] + 1 & self.slots - 1
        self.first = np.zeros(self.letters, np.int64)
        self.first[[at[p] for p in node if len(p) == 1]] = [k for p, k in node.items() if len(p) == 1]
        self.piece_at = np.full(len(node) + 1, -1, np.int32)
        self.piece_at[[node[p] for p in self.piece]] = list(self.piece.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        """Where a pair is looked for first."""
        return (keys * 0x9E3779B1) >> 16 & self.slots - 1

    def _next(self, keys: np.ndarray) -> np.ndarray:
        """The node that each (node, character) pair leads to; 0 for none."""
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.to[slot], 0)
        going = np.flatnonzero((met != keys) & (met >= 0))
        slot = slot[going]
        while len(going):
            slot = slot + 1 & self.slots - 1
            met, own = self.keys[slot], keys[going]
            out[going] = np.where(met == own, self.to[slot], 0)
            on = (met != own) & (met >= 0)
            going, slot = going[on], slot[on]
        return out

    def _fallback(self, c: str) -> tuple[int, ...]:
        if not self.id_of_byte:
            return (self.unknown,)
        return tuple(self.id_of_byte[b] for b in c.encode("utf-8", "surrogatepass"))

    def merges(self, piece: int) -> list[tuple[int, int]]:
        """The merges that make a piece: (rank, place from its start)."""
        found = self._merges.get(piece)
        if found is None:
            p, m = self.text[piece], int(self.split[piece])
            found = []
            if len(p) > 1:
                right = [(r, m + at) for r, at in self.merges(self.piece[p[m:]])]
                found = [*self.merges(self.piece[p[:m]]), *right, (int(self.rank[piece]), 0)]
            self._merges[piece] = found
        return found

    def _score(self, edges: list[tuple[int, int]]) -> Score:
        """The score of the pieces at the given places."""
        out: dict[int, int] = {}
        for i, p in edges:
            for r, at in self.merges(p) if p >= 0 else ():
                out[r] = out.get(r, 0) + ONE - (i + at)
        return Score(out)

    def segment(self, unit: str, n: int) -> list[tuple[Score, bytes]]:
        """The n best segmentations of a unit as (what it loses against the best, ids), best first; fewer if there are no more.

        Whole numbers with a digit for each merge in the unit's lattice stand for scores; a very long unit uses sparse ones.
        """
        length, get = len(unit), self.prefixes.get
        # the edges that end at each place, longest start first
        ending: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
        for i in range(length - 1, -1, -1):
            for j in range(i + 1, length + 1):
                found = get(unit[i:j])
                if found is not None and found >= 0 or j == i + 1:
                    ending[j].append((i, -1 if found is None else found))
                if found is None:  # no piece begins like this
                    break
        if length > SPARSE_CHARS:
            zero = Score({})
            weight = lambda i, p: self._score([(i, p)])
        else:
            zero, one = 0, (length + 1) ** 2
            bits, ranks, splits = (length * one).bit_length(), self.ranks, self.splits
            # the merges of a piece are the last ones of the pieces within it, which are edges too
            held = {ranks[p] for x in ending for i, p in x if p >= 0}
            digit = {r: bits * k for k, r in enumerate(sorted(held, reverse=True))}
            made: list[dict[int, int]] = [{} for _ in range(length + 1)]
            for j, x in enumerate(ending):
                own = made[j]
                for i, p in x:
                    if p < 0 or j == i + 1:
                        own[i] = 0
                    else:
                        m = i + splits[p]
                        own[i] = ((one - i) << digit[ranks[p]]) + made[m][i] + own[m]
            weight = None
        # forward: step[j] is the best score to j less the best to j - 1; loss of an edge: what the best path into its end has more
        step: list = [zero] * (length + 1)
        losses: list[list[tuple[int, int, object]]] = [[] for _ in range(length + 1)]
        for j in range(1, length + 1):
            since, k, values = zero, j - 1, []
            for i, p in ending[j]:
                while k > i:
                    since = since + step[k]
                    k -= 1
                values.append((weight(i, p) if weight else made[j][i]) - since)
            best = values[0]
            for v in values[1:]:
                if best < v:
                    best = v
            step[j] = best
            losses[j] = [(i, p, best - v) for (i, p), v in zip(ending[j], values)][::-1]
        out: list[tuple[Score, bytes]] = []
        # The agenda holds partial paths by their exact losses. No two share a completion and each has one of
        # just that loss, so the entries beyond those still wanted can never be needed.
        wanted, tick = n, 0
        agenda: list[tuple[object, int, int, tuple | None]] = [(zero, 0, length, None)]
        top = None
        while agenda:
            lost, _, at, path = agenda.pop(0)
            if at == 0:
                edges = []
                while path is not None:
                    i, p, path = path
                    edges.append((i, p))
                ids = [x for i, p in edges for x in ((p,) if p >= 0 else self._fallback(unit[i]))]
                score = self._score(edges)
                top = top or score
                out.append((top - score, np.array(ids, "<i4").tobytes()))
                wanted -= 1
                if not wanted:
                    break
                continue
            for i, p, loss in losses[at]:
                total = lost + loss
                if len(agenda) < wanted or not agenda[-1][0] < total:
                    tick -= 1  # ties go to the newest and among its edges to the shortest, as merging from the left does
                    insort(agenda, (total, tick, i, (i, p, path)))
                    if len(agenda) > wanted:
                        agenda.pop()
        return out

    def _arrays(self, units: list[str], length: int) -> list[str]:
        """Put units of one length into the table; returns those that need a search of their own."""
        n = len(units)
        text = self.letter[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length).T]
        alone = (text == 0).any(axis=0)
        deep, widest = 1, min(self.longest, length)
        piece = np.full((widest + 1, length, n), -1, np.int32)
        where, state = np.arange(length * n), np.zeros(length * n, np.int64)
        for d in range(1, widest + 1):
            fit = where < (length - d + 1) * n
            where, state = where[fit], state[fit]
            if d == 1:
                state = self.first[text.reshape(-1)]
            else:
                state = self._next(state * self.letters + text.reshape(-1)[where + (d - 1) * n])
            fit = state > 0
            where, state = where[fit], state[fit]
            if not len(where):
                break
            deep = d
            piece[d].reshape(-1)[where] = self.piece_at[state]
        alone |= (piece[1] < 0).any(axis=0)
        spans = [(d, i) for d in range(2, deep + 1) for i in np.flatnonzero((piece[d] >= 0).any(axis=1)).tolist()]
        weight = np.full((deep + 1, length, n), -(2**62), np.int64)
        weight[1] = 0
        if spans:
            # the merges of a unit's edges in order: they are base-4 digits, the earliest first
            held = np.stack([piece[s] for s in spans], axis=1)
            ranks = np.where(held >= 0, self.rank[held], TIE)
            order = np.argsort(ranks, axis=1, kind="stable")
            ranks = np.take_along_axis(ranks, order, axis=1)
            true = ranks != TIE
            new, again = np.ones(ranks.shape, bool), np.zeros(ranks.shape, bool)
            new[:, 1:] = ranks[:, 1:] != ranks[:, :-1]
            again[:, 1:] = ~new[:, 1:] & new[:, :-1]
            # a merge with several places has a second digit: of as many, those further to the left
            place = np.cumsum(new, axis=1) - 1 + np.cumsum(again, axis=1) - ~new
            left = np.zeros(ranks.shape, np.int64)
            left[:, :-1] = 2 * again[:, 1:]
            left += again
            alone |= np.where(true, place, 0).max(axis=1) >= DIGITS - 1
            if ranks.shape[1] > 3:
                alone |= ((ranks[:, 3:] == ranks[:, :-3]) & true[:, 3:]).any(axis=1)
            shift = 2 * np.maximum(DIGITS - 1 - place, 1)
            ones = np.empty(ranks.shape, np.int64)
            np.put_along_axis(ones, order, (np.int64(1) << shift) + (left << (shift - 2)), axis=1)
            column = np.zeros((deep + 1, length), np.int64)
            column[tuple(np.array(spans).T)] = np.arange(len(spans))
            for d in range(2, deep + 1):
                i, u = np.nonzero((piece[d] >= 0) & ~alone)
                m = self.split[piece[d, i, u]]
                weight[d, i, u] = ones[u, column[d, i]] + weight[m, i, u] + weight[d - m, i + m, u]
        forward, back = np.zeros((length + 1, n), np.int64), np.zeros((length + 1, n), np.int64)
        came = np.ones((length + 1, n), np.int64)
        starts: list[list[int]] = [[1] for _ in range(length)]
        for d, i in spans:
            starts[i].append(d)
        for j in range(1, length + 1):
            best, from_ = forward[j - 1].copy(), came[j]
            for d in range(2, min(deep, j) + 1):
                if d in starts[j - d]:
                    value = forward[j - d] + weight[d, j - d]
                    up = value > best
                    np.copyto(best, value, where=up)
                    np.copyto(from_, d, where=up)
            forward[j] = best
        on = np.zeros((length, n), np.int64)  # the length of the best path's piece that starts here
        ids, count = np.zeros((length, n), "<i4"), np.zeros(n, np.int64)
        at, every = np.full(n, length), np.arange(n)
        while True:
            u = every[at > 0]
            if not len(u):
                break
            d = came[at[u], u]
            at[u] -= d
            on[at[u], u] = d
            count[u] += 1
            ids[length - count[u], u] = piece[d, at[u], u]
        second = np.full(n, -(2**62), np.int64)
        for i in range(length - 1, -1, -1):
            best = np.full(n, -(2**62), np.int64)
            for d in starts[i]:
                value = weight[d, i] + back[i + d]
                np.maximum(best, value, out=best)
                np.maximum(second, np.where(on[i] == d, -(2**62), value + forward[i]), out=second)
            back[i] = best
        # the first digit in which the two best differ names the merge that the second goes without
        differ = forward[length] ^ np.maximum(second, 0)
        bit = np.frexp((differ & ~(differ >> 1)).astype(float))[1] - 1
        lead = np.full(n, TIE, np.int64)
        if spans:
            distinct = np.full((n, DIGITS), TIE, np.int64)
            for of, more in ((new, 0), (again, 1)):
                u, k = np.nonzero(of & true & ~alone[:, None])
                distinct[u, place[u, k] + more] = ranks[u, k]
            lead = np.where(differ > 0, distinct[every, np.clip(DIGITS - 1 - bit // 2, 0, DIGITS - 1)], TIE)
        lead = np.where(second < 0, NONE, lead)
        raw, wide = ids.T.tobytes(), 4 * length
        for u, (unit, bad, c, lost) in enumerate(zip(units, alone.tolist(), count.tolist(), lead.tolist())):
            if not bad:
                self.best[unit] = raw[(u + 1) * wide - 4 * c : (u + 1) * wide], lost
        return [unit for unit, bad in zip(units, alone.tolist()) if bad]

    def learn(self, units: Iterable[str]) -> None:
        """Put units that the table doesn't hold into it."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        for length, same in by_length.items():
            alone = same
            if length <= ARRAY_CHARS:
                alone = [u for a in range(0, len(same), UNITS_AT_ONCE) for u in self._arrays(same[a : a + UNITS_AT_ONCE], length)]
            for u in alone:
                found = self.segment(u, 2)
                self.best[u] = found[0][1], found[1][0].lead() if len(found) > 1 else NONE

    def units(self, text: str) -> list[str]:
        """The units of a text; very long ones cut where no piece goes across."""
        out = self.unit.findall(SPACE + text.replace(" ", SPACE))
        if max(map(len, out)) > WHOLE_CHARS:
            out = [v for u in out for v in (self._parts(u) if len(u) > WHOLE_CHARS else (u,))]
        return out

    def _parts(self, unit: str) -> Iterator[str]:
        get, begin, reach = self.prefixes.get, 0, 0
        for i in range(len(unit)):
            if i and reach <= i:
                yield unit[begin:i]
                begin = i
            j = i + 1
            while j <= len(unit) and (found := get(unit[i:j])) is not None:
                if found >= 0:
                    reach = max(reach, j)
                j += 1
        yield unit[begin:]

    def encode(self, texts: list[str]) -> Iterator[list[tuple[float, bytes]]]:
        """The n best segmentations of each whole text as (score, ids as little-endian 32-bit), best first; the empty text has one, empty."""
        for found in self.checked(texts):
            yield [(s, ids) for s, ids, _ in found]

    def checked(self, texts: list[str]) -> Iterator[list[tuple[float, bytes, bool]]]:
        """As ``encode``, each with whether the ids decode to the text."""
        at, chars = 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars > CHARS_AT_ONCE or i + 1 == len(texts):
                yield from self._some(texts[at : i + 1])
                at, chars = i + 1, 0

    def _some(self, texts: list[str]) -> Iterator[list[tuple[float, bytes, bool]]]:
        if len(self.best) > CACHE_UNITS:  # units met again move on from the old table, the others go with it
            self.old, self.best = self.best, {}
        # units by number, in the order in which they are met
        number: defaultdict[str, int] = defaultdict(count().__next__)
        cut = [self.units(t) if t else [] for t in texts]
        of = [np.fromiter(map(number.__getitem__, x), np.int64, len(x)) for x in cut]
        del cut
        units = list(number)
        new = [u for u in units if u not in self.best]
        again = [u for u in new if u in self.old]
        self.best.update(zip(again, map(self.old.__getitem__, again)))
        self.learn([u for u in new if u not in self.best])
        found = list(map(self.best.__getitem__, units))
        parts, lead = [x[0] for x in found], np.array([x[1] for x in found], np.int64)
        # all texts' ids one after another: ``ends`` has where each unit's end
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, start = np.frombuffer(b"".join(parts), "<i4"), np.cumsum(size) - size
        every = np.concatenate(of)
        many = size[every]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = pool[np.repeat(start[every] - ends[:-1], many) + np.arange(ends[-1])]
        # and what they decode to
        long = self.long[ids]
        spelt = np.concatenate([[0], np.cumsum(long)])
        place = np.repeat((self.begin[ids] - spelt[:-1]).astype(np.int32), long)
        place += np.arange(spelt[-1], dtype=np.int32)
        said = self.spelled[place].tobytes()
        ids = ids.tobytes()
        at = 0
        for text, own in zip(texts, of):
            if not len(own):
                yield [(0.0, b"", not text)]
                continue
            first, last = ends[at], ends[at + len(own)]
            whole, bounds = ids[4 * first : 4 * last], 4 * (ends[at : at + len(own) + 1] - first)
            at += len(own)
            yield self._best(text, whole, _same(said[spelt[first] : spelt[last]], text), bounds, own, units, lead[own])

    def _best(self, text: str, whole: bytes, says: bool, bounds: np.ndarray, own: np.ndarray, units: list[str], lead: np.ndarray) -> list[tuple[float, bytes, bool]]:
        """The n best of a text from the units that lose least: a choice other than a unit's best costs what it loses.

        ``own`` has the text's units by their place in ``units``, ``bounds`` where each one's ids lie in ``whole``, which ``says`` the text or not.
        """
        out = [(0.0, whole, says)]
        if self.n == 1:
            return out
        least = max(0, int(np.partition(lead, -min(self.n - 1, len(lead)))[-min(self.n - 1, len(lead))]))
        cheap: list[int] = []
        seen: Counter[int] = Counter()
        for i in np.flatnonzero(lead >= least).tolist():  # of equal units the first few say all
            seen[own[i]] += 1
            if seen[own[i]] < self.n:
                cheap.append(i)
        if not cheap:
            return out
        lists = [self._list(units[own[i]]) for i in cheap]
        first = sorted(range(len(cheap)), key=lambda k: (-lists[k][1][0].lead(), k))
        if len(first) >= self.n:  # no need of a unit whose loss begins with an earlier merge than n - 1 others' losses
            bound = lists[first[self.n - 2]][1][0].lead()
            first = [k for k in first if lists[k][1][0].lead() >= bound]
        first.sort()
        cheap, lists = [cheap[k] for k in first], [lists[k] for k in first]
        for lost, pick in self._combine([[x[0] for x in x_] for x_ in lists]):
            if any(pick):
                made, at, same = [], 0, True
                for i, j, found in zip(cheap, pick, lists):
                    if j:
                        a, b = int(bounds[i]), int(bounds[i + 1])
                        made += whole[at:a], found[j][1]
                        at = b
                        same = same and self._bytes(found[j][1]) == self._bytes(whole[a:b])
                ids = b"".join([*made, whole[at:]])
                # decoding goes piece by piece: if the parts put in say what those they replace say, so do the wholes
                out.append((-1.0 / (1 + lost.lead()) if lost.at else 0.0, ids, out[0][2] if same else self.says(ids, text)))
        return out

    def _list(self, unit: str) -> list[tuple[Score, bytes]]:
        found = self.lists.get(unit)
        if found is None:
            if len(self.lists) > CACHE_UNITS // 22:
                self.lists.clear()
            found = self.lists[unit] = self.segment(unit, self.n)
        return found

    def _combine(self, lists: list[list[Score]]) -> list[tuple[Score, tuple[int, ...]]]:
        """The n cheapest ways to take one entry of every ascending list."""
        start = tuple([0] * len(lists))
        heap, seen, out = [(Score({}), 0, start)], {start}, []
        while heap and len(out) < self.n:
            loss, _, pick = heapq.heappop(heap)
            out.append((loss, pick))
            for k, j in enumerate(pick):
                if j + 1 < len(lists[k]):
                    new = (*pick[:k], j + 1, *pick[k + 1 :])
                    if new not in seen:
                        seen.add(new)
                        # a list's first entry loses nothing; an object of its own, as one that is met twice would change the order of ties
                        more = lists[k][j + 1] - lists[k][j] if j else Score(lists[k][1].at)
                        heapq.heappush(heap, (loss + more if loss.at else more, len(seen), new))
        return out

    def _bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("i")))

    def says(self, ids: bytes, text: str) -> bool:
        """Whether a sequence of ids decodes to this text."""
        return _same(self._bytes(ids), text)

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids: byte pieces as UTF-8, the first space dropped."""
        whole = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return whole[1:] if whole[:1] == " " else whole


def _same(made: bytes, text: str) -> bool:
    """Whether decoded bytes are the text, their first space dropped; UTF-8 of a text is valid, so equal bytes are an equal text."""
    return made[made[:1] == b" " :] == text.encode()


def _last_merge(piece: str, rank: dict[str, int]) -> int:
    """Where merging ``piece`` by itself joins its last two symbols; 1 for a single character, 0 if merging doesn't get there."""
    symbols = list(piece)
    last = 1
    while len(symbols) > 1:
        made = [rank.get(a + b, TIE) for a, b in zip(symbols, symbols[1:])]
        r = min(made)
        if r == TIE:
            return 0
        i = made.index(r)
        last = len(symbols[0]) if len(symbols) == 2 else last
        symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
    return last


def _lattice(model: bytes, n: int) -> Lattice:
    made, key = worker_cache("pieces"), (hash(model), n)
    if key not in made:
        made[key] = Lattice(model, n)
    return made[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _nbest(texts: list[str], lattice: Lattice, with_ids: bool) -> pa.ListArray:
    """One array of segmentations for each text, as Arrow."""
    many, score, pieces, crc, whole, raw = [0], [], [], [], [], []
    for found in lattice.checked(texts):
        many.append(many[-1] + len(found))
        for s, ids, says in found:
            score.append(s)
            pieces.append(len(ids) // 4)
            crc.append(zlib.crc32(ids))
            whole.append(says)
            raw.append(ids if with_ids else b"")
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32))
    ids_ = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), "<i4")))
    if not with_ids:
        ids_ = pa.nulls(len(score), ids_.type)
    fields = [pa.array(score, pa.float64()), pa.array(pieces, pa.int32()), pa.array(crc, pa.int64()), ids_, pa.array(whole, pa.bool_())]
    each = pa.StructArray.from_arrays(fields, names=["score", "n_pieces", "ids_crc32", "ids", "round_trip"])
    return pa.ListArray.from_arrays(pa.array(many, pa.int32()), each)


#: Rows whose segmentations are held at a time, and characters; a single longer text goes alone.
ROWS_OUT, CHARS_OUT = 1_000, 3_000_000


def encode_nbest(docs: DataFrame, model: str, text_col: str = "text", n: int = 4, with_ids: bool = True, keep: list[str] | None = None) -> DataFrame:
    """The rows with ``nbest`` added: an array of (score, n_pieces, ids_crc32, ids, round_trip) of the n best segmentations, best first.

    ``keep`` names the columns that come along (all by default): texts that aren't wanted afterwards needn't come back from Python.

    ``model`` is the path of a byte-pair model file. The best segmentation is the one that merging in the
    file's order makes; the others do without as late a merge as can be. ``score`` is 0 for segmentations
    that lose nothing and -1 / r for one that goes without the r-th merge of the file, the earliest that
    it makes less often than the best.

    Null counts as empty; the empty text has one empty segmentation. Texts aren't normalized but for the
    space mark: a text that holds the mark itself decodes to spaces there, and its ``round_trip`` (whether
    the segmentation's ids decode to the text as given) is false. Without ``with_ids`` the ids stay null.
    ``ids_crc32`` is over little-endian 32-bit ids. A column named ``nbest`` is replaced.
    """
    source = docs.sparkSession.sparkContext.broadcast(_read(model))
    own = [c for c in (docs.columns if keep is None else keep) if c != "nbest"]
    kind = "array<struct<score:double,n_pieces:int,ids_crc32:bigint,ids:array<int>,round_trip:boolean>>"
    df = docs.select(*own, text_of(F.col(text_col)).alias("__pl_text"))
    schema = docs.select(*own, F.lit(None).cast(kind).alias("nbest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(source.value, n)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            at, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars > CHARS_OUT or i + 1 - at >= ROWS_OUT or i + 1 == len(texts):
                    part = b.slice(at, i + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], _nbest(texts[at : i + 1], lattice, with_ids)], names=schema.names)
                    at, chars = i + 1, 0

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with ``out_col`` added: the text of each id array (a null array: null; an empty one: the empty text).

    Null ids and ids that the file doesn't hold are left out. The two columns need different names.
    """
    source = df.sparkSession.sparkContext.broadcast(_read(model))
    own = [c for c in df.columns if c != out_col]
    schema = df.select(*own, F.lit(None).cast("string").alias(out_col)).schema
    if ids_col not in own:
        raise ValueError("the ids and the decoded text need different column names")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(source.value, 1)
        at, size = own.index(ids_col), len(lattice.text)
        for b in batches:
            text = [None if x is None else lattice.decode(np.array([i for i in x if i is not None and 0 <= i < size], np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=schema.names)

    return df.select(*own).mapInArrow(run, schema)
