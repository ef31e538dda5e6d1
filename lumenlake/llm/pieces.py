"""SentencePiece encoding and decoding by N-best segmentation.

The lattice of a text has an arc for every piece of the model's vocabulary that matches, weighted by the piece's score.
A forward Viterbi pass gives the best score from the start to every position. The search then runs backward from the end
as A*: these scores are exact for what is left of a partial segmentation, so segmentations leave the agenda best first.

A model's pieces hold blank marks only at their start, so every run of blanks starts a unit of its own (the run and the
word after it) and the lattice falls apart there, as it does between characters that no piece holds side by side. The
parts are searched on their own, and their N best are combined into the N best of a text, exactly. For whole corpora, all
parts that a batch of texts brings anew are searched side by side in numpy, and their N best are remembered: a word is
searched once, whatever signs follow it. Scores are the model's own. For a model of merges these are merge ranks, so the
best segmentation is that of the lattice, which can differ from that of greedy merging.

Characters without a piece, and the blank mark itself where a text holds it, are encoded as bytes. Decoding gives the
text back exactly.

Defined cases: a null or empty text is encoded as a single blank, which decodes to the empty text; of equal scores the
one found first wins, always the same; rows that repeat are all kept; fewer than N segmentations give fewer; extra
columns are ignored; an empty table gives no rows. A model with pieces that hold a mark after another character is
refused.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

MARK = "▁"
#: The setting that names the model's file, and the file where it is unset.
SETTING, MODEL = "spark.lumenlake.pieces.model", "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of each text.
NBEST = 4
#: Below the least score of all pieces: what a character in bytes costs.
UNKNOWN = 10.0
#: Parts that a task remembers; then those that it met least go.
REMEMBERED = 300_000
#: Characters of texts that are searched side by side, about.
BATCH = 1 << 20
#: Longer parts are searched on their own.
LONG = 64

_UNITS = re.compile(" ( *[^ ]*)")


@dataclass
class Vocabulary:
    """A model's pieces: what is broadcast, bounded by the model's size. Marks are blanks here."""

    pieces: dict[str, tuple]  # ((id,), score)
    trie: dict[str, list]  # character -> [what follows, the piece that ends here or None]
    longest: int
    bytes_from: int  # the id of byte 0
    decoded: list[bytes]
    unknown: float
    pairs: frozenset[str]  # neighbouring characters that some piece holds


def vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model)
    size = p.vocab_size()
    names = [p.id_to_piece(i) for i in range(size)]
    usual = [i for i in range(size) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    pieces = {names[i].replace(MARK, " "): ((i,), p.get_score(i)) for i in usual}
    if crossing := [k for k in pieces if " " in k.lstrip(" ")]:
        raise ValueError(f"pieces that cross words: {crossing[:5]}")
    trie: dict[str, list] = {}
    for name, found in pieces.items():
        node: list = [trie, None]
        for c in name:
            node = node[0].setdefault(c, [{}, None])
        node[1] = found
    zero = next(i for i in range(size) if p.is_byte(i))
    decoded = [b"" if p.is_control(i) or p.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(size)]
    for b in range(256):
        decoded[zero + b] = bytes([b])
    pairs = frozenset(k[n : n + 2] for k in pieces for n in range(len(k) - 1))
    return Vocabulary(pieces, trie, max(map(len, pieces)), zero, decoded, min(s for _, s in pieces.values()) - UNKNOWN, pairs)


def shared_vocabulary(spark: SparkSession, model: str | None):
    return spark.sparkContext.broadcast(vocabulary(model or spark.conf.get(SETTING, MODEL)))


def lattice(v: Vocabulary, text: str) -> tuple[list[float], list[list[tuple]]]:
    """The best score from the start to each position, found forward, and the arcs (start, ids, score) into each."""
    n = len(text)
    best = [0.0] + [-np.inf] * n
    into: list[list[tuple]] = [[] for _ in range(n + 1)]
    root, longest = v.trie, v.longest
    for start in range(n):
        here, kids, end = best[start], root, start
        covered = False
        for c in text[start : start + longest]:
            node = kids.get(c)
            if node is None:  # no piece begins so
                break
            end += 1
            kids, found = node
            if found is not None:
                ids, score = found
                into[end].append((start, ids, score))
                score += here
                if score > best[end]:
                    best[end] = score
                if end == start + 1:
                    covered = True
        if not covered:
            into[start + 1].append((start, tuple(v.bytes_from + b for b in text[start].encode()), v.unknown))
            if here + v.unknown > best[start + 1]:
                best[start + 1] = here + v.unknown
    return best, into


def nbest_word(v: Vocabulary, text: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n best segmentations of a unit or a part of one: (score, ids), best first."""
    best, into = lattice(v, text)
    agenda = [(-best[-1], 0, len(text), 0.0, None)]
    found: list[tuple[float, tuple[int, ...]]] = []
    number, open_ = 0, n
    while agenda:
        _, _, at, score, path = agenda.pop(0)
        if at == 0:
            ids: list[int] = []
            while path:
                ids += path[0]
                path = path[1]
            found.append((score, tuple(ids)))
            open_ -= 1
            if not open_:
                break
            continue
        # Estimates are reached, so no more segmentations than are still asked for need to be open.
        for start, own, more in into[at]:
            more += score
            estimate = -more - best[start]
            if len(agenda) < open_ or estimate <= agenda[-1][0]:
                number -= 1  # of equal estimates the one furthest on
                insort(agenda, (estimate, number, start, more, (own, path)))
                if len(agenda) > open_:
                    agenda.pop()
    return found


def units(text: str) -> list[str]:
    """What follows each first blank of the runs of blanks in a text that is begun with a blank."""
    if "  " in text or text.startswith(" "):
        return _UNITS.findall(" " + text)
    return text.split(" ")


def parts(v: Vocabulary, unit: str) -> list[str]:
    """A unit cut where no piece holds both neighbours, so that no arc crosses: its lattice falls apart there."""
    pairs, out, start = v.pairs, [], 0
    for i, (a, b) in enumerate(zip(unit, unit[1:]), 1):
        if a + b not in pairs:
            out.append(unit[start:i])
            start = i
    out.append(unit[start:])
    return out


def choices(losses: list[tuple[float, ...]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best of independent choices: (loss, number of the choice -> its alternative, where not the best).

    `losses` has what each choice's alternatives lose, ascending."""
    # n - 1 choices with the least loss suffice: changing one of them alone already gives n results.
    least = heapq.nsmallest(n - 1, ((own[0], i) for i, own in enumerate(losses) if own))
    open_ = [i for _, i in least]
    out, agenda = [], [(0.0, (0,) * len(open_))]
    seen = {agenda[0][1]}
    while agenda and len(out) < n:
        loss, picks = heapq.heappop(agenda)
        out.append((loss, {open_[j]: k for j, k in enumerate(picks) if k}))
        for j, k in enumerate(picks):
            own = losses[open_[j]]
            more = (*picks[:j], k + 1, *picks[j + 1 :])
            if k < len(own) and more not in seen:
                seen.add(more)
                heapq.heappush(agenda, (loss + own[k] - (own[k - 1] if k else 0.0), more))
    return out


class Trie:
    """A vocabulary's trie as an open hash table of (node, character), walked from many places at once."""

    def __init__(self, v: Vocabulary):
        nodes, edges = [v.trie], []
        piece = [(-1, 0.0)]
        for node, kids in enumerate(nodes):  # grows while it is walked
            for c, (below, found) in kids.items():
                edges.append((node << 32 | ord(c), len(nodes)))
                nodes.append(below)
                piece.append((found[0][0], found[1]) if found else (-1, 0.0))
        self.ids, self.scores = np.array([i for i, _ in piece]), np.array([x for _, x in piece])
        self.unknown, self.bytes_from = v.unknown, v.bytes_from
        # Characters of pairs are numbered from 1; `joined` says of two numbers whether some piece holds the two side by side.
        first, second = (np.array([ord(p[i]) for p in v.pairs], np.int64) for i in (0, 1))
        some = np.unique(np.append(first, second))
        self.number = np.zeros(0x110000, np.int32)
        self.number[some] = np.arange(1, len(some) + 1)
        self.joined = np.zeros((len(some) + 1, len(some) + 1), bool)
        self.joined[self.number[first], self.number[second]] = True
        self.bits = (2 * len(edges)).bit_length()
        self.keys, self.below = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        key, below = np.array([k for k, _ in edges], np.int64), np.array([b for _, b in edges], np.int32)
        slot = self._slot(key)
        while len(key):  # one of those that want a free slot gets it; the others move on
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            got = self.keys[slot] == key
            self.below[slot[got]] = below[got]
            key, below, slot = key[~got], below[~got], (slot[~got] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes below nodes by characters, -1 where there is none."""
        key = node.astype(np.int64) << 32 | char
        slot, out = self._slot(key), np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            held = self.keys[slot]
            found = held == key[left]
            out[left[found]] = self.below[slot[found]]
            on = ~found & (held != -1)
            left, slot = left[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def cut(self, texts: list[str]) -> tuple[pa.LargeStringArray, np.ndarray]:
        """Texts, each begun with a blank, cut where no piece holds both neighbours, so before runs of blanks too; and the
        number of every text's parts."""
        whole = " " + " ".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        firsts = np.cumsum(sizes) - sizes
        number = self.number[chars]
        new = np.ones(len(chars), bool)
        np.logical_not(self.joined[number[:-1], number[1:]], out=new[1:])
        new[firsts] = True
        begins, encoded = np.flatnonzero(new), whole.encode()
        if len(encoded) > len(chars):
            width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
            offsets = (np.cumsum(width) - width)[begins]
        else:
            offsets = begins
        offsets = np.append(offsets, len(encoded))
        parts = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(encoded))
        return parts, np.add.reduceat(new, firsts, dtype=np.int64)


def _last(mark: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The last marked index of each run that begins at `firsts`."""
    return np.maximum.reduceat(np.where(mark, np.arange(len(mark)), -1), firsts)


@dataclass
class Found:
    """The n best segmentations of units or texts, side by side: `ids` holds the ids of all, n of each one after the other,
    the best first.

    `sizes` says how many ids each has; `lost`, in rows of n, what it loses against the best, infinite where there are
    fewer than n."""

    ids: np.ndarray
    sizes: np.ndarray
    score: np.ndarray
    lost: np.ndarray

    def __add__(self, other: Found) -> Found:
        return Found(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in self.__dataclass_fields__))

    def taken(self, at: np.ndarray) -> Found:
        """Those of the units numbered `at`."""
        rows = (at[:, None] * self.lost.shape[1] + np.arange(self.lost.shape[1])).ravel()
        return Found(runs(self.ids, self.sizes, rows), self.sizes[rows], self.score[at], self.lost[at])

    def rank(self, k: int) -> np.ndarray:
        """The ids of the segmentations of rank k, one after the other."""
        return runs(self.ids, self.sizes, np.arange(len(self.score)) * self.lost.shape[1] + k)

    # The best, and the second best as what stands in place of it.
    own = property(lambda self: self.rank(0))
    own_n = gone = property(lambda self: self.sizes[:: self.lost.shape[1]])
    loss = property(lambda self: self.lost[:, 1])
    new = property(lambda self: self.rank(1))
    new_n = property(lambda self: self.sizes[1 :: self.lost.shape[1]])


def runs(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs numbered `at` of `flat`, whose runs have the given sizes, one after the other."""
    n = sizes[at]
    return flat[np.repeat((np.cumsum(sizes) - sizes)[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def spelt(ids: np.ndarray, bytes_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with characters, which stand as negative numbers, as their bytes; and how many ids each has become."""
    chars = -1 - ids[ids < 0]
    n = np.ones(len(ids), np.int64)
    n[ids < 0] += (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
    out = np.repeat(ids, n)
    out[out < 0] = bytes_from + np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8).astype(np.int64)
    return out, n


def two_best(trie: Trie, units: list[str]) -> Found:
    return n_best(trie, units, 2)


def n_best(trie: Trie, units: list[str], n: int) -> Found:
    """The n best segmentations of units.

    Forward, Viterbi scores of all positions of all units, position after position. Backward, the A* search side by side,
    a result of every unit a round: it follows the best arcs to the start, all other arcs into the positions it passes go
    to the unit's agenda, and the one with the best estimate, which the forward scores make exact, is taken up next."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    if not len(sizes):
        return Found(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, n)))
    chars = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.int64)
    unit = np.repeat(np.arange(len(units)), sizes)
    ends = np.cumsum(sizes)
    left = ends[unit] - np.arange(len(chars))
    # Arcs, by length: (start, length, id, score). A character without a piece has an arc of its own.
    alive, node, arcs = np.arange(len(chars)), np.zeros(len(chars), np.int32), []
    odd = np.ones(len(chars), bool)
    depth = 0
    while len(alive):
        node = trie.step(node, chars[alive + depth])
        depth += 1
        alive, node = alive[node >= 0], node[node >= 0]
        hit = trie.ids[node] >= 0
        arcs.append((alive[hit], np.full(int(hit.sum()), depth), trie.ids[node[hit]], trie.scores[node[hit]]))
        if depth == 1:
            odd[alive[hit]] = False
        on = left[alive] > depth
        alive, node = alive[on], node[on]
    lone = np.flatnonzero(odd)
    arcs.append((lone, np.ones(len(lone), np.int64), -1 - chars[lone], np.full(len(lone), trie.unknown)))
    start, size, ids, scores = (np.concatenate(x) for x in zip(*arcs, strict=True))
    # Positions are numbered through, one more than characters in each unit. Arcs are put in order of where they lead.
    source = start + unit[start]
    target = source + size
    base = ends - sizes + np.arange(len(units))
    order = np.argsort(target * 128 - size)
    source, target, ids, scores = source[order], target[order], ids[order], scores[order]
    firsts = np.flatnonzero(np.diff(target, prepend=-1))
    into = np.full(len(chars) + len(units), -1)
    into[target[firsts]] = np.arange(len(firsts))
    lasts = np.append(firsts[1:], len(target))
    # Forward: positions at the same distance from their units' starts at once.
    best, by = np.full(len(into), -np.inf), np.full(len(into), -1)
    best[base] = 0.0
    away = target[firsts] - np.repeat(base, sizes + 1)[target[firsts]]
    turn = np.argsort(away, kind="stable")
    for run in np.split(turn, np.flatnonzero(np.diff(away[turn])) + 1):
        counts = lasts[run] - firsts[run]
        heads = np.cumsum(counts) - counts
        own = np.repeat(firsts[run] - heads, counts) + np.arange(int(counts.sum()))
        value = best[source[own]] + scores[own]
        top = np.maximum.reduceat(value, heads)
        where = target[firsts[run]]
        best[where] = top
        by[where] = own[_last(value == np.repeat(top, counts), heads)]
    # Backward. A step is an arc and the number of the step after it, so a result is the number of its first step.
    goals = base + sizes
    first, lost = np.full((len(units), n), -1), np.full((len(units), n), np.inf)
    arcs, after, steps = [], [], 0
    agenda = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
    who, here, gone, last = np.arange(len(units)), goals, np.zeros(len(units)), np.full(len(units), -1)
    for k in range(n):
        if not len(who):
            break
        lost[who, k] = best[goals[who]] - (gone + best[here])
        passed = []
        whose = who
        while len(whose):
            on = here > base[whose]
            first[whose[~on], k] = last[~on]
            whose, here, gone, last = whose[on], here[on], gone[on], last[on]
            arc = by[here]
            passed.append((whose, here, arc, gone, last))
            arcs.append(arc)
            after.append(last)
            last = steps + np.arange(len(arc))
            steps += len(arc)
            gone, here = gone + scores[arc], source[arc]
        if k == n - 1:
            break
        # Agenda: whose, estimate, arc, score from there to the end, the step after it.
        whose, here, arc, gone, last = (np.concatenate(x) for x in zip(*passed, strict=True))
        run = into[here]
        counts = lasts[run] - firsts[run]
        heads = np.cumsum(counts) - counts
        row = np.repeat(np.arange(len(run)), counts)
        other = np.repeat(firsts[run] - heads, counts) + np.arange(int(counts.sum()))
        row, other = (x[other != arc[row]] for x in (row, other))
        to_end = gone[row] + scores[other]
        agenda = [np.concatenate(x) for x in zip(agenda, (whose[row], to_end + best[source[other]], other, to_end, last[row]), strict=True)]
        order = np.lexsort((-agenda[1], agenda[0]))
        own = agenda[0][order]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        place = np.arange(len(own)) - np.repeat(heads, np.diff(np.append(heads, len(own))))
        who, _, arc, gone, last = (x[order[heads]] for x in agenda)
        # No more than are still asked for need to stay.
        stay = order[(place > 0) & (place < n - 1 - k)]
        agenda = [x[stay] for x in agenda]
        here = source[arc]
        arcs.append(arc)
        after.append(last)
        last = steps + np.arange(len(arc))
        steps += len(arc)
    arcs, after = np.concatenate(arcs), np.concatenate(after)
    row = np.flatnonzero(first.ravel() >= 0)
    step, ways = first.ravel()[row], []
    while len(row):
        ways.append((row, ids[arcs[step]]))
        step = after[step]
        row, step = row[step >= 0], step[step >= 0]
    row, own = (np.concatenate(x) for x in zip(*ways, strict=True))
    order = np.argsort(row, kind="stable")
    own, own_k = spelt(own[order], trie.bytes_from)
    return Found(own.astype(np.int32), np.bincount(row[order], own_k, len(units) * n).astype(np.int64), best[goals], lost)


@cache
def combinations(n: int) -> np.ndarray:
    """Rows of alternatives, one for each of n - 1 choices, among which the n best combinations are: one that takes the
    i-th, the j-th ... alternative is no better than (i + 1)(j + 1)... others, itself included."""
    rows = [(0,) * (n - 1)]
    for choice in range(n - 1):
        rows += [(*r[:choice], i, *r[choice + 1 :]) for r in rows for i in range(1, n) if (i + 1) * math.prod(x + 1 for x in r) <= n]
    return np.array(rows, np.int64).reshape(len(rows), n - 1)


class Encoder:
    """The n best segmentations of texts; their parts are remembered, as rows of numbers."""

    def __init__(self, v: Vocabulary, n: int = NBEST):
        self.v, self.trie, self.n = v, Trie(v), n
        self.index: dict[str, int] = {}
        self.found = n_best(self.trie, [], n)
        self.uses = np.zeros(0, np.int64)

    def alone(self, units: list[str]) -> Found:
        """Long units: cut into parts, each searched on its own."""
        rows = [_combined([nbest_word(self.v, p, self.n) for p in parts(self.v, unit)], self.n) for unit in units]
        none = [(-np.inf, [])]
        full = [r + none * (self.n - len(r)) for r in rows]
        score = np.array([[s for s, _ in r] for r in full]).reshape(len(full), self.n)
        return Found(
            np.array([i for r in rows for _, ids in r for i in ids], np.int32), np.array([len(ids) for r in full for _, ids in r], np.int64),
            score[:, 0], score[:, :1] - score,
        )

    def learn(self, wanted: list[str]) -> np.ndarray:
        """The numbers of different parts; those that aren't remembered are searched."""
        if len(self.index) > REMEMBERED:
            stay = np.argsort(-self.uses, kind="stable")[: REMEMBERED // 3]
            stay = stay[self.uses[stay] > 1]
            names = list(self.index)
            self.index = {names[i]: n for n, i in enumerate(stay.tolist())}
            self.found, self.uses = self.found.taken(stay), np.ones(len(stay), np.int64)
        fresh = [u for u in wanted if u not in self.index]
        short, long = [u for u in fresh if len(u) <= LONG], [u for u in fresh if len(u) > LONG]
        self.found += n_best(self.trie, short, self.n) + self.alone(long)
        self.index.update(zip((*short, *long), range(len(self.index), len(self.index) + len(fresh))))
        self.uses = np.append(self.uses, np.zeros(len(fresh), np.int64))
        return np.fromiter(map(self.index.__getitem__, wanted), np.int64, len(wanted))

    def ranked(self, texts: list[str]) -> Found:
        """Of each text, as of units."""
        n = self.n
        every, size = self.trie.cut(texts)
        told = every.dictionary_encode()
        at = self.learn(told.dictionary.to_pylist())[told.indices.to_numpy()]
        self.uses += np.bincount(at, minlength=len(self.uses))
        heads = np.cumsum(size) - size
        # The n - 1 parts of each text that lose the least by their second best: changing one of them gives n results.
        loss, which = (self.found.lost[at, 1] if n > 1 else None), np.zeros((len(texts), n - 1), np.int64)
        for j in range(n - 1):
            least = np.minimum.reduceat(loss, heads)
            found = np.minimum.reduceat(np.where(loss == np.repeat(least, size), np.arange(len(at)), len(at)), heads)
            which[:, j] = np.where(least < np.inf, found, -1)  # none where all that have a second best are taken
            loss[which[which[:, j] >= 0, j]] = np.inf
        lost = np.where(which[:, :, None] >= 0, self.found.lost[at[which]], np.where(np.arange(n) > 0, np.inf, 0.0))
        picks = combinations(n)
        sums = sum((lost[:, j, picks[:, j]] for j in range(n - 1)), np.zeros((len(texts), len(picks))))
        order = np.argsort(sums, axis=1, kind="stable")[:, :n]
        lost = np.take_along_axis(sums, order, 1)
        there = lost < np.inf
        # The parts of every result, and in place of some of them their alternatives.
        text, rank = np.nonzero(there)
        rows = runs(at, size, text) * n
        place = np.cumsum(size[text]) - size[text] - heads[text]
        for j in range(n - 1):
            pick = picks[order[text, rank], j]
            rows[(place + which[text, j])[pick > 0]] += pick[pick > 0]
        counts = np.zeros(len(texts) * n, np.int64)
        counts[text * n + rank] = np.add.reduceat(self.found.sizes[rows], np.cumsum(size[text]) - size[text])
        return Found(runs(self.found.ids, self.found.sizes, rows), counts, np.add.reduceat(self.found.score[at], heads), lost)

    def best(self, texts: list[str]) -> tuple[Found, np.ndarray]:
        """ranked(), and at which piece the second best begins to stand in place of the best: the first."""
        return self.ranked(texts), np.zeros(len(texts), np.int64)


def _combined(found: list[list[tuple]], n: int) -> list[tuple[float, list[int]]]:
    """The n best of what the n best of parts in a row make: (score, ids)."""
    total = sum(f[0][0] for f in found)
    picked = choices([tuple(f[0][0] - s for s, _ in f[1:]) for f in found], n)
    return [(total - loss, [x for i, f in enumerate(found) for x in f[picks.get(i, 0)][1]]) for loss, picks in picked]


def nbest_text(v: Vocabulary, text: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a text: (score, ids)."""
    return _combined([nbest_word(v, p, n) for u in units(text) for p in parts(v, " " + u)], n)


def decode(v: Vocabulary, ids) -> str:
    """The text that ids stand for."""
    return b"".join(map(v.decoded.__getitem__, ids))[1:].decode("utf-8", "replace")


def changed(ids, at: int, gone: int, new) -> list[int]:
    """`ids` with `gone` of them from `at` on replaced by `new`."""
    return [*ids[:at], *new, *ids[at + gone :]]


def _lists(flat: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of the given sizes as an Arrow array of lists."""
    return pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), pa.array(flat))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches with texts of about BATCH characters."""
    for whole in batches:
        lengths = np.cumsum(pc.fill_null(pc.utf8_length(whole.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(lengths // BATCH)) + 1).tolist(), whole.num_rows]
        for at, end in zip(cuts, cuts[1:]):
            if end > at:
                yield whole.slice(at, end - at)


def round_trips(docs: DataFrame, model: str | None = None, nbest: int = NBEST) -> DataFrame:
    """(doc_id, n_pieces, ids, score, next_score, next_scores, next_ids, decoded_sha256, exact) of every row of
    docs(doc_id, text).

    `ids` and `score` are the best segmentation; `next_ids` and `next_scores` are the others of the `nbest` best, in whole
    lists of ids, the second best first, fewer where there are fewer. `next_score` is the second best's, null where there
    is none. `exact` says that decoding `ids` gives the text back."""
    if nbest < 2:
        raise ValueError("the two best at least")
    shared = shared_vocabulary(docs.sparkSession, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        own = Encoder(v, nbest)
        spelling, spelling_n = np.frombuffer(b"".join(v.decoded), np.uint8), np.fromiter(map(len, v.decoded), np.int64, len(v.decoded))
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = own.ranked(texts)
            ids, there = found.own, found.lost < np.inf
            scores, others = found.score[:, None] - found.lost, np.arange(nbest) > 0
            back = runs(spelling, spelling_n, ids).tobytes()
            ends = np.append(0, np.cumsum(np.add.reduceat(spelling_n[ids], np.cumsum(found.own_n) - found.own_n))).tolist()
            # All decoded texts begin with a blank that isn't theirs.
            texts_back = [back[a + 1 : b] for a, b in zip(ends, ends[1:])]
            next_ids = _lists(found.ids[np.repeat(np.tile(others, len(texts)), found.sizes)], found.sizes[(there & others).ravel()])
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_pieces": pa.array(found.own_n),
                "ids": _lists(ids, found.own_n),
                "score": pa.array(found.score),
                "next_score": pa.array(scores[:, 1], mask=~there[:, 1]),
                "next_scores": _lists(scores[there & others], there.sum(1) - 1),
                "next_ids": _lists(next_ids, there.sum(1) - 1),
                "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in texts_back]),
                "exact": pa.array([t.encode() == b for t, b in zip(texts, texts_back)]),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        encode,
        f"doc_id {kind}, n_pieces long, ids array<int>, score double, next_score double, next_scores array<double>, next_ids array<array<int>>, decoded_sha256 string, exact boolean",
    )


def segmentations(docs: DataFrame, model: str | None = None, nbest: int = NBEST) -> DataFrame:
    """(doc_id, rank, score, ids): the n best segmentations of every row of docs(doc_id, text), from rank 0."""
    shared = shared_vocabulary(docs.sparkSession, model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(shared.value, nbest)
        for batch in _slices(batches):
            found = own.ranked([t or "" for t in batch.column("text").to_pylist()])
            doc, rank = np.nonzero(found.lost < np.inf)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(doc)),
                    pa.array(rank.astype(np.int32)),
                    pa.array((found.score[:, None] - found.lost)[doc, rank]),
                    _lists(found.ids, found.sizes[doc * nbest + rank]),
                ],
                ["doc_id", "rank", "score", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, rank int, score double, ids array<int>")


def decoded(encodings: DataFrame, model: str | None = None) -> DataFrame:
    """`encodings` with the column `decoded`: the texts that their column `ids` stands for."""
    shared = shared_vocabulary(encodings.sparkSession, model)
    names, kinds = encodings.columns, encodings.schema.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids = batch.column("ids")
                texts = pa.array([None if x.values is None else decode(v, x.values.to_numpy(zero_copy_only=False).tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*names, "decoded"])

    return encodings.mapInArrow(back, kinds[len("struct<") : -1] + ",decoded:string")
