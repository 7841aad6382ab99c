"""Affine-gap alignment in numpy, and its column functions.

A gap of n costs open + (n - 1) * extend. Spark distributes the pairs; only
those that survive the column-function filters should reach these functions.
Scores of many pairs are worked out at once, one antidiagonal of all their
matrices at a time: its cells don't depend on each other, so a step is a few
operations on small whole numbers. A traceback is made in the part of the target
that the score-only pass has found, with one byte a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.proteins import base_scores, protein_scores

_LOW = -(1 << 40)
LOCAL_DNA, WITHIN_DNA, PROTEIN = base_scores(1, -1), base_scores(5, -4), protein_scores()
#: The part of a motif's own score from which it counts as found.
FOUND = 0.7
_FIELDS = ("score", "start", "end", "matches", "mismatches", "gaps")


def _codes(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)


def _row(h: np.ndarray, f: np.ndarray, s: np.ndarray, steps: np.ndarray, gap_open: int, gap_extend: int, floor: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next row: best scores, those that end in a gap of the target, those by the diagonal, and those by a gap of the query."""
    f = np.maximum(h - gap_open, f - gap_extend)
    d = np.full(len(h), 0 if floor else _LOW, np.int64)
    d[1:] = np.maximum(h[:-1] + s, 0) if floor else h[:-1] + s
    best = np.maximum(d, f)
    # gaps along the row: the best earlier cell, less what it costs to come from there
    run = np.maximum.accumulate(best + steps)
    e = np.full(len(h), _LOW, np.int64)
    e[1:] = run[:-1] - gap_open - steps[1:] + gap_extend
    return np.maximum(best, e), f, d, e


def local_score(query: str, target: str, scores: np.ndarray = LOCAL_DNA, gap_open: int = 5, gap_extend: int = 1) -> int:
    """Best local alignment score."""
    if not query or not target:
        return 0
    t, m = _codes(target), len(target)
    h, f, steps, best = np.zeros(m + 1, np.int64), np.full(m + 1, _LOW, np.int64), np.arange(m + 1) * gap_extend, 0
    profile = {q: scores[q][t] for q in set(_codes(query).tolist())}
    for q in _codes(query).tolist():
        h, f, _, _ = _row(h, f, profile[q], steps, gap_open, gap_extend, True)
        h = np.maximum(h, 0)
        best = max(best, int(h.max()))
    return best


def within_score(query: str, target: str, scores: np.ndarray = WITHIN_DNA, gap_open: int = 5, gap_extend: int = 2) -> tuple[int, int]:
    """Score and end of the whole query within the target, whose ends are free."""
    t, m = _codes(target), len(target)
    h, f, steps = np.zeros(m + 1, np.int64), np.full(m + 1, _LOW, np.int64), np.arange(m + 1) * gap_extend
    profile = {q: scores[q][t] for q in set(_codes(query).tolist())}
    for q in _codes(query).tolist():
        h, f, _, _ = _row(h, f, profile[q], steps, gap_open, gap_extend, False)
    end = int(h.argmax())
    return int(h[end]), end


#: Cells of an antidiagonal of a group of pairs, and letters of its targets, at most; below the least cells a step costs the same whatever it does.
GROUP_CELLS, LEAST_CELLS, GROUP_LETTERS = 1 << 15, 1 << 13, 1 << 26


def _groups(queries: list[np.ndarray], targets: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Pairs of near lengths, so that little of a group is padding."""
    n, m = (np.array([len(x) for x in y], np.int64) for y in (queries, targets))
    steps = np.floor(2 * np.log2(np.maximum(n, 1)))
    order = np.lexsort((m, steps))
    at = 0
    while at < len(order):
        to = at + 1
        first = order[at]
        wide, long = int(n[first]), int(m[first])
        while to < len(order) and steps[order[to]] == steps[first] and (m[order[to]] <= 1.2 * m[first] + 64 or (to + 1 - at) * (wide + 1) <= LEAST_CELLS):
            wide, long = max(wide, int(n[order[to]])), int(m[order[to]])
            if (to + 1 - at) * (wide + 1) > GROUP_CELLS or (to + 1 - at) * (long + 2 * wide) > GROUP_LETTERS:
                break
            to += 1
        yield order[at:to]
        at = to


def _letters(seqs: list[np.ndarray], before: int, length: int, pad: int) -> np.ndarray:
    """Letters by place and sequence, each sequence from before on, pad around it."""
    out = np.full((len(seqs), length), pad, np.uint8)
    for row, seq in zip(out, seqs, strict=True):
        row[before : before + len(seq)] = seq
    return out


def _diagonals(queries: list[np.ndarray], targets: list[np.ndarray], scores: np.ndarray, gap_open: int, gap_extend: int, local: bool) -> tuple[np.ndarray, np.ndarray]:
    """Best scores of a group, and for whole queries within targets (not local) the smallest ends that have them."""
    n, m = max(map(len, queries)), max(map(len, targets))
    pairs = len(queries)
    known = np.unique(np.concatenate([*queries, *targets]))
    code = np.zeros(256, np.uint8)
    code[known] = np.arange(len(known))
    pad, k = len(known), len(known) + 1
    table = np.full((k, k), min(-1, int(scores[np.ix_(known, known)].min())), np.int64)
    table[:pad, :pad] = scores[np.ix_(known, known)]
    top = int(max(table.max(), -table.min(), gap_open, gap_extend))
    kind = np.int16 if 4 * top * (n + 2) < 15_000 else np.int32
    low = kind(-15_000 if kind == np.int16 else -(1 << 29))
    table = table.astype(kind)
    q = np.ascontiguousarray(_letters([code[x] for x in queries], 0, n, pad).T)
    # reversed, so that the letters that meet the query's on an antidiagonal lie in order
    t = np.ascontiguousarray(_letters([code[x] for x in targets], n, m + 2 * n, pad)[:, ::-1].T)
    same, other = np.diag(table), table[~np.eye(k, dtype=bool)]
    plain = len(other) and (other == other[0]).all() and set(same.tolist()) <= {int(same.max()), int(other[0])}
    if plain:  # one score for equal letters, but those that equal nothing, and one for all others
        q[np.isin(q, np.flatnonzero(same == other[0]))] = 255
    else:
        q = q.astype(np.uint16) * k
    h1, h2, e, f = (np.full((n + 1, pairs), 0 if local else low, kind) for _ in range(4))
    if not local:
        h1[0] = h2[0] = 0
    e[:], f[:] = low, low
    best = np.zeros((n + 1, pairs), kind)
    sizes, lengths, column = np.array(list(map(len, queries))), np.array(list(map(len, targets))), np.arange(pairs)
    score, end = np.full(pairs, low, np.int64), np.zeros(pairs, np.int64)
    if not local:  # diagonal 1 has the first cell of the column without target letters
        h1[1], f[1] = -gap_open, -gap_open
    match, miss = same.max(), other[0] if plain else 0
    for d in range(1 if not local else 2, n + m + 1):
        if d > 1:
            hi = n if local else min(n, d - 1)
            window = t[m + n - d + 1 : m + n - d + 1 + hi]
            s = np.where(q[:hi] == window, match, miss) if plain else table.ravel()[q[:hi] + window]
            f_new = np.maximum(h1[:hi] - kind(gap_open), f[:hi] - kind(gap_extend))
            np.maximum(h1[1 : hi + 1] - kind(gap_open), e[1 : hi + 1] - kind(gap_extend), out=e[1 : hi + 1])
            s += h2[:hi]
            np.maximum(s, f_new, out=s)
            np.maximum(s, e[1 : hi + 1], out=s)
            f[1 : hi + 1] = f_new
            h2, h1 = h1, h2
            if local:
                np.maximum(s, 0, out=h1[1:])
                np.maximum(best, h1, out=best)
            else:
                h1[1 : hi + 1] = s
                h1[0] = 0
                if d <= n:
                    h1[d] = f[d] = -(gap_open + (d - 1) * gap_extend)
                    e[d] = low
        if not local:
            j = d - sizes
            value = h1[sizes, column].astype(np.int64)
            better = (j >= 0) & (j <= lengths) & (value > score)
            score[better], end[better] = value[better], j[better]
    return (best.max(axis=0).astype(np.int64), end) if local else (score, end)


#: Letters of targets that are worked on together, and of the longest target that is; longer ones go by antidiagonals.
CHUNK_LETTERS, LONGEST = 1 << 15, 1 << 22
#: Bits of each count that a row of _forward carries.
_BITS = 15


def _forward(queries: list[np.ndarray], targets: list[np.ndarray], scores: np.ndarray, gap_open: int, gap_extend: int, carry: bool) -> tuple[np.ndarray, ...]:
    """Whole queries within targets, row by row over all targets laid end to end: scores and smallest ends; with carry also what semi_global's traceback from each target's last letter counts: start, matches, mismatches, gaps.

    Queries come by falling length, so that those which are done lie at the end.
    """
    n, width = np.array(list(map(len, queries))), np.array([len(t) + 1 for t in targets])
    heads = np.concatenate(([0], np.cumsum(width)[:-1]))
    total, top = int(width.sum()), int(np.abs(scores).max())
    code = np.zeros(256, np.int64)
    known = np.unique(np.concatenate([*queries, *targets]))
    code[known] = np.arange(len(known))
    table = np.ascontiguousarray(scores[np.ix_(known, known)], np.int32).ravel()
    grid = np.full((int(n.max()), len(n)), 0, np.int64)
    for k, q in enumerate(queries):
        grid[: len(q), k] = code[q] * len(known)
    t = np.zeros(total, np.int64)
    place = np.arange(total)
    inside = np.ones(total, bool)
    inside[heads] = False
    t[inside] = code[np.concatenate(targets)]
    # best scores differ by less than apart, so nothing runs on from one target to the next
    apart = 2 * (top + gap_open + gap_extend) * (int(n.max()) + 2)
    kind = np.int32 if apart * len(n) + total * gap_extend < 1 << 30 else np.int64
    low = kind(-(1 << 29))
    steps = (place * gap_extend + np.repeat(np.arange(len(n)) * apart, width)).astype(kind)
    h, f, e = np.zeros(total, kind), np.full(total, low, kind), np.full(total, low, kind)
    one, two, three = 1 << _BITS, 1 << 2 * _BITS, 1 << 3 * _BITS
    if carry:
        ih, i_f = (place - np.repeat(heads, width)) * three, np.zeros(total, np.int64)
        positive = np.where((table > 0) & np.eye(len(known), dtype=bool).ravel(), two, one)
    score, end, info = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    active = len(n)
    for i in range(int(n.max())):
        if n[active - 1] == i:  # the queries that are done
            active = int(np.searchsorted(-n, -i, side="left"))
            total = int(heads[active])
            h, f, e, t, steps = h[:total], f[:total], e[:total], t[:total], steps[:total]
            if carry:
                ih, i_f, place = ih[:total], i_f[:total], place[:total]
        starts = heads[:active]
        at = np.repeat(grid[i, :active], width[:active])
        at += t
        opened, d = h - kind(gap_open), np.empty(total, kind)
        f -= kind(gap_extend)
        if carry:
            i_f = np.where(f >= opened, i_f, ih) + 1
        np.maximum(f, opened, out=f)
        np.add(h[:-1], table.take(at[1:]), out=d[1:])
        d[starts] = low
        best = np.maximum(d, f)
        value = best + steps
        run = np.maximum.accumulate(value)
        np.subtract(run[:-1], steps[1:], out=e[1:])
        e += kind(gap_extend - gap_open)
        e[starts] = low
        if carry:
            i_d = np.zeros(total, np.int64)
            np.add(ih[:-1], positive.take(at[1:]), out=i_d[1:])
            i_best = np.where(d >= f, i_d, i_f)
            first = np.zeros(total, np.int64)  # the first place that has the best value so far
            first[1:] = np.where(value[1:] > run[:-1], place[1:], 0)
            first = np.maximum.accumulate(first)
            i_e = np.zeros(total, np.int64)
            i_e[1:] = i_best[first[:-1]] + (place[1:] - first[:-1])
            ih = np.where(e > best, i_e, i_best)
        h = np.maximum(best, e)
        done = np.flatnonzero(n[:active] == i + 1)
        if len(done):
            of = slice(int(heads[done[0]]), total)
            score[done] = np.maximum.reduceat(h[of], heads[done] - of.start)
            hit = np.where(h[of] == np.repeat(score[done], width[done]), np.arange(total - of.start), total)
            end[done] = np.minimum.reduceat(hit, heads[done] - of.start) + of.start - heads[done]
            if carry:
                info[done] = ih[heads[done] + width[done] - 1]
    low_bits = one - 1
    return (score, end, info >> 3 * _BITS, info >> 2 * _BITS & low_bits, info >> _BITS & low_bits, info & low_bits) if carry else (score, end)


def _chunks(n: list[int], m: list[int]) -> Iterator[np.ndarray]:
    """Pairs by falling length of the query, so many letters of targets at a time."""
    order, at = np.lexsort((m, -np.array(n))), 0
    after = np.cumsum(np.array(m)[order] + 1)
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + CHUNK_LETTERS, side="right")))
        yield order[at:to]
        at = to


def _many(queries: Sequence[str], targets: Sequence[str], scores: np.ndarray, gap_open: int, gap_extend: int, local: bool) -> tuple[np.ndarray, np.ndarray]:
    score, end = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
    some = [i for i, (q, t) in enumerate(zip(queries, targets, strict=True)) if q and t]
    if not local:
        rows = [i for i in some if len(targets[i]) <= LONGEST]
        some = [i for i in some if len(targets[i]) > LONGEST]
        for chunk in _chunks([len(queries[i]) for i in rows], [len(targets[i]) for i in rows]):
            at = np.array(rows)[chunk]
            score[at], end[at] = _forward([_codes(queries[i]) for i in at], [_codes(targets[i]) for i in at], scores, gap_open, gap_extend, False)
    q, t = [_codes(queries[i]) for i in some], [_codes(targets[i]) for i in some]
    for group in _groups(q, t):
        at = np.array(some)[group]
        score[at], end[at] = _diagonals([q[i] for i in group], [t[i] for i in group], scores, gap_open, gap_extend, local)
    return score, end


def local_scores(queries: Sequence[str], targets: Sequence[str], scores: np.ndarray = LOCAL_DNA, gap_open: int = 5, gap_extend: int = 1) -> np.ndarray:
    """local_score of many pairs; 0 if either is empty."""
    return _many(queries, targets, scores, gap_open, gap_extend, True)[0]


def scores_within(queries: Sequence[str], targets: Sequence[str], scores: np.ndarray = WITHIN_DNA, gap_open: int = 5, gap_extend: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """within_score of many pairs: scores and ends; 0 and 0 if either is empty."""
    return _many(queries, targets, scores, gap_open, gap_extend, False)


#: Cells of a column of motifs, and letters of several targets that one run goes through at most.
COLUMN, RUN_LETTERS = 192, 1 << 13


class Motifs:
    """Scores of many whole queries within targets, one letter of the targets at a time for all queries.

    Queries lie one below the other in columns, each below a cell where it
    begins. A row sees each letter one step after the row above, so the cells of a
    step don't depend on each other. Targets follow each other with a letter
    between that equals nothing and where all queries start anew.
    """

    def __init__(self, queries: Sequence[str], scores: np.ndarray = WITHIN_DNA, gap_open: int = 5, gap_extend: int = 2) -> None:
        n = np.array(list(map(len, queries)), np.int64)
        longest = int(n.max())
        self.kind = np.int16 if 4 * int(np.abs(scores).max() + gap_open + gap_extend) * (longest + 2) < 8000 else np.int32
        self.low, self.extend = (-8000 if self.kind == np.int16 else -(1 << 27)), gap_extend
        height = max(COLUMN, longest + 1)
        room: list[int] = []
        places = []
        for k in np.argsort(-n, kind="stable").tolist():  # the first column with room
            c = next((c for c, r in enumerate(room) if r > n[k]), len(room))
            room[c:] = room[c:] or [height]
            places.append((k, height - room[c], c))
            room[c] -= int(n[k]) + 1
        cells = (height + 1, len(room))
        codes = [_codes(q) for q in queries]
        known = np.unique(np.concatenate(codes))
        self.letters, shape = len(known) + 1, (len(known) + 2, height, len(room))
        self.code = np.full(256, len(known), np.int64)  # the last two: letters of no query, and the one between targets
        self.code[known] = np.arange(len(known))
        profile = np.full(shape, self.low, self.kind)
        others = np.setdiff1d(np.arange(256), known)
        self.start, self.floor = np.zeros(cells, self.kind), np.zeros(cells, self.kind)
        self.opening, self.extending = np.full(cells, gap_open, self.kind), np.full(cells, gap_extend, self.kind)
        self.row, self.end = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for k, r, c in places:
            of = slice(r + 1, r + 1 + len(codes[k]))
            profile[:-2, of, c] = scores[np.ix_(known, codes[k])]
            profile[-2, of, c] = scores[np.ix_(others, codes[k])].max(axis=0)
            of, last = slice(r + 2, r + 2 + len(codes[k])), r + 1 + len(codes[k])
            self.start[of, c] = -(gap_open + np.arange(len(codes[k])) * gap_extend)
            self.floor[of, c] = 2 * self.low
            self.opening[last, c] = self.extending[last, c] = -self.low  # no gap runs on into the next query
            self.row[k], self.end[k] = last, last * cells[1] + c
        self.profile, self.height = profile.reshape(-1, len(room)), height

    def _run(self, targets: list[np.ndarray]) -> np.ndarray:
        height, between = self.height, self.letters
        size = np.array([len(t) + 1 for t in targets], np.int64)
        heads = np.concatenate(([0], np.cumsum(size)[:-1]))
        total = int(size.sum())
        letters = np.full(total + 2 * height, between, np.int64)
        for at, t in zip(heads.tolist(), targets, strict=True):
            letters[height + at + 1 : height + at + 1 + len(t)] = self.code[t]
        letters = np.ascontiguousarray(letters[::-1]) * height
        rows, x = np.arange(height), self.kind(self.extend)
        h1, h2 = self.start.copy(), self.start.copy()
        e, f, f2 = (np.full(h1.shape, self.low, self.kind) for _ in range(3))
        opened, s, cut = np.empty_like(h1), np.empty_like(h1[1:]), np.zeros(total + 2 * height, bool)
        cut[heads] = True
        many = len(targets) > 1
        seen = np.empty((total + height, len(self.end)), self.kind) if many else None
        best, value = self.start.ravel().take(self.end), np.empty(len(self.end), self.kind)
        for step in range(1, total + height):
            at = total + height - step
            np.take(self.profile, letters[at : at + height] + rows, axis=0, out=s, mode="clip")
            s += h2[:-1]
            np.subtract(h1, self.opening, out=opened)
            f -= self.extending
            e -= x
            np.maximum(opened[:-1], f[:-1], out=f2[1:])
            f, f2 = f2, f
            f[0] = self.low  # no gap comes in from above, nor sinks without end
            np.maximum(e, opened, out=e)
            if many and len(anew := np.flatnonzero(cut[max(0, step - height) : step])):  # rows that see the letter between targets
                e[step - max(0, step - height) - anew] = self.low
            np.maximum(s, f[1:], out=s)
            np.maximum(s, e[1:], out=s)
            np.maximum(s, self.floor[1:], out=h2[1:])
            h1, h2 = h2, h1
            if many:
                np.take(h1.ravel(), self.end, out=seen[step], mode="clip")
            else:
                np.take(h1.ravel(), self.end, out=value, mode="clip")
                np.maximum(best, value, out=best)
        if not many:
            return best[None].astype(np.int64)
        seen[0] = best
        out = np.empty((len(targets), len(self.end)), np.int64)
        for k, (row, column) in enumerate(zip(self.row.tolist(), np.ascontiguousarray(seen.T), strict=True)):
            out[:, k] = np.maximum.reduceat(column[row : row + total], heads)
        return out

    def scores(self, targets: Sequence[str]) -> np.ndarray:
        """The best score of each query (columns) within each target (rows)."""
        codes, out = [_codes(t) for t in targets], np.zeros((len(targets), len(self.end)), np.int64)
        at = 0
        while at < len(codes):
            to, letters = at + 1, len(codes[at])
            while to < len(codes) and letters + len(codes[to]) <= RUN_LETTERS:
                letters += len(codes[to]) + 1
                to += 1
            out[at:to] = self._run(codes[at:to])
            at = to
        return out


def _reach(query: str, score: int, scores: np.ndarray, gap_extend: int) -> int:
    """How far back from its end an alignment of that score can begin."""
    return len(query) + max(0, (int(scores[_codes(query), _codes(query)].sum()) - score)) // max(1, gap_extend) + 1


def semi_global(query: str, target: str, scores: np.ndarray = WITHIN_DNA, gap_open: int = 5, gap_extend: int = 2, known: tuple[int, int] | None = None) -> dict[str, int]:
    """The whole query within the target, whose ends are free: score, start, end, matches, mismatches, gaps.

    A first pass finds score and end. No alignment reaches back further than
    the query and the gaps that a score not below the worst can pay for, so
    directions are kept for that part only. known: its score and end.
    """
    score, end = known or within_score(query, target, scores, gap_open, gap_extend)
    n = len(query)
    begin = max(0, end - _reach(query, score, scores, gap_extend))
    t, m = _codes(target)[begin:end], end - begin
    h, f, steps = np.zeros(m + 1, np.int64), np.full(m + 1, _LOW, np.int64), np.arange(m + 1) * gap_extend
    ways = np.zeros((n + 1, m + 1), np.uint8)  # 0 diagonal, 1 a gap in the target, 2 one in the query; 4 and 8: that gap goes on
    q = _codes(query)
    for i in range(1, n + 1):
        old_f = f
        h, f, d, e = _row(h, f, scores[q[i - 1]][t], steps, gap_open, gap_extend, False)
        way = np.where(h == d, 0, np.where(h == f, 1, 2)).astype(np.uint8)
        way[1:] |= np.where(e[1:] == e[:-1] - gap_extend, 8, 0).astype(np.uint8)
        ways[i] = way | np.where(f == old_f - gap_extend, 4, 0).astype(np.uint8)
    i, j, matches, mismatches, lost = n, m, 0, 0, 0
    while i > 0:
        way = ways[i, j] & 3
        if way == 0:
            i, j = i - 1, j - 1
            same = q[i] == t[j] and scores[q[i], t[j]] > 0
            matches, mismatches = matches + same, mismatches + (not same)
        elif way == 1:
            while ways[i, j] & 4 and i > 1:
                i, lost = i - 1, lost + 1
            i, lost = i - 1, lost + 1
        else:
            while ways[i, j] & 8 and j > 1:
                j, lost = j - 1, lost + 1
            j, lost = j - 1, lost + 1
    return {"score": score, "start": begin + j, "end": end, "matches": int(matches), "mismatches": int(mismatches), "gaps": lost}


def _shares(found: np.ndarray, own: np.ndarray) -> list[float]:
    return [round(min(1.0, int(a) / max(1, int(b))), 4) for a, b in zip(found, own, strict=True)]


def _own_scores(seqs: Sequence[str], scores: np.ndarray, gap_open: int, gap_extend: int) -> np.ndarray:
    """Each sequence's score against itself; equal ones are scored once."""
    distinct = sorted(set(seqs))
    score = dict(zip(distinct, local_scores(distinct, distinct, scores, gap_open, gap_extend).tolist(), strict=True))
    return np.array([score[x] for x in seqs], np.int64)


def local_ratios(motifs: Sequence[str], targets: Sequence[str]) -> list[float]:
    """Local scores over the motifs' own scores, 1 at most, to four digits."""
    return _shares(local_scores(motifs, targets), _own_scores(motifs, LOCAL_DNA, 5, 1))


def protein_ratios(proteins: Sequence[str], frames: Sequence[Sequence[str | None]]) -> list[float]:
    """Local scores (BLOSUM62, gaps 10 and 1) in the best of each row's frames over the proteins' own, 1 at most, to four digits."""
    row = [i for i, x in enumerate(frames) for t in x if t]
    best = np.zeros(len(proteins), np.int64)
    np.maximum.at(best, row, local_scores([proteins[i] for i in row], [t for x in frames for t in x if t], PROTEIN, 10, 1))
    return _shares(best, _own_scores(proteins, PROTEIN, 10, 1))


def dna_ratio(motif: str, target: str) -> float:
    """Local score of the better strand over the motif's own, 1 at most, to four digits."""
    back = motif[::-1].translate(str.maketrans("ACGT", "TGCA"))
    return max(local_ratios([motif, back], [target, target]))


def protein_ratio(protein: str, frames: list[str | None]) -> float:
    """protein_ratios of one row."""
    return protein_ratios([protein], [frames])[0]


def _where_given(given: pd.Series, work: Callable[[np.ndarray], Sequence[float]]) -> pd.Series:
    """work's values for the rows that have something, null for the others."""
    out = pd.Series([None] * len(given), dtype="float64")
    rows = np.flatnonzero([bool(x) for x in given])
    if len(rows):
        out.iloc[rows] = work(rows)
    return out


@F.pandas_udf(T.DoubleType())
def local_ratio(motif: pd.Series, target: pd.Series) -> pd.Series:
    """Local score over the motif's own score, 1 at most; null without a motif."""
    return _where_given(motif, lambda rows: local_ratios([motif.iloc[i] for i in rows], [target.iloc[i] or "" for i in rows]))


@F.pandas_udf(T.DoubleType())
def best_protein_ratio(protein: pd.Series, frames: pd.Series) -> pd.Series:
    """protein_ratio of each row; null without a protein."""
    return _where_given(protein, lambda rows: protein_ratios([protein.iloc[i] for i in rows], [list(frames.iloc[i]) if frames.iloc[i] is not None else [] for i in rows]))


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("score", "end")]))
def within_scores(motif: pd.Series, target: pd.Series) -> pd.DataFrame:
    """Score and end only: what a search looks at before it traces hits back."""
    score, end = scores_within(motif.fillna("").tolist(), target.fillna("").tolist())
    return pd.DataFrame({"score": score, "end": end}).astype("int32")


def _hits(queries: Sequence[str], targets: Sequence[str], score: Sequence[int], end: Sequence[int], scores: np.ndarray, gap_open: int, gap_extend: int) -> list[dict[str, int]]:
    """semi_global of many pairs whose scores and ends are known: the counts of a traceback are carried along in the part of the target that it can reach."""
    out: list[dict[str, int]] = [{} for _ in queries]
    begin = [max(0, b - _reach(q, a, scores, gap_extend)) for q, a, b in zip(queries, score, end, strict=True)]
    rows = [i for i, q in enumerate(queries) if len(q) + end[i] - begin[i] < 1 << _BITS]
    for chunk in _chunks([len(queries[i]) for i in rows], [end[i] - begin[i] for i in rows]):
        at = [rows[i] for i in chunk]
        counts = _forward([_codes(queries[i]) for i in at], [_codes(targets[i][begin[i] : end[i]]) for i in at], scores, gap_open, gap_extend, True)[2:]
        for i, start, *rest in zip(at, *[c.tolist() for c in counts], strict=True):
            out[i] = dict(zip(_FIELDS, (score[i], begin[i] + start, end[i], *rest), strict=True))
    for i in set(range(len(queries))) - set(rows):  # more than a count holds
        out[i] = semi_global(queries[i], targets[i], scores, gap_open, gap_extend, (score[i], end[i]))
    return out


def traced(motifs: Sequence[str], targets: Sequence[str], scores: np.ndarray = WITHIN_DNA, gap_open: int = 5, gap_extend: int = 2) -> list[dict[str, int]]:
    """semi_global of many pairs at once; zeros if either is empty."""
    some = [i for i, (m, t) in enumerate(zip(motifs, targets, strict=True)) if m and t]
    m, t = [motifs[i] for i in some], [targets[i] for i in some]
    score, end = (x.tolist() for x in scores_within(m, t, scores, gap_open, gap_extend))
    out = [dict.fromkeys(_FIELDS, 0) for _ in motifs]
    for i, hit in zip(some, _hits(m, t, score, end, scores, gap_open, gap_extend), strict=True):
        out[i] = hit
    return out


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in _FIELDS]))
def semi_global_hit(motif: pd.Series, target: pd.Series) -> pd.DataFrame:
    """The best place of a motif in a target; zeros if either is empty."""
    return pd.DataFrame(traced(motif.fillna("").tolist(), target.fillna("").tolist()), columns=list(_FIELDS)).astype("int32")


def protein_hits(proteins: Sequence[str], frames: Sequence[Sequence[str | None]]) -> list[dict[str, int]]:
    """The best place of each protein in the best of its row's frames (BLOSUM62, gaps 11 and 1; the first of equals), and that frame's number.

    Only the best frame is traced. Zeros and frame -1 without a protein or frames.
    """
    pairs = [(i, k, x) for i, row in enumerate(frames) if proteins[i] for k, x in enumerate(row) if x]
    score, end = (x.tolist() for x in scores_within([proteins[i] for i, _, _ in pairs], [x for _, _, x in pairs], PROTEIN, 11, 1))
    best: dict[int, tuple[int, int, str, int]] = {}
    for (i, k, x), s, e in zip(pairs, score, end, strict=True):
        if i not in best or s > best[i][0]:
            best[i] = (s, e, x, k)
    rows = sorted(best)
    hits = _hits([proteins[i] for i in rows], [best[i][2] for i in rows], [best[i][0] for i in rows], [best[i][1] for i in rows], PROTEIN, 11, 1)
    out = [dict.fromkeys(_FIELDS, 0) | {"frame": -1} for _ in proteins]
    for i, hit in zip(rows, hits, strict=True):
        out[i] = hit | {"frame": best[i][3]}
    return out
