"""Line dedup with fuzzy lines.

Lines are normalised: lower case, letters, digits and single spaces (bytes of
scripts other than Latin without accents count as letters). Equal normalised
lines are one line, known by its earliest occurrence.

The words of a line are dealt to classes by their hash, and the SimHash of a
class's words is one block of the line's SimHash. By the pigeonhole principle
lines that differ in fewer words than there are classes share a block (a word
changed touches two classes at most). Lines of the same band of lengths join
on their blocks, short lines on two of them, and the shortest on their SimHash
without one word. Their lengths and whole SimHashes must
be near, too. In each bucket every line is
compared with the first line, which gives stars; then lines of different
groups in one bucket are compared with each other, so no candidate is left
out, and no edge is stored that a star has made needless. Linked lines have an edit
similarity of at least the given one, for lines of any length. One occurrence,
the earliest, is kept per connected group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOC, Table, Words, checkpoint, components, mix64, named_docs, names128, span_hashes, text_blocks, utf8

#: Shorter normalised lines are never removed.
MIN_CHARS = 12
#: A word's letters beyond the third tell lines apart; one block, or two, that make a key hold so many at least. Keys of the shortest lines hold so many letters.
ONE_TELLS, TWO_TELLS, KEY_CHARS = 8, 5, 4
#: Bands of lengths: lines below 48 bytes join on their SimHash without one of the words, or without none; lines below 160 bytes have 5 classes
#: and join on two blocks; then each band has 1.5 times the lengths of the last, and one block is a key.
_BOUNDS = np.array([48, 160, *(300 * 1.5**i for i in range(40))])
_CLASSES = np.array([1, 5, 6, *(round(8 * 1.18**i) for i in range(40))])
#: Lines of which one has so many bytes are candidates only if their whole SimHashes differ in so many bits at most; similar lines differ in some 9, others in some 30.
SIMHASH_CHARS, SIMHASH_BITS = 96, 18
# Letters, digits and all bytes of other scripts stay; line ends stay; anything else is a space.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_PLAIN[10] = 10
_TABLE = _PLAIN.tobytes()


def normal_forms(lines: list[str]) -> list[bytes]:
    """The normalised form of each line."""
    lower = pc.utf8_lower(pa.array(lines, pa.large_string())).cast(pa.large_binary()).to_pylist()
    return [b" ".join(x.translate(_TABLE).split()) for x in lower]


def edit_distance(a: bytes, b: bytes, limit: int) -> int:
    """Levenshtein distance of two byte strings by bit vectors; some number above limit if it is above."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    a, b = trimmed(a, b)
    if not a or not b:
        return max(len(a), len(b))
    if len(a) > 64 and least_distance(a, b) > limit:
        return limit + 1
    masks: dict[int, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for j, c in enumerate(b):
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up) & full, up & x
        score += bool(plus & top) - bool(minus & top)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~((eq | down) | plus) & full, plus & (eq | down)
        if score - (len(b) - j - 1) > limit:
            return limit + 1
    return score


def trimmed(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    """Both without the bytes that they begin and end with alike."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[:n], "little") ^ int.from_bytes(b[:n], "little")
    head = ((differs & -differs).bit_length() - 1) // 8 if differs else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differs = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    tail = ((differs & -differs).bit_length() - 1) // 8 if differs else n
    return a[: len(a) - tail], b[: len(b) - tail]


def edit_distances(pairs: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Levenshtein distances of many pairs at once: bit vectors of 64 rows, for all pairs of a chunk at each step."""
    out = np.zeros(len(pairs), np.int64)
    cut = [sorted(trimmed(a, b), key=len) for a, b in pairs]
    for k, (a, b) in enumerate(cut):
        out[k] = len(b)
    order = sorted((k for k, (a, _) in enumerate(cut) if a), key=lambda k: (-(-len(cut[k][0]) // 64), len(cut[k][1])))
    at = 0
    while at < len(order):
        words = -(-len(cut[order[at]][0]) // 64)
        chunk = order[at : at + max(16, 5120 // words)]
        at += len(chunk)
        out[chunk] = _chunk_distances([cut[k][0] for k in chunk], [cut[k][1] for k in chunk])
    return out


def _chunk_distances(rows: list[bytes], columns: list[bytes]) -> np.ndarray:
    n, one, zero = len(rows), np.uint64(1), np.uint64(0)
    m, steps = np.array([len(a) for a in rows]), np.array([len(b) for b in columns])
    words, every = -(-int(m.max()) // 64), np.arange(n)
    equal = np.zeros((n, 256, words), np.uint64)
    place = np.concatenate([np.arange(k) for k in m])
    np.bitwise_or.at(equal, (np.repeat(every, m), np.frombuffer(b"".join(rows), np.uint8), place // 64), one << (place % 64).astype(np.uint64))
    text = np.zeros((n, int(steps.max())), np.uint8)
    for k, b in enumerate(columns):
        text[k, : len(b)] = np.frombuffer(b, np.uint8)
    up, down = np.full((words, n), ~zero), np.zeros((words, n), np.uint64)
    plus, minus = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
    last, bit, score = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64), m.astype(np.int64)
    top = np.uint64(63)
    for j in range(text.shape[1]):
        eqs = equal[every, text[:, j]].T
        add, sub = np.full(n, one), np.zeros(n, np.uint64)  # what comes in from the word above
        for w in range(words):
            eq, p, q = eqs[w], up[w], down[w]
            xv = eq | q
            eq = eq | sub
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = q | ~(xh | p), p & xh
            plus[w], minus[w] = ph, mh
            out_add, out_sub = ph >> top, mh >> top
            ph, mh = ph << one | add, mh << one | sub
            up[w], down[w] = mh | ~(xv | ph), ph & xv
            add, sub = out_add, out_sub
        change = (plus[last, every] >> bit & one).astype(np.int64) - (minus[last, every] >> bit & one).astype(np.int64)
        score += np.where(j < steps, change, 0)
    return score


def grams(text: bytes, q: int) -> np.ndarray:
    """A hash of the q bytes at each place."""
    values = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    return span_hashes(values, np.arange(max(0, len(text) - q + 1)), np.arange(q, max(q, len(text) + 1)))


def least_distance(a: bytes, b: bytes) -> int:
    """A lower bound of the edit distance: an edit mends one surplus byte and one that lacks, and changes six sequences of six bytes."""
    surplus = np.bincount(np.frombuffer(a, np.uint8), minlength=256) - np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    bound = int(max(surplus[surplus > 0].sum(), -surplus[surplus < 0].sum()))
    if min(len(a), len(b)) > 256:
        both = np.concatenate((grams(a, 6), grams(b, 6)))
        values, which = np.unique(both, return_inverse=True)
        n = len(a) - 5
        differs = np.bincount(which[:n], minlength=len(values)) - np.bincount(which[n:], minlength=len(values))
        bound = max(bound, -(-int(np.abs(differs).sum()) // 12))
    return bound


def most_distance(a: bytes, b: bytes, q: int = 12) -> int:
    """An upper bound of the edit distance: sequences of q bytes that either text has once are matched in order, and the gaps between them compared."""
    x, y = grams(a, q), grams(b, q)
    vx, ax, nx = np.unique(x, return_index=True, return_counts=True)
    vy, ay, ny = np.unique(y, return_index=True, return_counts=True)
    _, i, j = np.intersect1d(vx[nx == 1], vy[ny == 1], assume_unique=True, return_indices=True)
    i, j = ax[nx == 1][i], ay[ny == 1][j]
    order = np.argsort(i)
    i, j = i[order].tolist(), j[order].tolist()
    tails: list[int] = []  # longest rising chain of places in b
    ends, back = [], [-1] * len(j)
    for k, v in enumerate(j):
        at = bisect_left(tails, v)
        back[k] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(k)
        else:
            tails[at], ends[at] = v, k
    chain, k = [], ends[-1] if ends else -1
    while k >= 0:
        chain.append(k)
        k = back[k]
    total = at_a = at_b = 0
    for k in reversed(chain):
        if i[k] >= at_a and j[k] >= at_b:
            u, v = a[at_a : i[k]], b[at_b : j[k]]
            total += edit_distance(u, v, max(len(u), len(v))) if max(len(u), len(v)) < 2048 else max(len(u), len(v))
            at_a, at_b = i[k] + q, j[k] + q
    u, v = a[at_a:], b[at_b:]
    return total + (edit_distance(u, v, max(len(u), len(v))) if max(len(u), len(v)) < 2048 else max(len(u), len(v)))


def similar(a: bytes, b: bytes, similarity: float) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer line's bytes. Bounds only spare the long way for long lines."""
    limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    if max(len(a), len(b)) > 1024:
        if least_distance(a, b) > limit:
            return False
        if most_distance(a, b) <= limit:
            return True
    return edit_distance(a, b, limit) <= limit


def _votes(ballots: np.ndarray, head: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Sums of the rows of ballots (64 bytes) from each head to the next, whose weights make total."""
    votes = np.add.reduceat(ballots.view(np.uint64), head, axis=0).view(np.uint8).astype(np.int32)  # eight counts at a time
    for k in np.flatnonzero(total > 255):  # more than a byte holds
        votes[k] = ballots[head[k] : head[k + 1] if k + 1 < len(head) else len(ballots)].sum(axis=0, dtype=np.int32)
    return votes


#: Letters beyond which lines are compared one by one, pairs and words of tables of a chunk at most, and pairs below which a chunk doesn't pay.
LONG_CHARS, CHUNK_PAIRS, CHUNK_WORDS, FEW_PAIRS = 4096, 2048, 1 << 21, 8


def within_limits(pairs: list[tuple[bytes, bytes]], limits: list[int]) -> np.ndarray:
    """Whether the edit distance of each pair (neither is empty) is at most its limit: many pairs at once, within the band that the limits leave."""
    out = np.zeros(len(pairs), bool)
    order = sorted(range(len(pairs)), key=lambda k: (limits[k], len(pairs[k][1])))
    sizes, at = [max(map(len, p)) for p in pairs], 0
    while at < len(order):
        to, widest = at + 1, 0
        while to < len(order) and to - at < CHUNK_PAIRS and limits[order[to]] <= 1.5 * limits[order[at]] + 8:
            widest = max(widest, sizes[order[to]])
            if (to + 1 - at) * 48 * (widest // 64 + 8) > CHUNK_WORDS:
                break
            to += 1
        chunk = order[at:to]
        if len(chunk) < FEW_PAIRS and widest > 64:
            out[chunk] = [edit_distance(*pairs[k], limits[k]) <= limits[k] for k in chunk]
        else:
            out[chunk] = _band_within([pairs[k][0] for k in chunk], [pairs[k][1] for k in chunk], np.array([limits[k] for k in chunk]))
        at = to
    return out


def _band_within(rows: list[bytes], columns: list[bytes], limits: np.ndarray) -> np.ndarray:
    """Bit vectors that hold the rows near the diagonal only, and move down by a row with each column; pairs that can't come back to their limit are left out."""
    n, one = len(rows), np.uint64(1)
    m, steps, band = np.array(list(map(len, rows))), np.array(list(map(len, columns))), int(limits.max())
    words = (2 * band + 64) // 64
    bits, last = 64 * words, int(steps.max())
    body, every = np.frombuffer(b"".join(rows), np.uint8), np.arange(n)
    known = np.unique(body)
    code = np.full(256, len(known))
    code[known] = np.arange(len(known))
    kinds = len(known) + 1
    table = np.zeros(((band + max(last, int(m.max()))) // 64 + words + 2, n * kinds), np.uint64)  # row r is bit r + bits
    place = bits + np.concatenate([np.arange(k) for k in m])
    np.add.at(table.ravel(), place // 64 * (n * kinds) + np.repeat(every * kinds, m) + code[body], one << (place % 64).astype(np.uint64))
    text = np.full((last, n), len(known))
    for k, b in enumerate(columns):
        text[: len(b), k] = code[np.frombuffer(b, np.uint8)]
    text += every * kinds
    up, down = np.zeros((words, n), np.uint64), np.zeros((words, n), np.uint64)
    for bit in range(bits - band - 1, bits):
        up[bit // 64] |= one << np.uint64(bit % 64)
    score, whose, out = np.minimum(m, band), every.copy(), np.zeros(n, bool)
    for j in range(last):
        word, shift = divmod(band + 1 + j, 64)
        x = np.take(table[word : word + words + 1], text[j], axis=1)
        x = x[:words] >> np.uint64(shift) | x[1:] << np.uint64(64 - shift) if shift else x[:words]
        total = x & up
        over = total.copy()
        total += up
        over = total < over
        for w in range(1, words):
            total[w] += over[w - 1]
            over[w] |= (total[w] == 0) & over[w - 1]
        total ^= up
        total |= x
        total |= down
        plus, minus = down | ~(total | up), total & up
        ahead = m - band > j
        change = total[-1] >> np.uint64(63) == 0
        if not ahead.all():  # the last row lies in the band
            bit = np.clip(bits - 2 - j + m - band, 0, bits - 1)
            at, bit = bit // 64, (bit % 64).astype(np.uint64)
            low = (plus[at, every] >> bit & one).astype(np.int64) - (minus[at, every] >> bit & one).astype(np.int64)
            change = np.where(ahead, change, np.where(j < steps, low, 0))
        score += change
        total[:-1] = total[:-1] >> one | total[1:] << np.uint64(63)
        total[-1] >>= one
        up, down = minus | ~(total | plus), total & plus
        if j % 32 == 31:
            alive = score <= limits + np.maximum(steps - np.maximum(j + 1, m - band), 0)
            if alive.sum() < 0.75 * len(alive):
                if not alive.any():
                    return out
                text, up, down = text[:, alive], up[:, alive], down[:, alive]
                m, steps, limits, score, whose = m[alive], steps[alive], limits[alive], score[alive], whose[alive]
                every = np.arange(len(whose))
    out[whose] = score <= limits
    return out


def similar_rows(left: list[bytes], right: list[bytes], similarity: float) -> list[bool]:
    """similar() for many pairs; what differs between two lines is compared many at once if it isn't too long."""
    out, later, cuts, limits = [False] * len(left), [], [], []
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        limit = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) > limit:
            continue
        x, y = trimmed(a, b)
        longer, shorter = max(len(x), len(y)), min(len(x), len(y))
        if longer <= limit:
            out[k] = True
        elif shorter and longer > LONG_CHARS:
            out[k] = similar(a, b, similarity)
        elif shorter:
            later.append(k)
            cuts.append((x, y))
            limits.append(limit)
    for k, within in zip(later, within_limits(cuts, limits).tolist(), strict=True):
        out[k] = within
    return out


class Lines:
    """The lines of a block of texts that may be removed: whose they are, their number and length when normalised."""

    def __init__(self, column: pa.Array):
        column = pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))
        data, ends = utf8(column)
        data = _PLAIN[data]
        starts = np.union1d(np.flatnonzero(data == 10) + 1, ends[:-1][np.diff(ends) > 0])
        starts = starts[starts < len(data)]
        words = Words((data, np.append(starts, len(data))))
        text = np.searchsorted(ends, starts, side="right") - 1
        first = np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool)
        number = np.arange(len(text)) - np.maximum.accumulate(np.where(first, np.arange(len(text)), 0)) if len(text) else text
        letters = np.concatenate(([0], np.cumsum(words.ends - words.starts)))
        chars = np.diff(letters[words.begin]) + np.maximum(words.counts - 1, 0)
        self.rows = np.flatnonzero(chars >= MIN_CHARS)
        self.words, self.text, self.number, self.chars = words, text[self.rows], number[self.rows].astype(np.int32), chars[self.rows].astype(np.int64)

    def names(self) -> np.ndarray:
        """A 128-bit name of each line's words, as two columns."""
        at, words = self.words.begin, self.words.hashes
        if not len(self.rows):
            return np.zeros((0, 2), np.uint64)
        return np.stack([span_hashes(h, at[self.rows], at[self.rows + 1]) for h in (words, mix64(words + np.uint64(0x5BD1E995)))], axis=1)

    def keys(self, rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the lines at these places of self.rows: the line (as its place in rows) and the key, sorted by line; and each line's whole SimHash."""
        band = np.searchsorted(_BOUNDS, self.chars[rows], side="right")
        longer = np.searchsorted(_BOUNDS, self.chars[rows] / similarity, side="right")  # the longest line that may link with it
        sim = np.zeros(len(rows), np.uint64)
        line, key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        also = np.flatnonzero(band < longer)
        for of, in_band in ((np.arange(len(rows)), band), (also, band[also] + 1)):
            if len(of):
                whole, keyed = self._band_keys(rows[of], in_band)
                if len(of) == len(rows):
                    sim[of] = whole
                line += [of[x] for x, _ in keyed]
                key += [k for _, k in keyed]
        line, key = np.concatenate(line), np.concatenate(key)
        order = np.argsort(line, kind="stable")
        return line[order], key[order], sim

    def _band_keys(self, rows: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        w, lines, classes = self.words, self.rows[rows], _CLASSES[band]
        n = w.counts[lines]
        owner = np.repeat(np.arange(len(rows)), n)
        at = np.repeat(w.begin[lines] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        hashes = mix64(w.hashes[at])
        dealt = ((hashes >> np.uint64(33)) % classes[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(owner * (int(classes.max()) + 1) + dealt, kind="stable")
        owner, dealt, at, hashes = owner[order], dealt[order], at[order], hashes[order]
        head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (dealt[1:] != dealt[:-1]))))
        size = w.ends[at] - w.starts[at]
        alone = classes[owner] == 1  # words of the shortest lines weigh by all their letters, others by those beyond the third
        weight = np.where(alone, np.minimum(size, 12), np.clip(size - 3, 0, 9))
        ballots = np.unpackbits(mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1) * weight.astype(np.uint8)[:, None]
        letters, total, tells = (np.add.reduceat(x, head) for x in (size, weight, np.maximum(size - 3, 0)))
        votes = _votes(ballots, head, total)

        def simhash(votes: np.ndarray, total: np.ndarray) -> np.ndarray:
            return np.packbits(2 * votes > total[:, None], axis=1).view(np.uint64).ravel()

        of, dealt = owner[head], dealt[head]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        whole = simhash(np.add.reduceat(votes, first, axis=0), np.add.reduceat(total, first))
        block = mix64(simhash(votes, total) + total.astype(np.uint64))  # equal words have equal weights
        one = classes[of] == 1  # the whole line and, below, the line without each word
        keyed = [(of[one], block[one])]
        word = np.flatnonzero(alone)
        mine = np.searchsorted(head, word, side="right") - 1
        left = total[mine] - weight[word]
        rest = mix64(simhash(votes[mine] - ballots[word], left) + left.astype(np.uint64))
        long = letters[mine] - size[word] >= KEY_CHARS
        keyed.append((owner[word][long], rest[long]))
        many = (classes[of] > 5) & (tells >= ONE_TELLS)
        keyed.append((of[many], mix64(block[many] ^ (dealt[many].astype(np.uint64) | band[of][many].astype(np.uint64) << np.uint64(32)))))
        five = classes[of] == 5
        table, count = np.zeros((len(rows), 5), np.uint64), np.zeros((len(rows), 5), np.int64)
        table[of[five], dealt[five]], count[of[five], dealt[five]] = block[five], tells[five]
        lines = np.flatnonzero(classes == 5)
        for i, j in combinations(range(5), 2):
            x = lines[count[lines, i] + count[lines, j] >= TWO_TELLS]
            keyed.append((x, mix64(mix64(table[x, i] + np.uint64(i)) ^ table[x, j] + np.uint64(j))))
        return whole, keyed


def find_lines(named: DataFrame, similarity: float) -> Table:
    """Every distinct line that may be removed: n (a number), place (of the earliest occurrence, with how many such lines its document has), chars, sim (its SimHash), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            lines = Lines(block.column(3))
            names = lines.names()
            if not len(names):
                continue
            _, one, which = np.unique(names[:, 0], return_index=True, return_inverse=True)
            line, key, sim = lines.keys(one, similarity)
            ends = np.searchsorted(line, np.arange(len(one) + 1)).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64))).take(pa.array(which))
            doc = [block.column(i).take(pa.array(lines.text)) for i in range(3)]
            eligible = np.bincount(lines.text, minlength=len(block))[lines.text].astype(np.int32)
            yield pa.RecordBatch.from_arrays([names128(names), *doc, pa.array(lines.number), pa.array(eligible), pa.array(lines.chars), pa.array(sim.view(np.int64)[which]), keys], ["name", *DOC, "number", "eligible", "chars", "sim", "keys"])

    found = named.select(*DOC, "text").mapInArrow(run, "name binary, none boolean, id long, salt long, number int, eligible int, chars long, sim long, keys array<long>")
    found = found.groupBy("name").agg(F.min(F.struct(*DOC, "number", "eligible")).alias("place"), F.first("chars").alias("chars"), F.first("sim").alias("sim"), F.first("keys").alias("keys"))
    return Table(found.select(F.monotonically_increasing_id().alias("n"), "place", "chars", "sim", "keys"))


def line_texts(named: DataFrame, lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """n and the normalised text of the lines in pairs (a, b), fetched from the documents they first stand in."""
    wanted = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    asked = lines.select("n", "place").join(wanted, "n").groupBy(*[F.col(f"place.{c}").alias(c) for c in DOC])
    asked = checkpoint(asked.agg(F.collect_list(F.struct(F.col("place.number").alias("number"), "n")).alias("asked")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                all_lines = text.as_py().split("\n")
                rows = asked.as_py()
                normal = normal_forms([all_lines[r["number"]] for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array([r["n"] for r in rows], pa.int64()), pa.array(normal, pa.binary())], ["n", "line"])

    found = named.select(*DOC, "text").join(asked.hint("shuffle_hash"), DOC).select("text", "asked").mapInArrow(run, "n long, line binary")
    return checkpoint(found.groupBy("n").agg(F.first("line").alias("line")))  # repeated rows have the same lines


def similar_pairs(named: DataFrame, lines: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs a, b whose lines are similar enough; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = similar_rows(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    pairs = checkpoint(pairs.distinct())
    texts = line_texts(named, lines, pairs)
    left, right = texts.select(F.col("n").alias("a"), F.col("line").alias("x")), texts.select(F.col("n").alias("b"), F.col("line").alias("y"))
    return checkpoint(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))


def candidates(chars: str, sim: str, other_chars: str, other_sim: str, similarity: float) -> Column:
    """Whether lengths and SimHashes allow two lines to be similar."""
    near = F.least(chars, other_chars) >= similarity * F.greatest(chars, other_chars) - 1e-6
    return near & ((F.greatest(chars, other_chars) < SIMHASH_CHARS) | (F.bit_count(F.col(sim).bitwiseXOR(F.col(other_sim))) <= SIMHASH_BITS))


def line_groups(named: DataFrame, lines: DataFrame, similarity: float) -> DataFrame:
    """id and component of every line of lines that links with another."""
    in_key, bucket = Window.partitionBy("key"), Window.partitionBy("key", "run")
    keyed = lines.select("n", F.explode("keys").alias("key"))
    shared = keyed.withColumn("least", F.min("n").over(in_key)).withColumn("most", F.max("n").over(in_key)).where("least <> most").select("n", "key")
    met = shared.join(lines.select("n", "chars", "sim"), "n")
    # a run is a stretch of a bucket in which each length is near the next; lines of two runs can't be similar
    before = F.lag("chars").over(in_key.orderBy("chars", "n"))
    met = met.withColumn("new", F.when(before >= similarity * F.col("chars") - 1e-6, 0).otherwise(1))
    met = met.withColumn("run", F.sum("new").over(in_key.orderBy("chars", "n").rowsBetween(Window.unboundedPreceding, 0)))
    met = checkpoint(met.withColumn("members", F.count("*").over(bucket)).where("members > 1").select("key", "run", "n", "chars", "sim", "members"))
    # a line that meets most others leads: what copies were made from has blocks in common with each of them
    weight = met.groupBy("n").agg(F.sum("members").alias("weight"))
    met = met.join(weight, "n").withColumn("lead", F.max_by(F.struct("n", "chars", "sim"), F.struct("weight", "n")).over(bucket))
    met = checkpoint(met.select("key", "run", "n", "chars", "sim", F.col("lead.n").alias("lead"), F.col("lead.chars").alias("lead_chars"), F.col("lead.sim").alias("lead_sim")))
    likely = candidates("chars", "sim", "lead_chars", "lead_sim", similarity) & (F.col("n") != F.col("lead"))
    stars = similar_pairs(named, lines, met.where(likely).select(F.col("n").alias("a"), F.col("lead").alias("b")), similarity)
    label = components(stars).select(F.col("id").alias("of"), "component")
    several = met.join(label, met["n"] == label["of"], "left").select("key", "run", "n", "chars", "sim", F.coalesce("component", "n").alias("label"))
    several = several.withColumn("least", F.min("label").over(bucket)).withColumn("most", F.max("label").over(bucket))
    several = checkpoint(several.where("least <> most").select("key", "run", "n", "chars", "sim", "label"))
    other = several.select("key", "run", *[F.col(c).alias(f"other_{c}") for c in ("n", "chars", "sim", "label")])
    likely = candidates("chars", "sim", "other_chars", "other_sim", similarity) & (F.col("label") < F.col("other_label"))
    across = several.join(other, ["key", "run"]).where(likely).select(F.col("n").alias("a"), F.col("other_n").alias("b"))
    return components(stars.unionByName(similar_pairs(named, lines, across, similarity)))


def kept_lines(named: DataFrame, similarity: float) -> DataFrame:
    """Per document (none, id, salt): the numbers of the lines that stay though another like them may be removed."""
    table = find_lines(named, similarity)
    lines = table.read()
    groups = line_groups(named, lines, similarity)
    rooted = lines.select("n", "place").join(groups, lines["n"] == groups["id"], "left")
    first = rooted.where("component is not null").groupBy("component").agg(F.min("place").alias("place")).select("place")
    kept = rooted.where("component is null").select("place").unionByName(first)
    kept = checkpoint(kept.groupBy(*[F.col(f"place.{c}").alias(c) for c in DOC]).agg(F.collect_list("place.number").alias("numbers"), F.max("place.eligible").alias("eligible")))
    table.drop()
    return kept


def cut_lines(named: DataFrame, kept: DataFrame) -> DataFrame:
    """rest, text, n_lines, n_removed: the documents without the lines that aren't kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            lines = Lines(block.column(1))
            bounds = np.searchsorted(lines.text, np.arange(len(block) + 1))
            out: list[list] = [[], [], []]
            for i, (text, numbers) in enumerate(zip(block.column(1).to_pylist(), block.column(2), strict=True)):
                own = lines.number[bounds[i] : bounds[i + 1]]
                gone = own[~np.isin(own, numbers.values.to_numpy() if numbers.is_valid else [])] if len(own) else own
                whole = text.split("\n") if text else []
                if len(gone):
                    stays = np.ones(len(whole), bool)
                    stays[gone] = False
                    text = "\n".join(x for x, k in zip(whole, stays.tolist(), strict=True) if k)
                for column, value in zip(out, (text, len(whole), len(gone)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["rest", "text", "n_lines", "n_removed"])

    kind = T.StructType([named.schema["rest"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    joined = named.join(kept.hint("shuffle_hash"), DOC, "left").select("rest", "text", "numbers", "eligible")
    whole = F.coalesce(F.size("numbers") == F.col("eligible"), F.lit(False))  # all that may be removed stays
    n_lines = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    plain = joined.where(whole).select("rest", "text", n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return plain.unionByName(joined.where(~whole).select("rest", "text", "numbers").mapInArrow(run, kind))


def dedup_lines(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """doc_id, text, n_lines, n_removed for every row of docs; text has its repeated lines removed.

    A line is removed if its group (equal after normalisation, or linked by
    edit similarities of at least the given one) has an earlier line: of a
    smaller doc_id, or earlier in the same document. Lines of fewer than
    MIN_CHARS normalised bytes stay. Null texts stay null and empty texts
    empty, with no lines; a null doc_id comes after all others. Rows of one
    doc_id are ordered by a hash of their text; fully repeated rows are one
    document and get equal results. An empty table gives no rows. Other
    columns, whatever their names, are dropped.
    """
    named = named_docs(docs.select("doc_id", "text"))
    return cut_lines(named, kept_lines(named, similarity)).select("rest.doc_id", "text", "n_lines", "n_removed")


def strip_lines(docs: DataFrame, similarity: float = 0.9) -> DataFrame:
    """The rows of docs with repeated lines taken out of text, as dedup_lines does; n_chars, where docs has it, is counted anew, other columns stay."""
    named = named_docs(docs)
    out = cut_lines(named, kept_lines(named.drop("rest"), similarity))
    columns = {c: F.col("rest").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
