"""Bases drawn, and letters put in another order, by the MD5 of a seed and each place; the digests of many places are worked out at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places whose digests are worked out together.
BLOCK = 1 << 14
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [np.uint32(int(abs(np.sin(i + 1)) * 2**32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def messages(seed: str, first: int, last: int) -> np.ndarray:
    """The padded MD5 blocks of seed-i for the places i from first on, before last, a row each; seed and place have 55 characters at most."""
    head = f"{seed}-".encode()
    out = np.zeros((last - first, 64), np.uint8)
    out[:, : len(head)] = np.frombuffer(head, np.uint8)
    digits = 1
    while first < last:
        to = min(last, 10**digits)
        if first < to:
            rows, at = out[len(out) - (last - first) :][: to - first], np.arange(first, to)
            for d in range(digits):
                rows[:, len(head) + d] = 48 + at // 10 ** (digits - 1 - d) % 10
            n = len(head) + digits
            rows[:, n], rows[:, 56], rows[:, 57] = 128, n * 8 & 255, n * 8 >> 8
            first = to
        digits += 1
    return out


def digests(blocks: np.ndarray) -> np.ndarray:
    """MD5 of messages of one block: four words a row."""
    words = np.ascontiguousarray(blocks.view("<u4").T.astype(np.uint32))
    some = words.any(axis=1)
    a, b, c, d = (np.full(len(blocks), x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += _SINES[i]
        if some[g]:
            f += words[g]
        turned = f << np.uint32(_TURNS[i])
        turned |= f >> np.uint32(32 - _TURNS[i])
        turned += b
        a, d, c, b = d, c, b, turned
    return np.stack([x + np.uint32(y) for x, y in zip((a, b, c, d), _START, strict=True)], axis=1)


def _drawn(seed: str, letters: str, words: np.ndarray) -> tuple[str, str]:
    base = np.frombuffer(b"ACGT", np.uint8)[words[:, 3] >> np.uint32(24) & np.uint32(3)]
    high = words.byteswap().astype(np.uint64)  # digests compare by their bytes
    key = high[:, 0] << np.uint64(32) | high[:, 1]
    order = np.argsort(key, kind="stable")
    if (key[order[1:]] == key[order[:-1]]).any():
        order = np.lexsort((high[:, 3], high[:, 2], high[:, 1], high[:, 0]))
    return base.tobytes().decode(), np.frombuffer(letters.encode("utf-32-le"), "<u4")[order].tobytes().decode("utf-32-le")


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("random", "shuffled")]))
def drawn(seed: pd.Series, seq: pd.Series) -> pd.DataFrame:
    """random: as many bases as seq has letters, drawn by the MD5 of the seed (a string) and the place; shuffled: the letters of seq in the order of these. Empty without a seed, null without seq."""
    out: list[tuple[str | None, str | None]] = []
    waiting: list[tuple[int, str, str]] = []
    size = 0

    def flush() -> None:
        blocks = [messages(s, i, min(i + BLOCK, len(x))) for _, s, x in waiting for i in range(0, len(x), BLOCK)]
        joined = np.concatenate(blocks)
        words = np.concatenate([digests(joined[i : i + BLOCK]) for i in range(0, len(joined), BLOCK)])
        at = 0
        for row, s, x in waiting:
            out[row] = _drawn(s, x, words[at : at + len(x)])
            at += len(x)
        waiting.clear()

    for row, (s, x) in enumerate(zip(seed, seq, strict=True)):
        out.append((x, x) if not x else ("", ""))
        if x and s is not None:
            waiting.append((row, s, x))
            size += len(x)
        if size >= BLOCK:
            flush()
            size = 0
    if waiting:
        flush()
    return pd.DataFrame(out, columns=["random", "shuffled"], dtype=object)
