"""Texts as sequences of distinct units, so that a tokenizer sees each unit of a worker's texts once.

A unit is a stretch of bytes between places that no token spans. Units are told
apart by Arrow's dictionaries, byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from .common import _SPACE

#: Units that are worked out at a time; a tokenizer's own objects take much room.
AT_ONCE = 1 << 14


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Values of so many bytes each, one after another in data."""
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values one after another, and how many each list has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, n.sum()), n


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, apart from white space (0x20, 0x09-0x0D), and how many each text has."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts = np.flatnonzero(first)
    return binaries(data[solid], np.flatnonzero(last) + 1 - starts).dictionary_encode(), np.diff(np.searchsorted(starts, offsets))


class Known:
    """What was worked out for units so far: some columns of binary values, a row for each unit. Beyond most units it starts anew."""

    def __init__(self, work_out: Callable[[list[bytes]], list[pa.Array]], most: int):
        self.work_out, self.most = work_out, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.columns: list[pa.Array] = []

    def rows(self, units: pa.DictionaryArray) -> np.ndarray:
        """The row of every unit; those not known yet are worked out together."""
        if len(self.place) > self.most:
            self.clear()
        keys = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [k for k in keys if k not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            got = [self.columns] if self.columns else []
            got += [self.work_out(new[i : i + AT_ONCE]) for i in range(0, len(new), AT_ONCE)]
            self.columns = [pa.concat_arrays(x) for x in zip(*got, strict=True)]
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[units.indices.to_numpy()]
