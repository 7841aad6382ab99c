"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The driver reads the rank file (its size is checked) and hands its bytes to the
tasks, so executors need no path of the driver's. Long texts are cut before
encoding, only between a non-space and a following white-space character: no
match of the splitting pattern spans such a place, so the ids are those of the
whole text. Decoding works on raw bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: A rank file above this size isn't sent to the tasks.
MAX_RANK_BYTES = 64 << 20
#: Texts are cut at safe boundaries into pieces of about so many characters.
PIECE_CHARS = 1 << 16
#: Pieces of one match longer than this (bytes) are merged by the heap below, not by the library.
LONG_MATCH = 2048
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={}), table, regex.compile(pattern)


def cut_safely(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Pieces of about size characters whose joints no match of the pattern spans."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        to = found.start() if found else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one very long match in n log n: lowest rank first, leftmost on ties, as the library merges."""
    import heapq

    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : end[i]])) is not None:
            heapq.heappush(heap, (r, before[i], end[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encode_text(text: str, ranks: bytes, pattern: str) -> list[int]:
    """Ids of a whole text, without special tokens."""
    encoding, table, split = _encoding(ranks, pattern)
    if len(text) <= LONG_MATCH // 4:
        return encoding.encode_ordinary(text)
    out: list[int] = []
    for piece in cut_safely(text):
        # only a long stretch of spaces, or without any, can hold a giant match
        if len(piece) > LONG_MATCH // 4 and max(map(len, regex.split(r"(?<=\S)(?=\s)|(?<=\s)(?=\S)", piece))) > LONG_MATCH // 4:
            for m in split.finditer(piece):
                raw = m[0].encode()
                out += merge_long(raw, table) if len(raw) > LONG_MATCH else encoding.encode_ordinary(m[0]) if raw not in table else [table[raw]]
        else:
            out += encoding.encode_ordinary(piece)
    return out


def decode_ids(ids: list[int], ranks: bytes, pattern: str) -> bytes:
    """The raw bytes of ids; unknown ids raise KeyError."""
    return _encoding(ranks, pattern)[0].decode_bytes(ids)


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        ranks = f.read(MAX_RANK_BYTES + 1)
    if len(ranks) > MAX_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MAX_RANK_BYTES} bytes")
    return ranks


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Columns key, ids array<int> and decoded binary of every whole text.

    A null or empty text has no ids and decodes to no bytes. Null and repeated
    keys are kept row by row; other columns are dropped.
    """
    ranks = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                ids = [encode_text(t, ranks, pattern) if t else [] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode_ids(x, ranks, pattern) for x in ids], pa.binary())], ["key", "ids", "decoded"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, ids array<int>, decoded binary").withColumnRenamed("key", key)


def bpe_digest(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """bpe_encode's results as digests, made in the task that encodes: key, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens and the digests of no bytes. Texts are
    encoded whole, however long. Null and repeated keys are kept row by row; an
    empty table gives no rows; other columns, whatever their names, are dropped.
    """
    ranks = read_ranks(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two = [], [], []
            for value in batch.column(1):
                ids = encode_text(t, ranks, pattern) if (t := value.as_py()) else []
                n.append(len(ids))
                one.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
                two.append(hashlib.sha256(decode_ids(ids, ranks, pattern)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    return picked.mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
