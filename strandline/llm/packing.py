"""Cost-balanced packing of tokenized documents into sequences of a fixed length.

A document is its tokens and an end token. Whole sequences are cut off long
documents; what is left of all documents of a block is assigned in descending
length, each to the sequence of the lowest estimated cost (linear plus quadratic
attention cost) that has room for it. When none has, the document is cut to fill
the roomiest sequence. The sequences of a block hold its tokens exactly: as many
full ones as fit, and for the rest sequences of powers of two, which need no
padding.

Every task packs the texts of its own partition, block by block, so nothing is
shuffled and no key can be hot. Sequence numbers carry the partition's number:
docs must give the same partitions when a task is run again, as files and
checkpoints do.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import _LOWER, text_blocks, utf8
from .units import Known, binaries, flattened, words

#: Tokens of a sequence; the token that ends a document.
SEQUENCE, END = 2048, 1
#: A token costs 1, and each token that attends to another within a piece so much.
ATTENTION = 1 / 6144
#: A tokenizer file above this size isn't sent to the tasks.
MAX_FILE_BYTES = 64 << 20
#: Distinct words that a worker remembers at most.
KNOWN_WORDS = 600_000
#: Bytes of text that are packed together.
PACK_BYTES = 16 << 20


def read_tokenizer(path: str) -> str:
    """The tokenizer's file; the driver reads it, so executors need no path of the driver's."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return text


class Encoder:
    """Ids of texts by a tokenizer that drops white space: each distinct word is encoded once."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        if self.ids(" ab \n\tc ") != self.ids("ab") + self.ids("c"):
            raise ValueError("this tokenizer's ids depend on white space")
        self.lowers = '"Lowercase"' in json.dumps(json.loads(file)["normalizer"])
        self.special = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known(self.work_out, KNOWN_WORDS)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def work_out(self, units: list[bytes]) -> list[pa.Array]:
        ids, lengths = flattened([e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)])
        return [binaries(ids.astype("<u4").view(np.uint8), 4 * lengths)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts with END after each, and where each text's begin (and the last's end)."""
        data, offsets = utf8(texts)
        if self.lowers:  # fewer distinct words; a special token in other letters is none, so such blocks stay
            lower = _LOWER[data]
            data = data if any(s in lower.tobytes() for s in self.special) else lower
        units, counts = words(data, offsets)
        rows = self.known.rows(units)
        known = pa.concat_arrays([*self.known.columns, binaries(np.array([END], "<u4").view(np.uint8), np.array([4]))])
        ends = np.cumsum(counts)
        places = np.full(len(rows) + len(counts), len(known) - 1)
        keep = np.ones(len(places), bool)
        keep[ends + np.arange(len(ends))] = False
        places[keep] = rows
        ids = known.take(pa.array(places))
        _, at, values = ids.buffers()
        at = np.frombuffer(at, np.int64, len(places) + 1) // 4
        return np.frombuffer(values, "<u4", at[-1]), at[np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))]


@lru_cache(maxsize=2)
def _encoder(file: str) -> Encoder:
    return Encoder(file)


def cost(lengths: np.ndarray) -> np.ndarray:
    """Estimated cost of pieces: linear, and quadratic for attention within a piece."""
    return lengths + ATTENTION * lengths.astype(float) ** 2


def capacities(tokens: int, size: int = SEQUENCE) -> np.ndarray:
    """Sequences that hold so many tokens without padding: full ones, then powers of two."""
    rest = tokens % size
    return np.array([size] * (tokens // size) + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1], np.int64)


def assign(lengths: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of so many tokens, 1 at least each."""
    whole = lengths // size
    document = np.repeat(np.arange(len(lengths)), whole)
    nth = np.arange(len(document)) - np.repeat(np.cumsum(whole) - whole, whole)
    pieces = [(d, int(k) * size, size, s, 0) for s, (d, k) in enumerate(zip(document.tolist(), nth, strict=True))]
    rest = lengths % size
    room = capacities(int(rest.sum()), size)
    begin, full, spent = len(pieces), room.copy(), np.zeros(len(room))
    order = np.argsort(-rest, kind="stable")
    waiting = [(int(rest[d]), d, int(whole[d]) * size) for d in order.tolist() if rest[d]]
    shorter: list[tuple[int, int, int]] = []  # ends of cut documents, the longest last
    at = 0
    while at < len(waiting) or shorter:
        if shorter and (at == len(waiting) or shorter[-1][0] > waiting[at][0]):
            left, d, start = shorter.pop()
        else:
            left, d, start = waiting[at]
            at += 1
        s = int(np.where(room >= left, spent, np.inf).argmin())
        if room[s] < left:
            s = int(np.lexsort((spent, -room))[0])
        n = min(left, int(room[s]))
        pieces.append((d, start, n, begin + s, int(full[s] - room[s])))
        room[s] -= n
        spent[s] += cost(np.array(n))
        if n < left:
            shorter.append((left - n, d, start + n))
            shorter.sort()
    return pieces


def pack_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A null or empty text is the end token alone. Null and repeated keys are kept
    row by row, each its own document; other columns are dropped; an empty table
    gives no rows. Texts are tokenized whole, however long.
    """
    file = read_tokenizer(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = _encoder(file), TaskContext.get().partitionId() << 33
        for block in text_blocks(batches, max_bytes=PACK_BYTES):
            ids, begin = encoder.encode(block.column(1))
            tokens = np.diff(begin)
            document, start, length, at, offset = np.array(assign(tokens), np.int64).T
            first = begin[document] + start
            sums = [zlib.crc32(ids[a : a + n]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            columns = [pa.array(x, pa.int64()) for x in (start, length, sums, tokens[document], sequence + at, offset)]
            yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(document)), *columns], ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += int(at.max()) + 1

    picked = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    names = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return picked.mapInArrow(run, f"key {kind}, {names}").withColumnRenamed("key", key)
