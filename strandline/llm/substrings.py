"""Substring dedup by difference-cover anchors.

Anchors are hashes of ANCHOR consecutive words at the positions whose residue
modulo PERIOD is in a difference cover: for any two positions some shift below
PERIOD brings both into the cover, so two equal windows of 20 words share an
aligned anchor. Only windows that hold an anchor seen elsewhere are then
extended to their full length, hashed and compared; all but the earliest window
of a sequence are removed.

Every exchange goes by hash or by document in packed columns. A block of
documents names each hash once, so a passage that a third of all documents
share reaches a partition once a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PACKED, PACKET_BYTES, Gathered, Words, exchange, firsts, mix64, parts_for, row_blocks, scatter, scatter_texts, span_hashes, text_blocks, utf8

# 0, 1, 3, 9 is a perfect difference cover modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
TEXTS, ANCHORS, KNOWN, DUPLICATES, WINDOWS, REMOVED = range(6)


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix64(doc.view(np.uint64) * np.uint64(31) + at.astype(np.uint64))


def _send(hashes: np.ndarray, doc: np.ndarray, salt: np.ndarray, at: np.ndarray, parts: int, kind: int, width: type) -> Iterator[pa.RecordBatch]:
    """One row per hash of this block, its earliest; the block's later ones are known to repeat and travel spread out."""
    order, first = firsts(hashes, doc, salt, at)
    repeats = np.concatenate((~first[1:], [False])) & first if len(first) else first
    head = order[first]
    yield scatter(hashes[head], parts, kind, [hashes[head].astype(width), doc[head], salt[head], at[head].astype(np.int32), repeats[first]])
    at_head = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
    same = (doc[order] == doc[at_head]) & (salt[order] == salt[at_head]) & (at[order] == at[at_head])  # the same row again
    rest = order[~first & ~same]
    if len(rest):
        yield scatter(_spread(doc[rest], at[rest]), parts, KNOWN, [doc[rest], salt[rest], at[rest].astype(np.int32)])


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), kept_sha256 for every row of docs.

    A word goes if a window of that many words that covers it also starts
    earlier: in a smaller doc_id, or earlier in the same document. Null and
    short texts keep all words. A null doc_id counts as the largest. Rows that
    share a doc_id are ordered by a hash of the text; fully repeated rows are
    one document and get equal results. Other columns are dropped.
    """
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"windows must have {PERIOD} words at least")
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("salt"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    parts = parts_for(docs)
    source = docs.select("id", "salt", "text")

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            words = Words(block.column(2))
            at, hashes = words.runs(anchor)
            place = at - words.begin[words.doc[at]]
            chosen = _IN_COVER[place % PERIOD]
            rows = words.doc[at[chosen]]
            yield from _send(hashes[chosen], block.column(0).to_numpy()[rows], block.column(1).to_numpy()[rows], place[chosen], parts, ANCHORS, np.uint32)

    def match_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered(batches)
        hashes, doc, salt, at, repeats = got.columns(ANCHORS, "u4", "i8", "i8", "i4", "?")
        order, first = firsts(hashes, doc, salt, at)
        single = first & np.concatenate((first[1:], [True])) if len(first) else first
        hit = order[~single | repeats[order]]
        known = got.columns(KNOWN, "i8", "i8", "i4")
        doc, salt, at = (np.concatenate((x[hit], y)) for x, y in zip((doc, salt, at), known, strict=True))
        yield scatter(doc, parts, DUPLICATES, [doc, salt, at])

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, max_bytes=PACKET_BYTES):
            raw, offsets = utf8(block.column(2))
            ids = block.column(0).to_numpy()
            yield scatter_texts(ids, parts, TEXTS, [ids, block.column(1).to_numpy(), block.column(3).is_valid().to_numpy(zero_copy_only=False)], raw, offsets)

    def rows_of(ids: np.ndarray, salts: np.ndarray, doc: np.ndarray, salt: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the texts (ids, salts) each (doc, salt, at) belongs to, and its place; repeated rows all get them."""
        order = np.lexsort((salts, ids))
        keys = list(zip(ids[order].tolist(), salts[order].tolist(), strict=True))
        groups: dict[tuple[int, int], list[int]] = {}
        for k, i in zip(keys, order.tolist(), strict=True):
            groups.setdefault(k, []).append(i)
        by, head = firsts(doc, salt, at)
        doc, salt, at = doc[by], salt[by], at[by]
        new = np.flatnonzero(head | np.concatenate(([True], salt[1:] != salt[:-1]))) if len(doc) else np.zeros(0, int)
        row, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(new, np.append(new[1:], len(doc))[: len(new)], strict=True):
            for i in groups.get((int(doc[a]), int(salt[a])), ()):
                row.append(np.full(b - a, i))
                place.append(at[a:b].astype(np.int64))
        row, place = np.concatenate(row), np.concatenate(place)
        order = np.argsort(row, kind="stable")
        return row[order], place[order]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered(batches)
        (ids, salts, _), texts = got.texts(TEXTS, "i8", "i8", "?")
        row, place = rows_of(ids, salts, *got.columns(DUPLICATES, "i8", "i8", "i4"))
        for block in row_blocks(texts):
            mine = slice(*np.searchsorted(row, (block.start, block.stop)))
            if mine.start == mine.stop:
                continue
            words = Words(texts[block])
            flags = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(flags, words.begin[row[mine] - block.start] + place[mine], 1)
            run = np.concatenate(([0], np.cumsum(flags)))
            start = np.arange(max(0, len(words.hashes) - window + 1))
            if len(start):
                start = start[(words.doc[start] == words.doc[start + window - 1]) & (run[start + PERIOD] > run[start])]
            hashes = span_hashes(words.hashes, start, start + window) if len(start) else np.zeros(0, np.uint64)
            rows = words.doc[start]
            yield from _send(hashes, ids[block][rows], salts[block][rows], start - words.begin[rows], parts, WINDOWS, np.uint64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered(batches)
        hashes, doc, salt, at, _ = got.columns(WINDOWS, "u8", "i8", "i8", "i4", "?")
        order, first = firsts(hashes, doc, salt, at)
        lead = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))] if len(order) else order
        later = order[(doc[order] != doc[lead]) | (salt[order] != salt[lead]) | (at[order] != at[lead])]
        known = got.columns(KNOWN, "i8", "i8", "i4")
        doc, salt, at = (np.concatenate((x[later], y)) for x, y in zip((doc, salt, at), known, strict=True))
        yield scatter(doc, parts, REMOVED, [doc, salt, at])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = Gathered(batches)
        (ids, salts, valid), texts = got.texts(TEXTS, "i8", "i8", "?")
        row, place = rows_of(ids, salts, *got.columns(REMOVED, "i8", "i8", "i4"))
        for block in row_blocks(texts):
            mine = slice(*np.searchsorted(row, (block.start, block.stop)))
            words = Words(texts[block])
            edge = np.zeros(len(words.hashes) + 1, np.int64)
            np.add.at(edge, words.begin[row[mine] - block.start] + place[mine], 1)
            np.add.at(edge, words.begin[row[mine] - block.start] + place[mine] + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            kept, counts = [], []
            for i in range(words.n_docs):
                out = gone[words.begin[i] : words.begin[i + 1]]
                own = texts[block.start + i].as_py().split()
                kept.append(b" ".join(w for w, x in zip(own, out.tolist(), strict=True) if not x) if out.any() else b" ".join(own))
                counts.append(int(out.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[block], mask=~valid[block]), pa.array(words.counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    packed = docs.mapInArrow(pack_texts, PACKED)
    anchors = exchange(parts, source.mapInArrow(find_anchors, PACKED)).mapInArrow(match_anchors, PACKED)
    windows = exchange(parts, packed, anchors).mapInArrow(extend, PACKED)
    removed = exchange(parts, windows).mapInArrow(judge, PACKED)
    return exchange(parts, packed, removed).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
