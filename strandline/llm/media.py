"""Media columns: payloads kept as 8-bit sound, cut into content-defined chunks that are stored once.

A text's UTF-8 bytes, padded, are the samples of a mono 8-bit WAV file. A
rolling gear hash over 32 bytes cuts the file where its high bits are zero, so
equal passages give equal chunks wherever they stand. A chunk table holds the
bytes of each digest once, and a list table the ordered digests of each
distinct medium. Reading joins the places of the lists with the chunks, puts
each medium together again and verifies its digest before its samples are
looked at.
"""

from __future__ import annotations

import bz2
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_blocks

#: Padding of payloads (bytes) and the chunk sizes: least, mean beyond it, most.
UNIT, LEAST, MEAN_BITS, MOST = 192, 2048, 13, 65536
RATE = 16_000
#: A chunk is hot if it fills more than this share of all places, so HOT chunks at most (MOST bytes each) are broadcast; chunks of fewer than HOT_LEAST places never are.
HOT, HOT_LEAST = 500, 4096
_GEAR = np.random.default_rng(20240902).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: bytes) -> bytes:
    """The bytes, filled up with spaces to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def to_wav(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload."""
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload + b"\0" * (n % 2)


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV file; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, width = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            width = struct.unpack("<H", media[at + 22 : at + 24])[0]
        if name == b"data":
            if width != 8 or at + 8 + n > len(media):
                raise ValueError("not whole 8-bit samples")
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no samples")


def chunk_ends(media: bytes) -> list[int]:
    """Ends of the content-defined chunks of media."""
    n = len(media)
    if n <= LEAST:
        return [n] if n else []
    h = _GEAR[np.frombuffer(media, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[media[i - j]] << j for j < 32
        h[k:] += h[:-k] << np.uint32(k)
    marks = np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        at = min(int(marks[i]) if i < len(marks) else n, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def features(payload: bytes) -> str:
    """Mean, deviation, range and zero crossings of the samples, and their spread over 16 levels."""
    x = np.frombuffer(payload, np.uint8)
    y = x.astype(np.int64)
    crossings = int(np.count_nonzero((y[1:] >= 128) != (y[:-1] >= 128)))
    levels = np.bincount(x >> 4, minlength=16)
    return f"{len(x)}:{y.mean():.4f}:{y.std():.4f}:{x.min()}-{x.max()}:{crossings}:" + ",".join(map(str, levels.tolist()))


def media_of(text: str | None) -> tuple[int, bytes]:
    """The number of a text's bytes and its medium."""
    raw = (text or "").encode()
    return len(raw), to_wav(payload_of(raw))


def pieces_of(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The digest (16 bytes of SHA-256) and the bytes of each chunk, in order."""
    at = 0
    for end in chunk_ends(media):
        piece = media[at:end]
        yield hashlib.sha256(piece).digest()[:16], piece
        at = end


def store_media(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: media (doc_id, n_bytes, media_bytes, medium of every row), lists (medium, digests in order, once a medium) and chunks (digest, data, once a digest).

    medium is the SHA-256 of a stored file; data is compressed by bz2.
    """

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            rows = [media_of(t) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(m) for _, m in rows], pa.int64()), pa.array([hashlib.sha256(m).digest() for _, m in rows], pa.binary()), pa.array([[d for d, _ in pieces_of(m)] for _, m in rows], pa.list_(pa.binary()))],
                ["doc_id", "n_bytes", "media_bytes", "medium", "digests"],
            )

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            unique = {d: p for t in block.column(0).to_pylist() for d, p in pieces_of(media_of(t)[1])}
            yield pa.RecordBatch.from_arrays([pa.array(list(unique), pa.binary()), pa.array([bz2.compress(p) for p in unique.values()], pa.binary())], ["digest", "data"])

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    media = checkpoint(kept.mapInArrow(lists, f"doc_id {kind}, n_bytes long, media_bytes long, medium binary, digests array<binary>"))
    chunks = kept.select("text").mapInArrow(pieces, "digest binary, data binary").groupBy("digest").agg(F.first("data").alias("data"))
    return media.drop("digests"), media.groupBy("medium").agg(F.first("digests").alias("digests")), chunks


def restore(half: bytes, parts: list[bytes]) -> tuple[bytes, bytes]:
    """The digest and payload of a medium whose compressed chunks come in order; ValueError if the digest begins otherwise."""
    media = b"".join(bz2.decompress(p) for p in parts)
    medium = hashlib.sha256(media).digest()
    if medium[: len(half)] != half:
        raise ValueError(f"medium {half.hex()} is damaged")
    return medium, from_wav(media)


def read_media(lists: DataFrame, chunks: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every medium of lists, put together from its chunks and verified: medium, payload_bytes, payload_sha256 (both as bytes), tail_crc32, feature (and payload).

    A missing or damaged chunk raises ValueError. The few hot chunks are
    broadcast, so no task gets all places of one.
    """
    # places and chunks move under half of a medium's digest; all of it is verified below
    places = lists.select(F.substring("medium", 1, 16).alias("half"), F.size("digests").alias("count"), F.posexplode("digests").alias("place", "digest"))
    counts = places.groupBy("digest").agg(F.count("*").alias("n"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()  # two numbers
    limit = max(HOT_LEAST, seen["all"] // HOT)
    if seen["most"] <= limit:
        found = places.join(chunks, "digest", "left")
    else:
        hot = F.broadcast(counts.where(F.col("n") > limit).select("digest"))  # HOT rows at most
        found = places.join(hot, "digest", "left_anti").join(chunks, "digest", "left")
        found = found.unionByName(places.join(hot, "digest", "left_semi").join(F.broadcast(chunks.join(hot, "digest", "left_semi")), "digest", "left"))
    found = found.groupBy("half", "count").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("parts"))  # the chunks of one file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for half, count, parts in zip(*batch.columns, strict=True):
                data = [p["data"] for p in parts.as_py()]
                if len(data) != count.as_py() or None in data:
                    raise ValueError(f"medium {half.as_py().hex()} lacks a chunk")
                medium, payload = restore(half.as_py(), data)
                values = (medium, len(payload), hashlib.sha256(payload).digest(), zlib.crc32(payload[-16:]), features(payload), payload if with_payload else None)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)

    types = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary())
    names = ["medium", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "payload"]
    return found.mapInArrow(run, "medium binary, payload_bytes long, payload_sha256 binary, tail_crc32 long, feature string, payload binary")


def media_columns(docs: DataFrame, with_payload: bool = False) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (and payload) for every row of docs.

    A null text is empty; its payload is UNIT spaces. Equal texts share one
    medium and get equal values; repeated and null doc_ids are kept row by row.
    An empty table gives no rows. Other columns, whatever their names, are
    dropped. A medium whose digest differs raises ValueError.
    """
    media, lists, chunks = store_media(docs)
    out = media.join(read_media(lists, chunks, with_payload), "medium", "left")
    lost = F.raise_error(F.lit("a medium was not found"))  # half a digest stands for one medium only
    out = out.withColumn("payload_sha256", F.lower(F.hex(F.coalesce("payload_sha256", lost.cast("binary"))))).withColumn("media_sha256", F.lower(F.hex("medium")))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(["payload"] if with_payload else []))
