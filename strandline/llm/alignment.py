"""Alignment of two tokenizers' tokens by bytes, and scores of linked ids.

Texts are cut where neither tokenizer's tokens can span, so both are run once for
each distinct unit of a worker's texts and groups never cross a unit. A block of
documents is stored as its distinct units' links, its distinct id pairs with how
many links hold them, and each document's list of units.

Pairs go by their B id to id-striped tasks, each with a dense matrix of counts
(its B ids by all A ids) that np.add.at fills; row maxima are the highest counts.
Counts and blocks' pairs then meet by a join on the pair, so that links are scored
where their counts are, and a block's scores come back to its documents.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, checkpoint, text_blocks, utf8
from .packing import MAX_FILE_BYTES, read_tokenizer
from .units import Known, binaries, flattened

#: B ids are dealt over so many stripes by their remainder.
STRIPES = 256
#: Pairs that a task adds up at most, about; beyond, a stripe's pairs are added up in parts first.
PAIRS_PER_TASK = 8 << 20
#: Distinct units that a worker remembers at most.
KNOWN_UNITS = 300_000
#: Bytes of text that make a block.
BLOCK_TEXT = 3 << 20

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_CUT = np.zeros(256, bool)
_CUT[[0x20, 0x0A]] = True


def cut_units(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Units of a space and each text, and how many each has: cut before a space or line feed that follows no white space.

    A character that may be Unicode white space (three bytes from E1 to E3, two
    from C2) counts as white space.
    """
    data, offsets = utf8(texts)
    data = np.insert(data, offsets[:-1], 0x20)
    offsets = offsets + np.arange(len(offsets))
    open_ = _WHITE[data]
    high = data >= 0x80
    open_[1:] |= high[1:] & (data[:-1] == 0xC2)
    open_[2:] |= high[2:] & (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
    first = _CUT[data]
    first[1:] &= ~open_[:-1]
    first[offsets[:-1]] = True
    starts = np.flatnonzero(first)
    return binaries(data, np.diff(np.append(starts, len(data)))).dictionary_encode(), np.diff(np.searchsorted(starts, offsets))


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(odd)}


def _taken(column: pa.Array, rows: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of rows, and where each row's begin (and the last's end)."""
    got = column.take(pa.array(rows))
    size = np.dtype(kind).itemsize
    ends = np.frombuffer(got.buffers()[1], np.int64, len(rows) + 1) // size
    return np.frombuffer(got.buffers()[2], kind, ends[-1]), ends


class Pair:
    """Two tokenizers: A, byte-level with its splitting pattern, and B, of pieces that never go on over a space."""

    def __init__(self, file: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(file), sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a.encode_special_tokens = True
        split = json.loads(file)["pre_tokenizer"]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if split["type"] != "ByteLevel" or not split["use_regex"] or split["add_prefix_space"] or any(c in p.lstrip(c) for p in pieces for c in "▁\n"):
            raise ValueError("the tokens of these tokenizers may span the places where texts are cut")
        byte = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(byte[c] for c in token if c in byte)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.names = pa.array([f"{i}{end}".encode() for size, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(size) for end in ends], pa.large_binary())
        self.known = Known(self.work_out, KNOWN_UNITS)

    def b_ids(self, units: list[str]) -> list[list[int]]:
        """B's ids of units; B sets a space before each by itself, which the unit has or must lose again."""
        out = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u == " ":
                out[i] = [self.space]
            elif u[0] != " ":
                out[i] = out[i][1:] if out[i][:1] == [self.space] else []
        return out

    @staticmethod
    def rejoined(ids: list[list[int]], table: list[bytes], units: list[bytes]) -> np.ndarray:
        """Whether each unit's tokens join to its bytes."""
        if b"".join([table[i] for i in chain.from_iterable(ids)]) == b"".join(units):
            sizes = np.array(list(map(len, table)), np.int64)
            flat, n = flattened(ids)
            return np.diff(np.concatenate(([0], np.cumsum(sizes[flat])))[np.concatenate(([0], np.cumsum(n)))]) == np.fromiter(map(len, units), np.int64, len(units))
        return np.array([b"".join([table[i] for i in x]) == u for x, u in zip(ids, units, strict=True)], bool)

    def work_out(self, units: list[bytes]) -> list[pa.Array]:
        """Of each unit: its groups as text, each closed by ;, its linked pairs (b, a as one number), and its counts.

        Counts are of A and B tokens, groups, links, and 1 if both join to the unit's bytes.
        """
        texts = [u.decode() for u in units]
        a_ids, b_ids = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.b_ids(texts)
        good = self.rejoined(a_ids, self.a_bytes, units) & self.rejoined(b_ids, self.b_bytes, units)
        if not good.all():
            a_ids, b_ids = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (a_ids, b_ids))
        (a, n_a), (b, n_b) = flattened(a_ids), flattened(b_ids)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        unit = np.repeat(np.arange(len(units)), n_a)

        # a group ends where tokens of both end; A's and then B's of a group, each with what follows it
        last = b_ends[np.minimum(np.searchsorted(b_ends, a_ends), max(0, len(b_ends) - 1))] == a_ends if len(a) else np.zeros(0, bool)
        a_cut = np.flatnonzero(last) + 1
        b_cut = np.searchsorted(b_ends, a_ends[last]) + 1
        names = np.empty(len(a) + len(b), np.int64)
        a_group, b_group = np.repeat(np.arange(len(a_cut)), np.diff(a_cut, prepend=0)), np.repeat(np.arange(len(b_cut)), np.diff(b_cut, prepend=0))
        closes = np.zeros(len(b), bool)
        closes[b_cut - 1] = True
        names[np.arange(len(a)) + np.concatenate(([0], b_cut))[a_group]] = 2 * a + last
        names[np.arange(len(b)) + a_cut[b_group]] = 2 * (len(self.a_sizes) + b) + closes
        text, at = _taken(self.names, names, "u1")
        run = at[np.concatenate(([0], np.cumsum(n_a + n_b)))]
        n_groups = np.bincount(unit[a_cut - 1], minlength=len(units))

        low = np.searchsorted(b_ends, a_ends - self.a_sizes[a], side="right")
        n = np.searchsorted(b_ends, a_ends, side="left") - low + 1
        linked = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        pairs = b[linked] * len(self.a_sizes) + np.repeat(a, n)
        n_links = np.bincount(unit, weights=n, minlength=len(units)).astype(np.int64)
        counts = np.stack([n_a, n_b, n_groups, n_links, good], axis=1).astype("<i4")
        return [
            binaries(text, np.diff(run)),
            binaries(pairs.astype("<i8").view(np.uint8), 8 * n_links),
            binaries(counts.ravel().view(np.uint8), np.full(len(units), 20)),
        ]


@lru_cache(maxsize=2)
def _pair(file: str, model: bytes) -> Pair:
    return Pair(file, model)


BLOCK_SCHEMA = "block long, key {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, units array<int>, lengths array<int>, places array<int>, pairs array<long>, n array<long>"


def _block(pair: Pair, block: int, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of one block: one a document, and one of the block's units and pairs."""
    units, counts = cut_units(texts)
    rows = pair.known.rows(units)
    stats = _taken(pair.known.columns[2], rows, "<i4")[0].reshape(-1, 5)
    ends = np.concatenate(([0], np.cumsum(counts)))
    bad = np.diff(np.concatenate(([0], np.cumsum(stats[:, 4] == 0)))[ends]) > 0
    empty = np.array(utf8(texts)[1][1:] == utf8(texts)[1][:-1])
    keep = np.repeat(~(bad | empty), counts)
    rows, stats = rows[keep], stats[keep]
    counts = np.where(bad | empty, 0, counts)
    ends = np.concatenate(([0], np.cumsum(counts)))
    totals = [np.diff(np.concatenate(([0], np.cumsum(stats[:, i], dtype=np.int64)))[ends]) for i in range(4)]
    text, at = _taken(pair.known.columns[0], rows, "u1")
    whole = memoryview(text)
    digests = [hashlib.sha256(whole[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(at[ends[:-1]].tolist(), at[ends[1:]].tolist(), strict=True)]

    used, place = np.unique(rows, return_inverse=True)
    flat, at = _taken(pair.known.columns[1], used, "<i8")
    pairs, places = np.unique(flat, return_inverse=True)
    n = np.bincount(places, weights=np.repeat(np.bincount(place, minlength=len(used)), np.diff(at)), minlength=len(pairs))
    rest = len(keys)
    documents = [pa.array(np.full(rest, block)), keys, *[pa.array(x) for x in totals], pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place.astype(np.int32)))]
    names = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
    kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    yield pa.RecordBatch.from_arrays([*documents, *[pa.nulls(rest, k) for k in kinds]], names)
    own = [np.diff(at).astype(np.int32), places.astype(np.int32), pairs, n.astype(np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.nulls(1, c.type) for c in documents[1:]], *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in own]], names)


def add_up(pairs: DataFrame, n_a: int, stripes: int, salts: int, last: bool) -> DataFrame:
    """Sums of n by (b, a): each task fills the dense matrix of its stripe, or of one of a stripe's salts; best is wanted at last only."""
    task = (F.col("b") % stripes) * salts + (F.pmod("salt", F.lit(salts)) if salts > 1 else F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, stripe = np.zeros((0, n_a), np.int64), 0
        for batch in batches:
            if not len(batch):
                continue
            b, a, n = (batch.column(i).to_numpy() for i in range(3))
            stripe = int(b[0]) % stripes
            if int(b.max()) // stripes >= len(matrix):
                matrix = np.concatenate((matrix, np.zeros((int(b.max()) // stripes + 1 - len(matrix), n_a), np.int64)))
            np.add.at(matrix, (b // stripes, a), n)
        row, a = np.nonzero(matrix)
        counts = matrix[row, a]
        best = counts == (matrix.max(axis=1)[row] if len(matrix) else counts)
        for i in range(0, len(row), 1 << 16):
            cut = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(row[cut] * stripes + stripe), pa.array(a[cut]), pa.array(counts[cut]), pa.array(best[cut])], ["b", "a", "n", "best"])

    out = pairs.repartitionById(stripes * salts, task.cast("int")).select("b", "a", "n").mapInArrow(run, "b long, a long, n long, best boolean")
    return out if last else out.withColumn("salt", F.lit(0))


def align_tokens(docs: DataFrame, file: str, model: str, text: str = "text", key: str = "doc_id", stripes: int = STRIPES) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A null or empty text has no tokens, nor has one that B's tokens don't give
    back byte for byte: all counts are 0 and groups_sha256 is ''. Null and
    repeated keys are kept row by row, each its own document; other columns are
    dropped; an empty table gives no rows. Texts are tokenized whole.
    """
    tokenizer = read_tokenizer(file)
    with open(model, "rb") as f:
        pieces = f.read(MAX_FILE_BYTES + 1)
    if len(pieces) > MAX_FILE_BYTES:
        raise ValueError(f"{model} is larger than {MAX_FILE_BYTES} bytes")
    n_a = len(_pair(tokenizer, pieces).a_sizes)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block = _pair(tokenizer, pieces), TaskContext.get().partitionId() << 33
        for part in text_blocks(batches, max_bytes=BLOCK_TEXT):
            yield from _block(pair, block, part.column(0), part.column(1))
            pa.default_memory_pool().release_unused()
            block += 1

    picked = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    kind = picked.schema["key"].dataType.simpleString()
    table = Table(picked.mapInArrow(cut, BLOCK_SCHEMA.format(kind=kind)))
    blocks = table.read()
    own = blocks.where("pairs IS NOT NULL")
    pairs = own.select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "p")).select("block", "at", F.expr(f"p.pairs div {n_a}").alias("b"), (F.col("p.pairs") % n_a).alias("a"), F.col("p.n").alias("n"), F.col("block").alias("salt"))
    total = own.agg(F.sum(F.size("pairs")).alias("n")).first()["n"] or 0  # one number
    salts = -(-total // (stripes * PAIRS_PER_TASK)) or 1
    counts = pairs if salts == 1 else add_up(pairs, n_a, stripes, salts, False)
    counts = add_up(counts, n_a, stripes, 1, True)
    scores = pairs.select("block", "at", "b", "a").join(counts.withColumnRenamed("n", "count"), ["b", "a"]).select(F.col("block").alias("of"), "at", "count", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.filter(pa.compute.is_valid(left["pairs"]))
        documents = left.filter(pa.compute.is_null(left["pairs"])).combine_chunks()
        lengths, places = (np.concatenate([np.zeros(0, np.int64), *[x.values.to_numpy() for x in own[c] if x.is_valid]]).astype(np.int64) for c in ("lengths", "places"))
        values = np.zeros((len(right), 2), np.int64)
        values[right["at"].to_numpy()] = np.stack([right["best"].to_numpy(), right["count"].to_numpy()], axis=1)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        units = np.diff(np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(values[places], axis=0)))[ends], axis=0)
        lists = documents["units"].combine_chunks() if documents.num_rows else pa.array([], pa.list_(pa.int32()))
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = lists.offsets.to_numpy().astype(np.int64)
        inner = lists.values.to_numpy()[at[0] : at[-1]] if len(at) else np.zeros(0, np.int64)
        sums = np.diff(np.concatenate((np.zeros((1, 2), np.int64), np.cumsum(units[inner], axis=0)))[at - at[0]], axis=0)
        return documents.select(["key", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1])).append_column("groups_sha256", documents["groups_sha256"])

    out = blocks.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(score, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    out = checkpoint(out.withColumnRenamed("key", key))
    table.drop()
    return out
