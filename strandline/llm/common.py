"""Shared helpers of the corpus operators: checkpoints, text blocks and word hashing.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so word
boundaries are found on the UTF-8 bytes of a whole block of documents at once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java and Python regular expression for one word.
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step looks at; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode one is made where none is set; on a cluster that is an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


class Table:
    """A table written as Parquet (compressed, unlike a checkpoint) in the shared folder, until drop() removes it."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What tells a document from another, without nulls: see named_docs.
DOC = ["none", "id", "salt"]
#: Rows that small() broadcasts at most (some 100 bytes each).
SMALL_ROWS = 100_000


def named_docs(docs: DataFrame) -> DataFrame:
    """docs as none, id (0 for null), salt (a hash of the text), text, and all other columns as rest; sorted by the first three, null ids come last."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("salt"), "text", F.struct(*rest).alias("rest"))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df (checkpointed), to be broadcast if it has so many rows at most; joined by shuffles otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def names128(names: np.ndarray) -> pa.Array:
    """Rows of two 64-bit columns as binary values of 16 bytes."""
    ends = np.arange(0, 16 * len(names) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(names, np.uint64))])


def n_words(text: Column) -> Column:
    """Number of words of a text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    blanks = (parts[0] == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return (F.size(parts) - blanks).cast("long")


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of a block hold max_bytes at most (one row at least)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(np.nan_to_num(np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.float64)))
        at = 0
        while at < len(ends):
            base = ends[at - 1] if at else 0.0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def row_blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[slice]:
    """Slices of a large_binary array that hold max_bytes at most (one row at least)."""
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1)[1:]
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, side="right")))
        yield slice(at, to)
        at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins and the last ends. Null is empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = (column.fill_null("") if pa.types.is_large_string(column.type) else column.fill_null(b"")).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RADIX = 0x9E3779B97F4A7C15
_RADIX_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTES = np.random.default_rng(20240901).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2 ** 64."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(max(n, 2 * BLOCK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[base][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, radix: int = _RADIX) -> np.ndarray:
    """Hash of values[starts:ends] for each span, from one running sum."""
    inverse = _RADIX_INVERSE if radix == _RADIX else pow(radix, -1, 1 << 64)
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(radix, len(values)), out=run[1:], dtype=np.uint64)
    return mix64((run[ends] - run[starts]) * powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of a block of texts: where they start and end, whose they are, and a 64-bit hash of each."""

    def __init__(self, column: pa.Array | tuple[np.ndarray, np.ndarray], lower: bool = False):
        data, self.offsets = column if isinstance(column, tuple) else utf8(column)
        self.data = _LOWER[data] if lower else data
        self.n_docs = len(self.offsets) - 1
        solid = ~_SPACE[self.data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        first[cuts] = solid[cuts]
        last[cuts - 1] = solid[cuts - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.begin = np.concatenate(([0], np.cumsum(self.counts)))
        self.hashes = span_hashes(_BYTES[self.data], self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of n words within one document."""
        at = np.arange(max(0, len(self.hashes) - n + 1))
        at = at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at
        return at, span_hashes(self.hashes, at, at + n) if len(at) else np.zeros(0, np.uint64)


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Each document's sorted distinct n-word shingles; with fewer words the whole sequence is one, without words none."""
    at, hashes = words.runs(n)
    cut = np.searchsorted(words.doc[at], np.arange(words.n_docs + 1)) if len(at) else np.zeros(words.n_docs + 1, int)
    out = []
    for d in range(words.n_docs):
        if words.counts[d] >= n:
            part = np.sort(hashes[cut[d] : cut[d + 1]])
            out.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
        elif words.counts[d]:
            b = words.begin[d : d + 2]
            out.append(span_hashes(words.hashes[b[0] : b[1]], np.array([0]), np.array([b[1] - b[0]])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def global_index(df: DataFrame, order: list[Column], name: str, parts: int = 64) -> DataFrame:
    """Number the rows from 0 in the given order without gathering them in one task."""
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = checkpoint(ranged.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(*order))))
    counts = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(counts):
        base[p], total = total, total + counts[p]
    lookup = F.create_map(*[F.lit(x) for p in base for x in (p, base[p])]) if base else None
    index = (F.element_at(lookup, F.col("__part")) + F.col("__at") - 1).cast("long") if base else F.lit(0).cast("long")
    return ranged.withColumn(name, index).drop("__part", "__at")


#: Rows that carry packed columns to a partition: its number, the kind of columns, how many values, their bytes.
PACKED = "p int, kind int, n int, data binary"
#: Bytes of text that are packed at a time; small packets compress badly.
PACKET_BYTES = 4 << 20
#: Bytes of text a partition of a packed exchange stands for.
PART_BYTES = 12 << 20


def parts_for(docs: DataFrame, text: str = "text") -> int:
    """Number of partitions of packed exchanges, in proportion to the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0  # one number
    return max(4, -(-total // PART_BYTES))


def scatter(keys: np.ndarray, parts: int, kind: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    """Pack equal-length columns, compressed, by the partition that their keys fall in."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    to = ((mix64(keys.astype(np.uint64, copy=False)) >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    sorted_to = to[order]
    cut = np.flatnonzero(np.concatenate(([True], sorted_to[1:] != sorted_to[:-1]))) if len(to) else np.zeros(0, int)
    ends = np.append(cut[1:], len(to))[: len(cut)]
    moved = [c[order] for c in columns]
    data = [squeeze.compress(b"".join(c[a:b].tobytes() for c in moved)) for a, b in zip(cut, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(sorted_to[cut], pa.int32()), pa.array(np.full(len(cut), kind), pa.int32()), pa.array(ends - cut, pa.int32()), pa.array(data, pa.binary())], ["p", "kind", "n", "data"])


def scatter_texts(keys: np.ndarray, parts: int, kind: int, columns: list[np.ndarray], raw: np.ndarray, offsets: np.ndarray, level: int = 6) -> pa.RecordBatch:
    """Pack rows of columns and the bytes raw[offsets[i]:offsets[i + 1]] of each, compressed, by the partition of their keys."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=level)
    to = ((mix64(keys.astype(np.uint64, copy=False)) >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
    ps, ns, data = [], [], []
    for p in np.unique(to):
        rows = np.flatnonzero(to == p)
        texts = [raw[offsets[i] : offsets[i + 1]] for i in rows]
        lengths = np.array([len(t) for t in texts], np.int64)
        ps.append(p)
        ns.append(len(rows))
        data.append(squeeze.compress(b"".join([*(c[rows].tobytes() for c in columns), lengths.tobytes(), *(t.tobytes() for t in texts)])))
    return pa.RecordBatch.from_arrays([pa.array(ps, pa.int32()), pa.array(np.full(len(ps), kind), pa.int32()), pa.array(ns, pa.int32()), pa.array(data, pa.binary())], ["p", "kind", "n", "data"])


class Gathered:
    """All packed rows of a partition, by kind; what a partition holds is bounded by PART_BYTES of text."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for kind, n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                self.rows.setdefault(kind, []).append((n, data))

    def columns(self, kind: int, *types: str) -> list[np.ndarray]:
        """The columns of a kind, put together."""
        import zstandard

        out: list[list[np.ndarray]] = [[] for _ in types]
        expand = zstandard.ZstdDecompressor()
        for n, data in self.rows.pop(kind, []):
            data, at = expand.decompress(data), 0
            for i, t in enumerate(types):
                out[i].append(np.frombuffer(data, t, n, at))
                at += n * np.dtype(t).itemsize
        return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)]

    def texts(self, kind: int, *types: str) -> tuple[list[np.ndarray], pa.Array]:
        """The columns and texts of a kind packed by scatter_texts."""
        import zstandard

        out, lengths, raws = [[] for _ in types], [], []
        expand = zstandard.ZstdDecompressor()
        for n, data in self.rows.pop(kind, []):
            data, at = expand.decompress(data), 0
            for i, t in enumerate(types):
                out[i].append(np.frombuffer(data, t, n, at))
                at += n * np.dtype(t).itemsize
            lengths.append(np.frombuffer(data, np.int64, n, at))
            raws.append(data[at + 8 * n :])
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths) if lengths else np.zeros(0, np.int64)))).astype(np.int64)
        texts = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(raws))])
        return [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, types, strict=True)], texts


def exchange(parts: int, *packed: DataFrame) -> DataFrame:
    """Bring packed rows to their partitions."""
    out = packed[0]
    for other in packed[1:]:
        out = out.unionByName(other)
    return out.repartition(parts, "p")


def firsts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order by the keys (the first decides first) and where a new value of the first key begins in it."""
    order = np.lexsort(keys[::-1])
    head = keys[0][order]
    return order, np.concatenate(([True], head[1:] != head[:-1])) if len(head) else np.zeros(0, bool)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): id and component, the smallest id reachable.

    Large and small stars by turns: each node's larger neighbours, and then its
    smaller ones, are tied to the smallest of all, until every node is tied to
    its component's smallest. Edges never grow in number; a turn is checkpointed.
    """
    star = checkpoint(edges.where("a <> b").select("a", "b").distinct())
    state = None
    while True:
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_ = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        tied = F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))
        star = checkpoint(small_.select(F.explode(tied).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        now = tuple(star.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first())  # two numbers
        if now == state:
            return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        state = now
