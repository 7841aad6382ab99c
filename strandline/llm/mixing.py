"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same fractional number of copies, target /
size of the source. Within blocks of a source, fractions are paired: mass,
counted in words, moves between the two at random until one is whole, so a
pair's words and each document's expectation stay. What stays fractional in a
block goes up a reduction tree, block by block, until one fraction a source is
left. Blocks have a bounded number of rows, so a hot source is spread.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, global_index, n_words

#: Rows of a block, and blocks that meet at a node of the tree.
BLOCK_ROWS, FAN_IN = 4096, 64
#: Up to so many sources are broadcast (some 50 bytes each).
BROADCAST_SOURCES = 100_000


def source_targets(rows: DataFrame, weights: tuple[float, ...], cap: float) -> tuple[DataFrame, int]:
    """Per source: rank by code point (null last), size, weight and target; and the number of sources.

    Targets share the sum of all sizes by weight; those above cap times their
    source's size stop there and the excess is shared anew, until none is above.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    sizes = global_index(sizes, [F.col("source").asc_nulls_last()], "rank")
    sizes = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    sizes = checkpoint(sizes)
    top, rate, stopped = F.lit(float(cap)) * F.col("source_size"), 0.0, -1
    while True:  # each turn stops one more source at least
        held = top <= F.lit(rate) * F.col("weight")
        r = sizes.agg(F.count("*").alias("n"), F.sum("source_size").alias("all"), F.sum(held.cast("int")).alias("held"), F.sum(F.when(held, top)).alias("held_size"), F.sum(F.when(~held, F.col("weight"))).alias("free")).first()
        if not r["free"] or r["held"] == stopped:
            break
        stopped, rate = r["held"], (float(r["all"]) - float(r["held_size"] or 0)) / r["free"]
    return sizes.withColumn("target", F.least(top, F.lit(rate) * F.col("weight"))), r["n"]


def pivot(mass: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions of copies so that the words, sum(mass * size), stay. Returns the rounded array and the row left fractional, or -1."""
    out, left = mass.copy(), -1
    luck = draw.random(len(mass))
    for j in range(len(out)):
        if not 1e-12 < out[j] < 1 - 1e-12:
            out[j] = round(out[j])
            continue
        if left < 0:
            left = j
            continue
        a, b = size[left], size[j]
        up, down = min((1 - out[left]) * a, out[j] * b), min(out[left] * a, (1 - out[j]) * b)
        move = up if luck[j] * (up + down) < down else -down
        out[left] += move / a
        out[j] -= move / b
        for k in (left, j):
            if out[k] < 1e-9 or out[k] > 1 - 1e-9:
                out[k] = round(out[k])
        if out[left] in (0.0, 1.0):
            left = j if 0 < out[j] < 1 else -1
    return out, left


def _rng(*key: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "little"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, size: Column | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken for every row of docs (and the columns in extra).

    Null texts have size 0; documents of size 0 take no words, and a source of
    size 0 has target 0. Null sources form one source, ranked last. Repeated
    rows are mixed as rows of their own. copies is at most ceil(cap). The same
    rows give the same result in every run, however they are partitioned.
    """
    rows = docs.select("doc_id", docs["source"].cast("string").alias("source"), (n_words(docs["text"]) if size is None else size).alias("size"), *extra)
    rows = checkpoint(rows)
    sources, n_sources = source_targets(rows, weights, cap)
    few = sources.select("source", "rank", "source_size", "target", "n_rows")
    joined = rows.join(F.broadcast(few) if n_sources <= BROADCAST_SOURCES else few, rows["source"].eqNullSafe(few["source"])).drop(few["source"])
    blocks = F.ceil(F.col("n_rows") / BLOCK_ROWS)
    joined = joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), blocks).cast("long"))
    joined = joined.withColumn("share", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    order = [("size", "descending"), ("doc_id", "ascending"), *((c, "ascending") for c in extra)]

    def round_block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        words, share = rows["size"].to_numpy().astype(float), rows["share"].to_numpy()
        whole = np.floor(share + 1e-12)
        done, left = pivot(np.where(words > 0, np.maximum(share - whole, 0.0), 0.0), words, _rng(seed, 0, *(k.as_py() for k in key)))
        open_ = np.arange(len(rows)) == left
        rows = rows.drop_columns(["n_rows", "share"])
        rows = rows.append_column("at", pa.array(np.arange(len(rows)), pa.int64())).append_column("part", pa.array(done, pa.float64(), mask=~open_))
        return rows.append_column("copies", pa.array((whole + np.where(open_, 0, done)).astype(np.int64)))

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("n_rows", "share").schema)
    first = checkpoint(joined.groupBy("rank", "block").applyInArrow(round_block, f"{kept}, at long, part double, copies long"))

    def round_node(level: int):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("size", "descending"), ("block", "ascending")]))
            done, left = pivot(rows["part"].to_numpy(), rows["size"].to_numpy().astype(float), _rng(seed, level, *(k.as_py() for k in key)))
            open_ = np.arange(len(rows)) == left
            return pa.table({"rank": rows["rank"], "block": rows["block"], "size": rows["size"], "part": pa.array(done, mask=~open_), "up": pa.array(done.round().astype(np.int64), mask=open_), "node": rows["node"]})

        return run

    decided = None
    rest = first.where("part is not null").select("rank", "block", "size", "part", F.floor(F.col("block") / FAN_IN).alias("node"))
    most, level = first.agg(F.max("block")).first()[0] or 0, 1
    while True:
        out = checkpoint(rest.groupBy("rank", "node").applyInArrow(round_node(level), "rank long, block long, size long, part double, up long, node long"))
        settled = out.where("up is not null").select("rank", "block", "up")
        decided = settled if decided is None else decided.unionByName(settled)
        rest = out.where("part is not null").select("rank", "block", "size", "part", F.floor(F.col("node") / FAN_IN).alias("node"))
        if most < FAN_IN:
            break
        most, level = most // FAN_IN, level + 1
    # one fraction a source is left: a last draw
    lot = F.pmod(F.xxhash64(F.lit(seed), "rank", "block"), F.lit(1 << 30)) / float(1 << 30)
    decided = decided.unionByName(rest.select("rank", "block", (lot < F.col("part")).cast("long").alias("up")))
    decided = decided.select(F.col("rank").alias("rank_"), F.col("block").alias("block_"), "up")
    out = first.join(decided, (first["rank"] == decided["rank_"]) & (first["block"] == decided["block_"]) & F.col("part").isNotNull(), "left")
    out = out.withColumn("copies", F.col("copies") + F.coalesce("up", F.lit(0)))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *extra)


def take_mix(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; the columns of docs stay, whatever their names.

    Rows are matched with their copies by doc_id, source, text and size, so
    repeated rows and null ids, sources or texts are taken as mix_sources says;
    an empty table gives no rows.
    """
    names = docs.columns
    keys = [F.col("doc_id").alias("_d"), F.col("source").cast("string").alias("_s"), F.xxhash64("text").alias("_t"), n_words(F.col("text")).alias("_z")]
    whole = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    whole = whole.withColumn("_n", F.row_number().over(Window.partitionBy("_d", "_s", "_t", "_z").orderBy(F.lit(0))))
    mixed = mix_sources(docs.select("doc_id", "source", "text", F.xxhash64("text").alias("__text")), extra=("__text",), **options)
    mixed = mixed.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("__text").alias("t"), F.col("size").alias("z"), "copies")
    mixed = mixed.withColumn("n", F.row_number().over(Window.partitionBy("d", "s", "t", "z").orderBy("copies")))
    on = F.col("_d").eqNullSafe(F.col("d")) & F.col("_s").eqNullSafe(F.col("s")) & (F.col("_t") == F.col("t")) & (F.col("_z") == F.col("z")) & (F.col("_n") == F.col("n"))
    taken = whole.join(mixed.where("copies > 0"), on)
    taken = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col("_doc").getField(c).alias(c) for c in names])
