"""Interval operators: overlap suppression, islands, locus clustering, proximity pairs. Hits have keys, event_id, lo, hi and value."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.order import RANGE_ROWS, checkpoint, ranged
from strandline.operators.scan import max_before, new_groups


def iou(a: Column, b: Column) -> Column:
    """Overlap over union of two inclusive spans."""
    both = F.greatest(F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"]) + 1, F.lit(0))
    return both / (a["hi"] - a["lo"] + 1 + b["hi"] - b["lo"] + 1 - both)


def overlap_share(a: Column, b: Column) -> Column:
    """Overlap over the shorter of two exclusive spans, at least 1."""
    both = F.greatest(F.least(a["hi"], b["hi"]) - F.greatest(a["lo"], b["lo"]), F.lit(0))
    return both / F.greatest(F.least(a["hi"] - a["lo"], b["hi"] - b["lo"]), F.lit(1))


def islands(hits: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """hits (with inclusive lo, hi and event_id) and their island, a run of spans that no gap splits, named by its first lo."""
    order = ["lo", "hi", "event_id"]
    reach = max_before(ranged(hits, [*keys, *order], rows_per_range=rows), keys, order, "hi", "__reach")
    opened = reach.withColumn("__open", F.when(F.col("__reach").isNull() | (F.col("lo") > F.col("__reach")), F.col("lo"))).drop("__reach")
    return max_before(opened, keys, order, "__open", "__last").withColumn("island", F.coalesce("__open", "__last")).drop("__open", "__last", "__part")


def _greedy(lo: list[int], hi: list[int], best: list[int], sure: list[bool], edge: list[bool], limit: float) -> list[int]:
    """For spans of one key: 1 kept, 0 dropped, 2 open, as it may depend on a span beyond the edge. best lists them best first."""
    kept: list[tuple[int, int]] = sorted((lo[i], hi[i]) for i in range(len(lo)) if sure[i])
    waiting: list[tuple[int, int]] = []
    state = [1 if s else 0 for s in sure]

    def meets(spans: list[tuple[int, int]], a: int, b: int) -> bool:
        size = b - a + 1
        for x, y in spans[bisect_left(spans, (int(a - size / limit) - 1, 0)) : bisect_right(spans, (b, 1 << 62))]:
            both = min(b, y) - max(a, x) + 1
            if both > 0 and both / (size + y - x + 1 - both) >= limit:
                return True
        return False

    for i in best:
        if sure[i] or meets(kept, lo[i], hi[i]):
            continue
        if edge[i] or meets(waiting, lo[i], hi[i]):
            insort(waiting, (lo[i], hi[i]))
            state[i] = 2
        else:
            insort(kept, (lo[i], hi[i]))
            state[i] = 1
    return state


def _decide(rows: DataFrame, keys: list[str], limit: float, parts: int) -> DataFrame:
    """rows with state (as _greedy has it; dropped ones are left out) and edge, each range of keys and lo on its own.

    A span of another range can only meet one that is near enough to its range's
    first or last lo for its length; such spans are open unless a kept one drops
    them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)  # a range of rows, RANGE_ROWS or so
        if not sum(map(len, got)):
            return
        table = pa.Table.from_batches(got).combine_chunks()
        table = table.filter(pa.compute.is_valid(table["lo"])).combine_chunks()
        part = TaskContext.get().partitionId()
        batch = table.to_batches()[0]
        column = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        group = np.cumsum(new_groups(batch, keys, None))
        lo, hi = column["lo"].astype(np.int64), column["hi"].astype(np.int64)
        size = hi - lo + 1
        edge = np.zeros(len(lo), bool)
        if part > 0:
            edge |= (group == group[0]) & (hi - lo[group == group[0]].min() + 1 <= size / limit)
        if part < parts - 1:
            edge |= (group == group[-1]) & (hi - lo[group == group[-1]].max() + 1 >= limit * size)
        state = np.zeros(len(lo), np.int8)
        cuts = np.flatnonzero(np.diff(np.concatenate(([0], group, [group[-1] + 1]))))
        order = np.lexsort((column["event_id"], -column["value"], group))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            best = (order[x:y] - x).tolist()
            state[x:y] = _greedy(lo[x:y].tolist(), hi[x:y].tolist(), best, column["sure"][x:y].tolist(), edge[x:y].tolist(), limit)
        yield from pa.Table.from_batches([batch]).append_column("state", pa.array(state)).append_column("edge", pa.array(edge)).filter(pa.array(state > 0)).to_batches()

    dealt = rows.repartitionByRange(parts, *keys, "lo", "event_id").sortWithinPartitions(*keys, "lo", "event_id")
    return dealt.mapInArrow(run, T.StructType([*rows.schema.fields]).add("state", T.ByteType()).add("edge", T.BooleanType()))


def _cells(rows: DataFrame, limit: float, around: bool) -> DataFrame:
    """rows by size (power of two) and cell (of that width) of lo; around: in every cell that a span overlapping by limit can be in."""
    size = F.floor(F.log2(F.col("hi") - F.col("lo") + 1)).cast("int")
    if not around:
        return rows.withColumn("__size", size).withColumn("__cell", F.floor(F.col("lo") / F.pow(F.lit(2.0), "__size")))
    spread = math.ceil(math.log2(1 / limit))
    rows = rows.withColumn("__size", F.explode(F.sequence(F.greatest(size - spread, F.lit(0)), size + spread)))
    width = F.pow(F.lit(2.0), "__size")
    return rows.withColumn("__cell", F.explode(F.sequence(F.floor((F.col("lo") - 2 * width + 1) / width), F.floor(F.col("hi") / width))))


def _lead(rows: DataFrame, keys: list[str], limit: float) -> DataFrame:
    """One round for spans in places so dense that ranges settle little: those that beat the best of every cell around stay.

    Returns rows with state; what a kept one drops is left out. Only the best of
    each cell meet each other, and spans meet the kept ones around, a few a cell.
    """
    name = F.struct(*keys, "event_id").alias("__id")
    rows = rows.select("*", name)
    open_, sure = rows.where("state = 2"), rows.where("state = 1")
    same = F.expr(" and ".join([f"a.`{k}` <=> b.`{k}`" for k in keys] + ["a.__size = b.__size", "a.__cell = b.__cell"]))
    span = lambda t: {"lo": F.col(f"{t}.lo"), "hi": F.col(f"{t}.hi")}
    rank = lambda t: F.struct((-F.col(f"{t}value")).alias("v"), F.col(f"{t}event_id").alias("e"))

    def without(some: DataFrame, kept: DataFrame) -> DataFrame:
        return _cells(some, limit, False).alias("a").join(_cells(kept, limit, True).alias("b"), same & (iou(span("a"), span("b")) >= limit), "left_anti").drop("__size", "__cell")

    left = checkpoint(without(open_, sure))
    best = _cells(left, limit, False).groupBy(*keys, "__size", "__cell").agg(F.min_by(F.struct("lo", "hi", "event_id", "value", "__id"), rank("")).alias("x")).select(*keys, "__size", "__cell", "x.*")
    beaten = _cells(best.drop("__size", "__cell"), limit, True).alias("a").join(best.alias("b"), same & (rank("b.") < rank("a."))).select("a.__id").distinct()
    winners = checkpoint(left.join(best.select("__id").distinct(), "__id", "left_semi").join(beaten, "__id", "left_anti"))
    others = without(left.join(winners.select("__id"), "__id", "left_anti"), winners)
    columns = [c for c in rows.columns if c not in ("state", "__id")]
    state = lambda df, n: df.select(*columns, F.lit(n).cast("byte").alias("state"))
    return state(winners, 1).unionByName(state(others, 2)).unionByName(state(sure, 1))


def suppress(hits: DataFrame, keys: list[str], limit: float, rows: int = RANGE_ROWS) -> DataFrame:
    """keys and event_id of the hits (keys, event_id, lo, hi, value) that greedy suppression keeps.

    Best first (value, then the smaller event_id, which is unique), a hit stays
    unless it overlaps one of its key that stays by limit (IoU) or more. Ranges of
    a key are settled apart; a hit that may depend on another range's stays open for
    the next round, in which few are left. Nothing holds a key's hits together.
    """
    flat = hits.select(*keys, "event_id", "lo", "hi", F.col("value").cast("double").alias("value"), F.lit(False).alias("sure"))
    flat, found, before = checkpoint(flat), [], None
    n = flat.count()
    while n:
        done = checkpoint(_decide(flat, keys, limit, -(-n // rows)))
        left = done.where("state = 2").count()
        found.append(done.where("state = 1 and not sure").select(*keys, "event_id"))
        done = done.withColumn("sure", F.col("state") == 1)
        if left > rows and before is not None and left > 0.7 * before:
            done = checkpoint(_lead(done, keys, limit))
            left = done.where("state = 2").count()
            found.append(done.where("state = 1 and not sure").select(*keys, "event_id"))
        flat = done.where("state = 2 or edge").withColumn("sure", F.col("state") == 1).drop("state", "edge")
        before, n = left, flat.count() if left else 0
    return reduce(DataFrame.unionByName, found) if found else flat.select(*keys, "event_id")


def cluster_loci(hits: DataFrame, keys: list[str], limit: float = 0.5, rows: int | None = None) -> DataFrame:
    """hits (keys, event_id, lo, hi, ...) and their island and cluster in it, counted from 0.

    In order of lo a hit joins the first cluster with a member that it overlaps by
    limit or more of the shorter of both, else it opens one. Spans of different
    islands never overlap; an island streams through a task that remembers only the
    spans that reach on.
    """
    inside = islands(hits, keys, rows).withColumn("__key", F.struct(*keys, "island"))
    dealt = inside.repartition("__key").sortWithinPartitions("__key", "lo", "hi", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reach, n = None, [], 0
        for batch in batches:
            if not len(batch):
                continue
            new = new_groups(batch, [*keys, "island"], last)
            lo, hi = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lo", "hi"))
            out = []
            for fresh, a, b in zip(new.tolist(), lo, hi, strict=True):
                if fresh:
                    reach, n = [], 0
                reach = [r for r in reach if r[1] > a]
                near = [c for x, y, c in reach if (min(b, y) - a) / max(min(b - a, y - x), 1) >= limit]
                c = min(near, default=n)
                n = max(n, c + 1)
                reach.append((a, b, c))
                out.append(c)
            last = [batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in (*keys, "island")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "cluster"])

    flat = dealt.drop("__key")
    return flat.mapInArrow(run, T.StructType([*flat.schema.fields]).add("cluster", T.IntegerType()))


def near_pairs(left: DataFrame, right: DataFrame, key: str, reach: int = 500) -> DataFrame:
    """Pairs of spans (key, id, lo, hi) of one key that lie at most reach apart; overlapping spans are 0 apart.

    Spans meet in cells of reach bases, so the join is an equi-join on key and
    cell and a key with many spans is spread over its cells.
    """
    cells = lambda df, by: df.withColumn("cell", F.explode(F.sequence(F.floor((F.col("lo") - by) / reach), F.floor((F.col("hi") + by) / reach))))
    a = cells(left, reach).select(F.col(key), F.col("id").alias("a_id"), F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), "cell")
    b = cells(right, 0).select(F.col(key), F.col("id").alias("b_id"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), "cell")
    gap = F.greatest(F.col("b_lo") - F.col("a_hi"), F.col("a_lo") - F.col("b_hi"), F.lit(0))
    # a pair meets in several cells and counts in the first of them
    return a.join(b, [key, "cell"]).where((gap <= reach) & (F.col("cell") == F.greatest(F.floor((F.col("a_lo") - reach) / reach), F.floor(F.col("b_lo") / reach)))).select(key, "a_id", "b_id", gap.alias("gap"))
