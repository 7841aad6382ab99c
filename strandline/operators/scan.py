"""Prefix scans in a given order: what each row's group amounts to up to it, without one task for a group.

Rows are dealt by ranges of keys and order. A range is scanned on its own, and
starts at what the ranges before it make of the group that it goes on with. Only
groups that span ranges need that, so what is put together afterwards has two
rows a range at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.order import checkpoint, range_count, ranged


def new_groups(batch: pa.RecordBatch, keys: list[str], last: list | None) -> np.ndarray:
    """Whether each row has other keys than the row before; last: the keys before the batch. Nulls are equal."""
    new = np.zeros(len(batch), bool)
    for k, key in enumerate(keys):
        column = batch.column(batch.schema.get_field_index(key))
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
        new[0] |= last is None or column[0].as_py() != last[k]
    new[0] |= last is None
    return new


def compose(scale: np.ndarray, add: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps x -> scale x + add of a batch, each put after all maps since its group's first, by doubling."""
    scale, add = scale.astype(float).copy(), add.astype(float).copy()
    begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    reach = np.arange(len(new)) - begin
    step = 1
    while step <= (reach.max() if len(reach) else 0):
        at = np.flatnonzero(reach >= step)
        scale[at], add[at] = scale[at] * scale[at - step], scale[at] * add[at - step] + add[at]
        step *= 2
    return scale, add


def affine_scan(df: DataFrame, keys: list[str], order: list[str], scale: str, add: str, name: str, start: str | None = None, rows: int | None = None) -> DataFrame:
    """df with name: x after each row of a group in order, where a row makes scale x + add of x.

    Before a group's first row x is what that row has as start, else 0. scale, add
    and start are columns of numbers without nulls. Rows of a group that are equal
    in order come in any order. rows is the number of rows of a range.
    """
    fields = df.schema
    pieces = df.repartitionByRange(range_count(df.count(), rows), *keys, *order).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a0, b0, s0 = None, 1.0, 0.0, 0.0
        for batch in batches:
            if not len(batch):
                continue
            new = new_groups(batch, keys, last)
            a, b = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (scale, add))
            begin = np.zeros(len(batch))
            if start:
                own = batch.column(batch.schema.get_field_index(start)).to_numpy(zero_copy_only=False)
                if last is None:  # the range's first group may have begun before, so its start stays apart
                    s0 = float(own[0])
                begin = np.where(new, own, 0.0)
                begin[0] = begin[0] if last is not None else 0.0
            goes_on = np.cumsum(new) == 0
            head = goes_on | (np.cumsum(new) == 1) if last is None else goes_on
            a, b = compose(a, b + a * begin, new)
            a, b = np.where(goes_on, a * a0, a), np.where(goes_on, a * b0 + b, b)
            starts = np.where(head, s0, 0.0)
            last, a0, b0, s0 = [batch.column(batch.schema.get_field_index(k))[-1].as_py() for k in keys], a[-1], b[-1], starts[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a), pa.array(b), pa.array(starts)], [*batch.schema.names, "__a", "__b", "__s"])

    schema = type(fields)([*fields.fields]).add("__a", "double").add("__b", "double").add("__s", "double")
    done = checkpoint(pieces.mapInArrow(run, schema).withColumn("__part", F.spark_partition_id()))
    # __a shrinks or stays as a group goes on within a range; its last row there is the one of the latest order
    ends = done.groupBy("__part", *keys).agg(F.max_by(F.struct("__a", "__b", "__s"), F.struct(*order)).alias("x")).select("__part", *keys, "x.__a", "x.__b", "x.__s")
    spans = ends.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    same = lambda a, b: F.expr(" and ".join([f"{a}.`{k}` <=> {b}.`{k}`" for k in keys]) or "true")
    wide = ends.alias("e").join(spans.alias("s"), same("e", "s"), "left_semi")  # two rows a range at most
    one = F.sort_array(F.collect_list(F.struct("__part", "__a", "__b", "__s")))
    carried = F.aggregate("x", F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("x")[0]["__s"].alias("x"))), lambda acc, r: F.concat(acc, F.array(F.struct(r["__part"].alias("part"), (r["__a"] * acc[F.size(acc) - 1]["x"] + r["__b"]).alias("x")))))
    carried = wide.groupBy(*keys).agg(one.alias("x")).select(*keys, carried.alias("x"), F.transform("x", lambda r: r["__part"]).alias("p"))
    # what a range starts with is what the one before it ended with
    before = carried.select(*keys, F.inline(F.arrays_zip(F.col("p").alias("__part"), F.transform(F.slice("x", 1, F.size("p")), lambda r: r["x"]).alias("__before"))))
    out = done.alias("d").join(F.broadcast(before).alias("b"), F.expr("d.__part = b.__part") & same("d", "b"), "left")
    return out.select("d.*", (F.col("d.__a") * F.coalesce("b.__before", "d.__s") + F.col("d.__b")).alias(name)).drop("__a", "__b", "__s", "__part")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, rows: int | None = None) -> DataFrame:
    """df with name: the largest value of the rows before each one of its group, in order; null for the first."""
    return max_before(ranged(df, [*keys, *order], rows_per_range=rows), keys, order, value, name).drop("__part")


def max_before(done: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """running_max of rows that are dealt by ranges of keys and order already, with __part."""
    within = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = done.groupBy("__part", *keys).agg(F.max(value).alias("__top"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range and group
    parts = parts.withColumn("__before", F.max("__top").over(earlier)).where("__before is not null").drop("__top")  # one a range at most
    same = F.expr(" and ".join(["d.__part = p.__part", *[f"d.`{k}` <=> p.`{k}`" for k in keys]]))
    out = done.withColumn("__within", F.max(value).over(within)).alias("d").join(F.broadcast(parts).alias("p"), same, "left")
    return out.select("d.*", F.greatest("d.__within", "p.__before").alias(name)).drop("__within")
