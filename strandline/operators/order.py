"""Row numbers and running counts in a given order without one task for all rows."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, and ranges at most (a number of each comes to the driver).
RANGE_ROWS, MAX_RANGES = 50_000, 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In local mode one is made where none is set; on a cluster that is an error."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt by the columns to at least as many partitions as tasks can run: for work that is dear by the row, where partitions sized by bytes would be few."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)


def range_count(n: int, rows_per_range: int | None = None) -> int:
    """How many ranges n rows are dealt by."""
    return max(1, min(MAX_RANGES, -(-n // (rows_per_range or RANGE_ROWS))))


def ranged(df: DataFrame, order: list[str], rows: int | None = None, rows_per_range: int | None = None) -> DataFrame:
    """df dealt by ranges of the order, with __part; checkpointed, so ranges stay as they are if an executor is lost."""
    n = df.count() if rows is None else rows
    return checkpoint(df.repartitionByRange(range_count(n, rows_per_range), *order).withColumn("__part", F.spark_partition_id()))


def number_rows(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Number the rows from 0 in the order of the columns: each range on its own, moved by the counts of those before it."""
    rows = ranged(df, order, parts and parts * RANGE_ROWS)
    before, total = {}, 0
    for part, n in sorted((r["__part"], r["n"]) for r in rows.groupBy("__part").agg(F.count("*").alias("n")).collect()):  # one row a range
        before[part], total = total, total + n
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    starts = df.sparkSession.createDataFrame(list(before.items()), "__part int, __before long")
    return rows.withColumn(name, at.cast("long")).join(F.broadcast(starts), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")  # a row a range


def running_counts(df: DataFrame, keys: list[str], value: str, weight: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """keys, value, n (rows of that value, or its summed weight), upto (n of this and all lower values of the group), total, and extra (summed).

    Distinct values are counted first and dealt by ranges; sums run within a
    range and start at what the ranges before hold of the group.
    """
    extra = extra or []
    n = df.groupBy(*keys, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"), *[F.sum(c).alias(c) for c in extra])
    rows = ranged(n, [*keys, value])
    parts = rows.groupBy("__part", *keys).agg(F.sum("n").alias("s"))  # a row a range and group that it touches: ranges and groups together at most
    before = F.sum("s").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("__part", *keys, F.coalesce(before, F.lit(0)).alias("before"), F.sum("s").over(Window.partitionBy(*keys)).alias("total"))
    within = F.sum("n").over(Window.partitionBy("__part", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    same = F.expr(" and ".join(["r.__part = p.__part", *[f"r.`{k}` <=> p.`{k}`" for k in keys]]))
    out = rows.withColumn("__within", within).alias("r").join(parts.alias("p"), same)
    return out.select(*[F.col(f"r.{k}").alias(k) for k in keys], F.col(f"r.{value}").alias(value), F.col("r.n").alias("n"), (F.col("r.__within") + F.col("p.before")).alias("upto"), F.col("p.total").alias("total"), *[F.col(f"r.{c}").alias(c) for c in extra])
