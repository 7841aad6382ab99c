"""Approximate quantiles from sketches that can be stored and merged."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sketch of size k answers with a rank that is off by RANK_ERROR / k ** POWER of all rows at most, in 99 of 100 cases.
RANK_ERROR, POWER = 2.296, 0.9021
#: Sizes that sketches can have.
LEAST_SIZE, MOST_SIZE = 8, 65_535


def sketch_size(error: float) -> int:
    """The least size whose rank error is error (a share of all rows) at most; ValueError where none is."""
    k = math.ceil((RANK_ERROR / error) ** (1 / POWER))
    if not 0 < error < 1 or k > MOST_SIZE:
        raise ValueError(f"no sketch has a rank error of {error}")
    return max(LEAST_SIZE, k)


def sketches(df: DataFrame, value: str, keys: list[str], error: float = 0.01, name: str = "sketch") -> DataFrame:
    """keys and a sketch of each group's values, in a column that can be stored; nulls are left out, a group of nulls has an empty sketch."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(sketch_size(error))).alias(name))


def merged(df: DataFrame, keys: list[str], error: float = 0.01, name: str = "sketch") -> DataFrame:
    """keys and the sketches of all rows of each group as one; the error stays what it was."""
    return df.groupBy(*keys).agg(F.kll_merge_agg_double(F.col(name), F.lit(sketch_size(error))).alias(name))


def quantile(sketch: Column, q: float | list[float]) -> Column:
    """The value at a share q of the rows, or an array of those at several; null where the sketch is empty."""
    wanted = F.array(*[F.lit(float(x)) for x in q]) if isinstance(q, list) else F.lit(float(q))
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, wanted))


def approximate_quantiles(df: DataFrame, value: str, q: float | list[float], keys: list[str] | None = None, error: float = 0.01, name: str = "q") -> DataFrame:
    """keys and the approximate quantile (q a number) or quantiles (q a list, an array) of each group."""
    keys = keys or []
    return sketches(df, value, keys, error).select(*keys, quantile(F.col("sketch"), q).alias(name))
