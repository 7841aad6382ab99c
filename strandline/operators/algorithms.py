"""Training algorithms by name: how rewards become advantages, and the loss that goes with them."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import scoring


class Algorithm(ABC):
    """Advantages of rewards, and a loss over sequences (see scoring.LOSSES)."""

    loss_name: str

    @abstractmethod
    def advantages(self, rewards: DataFrame) -> DataFrame:
        """rewards (with a column reward) and advantage."""

    def loss(self, **options: float) -> Column:
        return scoring.loss(self.loss_name, **options)


class GroupRelative(Algorithm):
    """Rewards less their group's mean, over its deviation (least at least; of one row 0). Groups are counted and joined, so none is held together."""

    loss_name = "grpo"

    def __init__(self, group: str = "group", least: float = 1e-8):
        self.group, self.least = group, least

    def advantages(self, rewards: DataFrame) -> DataFrame:
        stats = rewards.groupBy(self.group).agg(F.avg("reward").alias("__mean"), F.coalesce(F.stddev_samp("reward"), F.lit(0.0)).alias("__sd"))
        same = F.col(f"r.`{self.group}`").eqNullSafe(F.col(f"s.`{self.group}`"))
        out = rewards.alias("r").join(stats.alias("s"), same)
        return out.select("r.*", ((F.col("r.reward") - F.col("s.__mean")) / F.greatest("s.__sd", F.lit(self.least))).alias("advantage"))


class Clipped(Algorithm):
    """Rewards less the mean of all, over their deviation plus least; a single reward stays as it is."""

    loss_name = "ppo"

    def __init__(self, least: float = 1e-8):
        self.least = least

    def advantages(self, rewards: DataFrame) -> DataFrame:
        stats = rewards.agg(F.avg("reward").alias("__mean"), F.stddev_samp("reward").alias("__sd"), F.count("reward").alias("__n"))
        out = rewards.crossJoin(F.broadcast(stats))  # one row
        scaled = (F.col("reward") - F.col("__mean")) / (F.col("__sd") + self.least)
        return out.withColumn("advantage", F.when(F.col("__n") > 1, scaled).otherwise(F.col("reward"))).drop("__mean", "__sd", "__n")


ALGORITHMS: dict[str, type[Algorithm]] = {"grpo": GroupRelative, "ppo": Clipped}


def build_algorithm(name: str, **options: object) -> Algorithm:
    """An algorithm by name; KeyError with the known names for another."""
    if name not in ALGORITHMS:
        raise KeyError(f"no algorithm {name!r}; there are {', '.join(ALGORITHMS)}")
    return ALGORITHMS[name](**options)
