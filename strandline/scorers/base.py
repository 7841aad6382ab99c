"""What all scorers have: detail() and score() over a table of prompts and sequences, and the same for a few pairs."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import dna, tokens

#: A finished sequence ends in one of these.
ENDS = ("<EOS>", "</s>")
#: Cleaned sequences below so many bases have no score.
LEAST_BASES = 20


def finished(text: Column) -> Column:
    return F.contains(text, F.lit(ENDS[0])) | F.contains(text, F.lit(ENDS[1]))


class Scorer(ABC):
    """Scores rows of (id, prompt, sequence); subclasses say how in detail()."""

    @abstractmethod
    def detail(self, pairs: DataFrame) -> DataFrame:
        """id, reward and whatever else the scorer finds, for every row of pairs (id, prompt, sequence)."""

    def score(self, pairs: DataFrame) -> DataFrame:
        """id and reward for every row of pairs."""
        return self.detail(pairs).select("id", "reward")

    def score_batch(self, prompts: Sequence[str], sequences: Sequence[str]) -> list[float]:
        """Rewards of a few pairs, in their order; one Spark job."""
        if len(prompts) != len(sequences):
            raise ValueError("as many prompts as sequences are needed")
        if not prompts:
            return []
        spark = SparkSession.active()
        rows = spark.createDataFrame(list(zip(range(len(prompts)), prompts, sequences, strict=True)), "id long, prompt string, sequence string")
        found = {r["id"]: r["reward"] for r in self.score(rows).collect()}
        return [found[i] for i in range(len(prompts))]

    def score_sequence(self, prompt: str, sequence: str) -> float:
        return self.score_batch([prompt], [sequence])[0]

    def score_sequence_detailed(self, prompt: str, sequence: str) -> dict[str, object]:
        """All that detail() finds of one pair."""
        spark = SparkSession.active()
        (row,) = self.detail(spark.createDataFrame([(0, prompt, sequence)], "id long, prompt string, sequence string")).drop("id").collect()
        return row.asDict(recursive=True)


def wanted(pairs: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """id, at (place), token for every hard token of the prompts, with repeats, and seq (cleaned), eos of its row; a prompt without any has one row of null token."""
    clean = pairs.select("id", dna.clean_dna(F.coalesce("sequence", F.lit(""))).alias("seq"), finished(F.coalesce("sequence", F.lit(""))).alias("eos"), tokens.hard_tokens(tokens.tokens_in(F.coalesce("prompt", F.lit(""))), exclude=exclude).alias("hard"))
    return clean.select("id", "seq", "eos", F.posexplode_outer("hard").alias("at", "token"))
