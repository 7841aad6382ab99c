"""Scorers over hits that a search has found, and over plain substrings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import scoring

from .base import LEAST_BASES, Scorer, wanted
from .structure import Weights, structure


class HitScorer(Scorer):
    """Composite of the best hit of each wanted token: geometric mean of their qualities, sharpened, times recall.

    hits has id, token, pct_id, coverage, norm_score. Recall divides by the
    wanted tokens with repeats. No wanted token, or no hit, is a reward of 0.
    """

    def __init__(self, hits: DataFrame, cap: float = 5.0, sharpness: float = 2.0):
        self.hits, self.cap, self.sharpness = hits, cap, sharpness

    def detail(self, pairs: DataFrame) -> DataFrame:
        """id, reward, geo_mean, recall, found, expected."""
        q = scoring.token_quality(F.col("pct_id"), F.col("coverage"), F.col("norm_score"), self.cap)
        best = self.hits.groupBy("id", "token").agg(F.max(q).alias("q"))
        each = wanted(pairs).select("id", "at", "token").join(best, ["id", "token"], "left")
        geo = F.exp(F.avg(F.when(F.col("q").isNotNull(), F.ln(F.greatest("q", F.lit(1e-6))))))
        s = each.groupBy("id").agg(F.count("token").alias("expected"), F.count("q").alias("found"), geo.alias("geo_mean"))
        recall = F.col("found") / F.greatest("expected", F.lit(1))
        reward = F.coalesce(F.pow("geo_mean", F.lit(self.sharpness)) * (0.5 + 0.5 * recall), F.lit(0.0))
        return s.select("id", reward.alias("reward"), F.coalesce("geo_mean", F.lit(0.0)).alias("geo_mean"), recall.alias("recall"), "found", "expected")


class SearchScorer(HitScorer):
    """HitScorer over the hits of an external search: of a token's hits the one of the best bit_score counts, and score per letter is capped at 1.5."""

    def __init__(self, hits: DataFrame, cap: float = 1.5, sharpness: float = 2.0):
        best = hits.groupBy("id", "token").agg(F.max_by(F.struct("pct_id", "coverage", "norm_score"), F.struct("bit_score", "norm_score")).alias("x"))
        super().__init__(best.select("id", "token", *[F.least(f"x.{c}", F.lit(100.0)).alias(c) for c in ("pct_id", "coverage")], "x.norm_score"), cap, sharpness)


class ValidScorer(SearchScorer):
    """SearchScorer's reward times a structural multiplier, within 0 and 1, to four digits.

    The multiplier (see structure.structure) takes off for origins beyond one
    (by locus), markers beyond two, features nobody asked for and length, and adds
    for asked promoters near genes that they drive. hits also has lo, hi and
    bit_score; broad holds the hits of all tokens, hits unless given. No wanted
    token, or fewer than LEAST_BASES bases: reward 0, multiplier 1.
    """

    def __init__(self, hits: DataFrame, broad: DataFrame | None = None, weights: Weights = Weights(), cap: float = 1.5, sharpness: float = 2.0):
        super().__init__(hits, cap, sharpness)
        self.broad, self.weights = (hits if broad is None else broad).select("id", "token", "lo", "hi", "bit_score"), weights

    def detail(self, pairs: DataFrame) -> DataFrame:
        """What SearchScorer finds, base_reward, and what structure() finds."""
        asked = wanted(pairs).select("id", "token", F.length("seq").alias("length"))
        rows = super().detail(pairs).join(structure(asked, self.broad, self.weights), "id")
        scored = (F.col("expected") > 0) & (F.col("length") >= LEAST_BASES)
        base = F.when(scored, F.round("reward", 4)).otherwise(0.0)
        rows = rows.withColumn("base_reward", base).withColumn("multiplier", F.when(scored, F.col("multiplier")).otherwise(1.0))
        reward = F.round(F.least(F.greatest(F.col("base_reward") * F.col("multiplier"), F.lit(0.0)), F.lit(1.0)), 4)
        return rows.select("id", reward.alias("reward"), "base_reward", "multiplier", "geo_mean", "recall", "found", "expected", "ori_count", "ori_tokens", "amr_count", "unrequested", "pairs", "length")


class SubstringScorer(Scorer):
    """Share of the targets that occur in the sequence, whatever the case; 0 without targets."""

    def __init__(self, targets: tuple[str, ...]):
        self.targets = targets

    def detail(self, pairs: DataFrame) -> DataFrame:
        """id, reward, matched."""
        low = F.lower(F.coalesce("sequence", F.lit("")))
        matched = F.filter(F.array(*[F.lit(t) for t in self.targets]).cast("array<string>"), lambda t: F.contains(low, F.lower(t)))
        return pairs.select("id", (F.size(matched) / max(1, len(self.targets))).alias("reward"), matched.alias("matched"))
