"""What a construct's hits say of its structure: origins by locus, markers, unrequested features, driven genes and length."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import features, tokens
from strandline.operators import intervals
from strandline.operators.order import checkpoint


@dataclass(frozen=True)
class Weights:
    """Penalties and bonuses, each off or on the multiplier of 1."""

    excess_ori: float = 0.15
    excess_amr: float = 0.10
    unrequested: float = 0.05
    per_kb: float = 0.01
    soft_length: float = 8000.0
    length_cap: float = 0.15
    adjacency: float = 0.05
    reach: int = 500


def best_places(hits: DataFrame) -> DataFrame:
    """id, token, lo, hi, bit_score: the best hit of each token; of equals the first place."""
    lo, hi = F.least("lo", "hi"), F.greatest("lo", "hi")
    rank = F.struct("bit_score", (-lo).alias("l"), (-hi).alias("h"))
    return hits.groupBy("id", "token").agg(F.max_by(F.struct(lo.alias("lo"), hi.alias("hi"), "bit_score"), rank).alias("x")).select("id", "token", "x.*")


def origin_loci(best: DataFrame) -> DataFrame:
    """id, island, cluster, lo, hi, token (of the best hit) and tokens: ORI hits that overlap by half of the shorter make one origin."""
    ori = best.where(tokens.category_of(F.col("token")) == "ORI").withColumn("event_id", F.xxhash64("token"))
    rank = F.struct("bit_score", (-F.col("lo")).alias("l"), (-F.col("event_id")).alias("e"))
    return intervals.cluster_loci(ori, ["id"], 0.5).groupBy("id", "island", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max_by("token", rank).alias("token"), F.array_sort(F.collect_set("token")).alias("tokens"))


def driven_pairs(best: DataFrame, reach: int) -> DataFrame:
    """id, promoter, gene: promoters that drive a coding feature at most reach bases away."""
    kind = tokens.category_of(F.col("token"))
    spans = best.select(F.col("id").alias("of"), F.col("token").alias("id"), "lo", "hi", kind.alias("kind"))
    near = intervals.near_pairs(spans.where("kind = 'PROM'"), spans.where(F.col("kind").isin(*features.CODING)), "of", reach)
    return near.where(features.drives(F.col("a_id"), F.col("b_id"))).select(F.col("of").alias("id"), F.col("a_id").alias("promoter"), F.col("b_id").alias("gene"))


def structure(asked: DataFrame, hits: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """One row per id of asked (id, token, length): ori_count, ori_tokens, amr_count, unrequested, pairs and multiplier.

    hits (id, token, lo, hi, bit_score) may hold any token, asked for or not. An
    unrequested feature is a marker, reporter or tag that is found and wasn't asked
    for, or an origin none of whose tokens was; pairs count if both their tokens
    were asked for. A row of asked whose token is null asks for none.
    """
    asked = checkpoint(asked.select("id", "token", "length"))
    sizes = asked.groupBy("id").agg(F.max("length").alias("length"))
    wanted = asked.where("token is not null").select("id", "token").distinct().withColumn("asked", F.lit(True))
    best = checkpoint(best_places(hits.join(sizes.select("id"), "id", "left_semi")))
    found = best.join(wanted, ["id", "token"], "left").withColumn("kind", tokens.category_of(F.col("token")))
    plain = found.groupBy("id").agg(
        F.count_if(F.col("kind") == "AMR").alias("amr_count"),
        F.array_sort(F.collect_set(F.when(F.col("asked").isNull() & F.col("kind").isin("AMR", "REPORTER", "TAG"), F.col("token")))).alias("others"),
    )
    ours = wanted.where(tokens.category_of(F.col("token")) == "ORI").groupBy("id").agg(F.collect_set("token").alias("own"))
    loci = origin_loci(best).join(ours, "id", "left")
    strange = F.when(~F.arrays_overlap("tokens", F.coalesce("own", F.array().cast("array<string>"))), F.col("token"))
    loci = loci.groupBy("id").agg(F.count("*").alias("ori_count"), F.array_sort(F.flatten(F.collect_list("tokens"))).alias("ori_tokens"), F.array_sort(F.collect_list(strange)).alias("origins"))
    pairs = driven_pairs(found.where("asked").select("id", "token", "lo", "hi"), weights.reach)
    pairs = pairs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("promoter", "gene"))).alias("pairs"))
    rows = sizes.join(plain, "id", "left").join(loci, "id", "left").join(pairs, "id", "left")
    no = lambda c: F.coalesce(F.col(c), F.array().cast(rows.schema[c].dataType))
    rows = rows.withColumn("unrequested", F.concat(no("others"), no("origins"))).withColumn("pairs", no("pairs")).withColumn("ori_tokens", no("ori_tokens")).na.fill(0, ["amr_count", "ori_count"])
    over = lambda c, k: F.greatest(F.col(c) - k, F.lit(0))
    multiplier = (
        1 + weights.adjacency * F.size("pairs") - weights.excess_ori * over("ori_count", 1) - weights.excess_amr * over("amr_count", 2)
        - weights.unrequested * F.size("unrequested") - F.least(weights.per_kb * over("length", weights.soft_length) / 1000, F.lit(weights.length_cap))
    )
    return rows.select("id", "length", "ori_count", "ori_tokens", "amr_count", "unrequested", "pairs", F.round(multiplier, 4).alias("multiplier"))
