"""Local alignment of each wanted motif, on both strands and, for coding motifs, in all six frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import dna
from strandline.operators import align
from strandline.operators.order import spread

from .base import LEAST_BASES, Scorer, wanted

# Tokens that are never scored.
EXCLUDED = ("<ELEM_IRES>", "<ELEM_TRACRRNA>")


class AlignmentScorer(Scorer):
    """Sum over the wanted tokens of min(1, ratio / found), plus a bonus for a finished sequence.

    lookup has token, dna_seq, protein_seq and is_cds, a row a variant; any but
    token may be null. A token's ratio is its best variant's; tokens that lookup
    doesn't have are left out. A prompt without known tokens, or a sequence of
    fewer than LEAST_BASES bases, has a reward of 0.
    """

    def __init__(self, lookup: DataFrame, found: float = align.FOUND, eos_bonus: float = 0.15):
        self.lookup, self.found, self.eos_bonus = lookup.select("token", "dna_seq", "protein_seq", "is_cds"), found, eos_bonus

    def ratios(self, pairs: DataFrame) -> DataFrame:
        """id, at, token, ratio for the wanted tokens that lookup has."""
        asked = wanted(pairs, EXCLUDED).where((F.length("seq") >= LEAST_BASES) & F.col("token").isNotNull())
        each = spread(asked.join(self.lookup.withColumn("dna_seq", F.upper("dna_seq")), "token"), "id", "at", "token", "dna_seq")
        back = dna.reverse_complement(F.col("dna_seq"))
        by_dna = F.greatest(align.local_ratio("dna_seq", "seq"), align.local_ratio(back, "seq"))
        coding = F.when(F.coalesce("is_cds", F.lit(False)), F.col("protein_seq"))
        by_protein = align.best_protein_ratio(coding, dna.six_frames(F.col("seq"), stop="*"))
        ratio = F.greatest(F.coalesce(by_dna, F.lit(0.0)), F.coalesce(by_protein, F.lit(0.0)))
        return each.select("id", "at", "token", ratio.alias("ratio")).groupBy("id", "at", "token").agg(F.max("ratio").alias("ratio"))

    def detail(self, pairs: DataFrame) -> DataFrame:
        """id, reward, n_hard_tokens, n_found, qc_pass_rate, per_motif (token, score_ratio, found)."""
        hit = F.col("ratio") >= self.found
        each = F.array_sort(F.collect_list(F.struct("at", "token", F.col("ratio").alias("score_ratio"), hit.alias("found"))))
        got = self.ratios(pairs).groupBy("id").agg(F.sum(F.least(F.lit(1.0), F.col("ratio") / self.found)).alias("s"), F.count("*").alias("n"), F.count_if(hit).alias("f"), each.alias("m"))
        rows = wanted(pairs).select("id", "eos").distinct().join(got, "id", "left")
        bonus = F.when(F.col("eos"), self.eos_bonus).otherwise(0.0)
        return rows.select(
            "id", F.coalesce(F.col("s") + bonus, F.lit(0.0)).alias("reward"), F.coalesce("n", F.lit(0)).alias("n_hard_tokens"), F.coalesce("f", F.lit(0)).alias("n_found"), F.round(F.coalesce(F.col("f") / F.col("n"), F.lit(0.0)), 4).alias("qc_pass_rate"),
            F.transform(F.coalesce("m", F.array().cast("array<struct<at:int,token:string,score_ratio:double,found:boolean>>")), lambda x: F.struct(x["token"].alias("token"), x["score_ratio"].alias("score_ratio"), x["found"].alias("found"))).alias("per_motif"),
        )
