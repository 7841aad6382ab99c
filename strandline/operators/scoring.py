"""Scores over hits and rewards: composites, structural multipliers, separation, losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_quality(identity: Column, coverage: Column, norm: Column, cap: float = 1.5) -> Column:
    """0.4 identity + 0.35 coverage (both in percent) + 0.25 capped score per base."""
    return 0.4 * identity / 100 + 0.35 * coverage / 100 + 0.25 * F.least(norm / cap, F.lit(1.0))


def composite(quality: str, found: Column, expected: Column, sharpness: float = 2.0) -> tuple[Column, Column, Column]:
    """Aggregates over a plasmid's tokens: geometric mean, recall and composite."""
    geo = F.exp(F.avg(F.ln(F.greatest(F.col(quality), F.lit(1e-6)))))
    recall = found / F.greatest(expected, F.lit(1))
    return geo, recall, F.pow(geo, sharpness) * (0.5 + 0.5 * recall)


def structural_multiplier(n_ori: Column, n_amr: Column, n_extra: Column, length: Column, n_pairs: Column) -> Column:
    """1 + 0.05 a promoter pair - 0.15 an origin above 1 - 0.1 a marker above 2 - 0.05 an unrequested feature - 0.01 a kb above 8 kb (0.15 at most)."""
    over = lambda n, k: F.greatest(n - k, F.lit(0))
    return 1 + 0.05 * n_pairs - 0.15 * over(n_ori, 1) - 0.1 * over(n_amr, 2) - 0.05 * n_extra - F.least(0.01 * over(length, 8000) / 1000, F.lit(0.15))


def auroc(scored: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve by mid-ranks of distinct scores; ties count one half.

    Scores are counted first, so ranks are sums over distinct values only.
    """
    from strandline.operators.order import running_counts

    n = scored.groupBy(F.col(score).alias("v")).agg(F.sum(1 - F.col(positive).cast("long")).alias("w"), F.sum(F.col(positive).cast("long")).alias("p"))
    n = running_counts(n, [], "v", weight="w", extra=["p"])
    wins = F.sum(F.col("p") * (2 * (F.col("upto") - F.col("n")) + F.col("n")))
    return n.agg((wins / (2 * F.sum("p") * F.sum("n"))).alias("auroc"))


def clipped_surrogate(ratio: Column, advantage: Column, clip: float = 0.2) -> Column:
    return F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - clip)), F.lit(1 + clip)) * advantage)


def kl_estimate(reference: Column, current: Column) -> Column:
    """exp(d) - d - 1 with d = reference - current."""
    return F.exp(reference - current) - (reference - current) - 1


def step_advantage(reward: Column, baseline: Column, deviation: Column, least: float = 0.1) -> Column:
    """A reward less the baseline of its step, over the step's deviation (least at least)."""
    return (reward - baseline) / F.greatest(deviation, F.lit(least))


def pair_loss(chosen: Column, rejected: Column, beta: float = 0.1) -> Column:
    """-log sigmoid of beta times the margin."""
    return F.ln(1 + F.exp(-beta * (chosen - rejected)))


def masked_terms(current: str, old: str, reference: str, advantage: str, mask: str, clip: float = 0.2) -> list[Column]:
    """Aggregates over a sequence's tokens: n (masked tokens, 1 at least), lp, surr, kl and ref (sums over the mask; ref is the reference's lp)."""
    m, cur, ref = F.col(mask), F.col(current), F.col(reference)
    surrogate = clipped_surrogate(F.exp(cur - F.col(old)), F.col(advantage), clip)
    return [F.greatest(F.sum(m), F.lit(1)).alias("n"), F.sum(m * cur).alias("lp"), F.sum(m * surrogate).alias("surr"), F.sum(m * kl_estimate(ref, cur)).alias("kl"), F.sum(m * ref).alias("ref")]


#: Losses over sequences with adv, n, lp, surr and kl, by name.
LOSSES: dict[str, Callable[..., Column]] = {}


def register_loss(name: str) -> Callable:
    """Enter a loss into LOSSES."""

    def enter(f: Callable[..., Column]) -> Callable[..., Column]:
        LOSSES[name] = f
        return f

    return enter


@register_loss("reinforce")
def reinforce_loss() -> Column:
    return -F.avg(F.col("adv") * F.col("lp") / F.col("n"))


@register_loss("ppo")
def ppo_loss(entropy: float = 0.01) -> Column:
    return F.avg(-F.col("surr") / F.col("n") - entropy * (-F.col("lp") / F.col("n")))


@register_loss("grpo")
def grpo_loss(kl: float = 0.1) -> Column:
    return F.avg(-F.col("surr") / F.col("n") + kl * F.col("kl") / F.col("n"))


def loss(name: str, **options: float) -> Column:
    """A loss by name; KeyError with the known names for another."""
    if name not in LOSSES:
        raise KeyError(f"no loss {name!r}; there are {', '.join(LOSSES)}")
    return LOSSES[name](**options)


def top_k(p: Column, k: int) -> Column:
    """The k largest of an array as structs i (place), w (share of their sum), largest first; ties by place."""
    best = F.slice(F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, k)
    bound = F.array(F.struct(best.alias("b"), F.aggregate(best, F.lit(0.0), lambda a, x: a - x["v"]).alias("s")))
    return F.transform(bound, lambda t: F.transform(t["b"], lambda x: F.struct(x["i"].alias("i"), (-x["v"] / t["s"]).alias("w"))))[0]


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours) of each group, a column each.

    Values are counted first and the counts summed within ranges of values, so
    no task or group holds all values; a group's quantile takes the two values
    whose ranks are next to it.
    """
    from strandline.operators.order import running_counts

    keys = keys or []
    counted = running_counts(df.where(F.col(value).isNotNull()), keys, value)  # value, n, upto (rows up to and with it), total
    out = []
    for name, q in wanted.items():
        rank = F.lit(float(q)) * (F.col("total") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        at = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col(value)))  # noqa: E731, B023
        out.append((at(low) + (at(high) - at(low)) * F.max(rank - low)).alias(name))
    return counted.groupBy(*keys).agg(*out)


def moving_baseline(steps: DataFrame, keys: list[str], order: list[str], mean: str, decay: float = 0.95, rows: int | None = None) -> DataFrame:
    """steps with baseline: b = decay b + (1 - decay) mean over each group's steps in order up to and with each, the first being its mean.

    A step is an affine map of the baseline before it, so steps are scanned in
    ranges; no task holds a group. mean has no nulls.
    """
    from strandline.operators.scan import affine_scan

    terms = steps.withColumn("__scale", F.lit(float(decay))).withColumn("__add", (1 - decay) * F.col(mean)).withColumn("__start", F.col(mean).cast("double"))
    return affine_scan(terms, keys, order, "__scale", "__add", "baseline", "__start", rows).drop("__scale", "__add", "__start")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    # the sum is bound once, not per element
    bound = F.array(F.struct(powers.alias("p"), F.aggregate(powers, F.lit(0.0), lambda a, x: a + x).alias("s")))
    return F.transform(bound, lambda b: F.transform(b["p"], lambda p: p / b["s"]))[0]


def label_loss(logits: Column, label: Column) -> tuple[Column, Column]:
    """The place of the largest logit (the first of equals) and the cross-entropy of the label, a place from 0."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.array_position(logits, top) - 1, F.ln(total) + top - F.get(logits, label)


def perplexity(loss: Column, most: float = 20.0) -> Column:
    """exp of a mean loss, which counts as most at most."""
    return F.exp(F.least(loss, F.lit(most)))


def warm_cosine(step: Column, warm: int, total: int, peak: float) -> Column:
    """Linear warm-up, then a cosine to 0."""
    return F.when(step < warm, peak * step / warm).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least((step - warm) / F.lit(float(total - warm)), F.lit(1.0)))))
