"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration.

Each labelled text becomes a vector of statistics (never its label, language,
source or id). cos(Wx + b) approximates a Gaussian kernel; partitions sum
Z'Z and Z'y, Spark adds the sums up, and the driver solves one small system.
Scores of rows held back from the ridge fit are counted in bins and made
monotone by pooling adjacent violators, which turns scores into probabilities.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: The fit uses at most about so many labelled rows, chosen by a hash of doc_id; statistics and scores cover all rows.
MAX_LABELLED = 60_000
#: A document is kept from this score on.
ACCEPT = 0.3
_UPPER, _LETTER, _DIGIT, _MARK = regex.compile(r"\p{Lu}"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"), regex.compile(r"[^\p{L}\p{N}\s]")
N_STATISTICS = 24


def statistics(text: str | None) -> np.ndarray:
    """Shape statistics of one whole text; an empty or null text gives zeros."""
    out = np.zeros(N_STATISTICS)
    if not text:
        return out
    raw = text.encode()
    words, n = text.split(), len(text)
    if not words:
        out[0] = np.log1p(n)
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    ascii_upper, ascii_lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    wide = len(raw) - counts[:128].sum()
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    ends, caps, shout, plain, common = Counter(w[-1] for w in words), 0, 0, 0, Counter(words)
    for w in common:
        k = common[w]
        caps += k * (w[0].isupper() and not w.isupper())
        shout += k * (len(w) > 1 and w.isupper())
        plain += k * w.isalpha()
    lengths = np.fromiter((len(w) for w in words), float, len(words))
    lines = [x for x in text.split("\n") if x]
    sentences = max(1, sum(ends[c] for c in ".!?"))
    m = len(words)
    out[:] = (
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), len(common) / m, max(common.values()) / m,
        ascii_upper / len(raw), ascii_lower / len(raw), digits / len(raw), wide / len(raw), marks / len(raw),
        counts[[33, 63]].sum() / m, counts[[35, 36, 37, 38, 42]].sum() / m, counts[[124, 47, 92, 95, 61, 60, 62]].sum() / m, counts[[44, 46]].sum() / m,
        caps / m, shout / m, plain / m, sum(k for c, k in ends.items() if not c.isalnum()) / m,
        min(m / sentences, 200) / 20, len(set(lines)) / max(1, len(lines)), np.log1p(m / max(1, len(lines))),
        len(zlib.compress(raw, 1)) / len(raw), (counts[123:127].sum() + counts[91:94].sum()) / m,
    )
    return out


@dataclass
class QualityModel:
    """Standardisation, random features, ridge weights and the calibration steps; a few hundred KB at most."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(x @ self.w + self.b) * np.sqrt(2 / self.w.shape[1]), x / 6, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.knots, self.values) if len(x) else np.zeros(0)


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text modulo 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def isotonic(at: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order; one knot per pool, at the mean of its scores."""
    pools: list[list[float]] = []
    for x, g, n in zip(at, good, total, strict=True):
        pools.append([x * n, g, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.5 * 0.02) / (p[2] + 0.02) for p in pools])


def fit_quality(docs: DataFrame, labels: DataFrame, n_features: int = 256, gamma: float = 0.06, ridge: float = 1e-3, seed: int = 5, max_labelled: int = MAX_LABELLED) -> QualityModel:
    """Learn from the labelled rows whose fold isn't 0; fold 4 calibrates and the others fit.

    Null labels are left out; a doc_id labelled twice counts once, with its
    smaller label. Without labelled rows every score is 0.5. Ids of the sample
    are broadcast: max_labelled of them at most.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    usable = usable.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    n = usable.count()
    if n > max_labelled:  # the smallest hashes; a margin of a tenth keeps the broadcast bounded
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * 0.9 * max_labelled / n))
    usable = F.broadcast(usable)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(v.as_py()) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["y", "fold", "x"])

    sample = docs.select("doc_id", "text").join(usable, "doc_id").select("text", "y", "fold").mapInArrow(measure, "y int, fold long, x array<double>")
    sample = checkpoint(sample)
    stats = sample.where("fold <> 4").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    draw = np.random.default_rng(seed)
    if not stats:
        zero = np.zeros(N_STATISTICS)
        model = QualityModel(zero, zero + 1, np.zeros((N_STATISTICS, 1)), np.zeros(1), np.zeros(N_STATISTICS + 2), np.array([0.0]), np.array([0.5]))
        return model
    mean, scale = np.array([r["m"] for r in stats]), np.array([max(r["s"], 1e-6) for r in stats])
    w, b = draw.normal(size=(N_STATISTICS, n_features)) * np.sqrt(2 * gamma), draw.uniform(0, 2 * np.pi, n_features)
    model = QualityModel(mean, scale, w, b, np.zeros(n_features + N_STATISTICS + 1), np.array([0.0]), np.array([0.5]))
    width = len(model.beta)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = model.features(np.array(batch.column(1).to_pylist()).reshape(-1, N_STATISTICS))
            total[:, :width] += z.T @ z
            total[:, width] += z.T @ batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([np.sum(rows["v"].to_pylist(), axis=0)], pa.list_(pa.float64()))})

    parts = sample.where("fold <> 4").select("y", "x").coalesce(16).mapInArrow(sums, "i int, v array<double>")
    system = parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect()  # width rows
    system = np.array([r["v"] for r in sorted(system, key=lambda r: r["i"])])
    rows = max(1.0, system[-1, width - 1])
    model.beta = np.linalg.solve(system[:, :width] + ridge * rows / width * np.eye(width), system[:, width])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.clip(np.floor(model.raw(np.array(batch.column(1).to_pylist()).reshape(-1, N_STATISTICS)) * 500), -500, 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(0)], ["s", "y"])

    bins = sample.where("fold = 4").select("y", "x").mapInArrow(binned, "s long, y int").groupBy("s").agg(F.sum("y").alias("good"), F.count("*").alias("n")).orderBy("s").collect()  # 1501 bins at most
    if bins:
        model.knots, model.values = isotonic(np.array([(r["s"] + 0.5) / 500 for r in bins]), np.array([float(r["good"]) for r in bins]), np.array([float(r["n"]) for r in bins]))
    return model


def quality_score(model: QualityModel):
    """A column function: the score of a text, from 0 to 1. Null and empty texts have statistics of zero and a score like any other; whole texts count, however long."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts]).reshape(-1, N_STATISTICS)))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose score is accept or more; all columns stay, whatever their names.

    Equal texts have equal scores, so repeated rows stay or go together, and ids
    play no part. Without labelled rows every score is 0.5; an empty table gives
    no rows.
    """
    return docs.where(quality_score(fit_quality(docs, labels.select("doc_id", "quality")))(F.col("text")) >= accept)
