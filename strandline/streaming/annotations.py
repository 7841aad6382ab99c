"""A stream of annotations through the quality filter, with repeats dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_annotations(stream: DataFrame, registry: DataFrame, min_identity: float = 95.0, min_match: float = 80.0, delay: str = "10 minutes") -> DataFrame:
    """Annotations (plasmid_id, sseqid, pident, percmatch, fragment, ts) that pass, with their token, each once."""
    good = stream.where((F.col("pident") >= min_identity) & (F.col("percmatch") >= min_match) & ~F.col("fragment"))
    return good.join(registry.select("sseqid", "token"), "sseqid").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["plasmid_id", "token"])


def token_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Annotations per token and window of event time."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "token").agg(F.count("*").alias("n"))
