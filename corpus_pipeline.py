"""The corpus pipeline: quality, line dedup, near duplicates, source mix and tokens, one stage after another.

run() writes what each stage keeps as Parquet beside the checkpoints and reads
it again for the next stage, so a lost executor costs one stage at most. The
folders are removed when the last stage's rows are checkpointed.

All stages but the last return the columns of documents, whatever others there
are besides doc_id, text, source and n_chars, and keep their values. Null texts
are empty ones to every stage and stay null; null ids and sources are values of
their own; repeated rows are rows of their own, but for their lines and shingles
they are one document. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import bpe, lines, mixing, ngram_join, quality
from strandline.llm.common import Table, checkpoint


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats."""
    return lines.strip_lines(docs)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group linked by shared 5-word shingles."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of the bytes decoded from them."""
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", keep_quality), ("lines", drop_lines), ("near_duplicates", keep_one_copy), ("mix", mix), ("tokens", tokenize)]

#: SQL can't express the stages; tests/llm compares each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents: one row per document taken, as often as it is taken."""
    docs, tables = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        tables.append(Table(stage(spark, docs, sf_dir)))
        docs = tables[-1].read()
    out = checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    for table in tables:
        table.drop()
    return out
