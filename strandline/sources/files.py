"""File sources and sinks: FASTA, search hits, vocabularies, tolerant Parquet columns, fan-out tables."""

from __future__ import annotations

import hashlib
import html
import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import dna, tokens

# The columns of tabular search output.
HIT_COLUMNS = "qseqid string, sseqid string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double, nident int, slen int"

# The names that annotators give the sample's column, in the order in which they are tried.
SAMPLE_COLUMNS = ("sample_id", "qseqid", "plasmid_id", "Plasmid")


def first_column(df: DataFrame, *names: str) -> Column:
    """The first of the names that df has; ValueError if it has none."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {', '.join(names)} in {', '.join(df.columns)}")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Training pairs as prompt and sequence, from whichever columns the file has; full_text is cut at its separator."""
    df = spark.read.parquet(path)
    if {"token_prompt", "prompt"} & set(df.columns):
        return df.select(first_column(df, "token_prompt", "prompt").alias("prompt"), first_column(df, "token_completion", "sequence").alias("sequence"))
    parts = F.split(F.regexp_replace("full_text", "<EOS>$", ""), tokens.SEPARATORS, 2)
    return df.select(F.concat(parts[0], F.lit(tokens.SEQ)).alias("prompt"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("sequence"))


def read_fasta(spark: SparkSession, path: str, pipe_field: int | None = None) -> DataFrame:
    """id (first word of the header, or a field of it between pipes) and sequence, its lines put together."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("r")).where(F.trim("r") != "")
    lines = F.split("r", "\r?\n")
    head = F.split(lines[0], r"\s+")[0]
    head = head if pipe_field is None else F.coalesce(F.get(F.split(head, r"\|"), F.lit(pipe_field - 1)), head)
    body = F.array_join(F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), F.trim), "")
    return records.select(head.alias("id"), body.alias("sequence"))


def write_fasta(df: DataFrame, path: str, key: str = "id", seq: str = "sequence") -> None:
    """FASTA text; ids are made safe and repeated ones get __dupN."""
    clean = dna.fasta_id(F.col(key))
    n = F.row_number().over(Window.partitionBy(clean).orderBy(key, seq)) - 1
    name = F.when(n > 0, F.concat(clean, F.lit("__dup"), n.cast("string"))).otherwise(clean)
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), F.col(seq))).write.text(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Tabular search hits; comments, blank and short lines are skipped."""
    return spark.read.csv(path, sep="\t", comment="#", schema=HIT_COLUMNS, mode="DROPMALFORMED").where(F.col("slen").isNotNull())


def best_hits(hits: DataFrame) -> DataFrame:
    """Best hit by bit score per query and subject, with coverage and score per base."""
    cover = F.least(F.lit(100.0) * F.col("length") / F.col("slen"), F.lit(100.0))
    key = F.struct("bitscore", (-F.col("qstart")).alias("at"))
    best = hits.groupBy("qseqid", "sseqid").agg(F.max_by(F.struct(F.least("pident", F.lit(100.0)).alias("pident"), cover.alias("coverage"), (F.col("bitscore") / F.col("slen")).alias("norm"), "bitscore"), key).alias("x"))
    return best.select("qseqid", "sseqid", "x.*")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token and id from a JSON object, also one nested under token_to_id."""
    raw = spark.read.text(path, wholetext=True)
    body = F.coalesce(F.get_json_object("value", "$.token_to_id"), F.col("value"))
    return raw.select(F.explode(F.from_json(body, "map<string,int>")).alias("token", "id"))


def write_vocabulary(df: DataFrame, path: str) -> None:
    """One JSON object of token and id; a vocabulary is small."""
    pairs = F.array_sort(F.collect_list(F.struct("id", "token")))
    df.agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["token"].alias("key"), x["id"].alias("value")))))).write.text(path)


def write_fan_out(df: DataFrame, path: str) -> None:
    """Rows with splits and sequence_length as one table partitioned by split and bucket: readers prune what they don't need."""
    df.withColumn("split", F.explode("splits")).withColumn("bucket", tokens.bucket_ordinal(tokens.length_bucket(F.col("sequence_length")))).write.partitionBy("split", "bucket").mode("overwrite").parquet(path)


def read_fan_out(spark: SparkSession, path: str, split: str, up_to: str) -> DataFrame:
    """The rows of one split in all buckets up to a label."""
    return spark.read.parquet(path).where((F.col("split") == split) & (F.col("bucket") <= tokens.bucket_ordinal(F.lit(up_to))))


def has_hard_tokens(df: DataFrame) -> Column:
    """Whether a prompt has hard tokens: by has_hard_tokens, else by non-empty reward_motifs; true where df has neither."""
    if "has_hard_tokens" in df.columns:
        return F.coalesce("has_hard_tokens", F.lit(False))
    if "reward_motifs" in df.columns:
        return F.coalesce(F.size("reward_motifs") > 0, F.lit(False))
    return F.lit(True)


def good_annotations(df: DataFrame, min_percmatch: float = 95.0) -> DataFrame:
    """Annotations of percmatch or more that are no fragments; a null passes, and so does every row where df lacks the column."""
    if "percmatch" in df.columns:
        df = df.where(F.col("percmatch").isNull() | (F.col("percmatch") >= min_percmatch))
    return df.where(~F.coalesce(F.col("fragment"), F.lit(False))) if "fragment" in df.columns else df


def sample_column(df: DataFrame) -> str:
    """The column that names the sample of an annotator's table; ValueError if there is none."""
    return next((c for c in SAMPLE_COLUMNS if c in df.columns), None) or _no_column(SAMPLE_COLUMNS, df)


def _no_column(names: tuple[str, ...], df: DataFrame) -> str:
    raise ValueError(f"none of {', '.join(names)} in {', '.join(df.columns)}")


def display_columns(df: DataFrame, *wanted: str) -> DataFrame:
    """df with those of the wanted columns that it has, in the order wanted."""
    return df.select(*[c for c in wanted if c in df.columns])


def read_feature_metadata(spark: SparkSession, path: str, source: str, header: bool = True, kind: str | None = None, unescape: bool = False) -> DataFrame:
    """sseqid, Feature, Description, Type and db_source of one CSV, gzipped or not.

    Without a header its columns are the first three. kind fills in Type, and
    unescape decodes character references.
    """
    names = ("sseqid", "Feature", "Description")
    if header:
        df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    else:
        df = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names), quote='"', escape='"')
    text = unescaped if unescape else (lambda c: c)
    kind_ = F.lit(kind) if kind else F.col("Type") if "Type" in df.columns else F.lit(None).cast("string")
    return df.select(*[text(F.col(n)).alias(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names], kind_.alias("Type"), F.lit(source).alias("db_source"))


def unescaped(text: Column) -> Column:
    """Text with all character references decoded."""
    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return plain(text)


def read_token_list(spark: SparkSession, path: str) -> DataFrame:
    """token: one a line, trimmed; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("token")).where("token <> ''")


def write_token_list(df: DataFrame, path: str, table: str | None = None) -> None:
    """Distinct tokens in order, as text lines (a vocabulary is small) and, where named, as a table."""
    listed = df.select("token").where("token is not null").distinct().orderBy("token")
    listed.coalesce(1).write.mode("overwrite").text(path)
    if table:
        write_table(listed, table)


def write_table(df: DataFrame, name: str) -> None:
    """df as a table, in place of whatever schema and rows it had."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)


def merge_table(df: DataFrame, name: str, by: list[str]) -> None:
    """df's partitions (of the columns by) in place of the table's own, all others as they are; the table is made if there is none.

    Columns that the table lacks are added, null in its other rows, and columns
    that df lacks are null in its rows. A column of another type is an error before
    anything is written; a write that fails leaves every partition as it was, as
    files are moved in place when all tasks are done.
    """
    spark = df.sparkSession
    if not spark.catalog.tableExists(name):
        df.write.partitionBy(*by).format("parquet").saveAsTable(name)
        return
    have = {f.name: f.dataType for f in spark.table(name).schema}
    if wrong := [f.name for f in df.schema if f.name in have and f.dataType != have[f.name]]:
        raise ValueError(f"{', '.join(wrong)}: other types than in {name}")
    if new := [f for f in df.schema if f.name not in have]:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in new)})")
    fields = spark.table(name).schema
    rows = df.select(*[F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    mode, key = spark.conf.get("spark.sql.sources.partitionOverwriteMode"), "spark.sql.sources.partitionOverwriteMode"
    spark.conf.set(key, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(name)
    finally:
        spark.conf.set(key, mode)


def write_registry(df: DataFrame, json_path: str, parquet_path: str) -> None:
    """A registry of token, sseqid and other columns as one JSON object a token with its sequences nested, and as flat Parquet."""
    inner = F.array_sort(F.collect_list(F.struct("sseqid", *[c for c in df.columns if c not in ("token", "sseqid")])))
    df.groupBy("token").agg(inner.alias("sequences")).select(F.to_json(F.struct("token", "sequences"))).write.mode("overwrite").text(json_path)
    df.write.mode("overwrite").parquet(parquet_path)


def write_lookups(df: DataFrame, path: str, length: str = "length") -> None:
    """All variants of each token, and the longest alone (the smaller id of equals), as JSON lines in the folders full and longest."""
    every = F.array_sort(F.collect_list(F.struct("sseqid", length)))
    longest = F.max_by(F.struct("sseqid", length), F.struct(length, (-F.col("sseqid")).alias("i")))
    for name, value in (("full", every), ("longest", longest)):
        df.groupBy("token").agg(value.alias("variants")).select(F.to_json(F.struct("token", "variants"))).write.mode("overwrite").text(f"{path}/{name}")


def cached_result(prompts: DataFrame, path: str, parameters: dict[str, object], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(prompts), written once under a key of the parameters and the prompts and read from there afterwards.

    The key joins the SHA-1 of each prompt with its count by sums, so it
    depends on the prompts, not on their order, and nothing is collected.
    """
    spark = prompts.sparkSession
    part = lambda i: F.sum(F.conv(F.substring(F.sha1(F.col("prompt").cast("binary")), 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
    sums = prompts.agg(F.count("*").alias("n"), *[part(i).alias(f"s{i}") for i in range(5)]).first()  # one row
    key = hashlib.sha1(json.dumps([sorted((k, repr(v)) for k, v in parameters.items()), [str(x) for x in sums]]).encode()).hexdigest()
    target = f"{path}/{key}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        make(prompts).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def report_tables(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of results (model, prompt, category, requested, found): a summary a model, and one a model and category with a TOTAL."""
    each = results.groupBy("model", "prompt").agg(F.sum("requested").alias("requested"), F.sum("found").alias("found"))
    rate = F.col("found") / F.greatest("requested", F.lit(1))
    summary = each.groupBy("model").agg(F.count("*").alias("prompts"), F.avg(rate).alias("macro"), (F.sum("found") / F.sum("requested")).alias("micro"), F.count_if(F.col("found") >= F.col("requested")).alias("perfect"))
    category = results.rollup("model", "category").agg(F.sum("requested").alias("requested"), F.sum("found").alias("found")).where("model is not null").withColumn("category", F.coalesce("category", F.lit("TOTAL")))
    return summary, category


def report_lines(results: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """section, at, model, name and line of a Markdown report: of models, categories, every prompt, and probes (model, token, hit) where given."""
    summary, category = report_tables(results)
    each = results.groupBy("model", "prompt").agg(F.sum("requested").alias("requested"), F.sum("found").alias("found"))
    tables = [("Models", summary, None), ("Categories", category, "category"), ("Prompts", each.withColumn("share", F.col("found") / F.greatest("requested", F.lit(1))), "prompt")]
    if probes is not None:
        tables.append(("Probes", probes.select("model", "token", F.col("hit").cast("string").alias("hit")), "token"))
    out = []
    for i, (title, df, name) in enumerate(tables):
        cells = [F.coalesce(F.format_string("%.4f", c) if kind == "double" else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c, kind in df.dtypes]
        line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
        head = [f"## {title}", "", f"| {' | '.join(df.columns)} |", f"|{'-|' * len(df.columns)}"]
        head = results.sparkSession.createDataFrame([(i, 0, "", f"{k}", x) for k, x in enumerate(head)] + [(i, 2, "", "", "")], "section int, at int, model string, name string, line string")
        out += [head, df.select(F.lit(i).alias("section"), F.lit(1).alias("at"), F.col("model").cast("string").alias("model"), (F.col(name) if name else F.lit("")).cast("string").alias("name"), line.alias("line"))]
    return reduce(DataFrame.unionByName, out)


def write_report(results: DataFrame, path: str, probes: DataFrame | None = None) -> None:
    """report_lines as text files whose order is the report's; sections of a row a prompt stay distributed."""
    report_lines(results, probes).orderBy("section", "at", "model", "name").select("line").write.mode("overwrite").text(path)
