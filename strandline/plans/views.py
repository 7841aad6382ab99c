"""Domain tables as deterministic views over the star-schema tables, for Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import dna, tokens

# Category of each part type, and vector type of each market segment.
TYPE_CATEGORY = (("ECONOMY", "AMR"), ("STANDARD", "ORI"), ("SMALL", "PROM"), ("MEDIUM", "ELEM"), ("LARGE", "REPORTER"), ("PROMO", "TAG"))
SEGMENT_VECTORS = (("BUILDING", "Mammalian Expression"), ("AUTOMOBILE", "Bacterial Expression"), ("MACHINERY", "CRISPR; Lentiviral"), ("HOUSEHOLD", "Yeast Expression"), ("FURNITURE", "Plant Expression"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The file and place of a row: what SQL that leaves a tie open takes first.
ROW_PLACE = ("row_file", "row_index")


def placed_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with ROW_PLACE."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("row_file"), F.col("_metadata.row_index").alias("row_index"))


def annotations(spark: SparkSession, d: str, placed: bool = False) -> DataFrame:
    """Annotations; placed: with ROW_PLACE."""
    li = placed_table(spark, d, "lineitem") if placed else table(spark, d, "lineitem")
    start = (F.col("l_linenumber") * 100).alias("qstart")
    return li.select(
        F.col("l_orderkey").alias("plasmid_id"), F.col("l_partkey").alias("sseqid"), F.col("l_linenumber").alias("ln"),
        (F.lit(90.0) + F.round(F.col("l_discount") * 100)).alias("pident"), (F.col("l_quantity") * 2).alias("percmatch"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_returnflag") == "R").alias("fragment"), start, (F.col("l_linenumber") * 100 + F.col("l_quantity").cast("int") * 10).alias("qend"),
        *(ROW_PLACE if placed else ()),
    )


def registry(spark: SparkSession, d: str) -> DataFrame:
    category = F.lit("AMR")
    for name, value in TYPE_CATEGORY:
        category = F.when(F.col("p_type") == name, value).otherwise(category)
    part = table(spark, d, "part").select(F.col("p_partkey").alias("sseqid"), F.col("p_name").alias("feature"), category.alias("category"), "p_brand", "p_size")
    return part.select("sseqid", "feature", "category", F.concat(F.lit("<"), "category", F.lit("_"), F.translate(F.upper("p_brand"), "#", ""), F.lit(">")).alias("token"), F.col("p_size").alias("seq_len"))


def sequences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("plasmid_id"), dna.clean_dna(F.col("text")).alias("sequence"))


def motifs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("sseqid"), dna.clean_dna(F.col("text")).alias("motif"))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    vectors = F.lit("Other")
    for name, value in SEGMENT_VECTORS:
        vectors = F.when(F.col("c_mktsegment") == name, value).otherwise(vectors)
    cloning = F.concat(F.lit('{"vector_types":["'), vectors, F.lit('"],"backbone":"pBB '), (F.col("c_nationkey")).cast("string"), F.lit('.v/1"}'))
    inserts = F.concat(F.lit('[{"species":[["'), F.col("c_nationkey").cast("string"), F.lit('","Species '), (F.col("c_nationkey") % 5).cast("string"), F.lit('"],["9"]]}]'))
    return joined.select(F.col("o_orderkey").alias("id"), cloning.alias("cloning"), F.when(F.col("o_orderkey") % 50 == 0, "broken{").otherwise(inserts).alias("inserts"), F.col("o_orderpriority").alias("plasmid_copy"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    lo = F.floor(F.col("value") * 10).cast("int")
    return ev.select("event_id", "user_id", "event_type", "value", lo.alias("lo"), (lo + F.get_json_object("props", "$.k").cast("int") + 1).alias("hi"))


def plasmid_tokens(spark: SparkSession, d: str) -> DataFrame:
    """plasmid_id, tokens: the canonical token list of every plasmid, from its best annotations."""
    ann = annotations(spark, d).where((F.col("pident") >= 92) & (F.col("percmatch") >= 20) & ~F.coalesce("fragment", F.lit(False)))
    pairs = ann.join(registry(spark, d).select("sseqid", "token"), "sseqid").select("plasmid_id", "token")
    return pairs.groupBy("plasmid_id").agg(tokens.canonical(F.collect_set("token")).alias("tokens"))


def _case(column: str, pairs: tuple[tuple[str, str], ...], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE '{default}' END"


RANK_SQL = "CASE split_part(translate(t, '<>', ''), '_', 1) " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(tokens.CATEGORY_ORDER, 1)) + " ELSE 99 END"
#: WITH clauses of the views.
VIEWS_SQL = f"""
ann AS (SELECT l_orderkey AS plasmid_id, l_partkey AS sseqid, l_linenumber AS ln, 90.0::DOUBLE + round(l_discount * 100) AS pident, l_quantity * 2 AS percmatch,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag = 'R' END AS fragment, l_linenumber * 100 AS qstart, l_linenumber * 100 + l_quantity::INT * 10 AS qend FROM lineitem),
reg AS (SELECT p_partkey AS sseqid, p_name AS feature, {_case('p_type', TYPE_CATEGORY, 'AMR')} AS category, '<' || category || '_' || replace(upper(p_brand), '#', '') || '>' AS token, p_size AS seq_len FROM part),
seqs AS (SELECT doc_id AS plasmid_id, regexp_replace(regexp_replace(upper(text), '<[^>]+>', '', 'g'), '[^ATGCN]', '', 'g') AS sequence FROM documents),
mot AS (SELECT item_id AS sseqid, regexp_replace(regexp_replace(upper(text), '<[^>]+>', '', 'g'), '[^ATGCN]', '', 'g') AS motif FROM benchmark),
meta AS (SELECT o_orderkey AS id, '{{"vector_types":["' || {_case('c_mktsegment', SEGMENT_VECTORS, 'Other')} || '"],"backbone":"pBB ' || c_nationkey || '.v/1"}}' AS cloning,
        CASE WHEN o_orderkey % 50 = 0 THEN 'broken{{' ELSE '[{{"species":[["' || c_nationkey || '","Species ' || (c_nationkey % 5) || '"],["9"]]}}]' END AS inserts, o_orderpriority AS plasmid_copy
        FROM orders JOIN customer ON o_custkey = c_custkey),
hit AS (SELECT event_id, user_id, event_type, value, floor(value * 10)::INT AS lo, floor(value * 10)::INT + (json_extract_string(props, '$.k'))::INT + 1 AS hi FROM events),
ptok AS (SELECT plasmid_id, list_transform(list_sort(list_distinct(list({{'o': {RANK_SQL}, 't': t}}))), lambda x: x.t) AS tokens
        FROM (SELECT plasmid_id, token AS t FROM ann JOIN reg USING (sseqid) WHERE pident >= 92 AND percmatch >= 20 AND NOT coalesce(fragment, false)) GROUP BY 1)
"""


def with_views(sql: str) -> str:
    return f"WITH {VIEWS_SQL} {sql}" if not sql.lstrip().startswith(",") else f"WITH {VIEWS_SQL}{sql}"
