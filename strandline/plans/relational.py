"""Queries of the relational pipeline: scans, filters, joins, aggregates, windows, sets and sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import dna, tokens
from strandline.operators.homology import resolve_subjects
from strandline.sources.files import good_annotations

from .views import annotations, hits, metadata, plasmid_tokens, registry, sequences, table, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return register


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def scan_table_counts(spark, d):
    one = [table(spark, d, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


@query("SELECT l_orderkey, l_partkey, l_quantity * 2 AS percmatch FROM lineitem WHERE l_quantity >= 45")
def scan_pruned_columns(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 45").select("l_orderkey", "l_partkey", (F.col("l_quantity") * 2).alias("percmatch"))


@query("SELECT doc_id AS id, text AS prompt FROM documents")
def scan_tolerant_columns(spark, d):
    from strandline.sources.files import first_column

    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), first_column(docs, "token_prompt", "prompt", "full_text", "text").alias("prompt"))


@query("SELECT DISTINCT token AS token_str, category, true AS is_hard FROM reg UNION ALL VALUES ('<BOS>','STRUCT',false),('<EOS>','STRUCT',false),('<SEQ>','STRUCT',false),('<PAD>','STRUCT',false),('<UNK>','STRUCT',false)")
def src_inline_registry(spark, d):
    fixed = spark.createDataFrame([(f"<{x}>", "STRUCT", False) for x in ("BOS", "EOS", "SEQ", "PAD", "UNK")], "token_str string, category string, is_hard boolean")
    return registry(spark, d).select(F.col("token").alias("token_str"), "category", F.lit(True).alias("is_hard")).distinct().unionByName(fixed)


@query("SELECT plasmid_id, sseqid, ln FROM ann WHERE pident >= 95 AND percmatch >= 80 AND NOT fragment")
def filter_annotation_qc_builder(spark, d):
    return annotations(spark, d).where((F.col("pident") >= 95) & (F.col("percmatch") >= 80) & ~F.col("fragment")).select("plasmid_id", "sseqid", "ln")


@query("SELECT plasmid_id, sseqid, ln FROM ann WHERE percmatch >= 95 AND NOT coalesce(fragment, false)")
def filter_annotation_qc_registry(spark, d):
    return annotations(spark, d).where((F.col("percmatch") >= 95) & ~F.coalesce("fragment", F.lit(False))).select("plasmid_id", "sseqid", "ln")


@query("SELECT 'both' AS columns, plasmid_id, sseqid, ln FROM (SELECT *, CASE WHEN sseqid % 10 = 0 THEN NULL ELSE percmatch END AS pm FROM ann) WHERE (pm IS NULL OR pm >= 95) AND NOT coalesce(fragment, false) UNION ALL SELECT 'no fragment', plasmid_id, sseqid, ln FROM (SELECT *, CASE WHEN sseqid % 10 = 0 THEN NULL ELSE percmatch END AS pm FROM ann) WHERE pm IS NULL OR pm >= 95 UNION ALL SELECT 'no percmatch', plasmid_id, sseqid, ln FROM ann WHERE NOT coalesce(fragment, false)")
def filter_annotation_qc_eval(spark, d):
    """Annotations that pass: each check only where its column is there, and nulls pass. Once with both columns, once without either."""
    a = annotations(spark, d).withColumn("percmatch", F.when(F.col("sseqid") % 10 == 0, None).otherwise(F.col("percmatch")))
    views = (("both", a), ("no fragment", a.drop("fragment")), ("no percmatch", a.drop("percmatch")))
    kept = [good_annotations(df).select(F.lit(name).alias("columns"), "plasmid_id", "sseqid", "ln") for name, df in views]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


@query("SELECT p AS min_pident, m AS min_percmatch, count(*) FILTER (WHERE pident >= p AND percmatch >= m) AS n FROM ann, (VALUES (90), (95), (99)) a(p), (VALUES (50), (80), (95)) b(m) GROUP BY 1, 2")
def filter_threshold_grid(spark, d):
    grid = [(p, m) for p in (90, 95, 99) for m in (50, 80, 95)]
    counts = annotations(spark, d).agg(*[F.count_if((F.col("pident") >= p) & (F.col("percmatch") >= m)).alias(f"c{i}") for i, (p, m) in enumerate(grid)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(p).alias("min_pident"), F.lit(m).alias("min_percmatch"), F.col(f"c{i}").alias("n")) for i, (p, m) in enumerate(grid)])))


@query("SELECT plasmid_id, length(sequence) AS n, n_hard FROM seqs JOIN (SELECT plasmid_id, len(tokens) AS n_hard FROM ptok) USING (plasmid_id) WHERE length(sequence) BETWEEN 200 AND 1500 AND n_hard >= 2")
def filter_length_and_tokens(spark, d):
    """Sequences of 200 to 1500 bases whose prompt has two hard tokens or more."""
    s = sequences(spark, d).select("plasmid_id", F.length("sequence").cast("long").alias("n")).where("n between 200 and 1500")
    p = plasmid_tokens(spark, d).select("plasmid_id", F.size(tokens.hard_tokens(F.col("tokens"))).cast("long").alias("n_hard"))
    return s.join(p, "plasmid_id").where("n_hard >= 2")


@query("SELECT plasmid_id, sseqid, ln, round(least(85 + 15 * exp(-(qend - qstart) / 100.0::DOUBLE), 99), 6) AS limit_pct FROM ann WHERE pident >= least(85 + 15 * exp(-(qend - qstart) / 100.0::DOUBLE), 99)")
def filter_adaptive_identity(spark, d):
    limit = F.least(F.lit(85) + 15 * F.exp(-(F.col("qend") - F.col("qstart")) / F.lit(100.0)), F.lit(99.0))
    return annotations(spark, d).where(F.col("pident") >= limit).select("plasmid_id", "sseqid", "ln", F.round(limit, 6).alias("limit_pct"))


_BUCKET = "CASE WHEN n <= 4096 THEN 'leq_4k' WHEN n <= 8192 THEN 'leq_8k' WHEN n <= 16384 THEN 'leq_16k' WHEN n <= 32768 THEN 'leq_32k' ELSE 'gt_32k' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n_docs, min(n) AS low, max(n) AS high FROM (SELECT length(text) AS n FROM documents) GROUP BY 1")
def bucket_length(spark, d):
    n = table(spark, d, "documents").select(F.length("text").cast("long").alias("n"))
    return n.groupBy(tokens.length_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("n_docs"), F.min("n").alias("low"), F.max("n").alias("high"))


@query(f", b AS (SELECT n, {_BUCKET} AS bucket FROM (SELECT length(text) AS n FROM documents)), o AS (SELECT CASE bucket WHEN 'leq_4k' THEN 0 WHEN 'leq_8k' THEN 1 WHEN 'leq_16k' THEN 2 WHEN 'leq_32k' THEN 3 ELSE 4 END AS k FROM b) SELECT t AS target, count(*) AS n FROM o, (VALUES (0, 'leq_4k'), (1, 'leq_8k'), (2, 'leq_16k')) v(i, t) WHERE k <= i GROUP BY 1")
def bucket_rollup_numeric(spark, d):
    k = tokens.bucket_ordinal(tokens.length_bucket(F.length("text")))
    targets = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("target")) for i, t in enumerate(("leq_4k", "leq_8k", "leq_16k"))]), lambda x: k <= x["i"])
    return table(spark, d, "documents").select(F.explode(targets).alias("x")).groupBy("x.target").agg(F.count("*").alias("n"))


@query("SELECT json_extract_string(cloning, '$.backbone') AS backbone, count(*) AS n FROM meta GROUP BY 1")
def json_extract_fields(spark, d):
    return metadata(spark, d).groupBy(F.get_json_object("cloning", "$.backbone").alias("backbone")).agg(F.count("*").alias("n"))


@query("SELECT species, count(*) AS n FROM (SELECT json_extract_string(inserts, '$[0].species[0][1]') AS species FROM meta WHERE id % 50 <> 0) GROUP BY 1")
def json_species_tokens(spark, d):
    parsed = F.from_json("inserts", "array<struct<species:array<array<string>>>>")
    pairs = F.flatten(F.transform(F.coalesce(parsed, F.array()), lambda x: F.coalesce(x["species"], F.array())))
    names = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: p[1]))
    return metadata(spark, d).select(F.explode(names).alias("species")).groupBy("species").agg(F.count("*").alias("n"))


@query("""SELECT id, list_sort(list_distinct(list_filter([CASE WHEN contains(s, 'mammalian') THEN '<VEC_MAMMALIAN>' END, CASE WHEN contains(s, 'bacterial') THEN '<VEC_BACTERIAL>' END, CASE WHEN contains(s, 'lentivir') THEN '<VEC_LENTIVIRAL>' END,
 CASE WHEN contains(s, 'crispr') THEN '<VEC_CRISPR>' END, CASE WHEN contains(s, 'yeast') THEN '<VEC_YEAST>' END, CASE WHEN contains(s, 'plant') THEN '<VEC_PLANT>' END], lambda x: x IS NOT NULL))) AS vectors,
 CASE WHEN contains(lower(trim(plasmid_copy)), 'high') THEN '<COPY_HIGH>' WHEN contains(lower(trim(plasmid_copy)), 'low') THEN '<COPY_LOW>' END AS copy_number FROM (SELECT *, lower(json_extract_string(cloning, '$.vector_types[0]')) AS s FROM meta)""")
def keyword_tokens(spark, d):
    vectors = F.array_join(F.from_json(F.get_json_object("cloning", "$.vector_types"), "array<string>"), " ")
    return metadata(spark, d).select("id", tokens.keyword_tokens(vectors).alias("vectors"), tokens.copy_token(F.col("plasmid_copy")).alias("copy_number"))


@query(", b AS (SELECT id, trim(json_extract_string(cloning, '$.backbone')) AS backbone FROM meta), top AS (SELECT backbone, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, backbone LIMIT 20) SELECT id, '<BB_' || replace(replace(replace(upper(backbone), ' ', '_'), '/', '_'), '.', '') || '>' AS token FROM b WHERE backbone IN (SELECT backbone FROM top)")
def topn_backbone_tokens(spark, d):
    b = metadata(spark, d).select("id", F.trim(F.get_json_object("cloning", "$.backbone")).alias("backbone"))
    top = b.groupBy("backbone").count().orderBy(F.desc("count"), "backbone").limit(20).select("backbone")
    return b.join(F.broadcast(top), "backbone").select("id", F.concat(F.lit("<BB_"), tokens.clean_name(F.col("backbone")), F.lit(">")).alias("token"))  # 20 rows


@query("SELECT token, category, count(DISTINCT plasmid_id) AS plasmid_count FROM ann JOIN reg USING (sseqid) GROUP BY 1, 2 HAVING count(DISTINCT plasmid_id) >= 50")
def token_registry_union(spark, d):
    used = annotations(spark, d).select("sseqid", "plasmid_id").join(registry(spark, d), "sseqid")
    return used.groupBy("token", "category").agg(F.countDistinct("plasmid_id").alias("plasmid_count")).where("plasmid_count >= 50")


_BEST = "SELECT plasmid_id, token, sseqid, ln, pident, percmatch FROM ann JOIN reg USING (sseqid) WHERE pident >= 92 AND percmatch >= 20 AND NOT coalesce(fragment, false) QUALIFY row_number() OVER (PARTITION BY plasmid_id, token ORDER BY pident DESC, percmatch DESC, sseqid, ln) = 1"


def best_assignments(spark, d):
    """The best annotation of each token of each plasmid, ties by sseqid and line; from identity 92 and match 20 on, as the given SQL has it (the usual limits are 95 and 80)."""
    ann = annotations(spark, d).where((F.col("pident") >= 92) & (F.col("percmatch") >= 20) & ~F.coalesce("fragment", F.lit(False)))
    w = Window.partitionBy("plasmid_id", "token").orderBy(F.desc("pident"), F.desc("percmatch"), "sseqid", "ln")
    return ann.join(registry(spark, d).select("sseqid", "token"), "sseqid").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("plasmid_id", "token", "sseqid", "ln", "pident", "percmatch")


@query(_BEST)
def join_hard_assignment(spark, d):
    return best_assignments(spark, d)


@query("SELECT plasmid_id, tokens, len(tokens) AS n_tokens, '<BOS>' || array_to_string(tokens, '') || '<SEQ>' AS prompt, '<BOS>' || array_to_string(tokens, '') || '<SEQ>' || sequence || '<EOS>' AS full_text, length(sequence) AS sequence_length FROM ptok JOIN seqs USING (plasmid_id)")
def join_training_pairs(spark, d):
    t = plasmid_tokens(spark, d).join(sequences(spark, d), "plasmid_id")
    prompt = tokens.prompt_of(F.col("tokens"))
    return t.select("plasmid_id", "tokens", F.size("tokens").cast("long").alias("n_tokens"), prompt.alias("prompt"), F.concat(prompt, "sequence", F.lit("<EOS>")).alias("full_text"), F.length("sequence").cast("long").alias("sequence_length"))


@query(", r AS (SELECT plasmid_id, list({'token': token, 'qstart': ann.qstart} ORDER BY token) AS motifs FROM (" + _BEST + ") b JOIN ann USING (plasmid_id, sseqid, ln) WHERE token LIKE '<AMR%' OR token LIKE '<ORI%' GROUP BY 1) SELECT o_orderkey AS plasmid_id, len(motifs) AS n_motifs, motifs IS NOT NULL AND len(motifs) >= 1 AS has_hard_tokens FROM orders LEFT JOIN r ON o_orderkey = plasmid_id")
def join_reward_metadata(spark, d):
    best = best_assignments(spark, d).where(F.col("token").startswith("<AMR") | F.col("token").startswith("<ORI")).join(annotations(spark, d).select("plasmid_id", "sseqid", "ln", "qstart"), ["plasmid_id", "sseqid", "ln"])
    motifs = best.groupBy("plasmid_id").agg(F.array_sort(F.collect_list(F.struct("token", "qstart"))).alias("motifs"))
    plasmids = table(spark, d, "orders").select(F.col("o_orderkey").alias("plasmid_id"))
    return plasmids.join(motifs, "plasmid_id", "left").select("plasmid_id", F.when(F.col("motifs").isNotNull(), F.size("motifs").cast("long")).alias("n_motifs"), (F.col("motifs").isNotNull() & (F.size("motifs") >= 1)).alias("has_hard_tokens"))


@query("SELECT p_partkey, p_name, coalesce(e.s_suppkey, l.s_suppkey) AS s_suppkey FROM part LEFT JOIN supplier e ON 'Supplier#' || lpad(p_partkey::VARCHAR, 9, '0') = e.s_name LEFT JOIN supplier l ON lower('SUPPLIER#' || lpad((p_partkey % 200)::VARCHAR, 9, '0')) = lower(l.s_name)")
def join_bridge_case_insensitive(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    exact = s.select(F.col("s_name").alias("e_name"), F.col("s_suppkey").alias("e"))
    folded = s.select(F.lower("s_name").alias("l_name"), F.col("s_suppkey").alias("l"))
    part = table(spark, d, "part").select("p_partkey", "p_name", F.concat(F.lit("Supplier#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("e_name"), F.lower(F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("p_partkey") % 200).cast("string"), 9, "0"))).alias("l_name"))
    return part.join(exact, "e_name", "left").join(folded, "l_name", "left").select("p_partkey", "p_name", F.coalesce("e", "l").alias("s_suppkey"))


@query("SELECT sseqid, feature, coalesce(CASE WHEN sseqid % 3 = 0 THEN token END, CASE WHEN contains(lower(feature), 'small') THEN '<TAG_SMALL>' WHEN regexp_matches(lower(feature), '\\bring\\b') THEN '<TAG_RING>' WHEN contains(lower(feature), 'box') THEN '<ELEM_BOX>' END) AS mapped FROM reg")
def join_two_tier_mapping(spark, d):
    rules = (("small", "<TAG_SMALL>"), ("ring", "<TAG_RING>"), ("box", "<ELEM_BOX>"))
    low, pattern = F.lower("feature"), F.lit(None).cast("string")
    for key, token in reversed(rules):  # short patterns match whole words only
        pattern = F.when(low.rlike(rf"\b{key}\b") if key == "ring" else F.contains(low, F.lit(key)), token).otherwise(pattern)
    exact = registry(spark, d).where("sseqid % 3 = 0").select(F.col("sseqid").alias("s"), F.col("token").alias("exact"))
    r = registry(spark, d).select("sseqid", "feature")
    return r.join(exact, r["sseqid"] == exact["s"], "left").select("sseqid", "feature", F.coalesce("exact", pattern).alias("mapped"))


@query("SELECT sseqid, token FROM reg WHERE sseqid IN (SELECT sseqid FROM ann WHERE pident >= 99)")
def join_semi_reduce(spark, d):
    return registry(spark, d).select("sseqid", "token").join(annotations(spark, d).where("pident >= 99").select("sseqid"), "sseqid", "left_semi")


@query("SELECT sseqid, token FROM reg WHERE sseqid NOT IN (SELECT sseqid FROM ann WHERE pident >= 99)")
def join_anti_missing(spark, d):
    return registry(spark, d).select("sseqid", "token").join(annotations(spark, d).where("pident >= 99").select("sseqid"), "sseqid", "left_anti")


@query(", r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT a.doc_id, b.doc_id AS partner FROM r a JOIN r b ON b.rn = (a.rn + a.n // 2) % a.n")
def join_rotation_pair(spark, d):
    from strandline.operators.order import number_rows

    docs = number_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], "rn")
    n = docs.count()
    b = docs.select(F.col("doc_id").alias("partner"), F.col("rn").alias("brn"))
    return docs.join(b, F.col("brn") == F.pmod(F.col("rn") + n // 2, F.lit(n))).select("doc_id", "partner")


@query("SELECT a.doc_id, a.n_chars - length(b.sequence) AS delta FROM documents a JOIN seqs b ON doc_id = plasmid_id")
def join_paired_delta(spark, d):
    return table(spark, d, "documents").join(sequences(spark, d), F.col("doc_id") == F.col("plasmid_id")).select("doc_id", (F.col("n_chars") - F.length("sequence")).alias("delta"))


@query("SELECT sseqid, coalesce(first_db, 'unknown') AS db FROM reg LEFT JOIN (SELECT l_partkey AS sseqid, min(l_linestatus) AS first_db FROM lineitem WHERE l_quantity >= 40 GROUP BY 1) USING (sseqid)")
def join_metadata_fallback(spark, d):
    db = table(spark, d, "lineitem").where("l_quantity >= 40").groupBy(F.col("l_partkey").alias("sseqid")).agg(F.min("l_linestatus").alias("first_db"))
    return registry(spark, d).select("sseqid").join(db, "sseqid", "left").select("sseqid", F.coalesce("first_db", F.lit("unknown")).alias("db"))


@query("SELECT token, max_by(sseqid, pident * 100000 + percmatch * 100 - sseqid / 1e6::DOUBLE) AS best FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def join_feature_dictionary(spark, d):
    return annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("token").agg(F.max_by("sseqid", F.col("pident") * 100000 + F.col("percmatch") * 100 - F.col("sseqid") / F.lit(1e6)).alias("best"))


@query("SELECT sseqid, regexp_replace(feature || '|' || sseqid, '[^A-Za-z0-9_.-]', '_', 'g') AS clean, split_part(feature || '|' || sseqid, '|', -1) AS subject, row_number() OVER (PARTITION BY regexp_replace(feature, '[^A-Za-z0-9_.-]', '_', 'g') ORDER BY sseqid) - 1 AS dup FROM reg")
def join_subject_resolution(spark, d):
    full = F.concat_ws("|", "feature", F.col("sseqid").cast("string"))
    dup = F.row_number().over(Window.partitionBy(dna.fasta_id(F.col("feature"))).orderBy("sseqid")) - 1
    return registry(spark, d).select("sseqid", dna.fasta_id(full).alias("clean"), F.element_at(F.split(full, "\\|"), -1).alias("subject"), dup.cast("long").alias("dup"))


@query(", h AS (SELECT plasmid_id, ln, CASE sseqid % 3 WHEN 0 THEN 'gnl|db|' || sseqid ELSE '' END || CASE WHEN sseqid % 3 = 1 THEN regexp_replace('id ' || sseqid, '[^A-Za-z0-9_.-]', '_', 'g') WHEN sseqid % 3 = 2 THEN 'id ' || sseqid ELSE '' END AS subject FROM ann), k AS (SELECT CASE WHEN sseqid % 3 = 0 THEN sseqid::VARCHAR ELSE 'id ' || sseqid END AS id, token FROM reg WHERE sseqid % 7 <> 0), r AS (SELECT h.*, split_part(subject, '|', -1) AS own FROM h) SELECT plasmid_id, ln, subject, coalesce(a.token, b.token) AS token FROM r LEFT JOIN k a ON a.id = own LEFT JOIN k b ON regexp_replace(b.id, '[^A-Za-z0-9_.-]', '_', 'g') = own WHERE coalesce(a.token, b.token) IS NOT NULL")
def join_subject_tokens(spark, d):
    """Tokens of hits by their subject: its last field between pipes as an id, else as an id made safe for FASTA."""
    n, text = F.col("sseqid") % 3, F.col("sseqid").cast("string")
    named = F.concat(F.lit("id "), text)
    subject = F.when(n == 0, F.concat(F.lit("gnl|db|"), text)).when(n == 1, dna.fasta_id(named)).otherwise(named)
    h = annotations(spark, d).select("plasmid_id", "ln", subject.alias("subject"))
    known = registry(spark, d).where("sseqid % 7 <> 0").select(F.when(n == 0, text).otherwise(named).alias("sseqid"), "token")
    return resolve_subjects(h, known, "subject")


@query("SELECT a.conv_id, a.turn, length(a.text) AS prompt_chars, length(b.text) AS reply_chars FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.turn % 2 = 0")
def join_positional_zip(spark, d):
    c = table(spark, d, "conversations")
    a = c.where("turn % 2 = 0").select("conv_id", "turn", F.length("text").cast("long").alias("prompt_chars"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("reply_chars"))
    return a.join(b, ["conv_id", "turn"])


@query("SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.99), 4) AS p99 FROM orders")
def agg_profile_exact(spark, d):
    from strandline.operators.scoring import quantiles

    x, orders = F.col("o_totalprice"), table(spark, d, "orders").select("o_totalprice")
    plain = orders.agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    q = quantiles(orders, "o_totalprice", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    return plain.crossJoin(F.broadcast(q)).select("n", "mean", "sd", "low", "high", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p99")])  # one row each


@query("SELECT category, count(DISTINCT plasmid_id) AS plasmids, count(DISTINCT token) AS n_tokens, min(pident) AS low, max(pident) AS high, sum((percmatch >= 80)::INT)::BIGINT AS full_hits FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def agg_distinct_and_ranges(spark, d):
    return annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("category").agg(F.countDistinct("plasmid_id").alias("plasmids"), F.countDistinct("token").alias("n_tokens"), F.min("pident").alias("low"), F.max("pident").alias("high"), F.count_if(F.col("percmatch") >= 80).alias("full_hits"))


@query("SELECT n, count(*) AS plasmids FROM (SELECT plasmid_id, count(*) AS n FROM ann GROUP BY 1) GROUP BY 1")
def agg_histogram_of_counts(spark, d):
    return annotations(spark, d).groupBy("plasmid_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("plasmids"))


@query("SELECT category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def agg_share_of_total(spark, d):
    n = annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("category").agg(F.count("*").alias("n"))
    return n.select("category", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"))  # one row a category


@query("SELECT token, min(category) AS category, list_sort(list(DISTINCT feature)) AS features, count(DISTINCT plasmid_id) AS plasmid_count, count(DISTINCT sseqid) AS n_sequences FROM reg JOIN ann USING (sseqid) GROUP BY 1")
def agg_registry_rollup(spark, d):
    used = annotations(spark, d).select("sseqid", "plasmid_id").distinct().join(registry(spark, d), "sseqid")
    plasmids = used.groupBy("token", "plasmid_id").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("plasmid_count"))
    kinds = used.groupBy("token", "sseqid", "category", "feature").agg(F.lit(1).alias("one"))  # one row a sequence
    kinds = kinds.groupBy("token").agg(F.min("category").alias("category"), F.array_sort(F.collect_set("feature")).alias("features"), F.count("*").alias("n_sequences"))
    return kinds.join(plasmids, "token").select("token", "category", "features", "plasmid_count", "n_sequences")


@query("SELECT token, min_by(feature, (CASE WHEN sseqid % 3 = 0 THEN 0 WHEN sseqid % 3 = 1 THEN 1 ELSE 2 END) * 1000000 + sseqid) AS description FROM reg WHERE feature <> '' GROUP BY 1")
def agg_preferred_description(spark, d):
    rank = F.when(F.col("sseqid") % 3 == 0, 0).when(F.col("sseqid") % 3 == 1, 1).otherwise(2)
    return registry(spark, d).where("feature <> ''").groupBy("token").agg(F.min_by("feature", F.struct(rank.alias("r"), "sseqid")).alias("description"))


@query("SELECT category, count(*) AS n, count(*) FILTER (WHERE seq_len > 10) AS with_sequence FROM reg GROUP BY 1")
def agg_category_sequences(spark, d):
    return registry(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("seq_len") > 10).alias("with_sequence"))


@query("SELECT feature, count(*) AS n FROM reg WHERE category = 'TAG' GROUP BY 1 ORDER BY n DESC, feature LIMIT 20")
def agg_top_unmapped(spark, d):
    return registry(spark, d).where("category = 'TAG'").groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(20)


@query("SELECT plasmid_id, token, sseqid, pident FROM ann JOIN reg USING (sseqid) QUALIFY row_number() OVER (PARTITION BY plasmid_id, token ORDER BY pident DESC, ln, sseqid) = 1")
def agg_best_hit(spark, d):
    best = F.max_by(F.struct("sseqid", "pident"), F.struct("pident", (-F.col("ln")).alias("a"), (-F.col("sseqid")).alias("b")))
    return annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("plasmid_id", "token").agg(best.alias("x")).select("plasmid_id", "token", "x.sseqid", "x.pident")


@query("SELECT coalesce(category, 'TOTAL') AS category, count(*) AS requested, sum((percmatch >= 50)::INT)::BIGINT AS found, round(avg((percmatch >= 50)::INT), 8) AS rate FROM ann JOIN reg USING (sseqid) GROUP BY ROLLUP (category)")
def agg_category_hit_rate(spark, d):
    found = F.col("percmatch") >= 50
    return annotations(spark, d).join(registry(spark, d), "sseqid").rollup("category").agg(F.count("*").alias("requested"), F.count_if(found).alias("found"), F.round(F.avg(found.cast("int")), 8).alias("rate")).select(F.coalesce("category", F.lit("TOTAL")).alias("category"), "requested", "found", "rate")


@query("SELECT round(avg(rate), 8) AS macro, sum(f)::BIGINT AS found, sum(n)::BIGINT AS expected, sum((f = n)::INT)::BIGINT AS perfect FROM (SELECT plasmid_id, count(*) AS n, count(*) FILTER (WHERE percmatch >= 50) AS f, count(*) FILTER (WHERE percmatch >= 50) / count(*) AS rate FROM ann GROUP BY 1)")
def agg_macro_micro(spark, d):
    per = annotations(spark, d).groupBy("plasmid_id").agg(F.count("*").alias("n"), F.count_if(F.col("percmatch") >= 50).alias("f"))
    return per.agg(F.round(F.avg(F.col("f") / F.col("n")), 8).alias("macro"), F.sum("f").alias("found"), F.sum("n").alias("expected"), F.count_if(F.col("f") == F.col("n")).alias("perfect"))


@query("SELECT token, count(*) AS attempts, round(100.0::DOUBLE * count(*) FILTER (WHERE percmatch >= 70) / count(*), 6) AS pass_pct, round(avg(percmatch / 100), 8) AS mean_ratio FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def agg_token_pass_rates(spark, d):
    return annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("token").agg(F.count("*").alias("attempts"), F.round(F.lit(100.0) * F.count_if(F.col("percmatch") >= 70) / F.count("*"), 6).alias("pass_pct"), F.round(F.avg(F.col("percmatch") / 100), 8).alias("mean_ratio"))


@query("SELECT plasmid_id, list(token ORDER BY pident DESC, token, ln) AS by_identity, list(ln ORDER BY ln) AS ln_list FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def agg_collect_ordered(spark, d):
    order = F.array_sort(F.collect_list(F.struct((-F.col("pident")).alias("p"), "token", "ln")))
    return annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("plasmid_id").agg(F.transform(order, lambda x: x["token"]).alias("by_identity"), F.array_sort(F.collect_list("ln")).alias("ln_list"))


@query("SELECT category, token FROM (SELECT category, token, row_number() OVER (PARTITION BY category ORDER BY md5(token), token) AS rn FROM (SELECT DISTINCT category, token FROM reg)) WHERE rn <= 10")
def agg_category_representatives(spark, d):
    w = Window.partitionBy("category").orderBy(F.md5(F.col("token").cast("binary")), "token")
    return registry(spark, d).select("category", "token").distinct().withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("category", "token")


@query("SELECT plasmid_id, round(sum(least(1.0::DOUBLE, percmatch / 70)) + 0.15, 6) AS reward, round(avg((percmatch >= 70)::INT), 8) AS qc_rate FROM ann GROUP BY 1")
def agg_reward_forms(spark, d):
    return annotations(spark, d).groupBy("plasmid_id").agg(F.round(F.sum(F.least(F.lit(1.0), F.col("percmatch") / 70)) + 0.15, 6).alias("reward"), F.round(F.avg((F.col("percmatch") >= 70).cast("int")), 8).alias("qc_rate"))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS med, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sd_pop, CASE WHEN contains(event_type, 'e') THEN max(value) ELSE round(avg(value), 6) END AS stat FROM events GROUP BY 1")
def agg_model_summary(spark, d):
    from strandline.operators.scoring import quantiles

    v, e = F.col("value"), table(spark, d, "events").select("event_type", "value")
    plain = e.groupBy("event_type").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.stddev_pop(v), 6).alias("sd_pop"), F.when(F.contains("event_type", F.lit("e")), F.max(v)).otherwise(F.round(F.avg(v), 6)).alias("stat"))
    med = quantiles(e, "value", {"med": 0.5}, ["event_type"])
    return plain.join(med, "event_type").select("event_type", "mean", F.round("med", 6).alias("med"), "sd", "sd_pop", "stat")


@query("SELECT plasmid_id, sseqid, ln FROM ann QUALIFY row_number() OVER (PARTITION BY plasmid_id, sseqid ORDER BY pident DESC, percmatch DESC, ln) = 1")
def window_dedup_best(spark, d):
    w = Window.partitionBy("plasmid_id", "sseqid").orderBy(F.desc("pident"), F.desc("percmatch"), "ln")
    return annotations(spark, d).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("plasmid_id", "sseqid", "ln")


@query("SELECT plasmid_id, array_to_string(tokens, '') AS prompt FROM ptok QUALIFY row_number() OVER (PARTITION BY array_to_string(tokens, '') ORDER BY len(tokens) DESC, plasmid_id) <= 50")
def window_prompt_cap(spark, d):
    p = plasmid_tokens(spark, d).select("plasmid_id", F.array_join("tokens", "").alias("prompt"), F.size("tokens").alias("n"))
    w = Window.partitionBy("prompt").orderBy(F.desc("n"), "plasmid_id")
    return p.withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("plasmid_id", "prompt")


@query(", r AS (SELECT conv_id, turn, length(text)::DOUBLE AS r FROM conversations) SELECT conv_id, turn, round((r - avg(r) OVER w) / greatest(coalesce(stddev_samp(r) OVER w, 0), 1e-8), 6) AS z, CASE WHEN coalesce(stddev_samp(r) OVER w, 0) > 0.1 THEN round((r - avg(r) OVER w) / (stddev_samp(r) OVER w), 6) ELSE 0 END AS z_floor FROM r WINDOW w AS (PARTITION BY conv_id)")
def window_group_zscore(spark, d):
    w = Window.partitionBy("conv_id")
    r = F.length("text").cast("double")
    sd = F.coalesce(F.stddev_samp(r).over(w), F.lit(0.0))
    x = r - F.avg(r).over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(x / F.greatest(sd, F.lit(1e-8)), 6).alias("z"), F.when(sd > 0.1, F.round(x / sd, 6)).otherwise(0.0).alias("z_floor"))


@query("SELECT conv_id, turn, round((length(text) - m) / (s + 1e-8), 6) AS z FROM conversations, (SELECT avg(length(text)) AS m, stddev_samp(length(text)) AS s FROM conversations)")
def window_global_zscore(spark, d):
    c = table(spark, d, "conversations")
    stats = c.agg(F.avg(F.length("text")).alias("m"), F.stddev_samp(F.length("text")).alias("s"))
    return c.join(F.broadcast(stats)).select("conv_id", "turn", F.round((F.length("text") - F.col("m")) / (F.col("s") + 1e-8), 6).alias("z"))  # one row


@query(", e AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_reduce(v, lambda b, x: 0.95::DOUBLE * b + 0.05::DOUBLE * x), 6) AS baseline FROM e")
def window_ema_baseline(spark, d):
    """The moving baseline of each user after the last of their rewards, one a step."""
    from strandline.operators.scoring import moving_baseline

    e = moving_baseline(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value")
    return e.groupBy("user_id").agg(F.round(F.max_by("baseline", F.struct("ts", "event_id")), 6).alias("baseline"))


@query(", q AS (SELECT user_id, event_type, sum(round(value * 100)::BIGINT)::BIGINT AS w FROM events GROUP BY 1, 2), p AS (SELECT *, w / sum(w) OVER (PARTITION BY user_id) AS share, sum(w) OVER (PARTITION BY user_id ORDER BY w DESC, event_type ROWS UNBOUNDED PRECEDING) - w AS before, sum(w) OVER (PARTITION BY user_id) AS total FROM q) SELECT user_id, event_type, round(share, 8) AS share FROM p WHERE before < 0.9 * total")
def window_nucleus_filter(spark, d):
    q = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("w"))
    w = Window.partitionBy("user_id")
    before = F.sum("w").over(w.orderBy(F.desc("w"), "event_type").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    return q.select("user_id", "event_type", "w", before.alias("before"), F.sum("w").over(w).alias("total")).where("before < 0.9 * total").select("user_id", "event_type", F.round(F.col("w") / F.col("total"), 8).alias("share"))


@query("SELECT plasmid_id, max_by(ln, percmatch * 100000 + pident * 100 - ln) AS best, min_by(ln, percmatch * 100000 + pident * 100 - ln) AS worst FROM ann GROUP BY 1 HAVING max(percmatch) > min(percmatch)")
def topk_best_of_n(spark, d):
    key = F.col("percmatch") * 100000 + F.col("pident") * 100 - F.col("ln")
    return annotations(spark, d).groupBy("plasmid_id").agg(F.max_by("ln", key).alias("best"), F.min_by("ln", key).alias("worst"), F.max("percmatch").alias("hi"), F.min("percmatch").alias("lo")).where("hi > lo").select("plasmid_id", "best", "worst")


@query("SELECT conv_id, arg_max(turn, length(text) * 1000 - turn) AS chosen, arg_min(turn, length(text) * 1000 + turn) AS rejected FROM conversations GROUP BY 1 HAVING max(length(text)) > min(length(text))")
def pref_pairs(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("turn", n * 1000 - F.col("turn")).alias("chosen"), F.min_by("turn", n * 1000 + F.col("turn")).alias("rejected"), F.max(n).alias("hi"), F.min(n).alias("lo")).where("hi > lo").select("conv_id", "chosen", "rejected")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_worst_best(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 100")
def sample_hash_order(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42")).cast("binary")), "doc_id").limit(100)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id) <= floor(count(*) OVER () * 0.05) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_train_val(spark, d):
    from strandline.operators.order import number_rows

    docs = table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-42")).cast("binary")).alias("h"))
    n = docs.count()
    return number_rows(docs, ["h", "doc_id"], "rn").select("doc_id", F.when(F.col("rn") < int(n * 0.05), "val").otherwise("train").alias("split"))


@query(", r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn, count(*) OVER () AS n FROM documents) SELECT doc_id, rn // 32 AS batch, CASE WHEN rn < (n % 7) * (n // 7 + 1) THEN rn // (n // 7 + 1) ELSE n % 7 + (rn - (n % 7) * (n // 7 + 1)) // (n // 7) END + 1 AS shard FROM r")
def batch_and_shard(spark, d):
    from strandline.operators.order import number_rows

    docs = number_rows(table(spark, d, "documents").select("doc_id"), ["doc_id"], "rn")
    n = docs.count()
    q, r = n // 7, n % 7
    big = r * (q + 1)
    shard = F.when(F.col("rn") < big, F.floor(F.col("rn") / (q + 1))).otherwise(r + F.floor((F.col("rn") - big) / max(1, q))) + 1
    return docs.select("doc_id", F.floor(F.col("rn") / 32).alias("batch"), shard.cast("long").alias("shard"))


@query("SELECT plasmid_id, list_sort(list_intersect(tokens, ['<AMR_BRAND1>', '<ORI_BRAND2>', '<TAG_BRAND3>'])) AS found, list_sort(list_filter(['<AMR_BRAND1>', '<ORI_BRAND2>', '<TAG_BRAND3>'], lambda x: NOT list_contains(tokens, x))) AS missing FROM ptok")
def set_token_ops(spark, d):
    want = F.array(*[F.lit(x) for x in ("<AMR_BRAND1>", "<ORI_BRAND2>", "<TAG_BRAND3>")])
    return plasmid_tokens(spark, d).select("plasmid_id", F.array_sort(F.array_intersect("tokens", want)).alias("found"), F.array_sort(F.array_except(want, "tokens")).alias("missing"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))).distinct()


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier")
def set_union_missing_columns(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT plasmid_id, list_filter(tokens, lambda t: regexp_matches(t, '^<(AMR|ORI|PROM|REPORTER|REP|TAG|ELEM)_')) AS hard, list_sort(list_distinct(list_transform(tokens, lambda t: split_part(translate(t, '<>', ''), '_', 1)))) AS categories FROM ptok")
def tokens_parse_hard(spark, d):
    t = tokens.tokens_in(tokens.prompt_of(F.col("tokens")))
    return plasmid_tokens(spark, d).select("plasmid_id", tokens.hard_tokens(t).alias("hard"), F.array_sort(F.array_distinct(F.transform("tokens", tokens.category_of))).alias("categories"))


@query("SELECT plasmid_id, tokens FROM ptok")
def tokens_canonical_order(spark, d):
    return plasmid_tokens(spark, d)


@query("""SELECT split, count(*) AS n FROM (SELECT unnest(list_filter(['combined', CASE WHEN contains(cloning, 'Bacterial') THEN 'bacterial' END, CASE WHEN contains(cloning, 'Mammalian') OR contains(cloning, 'Lentiviral') THEN 'mammalian' END, CASE WHEN contains(cloning, 'CRISPR') THEN 'crispr' END, CASE WHEN contains(cloning, 'Yeast') THEN 'yeast' END, CASE WHEN contains(cloning, 'Plant') THEN 'plant' END], lambda x: x IS NOT NULL)) AS split FROM meta) GROUP BY 1""")
def splits_multilabel(spark, d):
    vectors = tokens.keyword_tokens(F.get_json_object("cloning", "$.vector_types"))
    return metadata(spark, d).select(F.explode(tokens.split_labels(vectors)).alias("split")).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND text <> '' AND lang IN ('en', 'de')")
def filter_null_guard(spark, d):
    return table(spark, d, "documents").where(F.col("text").isNotNull() & (F.col("text") != "") & F.col("lang").isin("en", "de")).select("doc_id")


@query("SELECT plasmid_id FROM ptok WHERE list_contains(tokens, '<ORI_BRAND2>') AND len(tokens) >= 2")
def filter_array_membership(spark, d):
    return plasmid_tokens(spark, d).where(F.array_contains("tokens", "<ORI_BRAND2>") & (F.size("tokens") >= 2)).select("plasmid_id")


@query("SELECT plasmid_id, sseqid, ln FROM ann WHERE least(percmatch, 100) >= 80 AND pident >= 95")
def filter_hit_quality(spark, d):
    return annotations(spark, d).where((F.least("percmatch", F.lit(100.0)) >= 80) & (F.col("pident") >= 95)).select("plasmid_id", "sseqid", "ln")
