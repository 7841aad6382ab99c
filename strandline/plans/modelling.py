"""Queries over text and sequences as models see them: k-mer tokens and ids, samples, tracebacks, features, negatives, proteins."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import dna, draws, features, tokens
from strandline.operators import align, homology, intervals, scoring
from strandline.operators.order import checkpoint, spread
from strandline.scorers import AlignmentScorer
from strandline.scorers.structure import structure

from .analytics import _frame, candidate_pairs, kmer_candidates, loci
from .relational import query
from .views import ROW_PLACE, annotations, hits, motifs, plasmid_tokens, registry, sequences, table

SPECIALS = ("<PAD>", "<UNK>", "<BOS>", "<EOS>", "<SEQ>")
K, STRIDE = 6, 3


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_VOCAB = "vc AS (SELECT unnest(range(0, 5))::BIGINT AS id, unnest(" + _sql_list(SPECIALS) + ") AS token UNION ALL SELECT 5 + i, array_to_string(list_transform(range(0, 6), lambda p: substring('ACGT', ((i // (4 ** (5 - p))::BIGINT) % 4 + 1)::INT, 1)), '') FROM range(0, 4096) t(i))"
# Texts of the model: every document's bases between its markers; each seventh lacks the end.
_TEXT = "tx AS (SELECT plasmid_id, '<BOS><ORI_F1><SEQ>' || sequence || CASE WHEN plasmid_id % 7 = 0 THEN '' ELSE '<EOS>' END AS text FROM seqs)"
_FILL = "array_to_string(list_transform(string_split({s}, ''), lambda c, i: CASE WHEN c = 'N' THEN substring('ACGT', ((instr('0123456789abcdef', right(md5((i - 1)::VARCHAR), 1)) - 1) % 4 + 1)::INT, 1) ELSE c END), '')"
_KMERS = "CASE WHEN length({s}) = 0 THEN [] ELSE list_transform(range(0, (ceil(greatest(length({s}) - 6, 0) / 3)::INT + 1)), lambda i: rpad(substring({s}, (3 * i + 1)::INT, 6), 6, 'A')) END"
_PARTS = f"pt AS (SELECT plasmid_id, {_FILL.format(s='sequence')} AS s FROM seqs), tt AS (SELECT plasmid_id, list_concat(list_concat(['<BOS>', '<ORI_F1>', '<SEQ>'], {_KMERS.format(s='s')}), CASE WHEN plasmid_id % 7 = 0 THEN [] ELSE ['<EOS>'] END) AS parts FROM pt)"


def _vocabulary(spark):
    return dna.kmer_vocabulary(spark, SPECIALS, K)


def _texts(spark, d):
    end = F.when(F.col("plasmid_id") % 7 == 0, "").otherwise("<EOS>")
    return sequences(spark, d).select("plasmid_id", F.concat(F.lit("<BOS><ORI_F1><SEQ>"), "sequence", end).alias("text"))


@query(f", {_VOCAB} SELECT id, token FROM vc")
def kmer_vocab(spark, d):
    """Special tokens first, then all k-mers in the order of ACGT."""
    return _vocabulary(spark)


@query(f", {_PARTS} SELECT plasmid_id, parts FROM tt")
def tokenize_text(spark, d):
    """Texts as tokens: special ones as they are, bases between them as k-mers."""
    return _texts(spark, d).select("plasmid_id", dna.tokenize(F.col("text"), K, STRIDE).alias("parts"))


@query(f", {_VOCAB}, {_PARTS} SELECT plasmid_id, pos - 1 AS pos, coalesce(id, 1) AS id FROM (SELECT plasmid_id, unnest(parts) AS token, generate_subscripts(parts, 1) AS pos FROM tt) LEFT JOIN vc USING (token)")
def token_ids(spark, d):
    """Ids of the tokens by the vocabulary, whose <UNK> stands for all others (as for <ORI_F1> here)."""
    each = _texts(spark, d).select("plasmid_id", F.posexplode(dna.tokenize(F.col("text"), K, STRIDE)).alias("pos", "token"))
    return each.select("plasmid_id", F.col("pos").cast("long").alias("pos"), dna.kmer_id(F.col("token"), SPECIALS, K, "<UNK>").alias("id"))


@query(f", {_TEXT} SELECT plasmid_id, regexp_extract_all(text, '<[^>]+>|[^\\s]') AS parts FROM tx")
def tokenize_characters(spark, d):
    """Texts as tokens of the character tokenizer: special ones as they are, one for each base between them."""
    return _texts(spark, d).select("plasmid_id", dna.tokenize_characters(F.col("text")).alias("parts"))


@query(f", {_PARTS} SELECT plasmid_id, '<BOS><ORI_F1><SEQ>' || CASE WHEN length(s) = 0 THEN '' ELSE rpad(s, (6 + 3 * ceil(greatest(length(s) - 6, 0) / 3))::INT, 'A') END || CASE WHEN plasmid_id % 7 = 0 THEN '' ELSE '<EOS>' END AS text FROM pt")
def detokenize_text(spark, d):
    """Tokens put together again: special ones stay, runs of k-mers give their first bases and the last one all."""
    parts = _texts(spark, d).select("plasmid_id", dna.tokenize(F.col("text"), K, STRIDE).alias("parts"))
    return parts.select("plasmid_id", dna.detokenize(F.col("parts"), STRIDE).alias("text"))


@query(", x AS (SELECT plasmid_id, sequence, reverse(translate(sequence, 'ACGTN', 'TGCAN')) AS back FROM seqs) SELECT plasmid_id, [" + ", ".join(_frame(s, k) for k in range(3) for s in ("sequence", "back")) + "] AS frames FROM x")
def seq_translate_documents(spark, d):
    """Six frames of every document's bases."""
    return sequences(spark, d).select("plasmid_id", dna.six_frames(F.col("sequence")).alias("frames"))


@query(f" SELECT plasmid_id, {_KMERS.format(s='sequence')} AS parts FROM seqs")
def seq_kmerize_documents(spark, d):
    return sequences(spark, d).select("plasmid_id", dna.kmerize(F.col("sequence"), K, STRIDE).alias("parts"))


@query(" SELECT plasmid_id, CASE WHEN length(sequence) = 0 THEN '' ELSE rpad(sequence, (6 + 3 * ceil(greatest(length(sequence) - 6, 0) / 3))::INT, 'A') END AS decoded FROM seqs")
def seq_kmer_decode_documents(spark, d):
    return sequences(spark, d).select("plasmid_id", dna.kmer_decode(dna.kmerize(F.col("sequence"), K, STRIDE), STRIDE).alias("decoded"))


@query(f" SELECT plasmid_id, CASE WHEN length(sequence) = 0 THEN '' ELSE {_FILL.format(s='sequence')} END AS filled FROM seqs")
def seq_n_replace_documents(spark, d):
    return sequences(spark, d).select("plasmid_id", dna.fill_n(F.col("sequence")).alias("filled"))


_IDS = "list_transform(CASE WHEN length(sequence) = 0 THEN [] ELSE string_split(sequence, '') END, lambda c: instr('ACGTN', c) + 10)"


@query(f", e AS (SELECT plasmid_id, [2, 3, 5] AS p, {_IDS} AS c FROM seqs), i AS (SELECT plasmid_id, len(c) AS n, list_slice(list_concat(list_concat(p, c), [1]), 1, 512) AS ids, list_slice(list_concat(list_concat(list_concat(list_concat([7], p), [8]), c), [1]), 1, 512) AS old FROM e) SELECT plasmid_id, list_concat(ids, list_transform(range(0, 512 - len(ids)), lambda x: 0))::INT[] AS input_ids, len(ids) AS n_mask, list_concat(list_concat([-100, -100, -100], list_slice(ids, 4, 512)), list_transform(range(0, 512 - len(ids)), lambda x: -100))::INT[] AS labels, list_concat(old, list_transform(range(0, 512 - len(old)), lambda x: 0))::INT[] AS legacy_ids FROM i")
def seq_encode_documents(spark, d):
    """Samples of 512 ids, with labels, and as older models wrap them: start, prompt, separator, completion, end."""
    ids = F.when(F.length("sequence") == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split("sequence", ""), lambda c: F.locate("A", c) * 1 + F.locate("C", c) * 2 + F.locate("G", c) * 3 + F.locate("T", c) * 4 + F.locate("N", c) * 5 + 10))
    prompt = F.array(*[F.lit(x) for x in (2, 3, 5)])
    inputs, mask, labels = dna.encode_sample(prompt, ids, 512, 1, 0)
    old, _, _ = dna.encode_sample(F.concat(F.array(F.lit(7)), prompt, F.array(F.lit(8))), ids, 512, 1, 0)
    return sequences(spark, d).select("plasmid_id", inputs.alias("input_ids"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).cast("long").alias("n_mask"), labels.alias("labels"), old.alias("legacy_ids"))


@query("SELECT doc_id, regexp_replace(upper(array_to_string(list_filter(string_split(replace(text, 'ß', 'SS'), chr(10)), lambda x: NOT starts_with(x, '>')), '')), '[^ATGCNRYSWKMBDHV]', '', 'g') AS sequence FROM documents")
def seq_clean_iupac_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", dna.clean_iupac(F.col("text")).alias("sequence"))


@query(f", {_TEXT} SELECT plasmid_id, contains(text, '<EOS>') OR contains(text, '</s>') AS eos, length(regexp_replace(regexp_replace(upper(text), '<[^>]+>', '', 'g'), '[^ATGCN]', '', 'g')) AS n FROM tx")
def seq_eos_flag(spark, d):
    """Whether a raw text is finished, and the bases that cleaning leaves."""
    from strandline.scorers.base import finished

    return _texts(spark, d).select("plasmid_id", finished(F.col("text")).alias("eos"), F.length(dna.clean_dna(F.col("text"))).cast("long").alias("n"))


@query()
def str_unescape(spark, d):
    """Pages with all character references decoded."""

    @F.pandas_udf("string")
    def plain(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return table(spark, d, "pages").select("page_id", plain("html").alias("plain"))


@query(", p AS (SELECT page_id, trim(CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN '<BOS> ' || url ELSE ' <BOS>' || url || '<SEQ> ' END) AS t FROM pages), q AS (SELECT page_id, CASE WHEN starts_with(t, '<BOS>') THEN t ELSE '<BOS> ' || t END AS t FROM p) SELECT page_id, CASE WHEN ends_with(t, '<SEQ>') THEN t ELSE rtrim(t) || ' <SEQ>' END AS prompt FROM q")
def str_prompt_format(spark, d):
    """Prompts that begin with <BOS> and end with <SEQ>."""
    raw = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("<BOS> "), "url")).otherwise(F.concat(F.lit(" <BOS>"), "url", F.lit("<SEQ> ")))
    return table(spark, d, "pages").select("page_id", tokens.format_prompt(raw).alias("prompt"))


_RANK = "CASE split_part(translate(t, '<>', ''), '_', 1) " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(tokens.CATEGORY_ORDER, 1)) + " ELSE 99 END"


@query(f", l AS (SELECT plasmid_id, ln, token AS t FROM ann JOIN reg USING (sseqid)), g AS (SELECT plasmid_id, list_distinct(list({{'o': {_RANK}, 't': t}})) AS good, list('<NOT_' || ln || '>' ORDER BY ln) AS invalid FROM l GROUP BY 1) SELECT plasmid_id, '<BOS> ' || array_to_string(list_transform(list_sort(good), lambda x: x.t), ' ') || ' <SEQ>' AS prompt, invalid FROM g")
def tokens_validated(spark, d):
    """Token lists with invalid entries and repeats: valid ones once, in canonical order, rendered; invalid ones listed."""
    each = annotations(spark, d).join(registry(spark, d), "sseqid").select("plasmid_id", "ln", F.concat(F.lit("<NOT_"), F.col("ln").cast("string"), F.lit(">")).alias("bad"), "token")
    listed = each.groupBy("plasmid_id").agg(F.array_sort(F.collect_list(F.struct("ln", "bad", "token"))).alias("x"))
    raw = F.flatten(F.transform("x", lambda r: F.array(r["bad"], r["token"], r["token"])))
    prompt, invalid = tokens.validated(raw, lambda t: ~t.startswith("<NOT"))
    return listed.select("plasmid_id", prompt.alias("prompt"), invalid.alias("invalid"))


_SP = "CASE c_nationkey % 6 WHEN 0 THEN 'Homo sapiens' WHEN 1 THEN 'Escherichia coli' WHEN 2 THEN 'Mus musculus' WHEN 3 THEN 'Synthetic' WHEN 4 THEN 'synthetic construct' ELSE 'Unknown' END"


@query(f", s AS (SELECT c_custkey, {_SP} AS a, CASE WHEN c_custkey % 2 = 0 THEN 'Homo sapiens' ELSE 'Nobody' END AS b FROM customer) SELECT c_custkey, list_sort(list_distinct(list_filter([CASE a WHEN 'Homo sapiens' THEN '<SP_HUMAN>' WHEN 'Escherichia coli' THEN '<SP_ECOLI>' WHEN 'Mus musculus' THEN '<SP_MOUSE>' WHEN 'Synthetic' THEN '<SP_SYNTHETIC>' WHEN 'synthetic construct' THEN '<SP_SYNTHETIC>' END, CASE b WHEN 'Homo sapiens' THEN '<SP_HUMAN>' END], lambda x: x IS NOT NULL))) AS species FROM s")
def json_species_map(spark, d):
    """Species of each insert as tokens, sorted and once each."""
    names = ("Homo sapiens", "Escherichia coli", "Mus musculus", "Synthetic", "synthetic construct", "Unknown")
    a = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_nationkey") % 6 + 1).cast("int"))
    b = F.when(F.col("c_custkey") % 2 == 0, "Homo sapiens").otherwise("Nobody")
    inserts = F.to_json(F.array(F.struct(F.array(F.array(F.lit("9606"), a), F.array(F.lit("1"), b)).alias("species"))))
    parsed = F.from_json(inserts, "array<struct<species:array<array<string>>>>")
    found = F.transform(F.filter(F.flatten(F.transform(parsed, lambda x: x["species"])), lambda p: F.size(p) >= 2), lambda p: p[1])
    return table(spark, d, "customer").select("c_custkey", features.species_tokens(found).alias("species"))


_FEATURES = ("AmpR promoter", "ampicillin resistance promoter 2", "CMV Enhancer B", "the cat gene", "category", "3' LTR (truncated)", "SV40 ori", "my ori", "orient", "EGFP-tag", "eGFP", "V5", "xV5", "NeoR/KanR", "neo cassette", "lac UV5 promoter")


def _regex_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(low, '{r.replace(chr(39), chr(39) * 2)}') THEN '{t}'" for r, t in ((features.feature_pattern(p, w), t) for p, w, t in features.feature_rules())) + " END"


@query(f", f AS (SELECT sseqid, lower(feature || ' ' || ({_sql_list(_FEATURES)})[(sseqid % {len(_FEATURES)} + 1)::INT]) AS low FROM reg) SELECT sseqid, {_regex_sql()} AS token FROM f")
def map_feature_patterns(spark, d):
    """Tokens of feature names: overrides, then patterns by category, short ones as whole words."""
    name = F.concat_ws(" ", "feature", F.element_at(F.array(*[F.lit(x) for x in _FEATURES]), (F.col("sseqid") % len(_FEATURES) + 1).cast("int")))
    return features.map_features(registry(spark, d).select("sseqid", name.alias("name")), "name").select("sseqid", "token")


@query(", dict AS (SELECT feature, min(token) AS token FROM reg WHERE sseqid % 2 = 0 GROUP BY 1), low AS (SELECT lower(feature) AS feature, min(token) AS token FROM dict GROUP BY 1), a AS (SELECT plasmid_id, ln, percmatch, CASE WHEN sseqid % 3 = 0 THEN upper(feature) ELSE feature END AS feature FROM ann JOIN reg USING (sseqid)), m AS (SELECT a.*, coalesce(dict.token, low.token) AS token FROM a LEFT JOIN dict USING (feature) LEFT JOIN low ON lower(a.feature) = low.feature) SELECT plasmid_id, token, max(percmatch) AS best, arg_min(ln, ln - percmatch * 1000) AS ln FROM m WHERE token IS NOT NULL GROUP BY 1, 2")
def map_feature_dictionary(spark, d):
    """Tokens of feature names by a dictionary, exactly or else without case; the best match of each token of a plasmid, ties to the first."""
    known = registry(spark, d).where("sseqid % 2 = 0").groupBy("feature").agg(F.min("token").alias("exact"))
    folded = known.groupBy(F.lower("feature").alias("low")).agg(F.min("exact").alias("folded"))
    name = F.when(F.col("sseqid") % 3 == 0, F.upper("feature")).otherwise(F.col("feature"))
    a = annotations(spark, d).join(registry(spark, d).select("sseqid", "feature"), "sseqid").select("plasmid_id", "ln", "percmatch", name.alias("feature"))
    m = a.join(known, "feature", "left").withColumn("low", F.lower("feature")).join(folded, "low", "left").withColumn("token", F.coalesce("exact", "folded")).where("token is not null")
    return m.groupBy("plasmid_id", "token").agg(F.max("percmatch").alias("best"), F.max_by("ln", F.struct("percmatch", (-F.col("ln")).alias("l"))).alias("ln"))


_PROMOTER = "CASE event_id % 5 WHEN 0 THEN '<PROM_AMPR>' WHEN 1 THEN '<PROM_LAC>' WHEN 2 THEN '<PROM_T3>' WHEN 3 THEN '<PROM_CMV>' ELSE '<PROM_OTHER>' END"
_CODING = "CASE event_id % 4 WHEN 0 THEN '<AMR_AMPICILLIN>' WHEN 1 THEN '<REPORTER_GFP>' WHEN 2 THEN '<ELEM_WPRE>' ELSE '<TAG_V5>' END"


@query(f", a AS (SELECT *, {_PROMOTER} AS p FROM hit WHERE event_type = 'click'), b AS (SELECT *, {_CODING} AS c FROM hit WHERE event_type = 'error') SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, greatest(b.lo - a.hi, a.lo - b.hi, 0) AS gap FROM a JOIN b ON a.user_id = b.user_id WHERE greatest(b.lo - a.hi, a.lo - b.hi, 0) <= 50 AND c <> '<ELEM_WPRE>' AND CASE p WHEN '<PROM_AMPR>' THEN c = '<AMR_AMPICILLIN>' WHEN '<PROM_T3>' THEN false ELSE true END")
def interval_adjacency_affinity(spark, d):
    """Promoters near coding features that they drive."""
    h = hits(spark, d).withColumnRenamed("event_id", "id")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("id") % len(names) + 1).cast("int"))
    a = h.where("event_type = 'click'").withColumn("token", pick(("<PROM_AMPR>", "<PROM_LAC>", "<PROM_T3>", "<PROM_CMV>", "<PROM_OTHER>")))
    b = h.where("event_type = 'error'").withColumn("token", pick(("<AMR_AMPICILLIN>", "<REPORTER_GFP>", "<ELEM_WPRE>", "<TAG_V5>")))
    near = intervals.near_pairs(a, b, "user_id", 50)
    near = near.join(a.select(F.col("id").alias("a_id"), F.col("token").alias("p")), "a_id").join(b.select(F.col("id").alias("b_id"), F.col("token").alias("c")), "b_id")
    return near.where(features.drives(F.col("p"), F.col("c"))).select("user_id", "a_id", "b_id", "gap")


@query()
def interval_ori_tokens(spark, d):
    """Loci of overlapping hits with their bounds, best hit and sorted token set."""
    h = hits(spark, d).where("event_type = 'error'").withColumn("token", F.concat(F.lit("<ORI_"), (F.col("event_id") % 4).cast("string"), F.lit(">")))
    best = F.max_by("event_id", F.struct("value", (-F.col("event_id")).alias("e"))).alias("best")
    return loci(h, ["user_id"], best, F.array_sort(F.collect_set("token")).alias("tokens")).select("user_id", "locus", "lo", "hi", "best", "tokens")


_STRUCTURE = """, w AS (SELECT DISTINCT plasmid_id, unnest(tokens) AS token FROM ptok),
f AS (SELECT plasmid_id, token, category, arg_max(qstart, percmatch * 1000 - ln) AS lo, arg_max(qend, percmatch * 1000 - ln) AS hi, max(percmatch) AS best FROM ann JOIN reg USING (sseqid) GROUP BY 1, 2, 3),
o AS (SELECT plasmid_id, list_reduce(list({'c': 0, 'lo': lo, 'hi': hi, 't': token} ORDER BY lo, hi), lambda acc, h: list_append(acc, {'c': coalesce(list_min(list_transform(list_filter(acc, lambda k: greatest(least(k.hi, h.hi) - greatest(k.lo, h.lo), 0) / greatest(least(k.hi - k.lo, h.hi - h.lo), 1) >= 0.5), lambda k: k.c)), coalesce(list_max(list_transform(acc, lambda k: k.c)) + 1, 0)), 'lo': h.lo, 'hi': h.hi, 't': h.t}), []::STRUCT(c INT, lo BIGINT, hi BIGINT, t VARCHAR)[]) AS m FROM f WHERE category = 'ORI' GROUP BY 1),
l AS (SELECT x.plasmid_id, m.c AS c, bool_or(w.token IS NOT NULL) AS own FROM (SELECT plasmid_id, unnest(m) AS m FROM o) x LEFT JOIN w ON w.plasmid_id = x.plasmid_id AND w.token = x.m.t GROUP BY 1, 2),
n AS (SELECT plasmid_id, count(*) AS ori, count(*) FILTER (WHERE NOT own) AS free FROM l GROUP BY 1),
a AS (SELECT f.plasmid_id, count(*) FILTER (WHERE category = 'AMR') AS amr, count(*) FILTER (WHERE w.token IS NULL AND category IN ('AMR', 'REPORTER', 'TAG')) AS others FROM f LEFT JOIN w USING (plasmid_id, token) GROUP BY 1),
p AS (SELECT x.plasmid_id, count(*) AS pairs FROM (SELECT f.* FROM f JOIN w USING (plasmid_id, token) WHERE category = 'PROM') x JOIN (SELECT f.* FROM f JOIN w USING (plasmid_id, token) WHERE category IN ('AMR', 'REPORTER', 'TAG')) y ON x.plasmid_id = y.plasmid_id WHERE greatest(y.lo - x.hi, x.lo - y.hi, 0) <= 500 GROUP BY 1),
z AS (SELECT plasmid_id, coalesce(ori, 0) AS ori, coalesce(amr, 0) AS amr, coalesce(others, 0) + coalesce(free, 0) AS extra, coalesce(pairs, 0) AS pairs, coalesce(length(sequence), 0) AS size FROM (SELECT plasmid_id FROM ptok) LEFT JOIN n USING (plasmid_id) LEFT JOIN a USING (plasmid_id) LEFT JOIN p USING (plasmid_id) LEFT JOIN seqs USING (plasmid_id))
SELECT plasmid_id, ori AS ori_count, amr AS amr_count, extra AS unrequested, pairs, round(1 + 0.05::DOUBLE * pairs - 0.15::DOUBLE * greatest(ori - 1, 0) - 0.1::DOUBLE * greatest(amr - 2, 0) - 0.05::DOUBLE * extra - least(0.01::DOUBLE * greatest(size - 8000, 0) / 1000, 0.15::DOUBLE), 4)::DOUBLE AS multiplier FROM z"""


@query(_STRUCTURE)
def score_structural_pairs(spark, d):
    """Structure of every plasmid with a prompt: origins by locus, markers, what nobody asked for, asked promoters near genes that they drive, and the multiplier."""
    asked = plasmid_tokens(spark, d).join(sequences(spark, d), "plasmid_id", "left")
    asked = asked.select(F.col("plasmid_id").alias("id"), F.explode("tokens").alias("token"), F.coalesce(F.length("sequence"), F.lit(0)).alias("length"))
    a = annotations(spark, d).join(registry(spark, d), "sseqid")
    # of equal matches the first line counts
    placed = a.select(F.col("plasmid_id").alias("id"), "token", F.col("qstart").alias("lo"), F.col("qend").alias("hi"), (F.col("percmatch") * 1000 - F.col("ln")).alias("bit_score"))
    out = structure(asked, placed)
    return out.select(F.col("id").alias("plasmid_id"), "ori_count", "amr_count", F.size("unrequested").cast("long").alias("unrequested"), F.size("pairs").cast("long").alias("pairs"), "multiplier")


@query("SELECT event_id, CASE WHEN rev THEN len - 1 - ((e + 1) * 3 - 1 + f) ELSE s * 3 + f END AS dna_start, CASE WHEN rev THEN len - 1 - (s * 3 + f) ELSE (e + 1) * 3 - 1 + f END AS dna_end FROM (SELECT event_id, lo AS s, hi AS e, event_id % 3 AS f, event_id % 2 = 1 AS rev, 10000 + user_id AS len FROM hit)")
def protein_coordinates(spark, d):
    """Places in a frame's protein as places in the DNA; frames of the other strand are mirrored."""
    start, end = dna.frame_to_dna(F.col("lo"), F.col("hi"), F.col("event_id") % 3, F.col("event_id") % 2 == 1, F.col("user_id") + 10_000)
    return hits(spark, d).select("event_id", start.alias("dna_start"), end.alias("dna_end"))


_CIGAR = "CASE WHEN event_id % 3 = 0 THEN (lo % 5 + 1) || 'I' ELSE '' END || (lo % 40 + 1) || '=' || (hi % 3 + 1) || 'X' || (lo % 4 + 1) || 'I' || (hi % 30 + 1) || 'M' || (lo % 6 + 1) || 'D' || (hi % 9 + 1) || '=' || CASE WHEN event_id % 4 = 0 THEN (hi % 7 + 1) || 'I2I' ELSE '' END"


@query("SELECT event_id, ((lo % 40 + 1) + (hi % 30 + 1) + (hi % 9 + 1))::BIGINT AS matches, (hi % 3 + 1)::BIGINT AS mismatches, (lo % 4 + 1)::BIGINT AS ins, (lo % 6 + 1)::BIGINT AS dels, lead::BIGINT AS start_query, (lead + (lo % 40 + 1) + (hi % 3 + 1) + (lo % 4 + 1) + (hi % 30 + 1) + (hi % 9 + 1) - 1)::BIGINT AS end_query FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN lo % 5 + 1 ELSE 0 END AS lead FROM hit)")
def cigar_metrics(spark, d):
    """Counts and places of alignments given as CIGAR strings; insertions at either end are no part of them."""
    return hits(spark, d).select("event_id", dna.cigar(F.expr(_CIGAR)).alias("c")).select("event_id", "c.*")


@query(", x AS (SELECT plasmid_id, sequence AS s, length(sequence) AS n FROM seqs) SELECT plasmid_id, substring(s, 1, n // 4) AS prefix_25, substring(s, 1, n // 2) AS prefix_50, substring(s, 1, (n * 3) // 4) AS prefix_75, array_to_string(list_transform(range(0, n), lambda i: substring('ACGT', (instr('0123456789abcdef', right(md5(plasmid_id || '-' || i), 1)) - 1) % 4 + 1, 1)), '') AS random, array_to_string(list_transform(list_sort(list_transform(range(0, n), lambda i: md5(plasmid_id || '-' || i) || substring(s, (i + 1)::INT, 1))), lambda x: right(x, 1)), '') AS shuffled FROM x")
def seq_negatives(spark, d):
    """Sequences that should score low: prefixes, random bases of the same length, and the same bases in another order; seeded by id and place."""
    n = F.length("sequence")
    cut = lambda k: F.substr("sequence", F.lit(1), F.floor(n * k / 4).cast("int"))
    x = sequences(spark, d).withColumn("x", draws.drawn(F.col("plasmid_id").cast("string"), "sequence"))
    return x.select("plasmid_id", cut(1).alias("prefix_25"), cut(2).alias("prefix_50"), cut(3).alias("prefix_75"), "x.random", "x.shuffled")


@query(", p AS (SELECT plasmid_id, tokens, count(*) OVER () AS n, row_number() OVER (ORDER BY plasmid_id) - 1 AS rn FROM ptok) SELECT a.plasmid_id, a.tokens, list_filter(a.tokens, lambda t: ord(md5(t || a.plasmid_id)) % 2 = 0 AND t <> a.tokens[1]) AS kept, b.tokens AS other FROM p a JOIN p b ON b.rn = (a.rn + a.n // 2) % a.n")
def prompt_negatives(spark, d):
    """Prompts that don't fit their sequence: without some hard tokens (one at least), and those of another plasmid."""
    from strandline.operators.order import number_rows

    p = number_rows(plasmid_tokens(spark, d), ["plasmid_id"], "rn")
    n = p.count()
    b = p.select(F.col("tokens").alias("other"), F.col("rn").alias("brn"))
    kept = F.filter("tokens", lambda t: (F.ascii(F.md5(F.concat(t, F.col("plasmid_id").cast("string")).cast("binary"))) % 2 == 0) & (t != F.col("tokens")[0]))
    return p.join(b, F.col("brn") == F.pmod(F.col("rn") + n // 2, F.lit(n))).select("plasmid_id", "tokens", kept.alias("kept"), "other")


@query()
def str_prompt_hash(spark, d):
    """A 32-bit hash of each prompt."""
    return plasmid_tokens(spark, d).select("plasmid_id", F.hash(tokens.prompt_of(F.col("tokens"))).alias("prompt_hash"))


def _candidates(spark, d):
    return candidate_pairs(motifs(spark, d), sequences(spark, d))


@query()
def align_protein_ratio(spark, d):
    """The better of a motif's DNA and protein score (its own first frame, in all six frames), and whether it is found."""
    protein = dna.translate(F.col("motif"), 0, "*")
    by_dna = F.greatest(align.local_ratio("motif", "sequence"), align.local_ratio(dna.reverse_complement(F.col("motif")), "sequence"))
    by_protein = align.best_protein_ratio(protein, dna.six_frames(F.col("sequence"), "*"))
    r = _candidates(spark, d).select("plasmid_id", "sseqid", by_dna.alias("dna_ratio"), by_protein.alias("protein_ratio"))
    best = F.greatest(F.coalesce("dna_ratio", F.lit(0.0)), F.coalesce("protein_ratio", F.lit(0.0)))
    return r.select("plasmid_id", "sseqid", "dna_ratio", "protein_ratio", best.alias("ratio"), (best >= align.FOUND).alias("found"))


#: Motifs translate to a protein that is searched from so many amino acids on.
LEAST_PROTEIN = 10


def _proteins(m):
    """sseqid, protein: motifs whose first frame has no stop but the last letter."""
    protein = F.regexp_replace(dna.translate(F.col("motif"), 0, "*"), r"\*$", "")
    return m.select("sseqid", protein.alias("protein")).where((F.length("protein") >= LEAST_PROTEIN) & ~F.contains("protein", F.lit("*")))


def _protein_hits(spark, d, s=None, m=None):
    m, s = _proteins(motifs(spark, d) if m is None else m), sequences(spark, d) if s is None else s
    pairs = homology.protein_candidates(m, s).join(m, "sseqid").join(s, "plasmid_id")
    return homology.translated_hits(spread(pairs, "plasmid_id", "sseqid")).where("coverage >= 30 and pct_id >= 60")


#: Motifs are searched by DNA from so many bases on, and found from so much score a base on.
LEAST_DNA, DNA_SCORE = 10, 1.5


def _dna_hits(spark, d):
    """DNA hits on both strands: the scores of all motifs in all sequences, then tracebacks of those that are found."""
    m, s = motifs(spark, d).where(F.length("motif") >= LEAST_DNA), sequences(spark, d)
    pairs = homology.dna_pairs(m, s, DNA_SCORE).join(m, "sseqid").join(s, "plasmid_id")
    q = F.when(F.col("strand") == "+", F.col("motif")).otherwise(dna.reverse_complement(F.col("motif")))
    each = spread(pairs.select("plasmid_id", "sseqid", "strand", q.alias("q"), "sequence"), "plasmid_id", "sseqid", "strand")
    hit = each.select("plasmid_id", "sseqid", "strand", F.length("q").alias("n"), align.semi_global_hit("q", "sequence").alias("h"))
    return hit.select("plasmid_id", "sseqid", "strand", F.col("h.start").alias("start"), F.col("h.end").alias("end"), *homology.metrics(F.col("n"))).where("coverage >= 30 and pct_id >= 60")


def filled_motifs(spark, d):
    """Motifs without N, of 30 bases or more."""
    return motifs(spark, d).select("sseqid", dna.fill_n(F.col("motif")).alias("motif")).where("length(motif) >= 30")


def constructs(spark, d):
    """Every document's bases followed by a filled motif: on even ids its first seven tenths, on odd ids its protein in other codons."""
    from strandline.operators.order import number_rows

    m = number_rows(filled_motifs(spark, d), ["sseqid"], "nth")
    n = max(1, m.count())
    # both pieces are made once a motif, not once a document
    m = checkpoint(m.select("nth", F.substr("motif", F.lit(1), F.floor(F.length("motif") * 0.7).cast("int")).alias("part"), dna.back_translate(dna.translate(F.col("motif"), 0, "*")).alias("again")))
    s = sequences(spark, d).join(m, F.pmod("plasmid_id", F.lit(n)) == F.col("nth"))
    piece = F.when(F.col("plasmid_id") % 2 == 0, F.col("part")).otherwise(F.col("again"))
    return s.select("plasmid_id", F.concat("sequence", piece).alias("sequence"))


@query(""", b AS (SELECT plasmid_id AS qseqid, token, ln % 2 AS o, ln, sseqid, percmatch * 3 + ln % 3 AS bits, least(pident + 2, 100) AS pid, pident + 2 AS raw, least(100.0::DOUBLE * (qend - qstart) / greatest(seq_len * 12, 1), 100) AS coverage, (percmatch * 3 + ln % 3) / greatest(seq_len * 12, 1) AS norm, qstart, qend FROM ann JOIN reg USING (sseqid))
SELECT qseqid, token, arg_max(sseqid::VARCHAR, k) AS sseqid, max(bits) AS bitscore, round(arg_max(pid, k), 6) AS pct_id, round(arg_max(coverage, k), 6) AS coverage, round(arg_max(norm, k), 6) AS norm_score, arg_max(qstart, k) AS lo, arg_max(qend, k) AS hi, CASE WHEN arg_max(o, k) = 0 THEN 'nucleotide' ELSE 'translated' END AS search
FROM (SELECT *, bits * 1000000 - o * 100000 - qstart AS k FROM b WHERE coverage >= 30 AND raw >= 95) GROUP BY 1, 2""")
def agg_token_hits(spark, d):
    """The best hit of each token in either of two searches' tables, with its places; annotations of odd lines stand for the translated search's, and of equal ones the first row counts."""
    a = annotations(spark, d, placed=True).join(registry(spark, d), "sseqid")
    rows = a.select(
        F.col("plasmid_id").alias("qseqid"), F.col("sseqid").cast("string").alias("sseqid"), (F.col("pident") + 2).alias("pident"), (F.col("qend") - F.col("qstart")).alias("length"), "qstart", "qend",
        F.lit(0.0).alias("evalue"), (F.col("percmatch") * 3 + F.col("ln") % 3).alias("bitscore"), (F.col("seq_len") * 12).alias("slen"), "ln", *ROW_PLACE,
    )
    known = registry(spark, d).select(F.col("sseqid").cast("string").alias("sseqid"), "token")
    best = homology.token_hits(rows.where("ln % 2 = 0").drop("ln"), rows.where("ln % 2 = 1").drop("ln"), known, min_identity=95.0, ties=ROW_PLACE)
    return best.select("qseqid", "token", "sseqid", "bitscore", *[F.round(c, 6).alias(c) for c in ("pct_id", "coverage", "norm_score")], "lo", "hi", "search")


@query()
def search_translated(spark, d):
    """Motifs' proteins found in any of the six frames, with their places in the DNA."""
    return _protein_hits(spark, d)


@query()
def search_translated_constructs(spark, d):
    """search_translated over documents to which motifs in other codons were added."""
    return _protein_hits(spark, d, constructs(spark, d), filled_motifs(spark, d))


@query()
def align_repair_constructs(spark, d):
    """align_repair_all over documents to which parts of motifs were added."""
    return _repaired(filled_motifs(spark, d), constructs(spark, d))


@query()
def search_three_pass(spark, d):
    """Motif search by DNA and by protein; overlaps are suppressed within a motif and then among all, by score per letter."""
    columns = ("plasmid_id", "sseqid", "strand", "start", "end", "norm_score", "pct_id", "coverage", "kind")
    protein = _protein_hits(spark, d).withColumn("strand", F.when(F.col("frame") % 2 == 1, "-").otherwise("+")).withColumn("kind", F.lit("protein"))
    hit = _dna_hits(spark, d).withColumn("kind", F.lit("dna")).select(*columns).unionByName(protein.select(*columns))
    spans = checkpoint(hit.select("*", F.xxhash64("sseqid", "strand", "kind").alias("event_id"), F.col("start").alias("lo"), (F.col("end") - 1).alias("hi"), F.col("norm_score").alias("value")))
    own = spans.join(intervals.suppress(spans, ["plasmid_id", "sseqid"], 0.5), ["plasmid_id", "sseqid", "event_id"])
    kept = own.join(intervals.suppress(own, ["plasmid_id"], 0.3), ["plasmid_id", "event_id"])
    return kept.select(*columns)


@query()
def score_batch(spark, d):
    """Rewards of documents against prompts of the motifs whose k-mers they share."""
    token = F.concat(F.lit("<AMR_M"), F.col("sseqid").cast("string"), F.lit(">"))
    lookup = motifs(spark, d).select(token.alias("token"), F.col("motif").alias("dna_seq"), dna.translate(F.col("motif"), 0, "*").alias("protein_seq"), F.lit(True).alias("is_cds"))
    asked = kmer_candidates(motifs(spark, d), sequences(spark, d)).groupBy("plasmid_id").agg(F.array_join(F.array_sort(F.collect_set(token)), "").alias("t"))
    text = table(spark, d, "documents").select(F.col("doc_id").alias("plasmid_id"), F.col("text").alias("sequence"))
    pairs = asked.join(text, "plasmid_id").select(F.col("plasmid_id").alias("id"), F.concat(F.lit("<BOS>"), "t", F.lit("<SEQ>")).alias("prompt"), "sequence")
    return AlignmentScorer(lookup).detail(pairs).drop("per_motif").withColumnRenamed("id", "plasmid_id")


@query()
def align_repair_all(spark, d):
    """Sequences whose weak hits (identity 90 or more, coverage 40 to 85; the best of each motif) are replaced by the motifs, from the right, overlapping ones left out."""
    return _repaired(motifs(spark, d), sequences(spark, d))


def _repaired(m, s):
    hit = candidate_pairs(m, s).select("plasmid_id", "sseqid", "motif", align.semi_global_hit("motif", "sequence").alias("h"))
    n = F.length("motif")
    weak = hit.where((100 * F.col("h.matches") / F.greatest(F.col("h.matches") + F.col("h.mismatches"), F.lit(1)) >= 90) & (100 * F.col("h.matches") / n >= 40) & (100 * F.col("h.matches") / n < 85))
    listed = weak.groupBy("plasmid_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("h.start")).alias("from_right"), "sseqid", F.col("h.start").alias("start"), F.col("h.end").alias("end"), "motif"))).alias("r"))
    return dna.splice(listed.join(s, "plasmid_id"), "sequence", "r").select("plasmid_id", "repaired", "n_repairs")


