"""Queries over sequences, intervals, alignments and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import dna, tokens
from strandline.operators import align, intervals, scoring
from strandline.operators.order import checkpoint, spread
from strandline.operators.scan import affine_scan

from .relational import ORACLE_SQL, QUERIES, query
from .views import annotations, hits, motifs, registry, sequences, table


#: k-mers of motifs that are broadcast at most (some 60 bytes each).
BROADCAST_KMERS = 1_000_000
#: Bases of a piece of a sequence whose k-mers are listed at a time.
PIECE = 1000
#: Hashes of k-mers have so many bits, and bases that are hashed at a time.
FLAG_BITS, BLOCK = 24, 1 << 18


@query("SELECT plasmid_id, sequence, length(sequence) AS n FROM seqs")
def seq_clean(spark, d):
    return sequences(spark, d).select("plasmid_id", "sequence", F.length("sequence").cast("long").alias("n"))


@query("SELECT item_id, regexp_replace(upper(array_to_string(list_filter(string_split(replace(text, 'ß', 'SS'), chr(10)), lambda x: NOT starts_with(x, '>')), '')), '[^ATGCNRYSWKMBDHV]', '', 'g') AS sequence FROM benchmark")
def seq_clean_iupac(spark, d):
    return table(spark, d, "benchmark").select("item_id", dna.clean_iupac(F.col("text")).alias("sequence"))


@query("SELECT plasmid_id, reverse(translate(sequence, 'ACGTN', 'TGCAN')) AS rc FROM seqs")
def seq_revcomp(spark, d):
    return sequences(spark, d).select("plasmid_id", dna.reverse_complement(F.col("sequence")).alias("rc"))


def _frame(seq: str, frame: int) -> str:
    s = f"substring({seq}, {frame + 1})"
    letter = "CASE WHEN contains(substring(s, 3*i+1, 3), 'N') THEN 'X' ELSE replace(substring('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (16 * (instr('TCAG', substring(s, 3*i+1, 1)) - 1) + 4 * (instr('TCAG', substring(s, 3*i+2, 1)) - 1) + instr('TCAG', substring(s, 3*i+3, 1)))::INT, 1), '*', 'X') END".replace("(s,", f"({s},")
    return f"CASE WHEN length({s}) >= 3 THEN array_to_string(list_transform(range(0, length({s}) // 3), lambda i: {letter}), '') END"


@query(", x AS (SELECT sseqid, motif, reverse(translate(motif, 'ACGTN', 'TGCAN')) AS back FROM mot) SELECT sseqid, [" + ", ".join(_frame(s, k) for k in range(3) for s in ("motif", "back")) + "] AS frames FROM x")
def seq_translate_six(spark, d):
    return _frames(motifs(spark, d))


def _frames(m):
    return m.select("sseqid", dna.six_frames(F.col("motif")).alias("frames"))


@query(", m AS (SELECT DISTINCT sseqid, unnest(list_transform(range(1, greatest(length(motif) - 13, 1)), lambda i: substring(motif, i, 15))) AS k FROM mot WHERE length(motif) >= 15), n AS (SELECT sseqid, count(*) AS n FROM m GROUP BY 1), s AS (SELECT DISTINCT plasmid_id, unnest(list_transform(range(1, greatest(length(sequence) - 13, 1)), lambda i: substring(sequence, i, 15))) AS k FROM seqs WHERE length(sequence) >= 15) SELECT plasmid_id, sseqid, count(*) AS common, n FROM s JOIN m USING (k) JOIN n USING (sseqid) GROUP BY 1, 2, n HAVING count(*) >= 0.15 * n")
def seq_kmer_containment(spark, d):
    return kmer_candidates(motifs(spark, d), sequences(spark, d))


def _kmer_flags(letters, k):
    """A hash of FLAG_BITS bits of the k-mer at each place of the letters (bytes)."""
    n = len(letters) - k + 1
    code = np.zeros(max(n, 0), np.uint64)
    for i in range(k if n > 0 else 0):
        code *= np.uint64(0x9E3779B97F4A7C15)
        code += letters[i : i + n]
    return (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FLAG_BITS)


def known_kmers(s, known, k):
    """plasmid_id and k: the k-mers of the sequences (ASCII) that may be among the known ones (a column k).

    Tasks get one flag for each hash. k-mers whose flag isn't set are
    dropped where they are read; a join tells the few others that aren't known.
    """

    def flags(batches):
        for batch in batches:
            words = "".join(batch.column(0).to_pylist()).encode("ascii", "replace")
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_kmer_flags(np.frombuffer(words, np.uint8), k)[::k]).astype(np.int32))], ["flag"])

    bits = np.zeros(1 << FLAG_BITS, bool)
    bits[[r["flag"] for r in known.select("k").mapInArrow(flags, "flag int").distinct().collect()]] = True  # a row a known k-mer, BROADCAST_KMERS at most
    bits = np.packbits(bits)

    def run(batches):
        for batch in batches:
            seqs = [x.encode("ascii", "replace") for x in batch.column(1).to_pylist()]
            sizes = np.array(list(map(len, seqs)))
            block = np.cumsum(sizes) // BLOCK
            for b in np.unique(block):
                rows = np.flatnonzero(block == b)
                letters = np.frombuffer(b"".join(seqs[r] for r in rows), np.uint8)
                flag = _kmer_flags(letters, k)
                at = np.flatnonzero(bits[flag >> np.uint64(3)] >> (7 - (flag & np.uint64(7))).astype(np.uint8) & 1)
                ends = np.cumsum(sizes[rows])
                of = np.searchsorted(ends, at, side="right")
                within = at + k <= ends[of]
                at, of = at[within], of[within]
                data = letters[at[:, None] + np.arange(k)].tobytes()
                text = pa.StringArray.from_buffers(len(at), pa.py_buffer((np.arange(len(at) + 1) * k).astype(np.int32)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[of])), text], ["plasmid_id", "k"])

    s = s.select("plasmid_id", "sequence")
    return s.mapInArrow(run, T.StructType([s.schema["plasmid_id"], T.StructField("k", T.StringType())]))


def kmer_candidates(m, s, k=15, share=0.15):
    """Pairs of sequence and motif that share enough of the motif's k-mers.

    k-mers meet the motifs' k-mers before anything is deduplicated, so only k-mers
    of motifs are ever shuffled. Where these are many, sequences are cut into
    pieces that overlap by k - 1, and all their k-mers are listed and joined.
    """
    m = m.select("sseqid", F.explode(dna.kmers(F.col("motif"), k)).alias("k"))
    n = m.groupBy("sseqid").agg(F.count("*").alias("n"))
    known = checkpoint(m.select("k").distinct())
    s = s.where(F.length("sequence") >= k)
    if known.count() <= BROADCAST_KMERS:
        known, s = F.broadcast(known), known_kmers(s, known, k)
    else:
        starts = F.explode(F.sequence(F.lit(1), F.greatest(F.length("sequence") - k + 1, F.lit(1)), F.lit(PIECE)))
        s = s.select("plasmid_id", "sequence", starts.alias("i")).select("plasmid_id", F.substr("sequence", F.col("i"), F.lit(PIECE + k - 1)).alias("piece"))
        s = s.select("plasmid_id", F.explode(F.regexp_extract_all("piece", F.lit(f"(?=(.{{{k}}}))"), F.lit(1))).alias("k"))
    found = s.join(known, "k", "left_semi").distinct()
    return found.join(m, "k").groupBy("plasmid_id", "sseqid").agg(F.count("*").alias("common")).join(n, "sseqid").where(F.col("common") >= share * F.col("n")).select("plasmid_id", "sseqid", "common", "n")


@query("SELECT sseqid, list_transform(range(0, (ceil(greatest(length(motif) - 6, 0) / 3)::INT + 1)), lambda i: rpad(substring(motif, (3 * i + 1)::INT, 6), 6, 'A')) AS parts FROM mot WHERE length(motif) > 0")
def seq_kmerize(spark, d):
    return _kmerize(motifs(spark, d))


def _kmerize(m):
    return m.where("length(motif) > 0").select("sseqid", dna.kmerize(F.col("motif"), 6, 3).alias("parts"))


@query("SELECT sseqid, rpad(motif, (6 + 3 * ceil(greatest(length(motif) - 6, 0) / 3))::INT, 'A') AS decoded FROM mot WHERE length(motif) > 0")
def seq_kmer_decode(spark, d):
    return _kmer_decode(motifs(spark, d))


def _kmer_decode(m):
    return m.where("length(motif) > 0").select("sseqid", dna.kmer_decode(dna.kmerize(F.col("motif"), 6, 3), 3).alias("decoded"))


@query("SELECT sseqid, array_to_string(list_transform(string_split(motif, ''), lambda c, i: CASE WHEN c = 'N' THEN substring('ACGT', ((instr('0123456789abcdef', right(md5((i - 1)::VARCHAR), 1)) - 1) % 4 + 1)::INT, 1) ELSE c END), '') AS filled FROM mot WHERE length(motif) > 0")
def seq_n_replace(spark, d):
    return _n_replace(motifs(spark, d))


def _n_replace(m):
    return m.where("length(motif) > 0").select("sseqid", dna.fill_n(F.col("motif")).alias("filled"))


@query(", e AS (SELECT sseqid, [2, 3, 5] AS p, list_transform(string_split(motif, ''), lambda c: instr('ACGTN', c) + 10) AS c FROM mot WHERE length(motif) > 0), i AS (SELECT sseqid, list_slice(list_concat(list_concat(p, c), [1]), 1, 40) AS ids FROM e) SELECT sseqid, list_concat(ids, list_transform(range(0, 40 - len(ids)), lambda x: 0))::INT[] AS input_ids, list_concat(list_concat([-100, -100, -100], list_slice(ids, 4, 40)), list_transform(range(0, 40 - len(ids)), lambda x: -100))::INT[] AS labels FROM i")
def seq_encode_sample(spark, d):
    ids = F.transform(F.split("motif", ""), lambda c: F.locate("A", c) * 1 + F.locate("C", c) * 2 + F.locate("G", c) * 3 + F.locate("T", c) * 4 + F.locate("N", c) * 5 + 10)
    inputs, _, labels = dna.encode_sample(F.array(*[F.lit(x) for x in (2, 3, 5)]), ids, 40, 1, 0)
    return motifs(spark, d).where("length(motif) > 0").select("sseqid", inputs.alias("input_ids"), labels.alias("labels"))


@query("SELECT DISTINCT token, lower(md5(token)) AS md5_hex, sha1(token) AS sha1_hex, sha256(token) AS sha2_hex FROM reg")
def str_hash_digests(spark, d):
    t = registry(spark, d).select("token").distinct()
    raw = F.col("token").cast("binary")
    return t.select("token", F.md5(raw).alias("md5_hex"), F.sha1(raw).alias("sha1_hex"), F.sha2(raw, 256).alias("sha2_hex"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&') AS plain, upper(regexp_replace(url, '\\s', '', 'g')) AS packed, CASE WHEN starts_with(url, 'https') THEN url ELSE '<BOS>' || url END AS prompt FROM pages")
def str_cleaners(spark, d):
    plain = F.col("url")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return table(spark, d, "pages").select("page_id", plain.alias("plain"), F.upper(F.regexp_replace("url", r"\s", "")).alias("packed"), F.when(F.col("url").startswith("https"), F.col("url")).otherwise(F.concat(F.lit("<BOS>"), "url")).alias("prompt"))


_IOU = "greatest(least(k.hi, h.hi) - greatest(k.lo, h.lo) + 1, 0) / (k.hi - k.lo + 1 + h.hi - h.lo + 1 - greatest(least(k.hi, h.hi) - greatest(k.lo, h.lo) + 1, 0))"


def _nms(key: str, limit: float) -> str:
    return f", g AS (SELECT {key}, list({{'lo': lo, 'hi': hi, 'id': event_id}} ORDER BY value DESC, event_id) AS spans FROM hit GROUP BY {key}), k AS (SELECT {key}, list_reduce(spans, lambda kept, h: CASE WHEN len(list_filter(kept, lambda k: {_IOU} >= {limit})) > 0 THEN kept ELSE list_append(kept, h) END, []::STRUCT(lo INT, hi INT, id BIGINT)[]) AS kept FROM g) SELECT {key}, unnest(list_transform(kept, lambda x: x.id)) AS event_id FROM k"


@query(_nms("user_id, event_type", 0.5))
def interval_nms_token(spark, d):
    """Hits that stay within their user and type."""
    return intervals.suppress(hits(spark, d), ["user_id", "event_type"], 0.5)


@query(_nms("user_id", 0.3))
def interval_nms_global(spark, d):
    """Hits that stay among all of their user."""
    return intervals.suppress(hits(spark, d), ["user_id"], 0.3)


@query()
def interval_ori_loci(spark, d):
    """Loci of overlapping hits with their bounds, best score and number of members, numbered within the user."""
    found = loci(hits(spark, d).where("event_type = 'error'"), ["user_id"], F.max("value").alias("best"), F.count("*").alias("members"))
    return found.select("user_id", "locus", "lo", "hi", "best", "members")


def loci(h, keys, *columns):
    """Loci of hits by keys: locus (from 0 in their order), lo, hi and the given aggregates over their members."""
    found = intervals.cluster_loci(h, keys).groupBy(*keys, "island", "cluster").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), *columns)
    one = F.lit(1.0)
    return affine_scan(found.withColumn("one", one), keys, ["island", "cluster"], "one", "one", "nth").withColumn("locus", (F.col("nth") - 1).cast("int"))


@query("SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id, greatest(b.lo - a.hi, a.lo - b.hi, 0) AS gap FROM hit a JOIN hit b ON a.user_id = b.user_id WHERE a.event_type = 'click' AND b.event_type = 'error' AND greatest(b.lo - a.hi, a.lo - b.hi, 0) <= 50")
def interval_adjacency(spark, d):
    h = hits(spark, d).withColumnRenamed("event_id", "id")
    return intervals.near_pairs(h.where("event_type = 'click'"), h.where("event_type = 'error'"), "user_id", 50)


@query("SELECT plasmid_id, round(1 + 0.05 * p - 0.15 * greatest(o - 1, 0) - 0.1 * greatest(a - 2, 0) - 0.05 * x - least(0.01 * greatest(n - 8000, 0) / 1000, 0.15), 6)::DOUBLE AS multiplier FROM (SELECT plasmid_id, count(*) FILTER (WHERE category = 'ORI') AS o, count(*) FILTER (WHERE category = 'AMR') AS a, count(*) FILTER (WHERE category = 'TAG') AS x, count(*) FILTER (WHERE category = 'PROM') AS p, sum(qend - qstart) * 10 AS n FROM ann JOIN reg USING (sseqid) GROUP BY 1)")
def score_structural(spark, d):
    of = lambda c: F.count_if(F.col("category") == c)
    a = annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("plasmid_id").agg(of("ORI").alias("o"), of("AMR").alias("a"), of("TAG").alias("x"), of("PROM").alias("p"), (F.sum(F.col("qend") - F.col("qstart")) * 10).alias("n"))
    return a.select("plasmid_id", F.round(scoring.structural_multiplier(F.col("o"), F.col("a"), F.col("x"), F.col("n"), F.col("p")), 6).alias("multiplier"))


@query(", q AS (SELECT plasmid_id, 0.4::DOUBLE * pident / 100 + 0.35::DOUBLE * least(percmatch, 100) / 100 + 0.25::DOUBLE * least(percmatch / 100 / 1.5::DOUBLE, 1) AS q, percmatch >= 50 AS f FROM ann) SELECT plasmid_id, round(exp(avg(ln(greatest(q, 1e-6)))), 10) AS geo, round(count(*) FILTER (WHERE f) / count(*), 10) AS recall, round(pow(exp(avg(ln(greatest(q, 1e-6)))), 2) * (0.5::DOUBLE + 0.5::DOUBLE * (count(*) FILTER (WHERE f) / count(*))), 10) AS composite FROM q GROUP BY 1")
def score_composite(spark, d):
    q = annotations(spark, d).select("plasmid_id", scoring.token_quality(F.col("pident"), F.least("percmatch", F.lit(100.0)), F.col("percmatch") / 100).alias("q"), (F.col("percmatch") >= 50).alias("f"))
    geo, recall, total = scoring.composite("q", F.count_if("f"), F.count("*"))
    return q.groupBy("plasmid_id").agg(F.round(geo, 10).alias("geo"), F.round(recall, 10).alias("recall"), F.round(total, 10).alias("composite"))


@query("SELECT plasmid_id, round(pow(0.85::DOUBLE, greatest(count(*) FILTER (WHERE category = 'ORI') - 1, 0)) * pow(0.95::DOUBLE, greatest(count(*) FILTER (WHERE category = 'ELEM') - 1, 0)), 8) AS score FROM ann JOIN reg USING (sseqid) GROUP BY 1")
def score_demo_duplicates(spark, d):
    extra = lambda c: F.greatest(F.count_if(F.col("category") == c) - 1, F.lit(0))
    return annotations(spark, d).join(registry(spark, d), "sseqid").groupBy("plasmid_id").agg(F.round(F.pow(F.lit(0.85), extra("ORI")) * F.pow(F.lit(0.95), extra("ELEM")), 8).alias("score"))


@query("SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'queque')::INT) / 3, 8) AS score FROM documents")
def score_substring(spark, d):
    found = sum(F.contains(F.lower("text"), F.lit(x)).cast("int") for x in ("the", "and", "queque"))
    return table(spark, d, "documents").select("doc_id", F.round(found / 3, 8).alias("score"))


@query("SELECT doc_id, round(CASE WHEN n > 3500 THEN greatest(0.5, 1 - 0.3 * (n - 3500) / 3500.0::DOUBLE) ELSE 1 END + 0.15, 6)::DOUBLE AS reward FROM (SELECT doc_id, length(text) AS n FROM documents)")
def score_length_shaped(spark, d):
    n = F.length("text")
    return table(spark, d, "documents").select("doc_id", F.round(F.when(n > 3500, F.greatest(F.lit(0.5), 1 - 0.3 * (n - 3500) / F.lit(3500.0))).otherwise(1.0) + 0.15, 6).alias("reward"))


def candidate_pairs(m, s):
    """kmer_candidates with motif and sequence, spread for the alignments to come."""
    pairs = kmer_candidates(m, s).select("plasmid_id", "sseqid")
    return spread(pairs.join(m, "sseqid").join(s, "plasmid_id"), "plasmid_id", "sseqid")


@query()
def align_local_ratio(spark, d):
    c = candidate_pairs(motifs(spark, d), sequences(spark, d))
    return c.select("plasmid_id", "sseqid", F.greatest(align.local_ratio("motif", "sequence"), align.local_ratio(dna.reverse_complement(F.col("motif")), "sequence")).alias("ratio"))


@query()
def align_semiglobal(spark, d):
    c = candidate_pairs(motifs(spark, d), sequences(spark, d))
    hit = c.select("plasmid_id", "sseqid", F.length("motif").alias("n"), align.semi_global_hit("motif", "sequence").alias("h"))
    return hit.select("plasmid_id", "sseqid", "h.*", (100 * F.col("h.matches") / F.greatest(F.col("h.matches") + F.col("h.mismatches"), F.lit(1))).alias("pct_id"), (100 * F.col("h.matches") / F.col("n")).alias("coverage"), (F.col("h.score") / F.col("n")).alias("norm_score"))


@query()
def align_repair(spark, d):
    """Sequences whose best weak hit (identity 90 or more, coverage 40 to 85) is replaced by the motif."""
    h = align_semiglobal(spark, d).where("pct_id >= 90 and coverage >= 40 and coverage < 85")
    best = h.groupBy("plasmid_id").agg(F.max_by(F.struct("sseqid", "start", "end"), F.struct("norm_score", "sseqid")).alias("b")).select("plasmid_id", "b.*")
    s = best.join(sequences(spark, d), "plasmid_id").join(motifs(spark, d), "sseqid")
    return s.select("plasmid_id", "sseqid", F.concat(F.col("sequence").substr(F.lit(1), F.col("start")), "motif", F.col("sequence").substr(F.col("end") + 1, F.length("sequence"))).alias("repaired"))


@query("SELECT round(avg(CASE WHEN p.n > q.n THEN 1.0::DOUBLE WHEN p.n = q.n THEN 0.5::DOUBLE ELSE 0 END), 8) AS auroc FROM (SELECT n_chars AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1) p, (SELECT n_chars AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0) q")
def agg_separation_auroc(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("n_chars", "quality")
    return scoring.auroc(x, "n_chars", "quality").select(F.round("auroc", 8).alias("auroc"))


@query("SELECT quality, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.25), 4) AS q1, round(quantile_cont(n_chars, 0.75), 4) AS q3 FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg_separation_iqr(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("quality", "n_chars")
    mean = x.groupBy("quality").agg(F.round(F.avg("n_chars"), 6).alias("mean"))
    q = scoring.quantiles(x, "n_chars", {"q1": 0.25, "q3": 0.75}, ["quality"])
    return mean.join(q, mean["quality"].eqNullSafe(q["quality"])).select(mean["quality"], "mean", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"))


@query("SELECT conv_id, round(avg((length(text) % 7 = turn % 7)::INT) FILTER (WHERE role <> 'user'), 8) AS accuracy, round(exp(least(avg(length(text)) / 100, 20)), 4) AS perplexity FROM conversations GROUP BY 1")
def agg_masked_accuracy(spark, d):
    right = (F.length("text") % 7 == F.col("turn") % 7).cast("int")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.when(F.col("role") != "user", right)), 8).alias("accuracy"), F.round(F.exp(F.least(F.avg(F.length("text")) / 100, F.lit(20))), 4).alias("perplexity"))


@query(", e AS (SELECT vec_id, unnest(range(0, 64)) AS expert, unnest(embedding) AS v FROM embeddings), t AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, expert) <= 2) SELECT expert::INT AS expert, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM t GROUP BY 1")
def agg_router_histogram(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v).alias("v"), i.alias("i")))).alias("t"))
    n = e.select(F.explode(F.slice("t", 1, 2)).alias("x")).groupBy(F.col("x.i").alias("expert")).agg(F.count("*").alias("n"))
    return n.select("expert", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 8).alias("share"))  # 64 rows


@query("SELECT label, (unnest(range(0, 64)))::INT AS pos, unnest(m) AS mean FROM (SELECT label, [" + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 5)" for i in range(64)) + "] AS m FROM embeddings GROUP BY 1)")
def agg_elementwise_mean(spark, d):
    return table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


@query(", s AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM s) SELECT vec_id, round(-list_sum(list_transform(p, lambda x: x * ln(x))), 6) AS entropy, round(ln(p[1]), 6) AS logp FROM p")
def kl_entropy(spark, d):
    p = scoring.softmax(F.transform("embedding", lambda x: x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", F.round(-F.aggregate("p", F.lit(0.0), lambda a, x: a + x * F.ln(x)), 6).alias("entropy"), F.round(F.ln(F.col("p")[0]), 6).alias("logp"))


@query(", x AS (SELECT conv_id, turn, length(text) / 1000.0::DOUBLE AS r, exp(turn / 100.0::DOUBLE) AS q FROM conversations) SELECT conv_id, round(-avg(least(q * r, least(greatest(q, 0.8::DOUBLE), 1.2::DOUBLE) * r)), 6) AS ppo, round(-avg(r * turn / 100.0::DOUBLE), 6) AS reinforce, round(avg(exp(r - q) - (r - q) - 1), 6) AS kl FROM x GROUP BY 1")
def loss_reinforce_ppo_grpo(spark, d):
    x = table(spark, d, "conversations").select("conv_id", "turn", (F.length("text") / F.lit(1000.0)).alias("r"), F.exp(F.col("turn") / F.lit(100.0)).alias("q"))
    return x.groupBy("conv_id").agg(F.round(-F.avg(scoring.clipped_surrogate(F.col("q"), F.col("r"))), 6).alias("ppo"), F.round(-F.avg(F.col("r") * F.col("turn") / F.lit(100.0)), 6).alias("reinforce"), F.round(F.avg(scoring.kl_estimate(F.col("r"), F.col("q"))), 6).alias("kl"))


@query("SELECT conv_id, round(ln(1 + exp(-0.1::DOUBLE * (max(length(text)) - min(length(text))) / 100)), 6) AS loss FROM conversations GROUP BY 1")
def loss_dpo(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.round(scoring.pair_loss(F.max(n) / 100, F.min(n) / 100), 6).alias("loss"))


@query("SELECT event_id, round(CASE WHEN event_id < 500 THEN 0.001::DOUBLE * event_id / 500 ELSE 0.001::DOUBLE * 0.5 * (1 + cos(3.141592653589793::DOUBLE * least((event_id - 500) / 9500.0::DOUBLE, 1))) END, 9) AS lr FROM events")
def math_lr_schedule(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scoring.warm_cosine(F.col("event_id"), 500, 10_000, 0.001), 9).alias("lr"))


@query()
def uuid5_tokens(spark, d):
    return registry(spark, d).select("token").distinct().select("token", dna.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("token")).alias("uuid"))


@query()
def seq_corrupt(spark, d):
    """Sequences with seeded substitutions, deletions and insertions, and how many of each."""
    @F.pandas_udf("corrupted string, substituted int, deleted int, inserted int")
    def corrupt(ids: pd.Series, seqs: pd.Series) -> pd.DataFrame:
        out = []
        for i, s in zip(ids, seqs, strict=True):
            if s is None:
                out.append((None, 0, 0, 0))
                continue
            draw = np.random.default_rng(0 if pd.isna(i) else int(i) % (1 << 64))
            x = np.frombuffer(s.encode(), np.uint8).copy()
            swap = draw.random(len(x)) < 0.05
            x[swap] = np.frombuffer(b"ACGT", np.uint8)[draw.integers(0, 4, swap.sum())]
            gone = (draw.random(len(x)) < 0.02) & (len(x) > 100)
            x = x[~gone]
            at = draw.integers(0, len(x) + 1, len(x) // 500 + 1 if len(x) > 100 else 0)
            runs = draw.integers(1, 16, len(at))
            x = np.insert(x, np.repeat(at, runs), np.frombuffer(b"ACGT", np.uint8)[draw.integers(0, 4, runs.sum())])
            out.append((x.tobytes().decode(), int(swap.sum()), int(gone.sum()), int(runs.sum())))
        return pd.DataFrame(out, columns=["corrupted", "substituted", "deleted", "inserted"])

    return sequences(spark, d).select("plasmid_id", corrupt("plasmid_id", "sequence").alias("c")).select("plasmid_id", "c.*")


@query("SELECT sseqid, CASE WHEN regexp_matches(token, '^<(VEC|BB|COPY|SP|AMR|ORI|PROM|ELEM|REPORTER|TAG)_') THEN 'annotation' WHEN starts_with(token, '<') THEN 'structural' ELSE 'dna' END AS kind FROM reg")
def token_kinds(spark, d):
    pattern = "^<(" + "|".join(tokens.CATEGORY_ORDER) + ")_"
    return registry(spark, d).select("sseqid", F.when(F.col("token").rlike(pattern), "annotation").when(F.col("token").startswith("<"), "structural").otherwise("dna").alias("kind"))


# Names of earlier rounds, when the plain names read parts of their tables; both read all of them now.
for _name in ("interval_nms_token", "interval_nms_global", "seq_translate_six", "seq_kmer_containment", "seq_kmerize", "seq_kmer_decode", "seq_n_replace"):
    QUERIES[f"{_name}_whole"], ORACLE_SQL[f"{_name}_whole"] = QUERIES[_name], ORACLE_SQL[_name]
