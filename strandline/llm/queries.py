"""The queries op1 to op13 and pipeline: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, filter_audit, fingerprints, html, lines, media, mixing, ngram_join, packing, quality, substrings, urls
from .common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.bpe_digest(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of every document's payload, read back from stored chunks."""
    return media.media_columns(read(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and component of links by 5-word shingles."""
    return ngram_join.ngram_components(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix to target weights takes of every document."""
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document by a model that learns from the other folds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), quality.quality_score(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.ACCEPT).cast("int"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that windows of 20 words repeat."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that earlier lines repeat, closely or exactly."""
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page by rules, else by its host's reputation, which labels.toxic of the same id gives."""
    outcomes = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return urls.judge_urls(read(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract_main_text(read(spark, sf_dir, "pages"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens of every document, scored by how often the corpus links their ids."""
    one, two = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align_tokens(read(spark, sf_dir, "documents"), one, two)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of every source in every order, and what of it is good or toxic."""
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document's tokens, packed into sequences of 2048."""
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_fingerprints, op2_bpe, op3_media, op4_ngram_join, op5_mixing, op6_quality, op7_substrings, op8_lines, op9_urls, op10_html, op11_alignment, op12_filter_audit, op13_packing)}

ORACLE_SQL = {
    "op9_urls": r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (
  SELECT *, CASE WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
o AS (SELECT doc_id AS page_id, max(toxic) AS bad FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
q AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\.$|\.(:[0-9]*)$', '', 'g') AS site FROM r),
x AS (SELECT *, CASE WHEN regexp_matches(site, '\.(ac|co|com|edu|gob|gov|gouv|net|org)\.[^.]{2}$')
                     THEN split_part(site, '.', -2) || '.' || split_part(site, '.', -1) ELSE split_part(site, '.', -1) END AS suffix FROM q),
y AS (SELECT *, CASE WHEN suffix LIKE '%.%' THEN regexp_extract(site, '[^.]+\.[^.]+\.[^.]+$') WHEN site LIKE '%.%' THEN regexp_extract(site, '[^.]*\.[^.]*$') ELSE site END AS domain FROM x),
h AS (SELECT site, any_value(domain) AS domain, any_value(suffix) AS suffix, count(*) AS n, sum(bad)::DOUBLE AS k FROM y JOIN o USING (page_id) WHERE site <> '' GROUP BY 1),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) FROM h) AS p FROM h GROUP BY 1),
sr AS (SELECT least(greatest(coalesce(sum(pow(k - n * p, 2) - n * p * (1 - p)) / nullif(sum((n - 1) * n * p * (1 - p)), 0), 0), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) AS r FROM s0),
s AS (SELECT suffix, k + (1 - r) / r * p AS a, n - k + (1 - r) / r * (1 - p) AS b FROM s0, sr),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(a / (a + b)) AS p FROM h JOIN s USING (suffix) GROUP BY 1),
dr AS (SELECT least(greatest(coalesce(sum(pow(k - n * p, 2) - n * p * (1 - p)) / nullif(sum((n - 1) * n * p * (1 - p)), 0), 0), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) AS r FROM d0),
d AS (SELECT domain, k + (1 - r) / r * p AS a, n - k + (1 - r) / r * (1 - p) AS b FROM d0, dr),
h0 AS (SELECT site, n, k, a / (a + b) AS p FROM h JOIN d USING (domain)),
hr AS (SELECT least(greatest(coalesce(sum(pow(k - n * p, 2) - n * p * (1 - p)) / nullif(sum((n - 1) * n * p * (1 - p)), 0), 0), 1 / 1001.0::DOUBLE), 0.5::DOUBLE) AS r FROM h0),
g AS (SELECT site, k + (1 - r) / r * p AS a, n - k + (1 - r) / r * (1 - p) AS b FROM h0, hr),
z AS (SELECT y.*, coalesce(g.a, d.a, s.a) AS a, coalesce(g.b, d.b, s.b) AS b FROM y LEFT JOIN g USING (site) LEFT JOIN d ON y.domain = d.domain LEFT JOIN s ON y.suffix = s.suffix)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN a / (a + b) - 1.645::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM z
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
              regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > lowest, false)] AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT o, i AS step, o[i] AS f, list_transform(o, lambda k: chr((64 + k)::INT)) AS letters FROM o, x),
r AS (SELECT part, array_to_string(letters, '') AS filter_order, step, f, n, good, toxic, fails[f] AS hit,
             list_bool_or(list_transform(o[1:step - 1], lambda k: fails[k])) IS TRUE AS gone,
             len(list_filter(fails, lambda v: v)) AS failed FROM c, s),
g AS (SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed,
             coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant, coalesce(sum(n) FILTER (hit AND failed = 1), 0) AS unique_fails,
             coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g
""",
}
