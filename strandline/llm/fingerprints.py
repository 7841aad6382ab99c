"""Document fingerprints by consistent weighted sampling, with column functions only.

A text's terms are its lower-cased words, weighted by how often they occur. For
each of k samples, every term draws r and c from Gamma(2, 1) and b from [0, 1)
by hashing; with t = floor(ln w / r + b) the term's level is
ln c - r (t - b + 1), and the sample is the (term, t) of lowest level. Two texts
agree in a sample with probability sum(min(w, w')) / sum(max(w, w')), the
generalised Jaccard similarity.

Neighbours in the order of doc_id are found within ranges of ids, cut at the
quantiles of a bounded sample. Each range also gets a copy of the first document
of the next one, so no range needs a look outside and the only shuffle of texts
is by range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_GAP

#: Samples of a fingerprint: the likeness has a standard error of 0.0625 at most.
SAMPLES = 64
#: Samples are drawn by so many aggregates, over so many turns a term; a generated method of more would be too long to be compiled.
AGGREGATES = 16
#: Documents of a range of ids, ranges of a partition, and ranges at most (their first ids are broadcast, 24 bytes each).
RANGE_DOCS, RANGES_PER_PART, MAX_RANGES = 400, 4, 1 << 16
#: Ids that are sampled per range to cut the ranges (16 bytes each).
SAMPLED = 8
#: Cuts are searched as a tree of so many branches.
_FAN = 64
#: Gamma(2, 1) is drawn as one of 1024 equally likely quantiles; of r, the uppermost step is drawn exactly, as its tail decides.
_STEPS = 1024


def _quantiles(want: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution is 1 - (1 + x) exp(-x), by bisection."""
    low, high = np.zeros(len(want)), np.full(len(want), 40.0)
    for _ in range(80):
        mid = (low + high) / 2
        under = 1 - (1 + mid) * np.exp(-mid) < want
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    return (low + high) / 2


_MIDDLES = _quantiles((np.arange(_STEPS) + 0.5) / _STEPS)
_TAIL = float(_quantiles(np.array([1 - 1 / _STEPS]))[0])


def sample(term: Column, log_weight: Column, k: Column) -> Column:
    """Level and identity of a term in sample k in one long: the lower the level the lower the number; the low 20 bits tell (term, t)."""
    h = F.xxhash64(term, k)
    more = F.xxhash64(term, -1 - k)
    unit = lambda bits: (bits.cast("double") + 0.5) / float(1 << 24)
    part = lambda x, shift: F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << 24) - 1))
    # beyond the last step, r exceeds it by Exp(1), or by the sum of two with probability 1 / (1 + step)
    tail = _TAIL - F.log(unit(part(more, 40))) - F.when(unit(part(more, 20)) < 1 / (1 + _TAIL), F.log(unit(part(more, 0)))).otherwise(0.0)
    at = F.shiftrightunsigned(h, 54).cast("int")
    r = F.when(at < _STEPS - 1, F.get(F.lit(_MIDDLES), at)).otherwise(tail)
    log_c = F.get(F.lit(np.log(_MIDDLES)), F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(_STEPS - 1)).cast("int"))
    b = part(h, 20).cast("double") / float(1 << 24)
    t = F.floor(log_weight / r + b)
    level = log_c - r * (t.cast("double") - b + 1.0)
    tag = (h + t * F.lit(0x9E375)).bitwiseAND(F.lit((1 << 20) - 1))
    return F.shiftleft(((level + 256.0) * float(1 << 34)).cast("long"), 20).bitwiseOR(tag)


def _agreement(a: Column, b: Column, k: int) -> Column:
    """Share of equal samples; two empty texts agree wholly, an empty and another not at all."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / float(k)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def cuts_of(docs: DataFrame, ranges: int, n: int) -> list[tuple[int, int]]:
    """The first (id, salt) of each range but the first, in the order of ids falling and salts rising; from a sample of SAMPLED rows a range."""
    share = min(1.0, SAMPLED * ranges / max(1, n))
    keys = docs.select("id", "salt")
    sample = sorted(((-r["id"], r["salt"]) for r in (keys if share == 1.0 else keys.sample(False, share, 7)).collect()))  # some SAMPLED * MAX_RANGES rows at most
    return [(-i, s) for i, s in (sample[len(sample) * k // ranges] for k in range(1, ranges))] if sample else []


def range_of(cuts: list[tuple[int, int]]) -> Column:
    """How many cuts are not after a row's (id, salt): its range, found level by level."""
    levels = [cuts]
    while len(levels[-1]) >= _FAN:
        levels.append(levels[-1][_FAN - 1 :: _FAN])
    at = F.lit(0)
    for level in reversed(levels):
        if not level:
            continue
        ids, salts = (F.lit(np.array([c[i] for c in level], np.int64)) for i in range(2))
        salt = F.slice(salts, at * _FAN + 1, _FAN)
        not_after = F.filter(F.slice(ids, at * _FAN + 1, _FAN), lambda x, i: (x > F.col("id")) | ((x == F.col("id")) & (F.get(salt, i) <= F.col("salt"))))  # noqa: B023
        at = at * _FAN + F.size(not_after)
    return at.cast("int")


def fingerprints(docs: DataFrame, k: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many (or all) of the next document, in descending order of doc_id;
    the first follows the last. Null texts are empty. Rows of equal doc_id are
    ordered by a hash of their text, and a null doc_id counts as the smallest
    64-bit number, so many rows of one id, or of none, spread over ranges; only
    fully repeated rows stay together. Each repeated row gets its row. A text
    without words has the fingerprint ''. An empty table gives no rows, and a
    single document follows itself. Other columns, whatever their names, are
    dropped.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("salt"))
    n_docs = docs.count()
    ranges = max(1, min(MAX_RANGES, -(-n_docs // RANGE_DOCS)))
    parts = max(1, -(-ranges // RANGES_PER_PART))
    ranged = docs.withColumn("range", range_of(cuts_of(docs, ranges, n_docs)))
    heads = ranged.groupBy("range").agg(F.min(F.struct((-1 - F.col("id")).alias("down"), "salt")).alias("head"))  # -1 - id falls as id rises, without overflow
    order = Window.orderBy("range")  # one row a range, MAX_RANGES at most
    last = F.row_number().over(order) == F.count("*").over(Window.partitionBy())
    heads = heads.select("range", F.when(last, F.first("head").over(order)).otherwise(F.lead("head").over(order)).alias("head"))
    heads = heads.select("range", (-1 - F.col("head.down")).alias("head_id"), F.col("head.salt").alias("head_salt"))
    copies = docs.join(F.broadcast(heads), (docs["id"] == F.col("head_id")) & (docs["salt"] == F.col("head_salt"))).dropDuplicates(["range"])  # a text a range
    rows = ranged.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "text", "id", "salt", "range", F.lit(True).alias("copy"))).repartition(parts, "range")
    order = Window.partitionBy("range").orderBy("copy", F.col("id").desc(), "salt", F.col("doc_id").desc_nulls_last(), "text")
    n = F.length("text")
    edited = F.concat(F.col("text").substr(F.lit(1), n - F.floor(n / 2).cast("int")), F.col("next").substr(F.lit(1), F.floor(n / 2).cast("int")))
    rows = rows.withColumn("next", F.lead("text").over(order)).withColumn("at", F.row_number().over(order))
    rows = rows.withColumn("edited", F.when(~F.col("copy"), edited))
    digest = F.sha2("edited", 256)
    words = lambda text: F.array_remove(F.split(F.lower(text), WORD_GAP), "")
    quarters = [F.conv(F.substring(digest, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    sides = F.array(F.struct(F.lit(0).alias("side"), words(F.col("text")).alias("words")), F.struct(F.lit(1).alias("side"), words(F.col("edited")).alias("words")))
    rows = rows.select("range", "at", "copy", "doc_id", n.cast("long").alias("n_chars"), *quarters, F.explode(sides).alias("s"))
    rows = rows.where(~F.col("copy") | (F.col("s.side") == 0))
    keep = ["copy", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3"]
    terms = rows.select("range", (F.col("at") * 2 + F.col("s.side")).alias("at"), *keep, F.explode_outer("s.words").alias("word"))
    terms = terms.withColumn("copy", F.col("copy").cast("int")).withColumn("term", F.when(F.col("word").isNotNull(), F.xxhash64("word"))).drop("word")
    weighted = terms.groupBy("range", "at", "term").agg(F.count("*").alias("w"), *[F.max(c).alias(c) for c in keep])
    turns = -(-k // AGGREGATES)
    drawn = weighted.withColumn("log_w", F.log(F.col("w").cast("double"))).withColumn("turn", F.explode(F.array(*[F.lit(i) for i in range(turns)])))
    levels = [F.min(sample(F.col("term"), F.col("log_w"), F.col("turn") * AGGREGATES + i)).alias(f"m{i}") for i in range(AGGREGATES)]
    found = drawn.groupBy("range", "at", "turn").agg(*[F.max(c).alias(c) for c in keep], F.max("term").alias("some"), *levels)
    # turns times two sides make a document's rows; those of the next document follow
    low_bits = F.lit((1 << 20) - 1)
    order = Window.partitionBy("range").orderBy("at", "turn")
    part = F.when(F.col("some").isNotNull(), F.array(*[F.col(f"m{i}").bitwiseAND(low_bits).cast("int") for i in range(AGGREGATES)]))
    found = found.select("range", "at", "turn", *keep, part.alias("part"))
    found = found.withColumn("text", F.coalesce(F.array_join(F.transform("part", lambda x: F.lpad(F.lower(F.hex(x)), 5, "0")), ""), F.lit("")))
    edited_part, next_part = F.lead("part", turns).over(order), F.lead("part", 2 * turns).over(order)
    found = found.withColumn("like_edited", _agreement(F.col("part"), edited_part, AGGREGATES)).withColumn("like_next", _agreement(F.col("part"), next_part, AGGREGATES))
    ahead = lambda c, i: F.lead(c, i).over(order) if i else F.col(c)
    mean = lambda c: sum((ahead(c, i) for i in range(1, turns)), F.col(c)) / float(turns)
    found = found.select(
        "turn", "at", *keep, F.concat(*[ahead("text", i) for i in range(turns)]).alias("fingerprint"), F.concat(*[ahead("text", turns + i) for i in range(turns)]).alias("edited_fingerprint"),
        mean("like_edited").alias("near_edited"), mean("like_next").alias("near_next"),
    )
    found = found.where((F.col("copy") == 0) & (F.col("at") % 2 == 0) & (F.col("turn") == 0))
    sha = F.concat(*[F.lower(F.lpad(F.hex(f"sha{i}"), 16, "0")) for i in range(4)])
    return found.select("doc_id", "n_chars", sha.alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
