"""Filter interaction audit: what five document filters remove, alone and in every order.

The words of every text are rows: they are counted by (document, word), then by
document. The other filters' flags join that outer, and one aggregation by part
makes 32 conditional counts, one for each set of failed filters. All 120 orders
follow from these alone.

A document is a row of docs; rows that share doc_id and text count as often as
they occur. A null text is empty, a null source is the part ''. A null doc_id is
smaller than none and has none smaller, so such a row never fails E, and labels
never meet it. Of several labels of one id, any that says 1 counts. An empty
table gives no rows. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP

#: A: words below; B: percent of distinct words below; C: percent of A-Z above; D: holds one of these; E: repeats an earlier text.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
SETS = range(1 << len(FILTERS))
#: Shares of the 120 orders in which one of n failed filters comes first.
FIRST_OF = {n: 120 // n for n in range(1, len(FILTERS) + 1)}


def word_counts(docs: DataFrame) -> DataFrame:
    """total and distinct words of every text with words, by its name (k1, k2).

    Texts move once, one row each, by their row's number: no key, however
    frequent, brings rows together, and both counts follow without a shuffle.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "k1", "k2", "text").repartition("row")
    words = rows.select("row", "k1", "k2", F.explode(F.split("text", WORD_GAP)).alias("word")).where("word <> ''")
    by_word = words.groupBy("row", "k1", "k2", "word").agg(F.count("*").alias("n"))
    by_row = by_word.groupBy("row", "k1", "k2").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    return by_row.groupBy("k1", "k2").agg(F.max("total").alias("total"), F.max("distinct").alias("distinct"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts n by part, failed (bits of A to E), good and toxic."""
    docs = docs.select(
        F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"),
    )
    docs = docs.select("*", F.xxhash64("none", "id", "text").alias("k1"), F.hash("text", "id").alias("k2"))
    upper = F.regexp_count("text", F.lit("[A-Z]"))
    flags = docs.select(
        "none", "id", "k1", "k2", "part", F.unhex(F.sha2("text", 256)).alias("same"),
        (100 * upper > MAX_UPPER_PERCENT * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"),
    )
    flags = flags.groupBy(*flags.columns).agg(F.count("*").alias("n"))
    flags = flags.join(word_counts(docs), ["k1", "k2"], "left")

    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id"))
    known = known.agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
    known = known.withColumn("spread", F.lit(0).cast("long"))
    flags = flags.withColumn("spread", F.when(F.col("none"), F.coalesce(F.nullif("k1", F.lit(0)), F.lit(1))).otherwise(0).cast("long"))
    flags = flags.join(known, ["id", "spread"], "left").na.fill(0, ["good", "toxic", "total", "distinct"])

    alone = (F.col("total") < MIN_WORDS, 100 * F.col("distinct") < MIN_DISTINCT_PERCENT * F.col("total"), F.col("c"), F.col("d"))
    flags = flags.withColumn("failed", sum((f.cast("int") * (1 << i) for i, f in enumerate(alone)), F.lit(0)))
    # a text's rows become a few counts before they meet, and its first rows are told from the others by counts
    order = F.when(~F.col("none"), F.col("id"))
    texts = flags.groupBy("same", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("none"), F.col("n")).otherwise(0)).alias("nameless"), F.min(order).alias("first"), F.min_by("n", order).alias("n_first"))
    lowest = texts.groupBy("same").agg(F.min("first").alias("lowest"))
    texts = texts.join(lowest, "same", "left")
    new = F.col("nameless") + F.when(F.col("first") == F.col("lowest"), F.col("n_first")).otherwise(0)
    both = F.array(F.struct(F.col("failed").alias("failed"), new.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - new).alias("n")))
    return texts.select("part", "good", "toxic", F.explode(both).alias("e")).select("part", "good", "toxic", "e.failed", "e.n").where("n > 0")


def conditional_counts(failed: DataFrame) -> DataFrame:
    """One row a part: n_0 to n_31 by the set of failed filters, and the good and toxic among them."""
    weights = {"n": "n", "good": "n * good", "toxic": "n * toxic"}
    return failed.groupBy("part").agg(*[F.expr(f"sum(if(failed = {s}, {w}, 0L)) AS {k}_{s}") for k, w in weights.items() for s in SETS])


def _passing(kind: str) -> str:
    """SQL of an array by set of filters: how many documents fail none of the set."""
    return f"array({', '.join(' + '.join(f'{kind}_{s}' for s in SETS if not s & tested) for tested in SETS)}) AS {kind}"


def _steps() -> list[dict]:
    """Every order's steps: its filter's number and bit, the filters applied before and the filters applied then."""
    out = []
    for order in permutations(range(len(FILTERS))):
        done = 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": "".join(FILTERS[k] for k in order), "step": step, "i": i, "bit": 1 << i, "done": done, "then": done | 1 << i})
            done |= 1 << i
    return out


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    docs has doc_id, source and text; labels has doc_id, quality and toxic.
    """
    counts = conditional_counts(failures(docs, labels))
    filters = range(len(FILTERS))
    only = ", ".join(f"n_{1 << i}" for i in filters)
    # of n failed filters each comes first in one of n orders
    shapley = ", ".join(" + ".join(f"{FIRST_OF[s.bit_count()]} * n_{s}" for s in SETS if s >> i & 1) for i in filters)
    parts = counts.selectExpr("part", *map(_passing, ("n", "good", "toxic")), f"array({only}) AS only", f"array({shapley}) AS shapley")
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order string, step int, i int, bit int, done int, then int>>")
    rows = parts.select("*", F.inline(steps)).selectExpr("*", "n[done] - n[then] AS removed")
    return rows.selectExpr("part", "filter_order", "step", "n[then] AS kept", "removed", "n[0] - n[bit] - removed AS redundant", "only[i] AS unique_fails", "good[done] - good[then] AS good_lost", "toxic[done] - toxic[then] AS toxic_lost", "shapley[i] AS shapley")
