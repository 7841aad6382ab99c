"""N-gram Jaccard join by set-relation skipping.

A document's set is its distinct n-word shingles, as 64-bit hashes; equal sets
are one set. Tokens are ordered rare first (frequent ones, counted over all
documents, come last) and each set is indexed under its prefix, so that two
linked sets meet in some list. A list falls into blocks by size, and a set
stands in it by its position: of tokens with equal lists only the first is
searched, blocks whose sizes rule a link out never meet, and pairs that position
and size rule out are skipped.

Answers of similar sets are reused. First, the members of each list are
compared with its first set only, which gives their distance to it. Sets that
a chain of links joins need no comparison with each other, as their answer,
the component, is known. And the distance, 1 - Jaccard similarity, is a
metric: what is far from a list's first set is far from all that are near to
it, so those answers follow from the ones that are computed. Who has led has met
all that it may link with and leaves its lists. In further turns other members
lead, the one of most links yet and some at random; when few pairs are left to a
set, or after the last turn, all that remain are compared, across components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC, Table, Words, checkpoint, components, mix64, named_docs, names128, shingle_sets, signed, small, text_blocks

#: Blocks in which frequent tokens are counted (bytes), the occurrences in a block that make a token a candidate, and the most tokens that are broadcast (8 bytes each). The order of tokens decides speed only.
COUNT_BYTES, COUNT_LEAST, MAX_FREQUENT = 8 << 20, 2, 1 << 18
#: Sets of a block that are compared together, turns in which so many members of each list lead before all that is left is compared, and the pairs that a set of a list may be in to end them.
BLOCK_SETS, TURNS, LEADS, FEW_PAIRS = 64, 3, 8, 3


def set_names(sets: list[np.ndarray]) -> pa.Array:
    """A 128-bit name for each set of tokens; null for an empty one."""
    sums = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        sums[i] = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    sizes = np.array([len(s) for s in sets], np.uint64)
    names = names128(mix64(sums + sizes[:, None]))
    return pa.array([v if n else None for v, n in zip(names.to_pylist(), sizes.tolist(), strict=True)], pa.binary())


def common_tokens(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    small_, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small_):
        return 0
    at = np.searchsorted(large, small_)
    return int((large[np.minimum(at, len(large) - 1)] == small_).sum())


def prefix_length(n: int, percent: int) -> int:
    """A link needs ceil(percent * n / 100) common tokens, so one is among the first n less that, plus 1."""
    return n - -(-percent * n // 100) + 1


def frequent_tokens(docs: DataFrame, n: int) -> np.ndarray:
    """Tokens that are frequent in blocks of documents, in ascending order of their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []

        def often() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            many = times >= COUNT_LEAST
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(tokens[many])), pa.array(times[many], pa.int64())], ["token", "times"])

        size = 0
        for block in text_blocks(batches):
            sets += [s for s in shingle_sets(Words(block.column(0), lower=True), n) if len(s)]
            size += block.nbytes
            if size > COUNT_BYTES:
                yield often()
                size = 0
        yield often()

    counted = docs.select("text").mapInArrow(count, "token long, times long").groupBy("token").agg(F.sum("times").alias("times"))
    rows = counted.orderBy(F.desc("times"), "token").limit(MAX_FREQUENT).collect()
    return np.array([r["token"] for r in reversed(rows)], np.int64).view(np.uint64)


def find_members(docs: DataFrame, n: int) -> DataFrame:
    """none, id, salt, n_shingles and name of the set (null for an empty one) of every row; checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            sets = shingle_sets(Words(block.column(3), lower=True), n)
            yield pa.RecordBatch.from_arrays([*[block.column(i) for i in range(3)], pa.array([len(s) for s in sets], pa.int64()), set_names(sets)], [*DOC, "n_shingles", "name"])

    found = named_docs(docs.select("doc_id", "text")).select(*DOC, "text").mapInArrow(run, "none boolean, id long, salt long, n_shingles long, name binary")
    return checkpoint(found)


def find_sets(members: DataFrame) -> DataFrame:
    """Every distinct set: number (n), name, size and place of its first document; checkpointed."""
    sets = members.where("name is not null").groupBy("name").agg(F.min(F.struct(*DOC)).alias("place"), F.max("n_shingles").alias("size"))
    return checkpoint(sets.select(F.monotonically_increasing_id().alias("n"), "name", "size", "place"))


def find_postings(named: DataFrame, sets: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """token, n, info (size and, in the lower 32 bits, position) for the first tokens of each set, rare ones first."""
    by_value = np.argsort(frequent)
    value = frequent[by_value]

    def prefix(tokens: np.ndarray) -> np.ndarray:
        """Of rare tokens by value, then frequent ones by rising count, the first."""
        k = prefix_length(len(tokens), percent)
        if len(value):
            at = np.minimum(np.searchsorted(value, tokens), len(value) - 1)
            often = value[at] == tokens
            late = by_value[at[often]]
            tokens = np.concatenate((tokens[~often], tokens[often][np.argsort(late)]))
        return tokens[:k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            sets = shingle_sets(Words(block.column(1), lower=True), n)
            firsts = [prefix(s) for s in sets]
            counts = np.array([len(f) for f in firsts])
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            info = np.repeat(np.array([len(s) for s in sets], np.int64) << 32, counts) | at
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(firsts))), pa.array(np.repeat(block.column(0).to_numpy(), counts)), pa.array(info)], ["token", "n", "info"])

    places = sets.select("n", *[F.col(f"place.{c}").alias(c) for c in DOC])
    found = named.select(*DOC, "text").join(small(places, 300_000), DOC).select("n", "text")
    return found.mapInArrow(run, "token long, n long, info long")


def fetch_sets(named: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, known: DataFrame | None = None) -> DataFrame:
    """n and all tokens (sorted, 8 bytes each) of the sets in pairs (a, b), from their first documents; those of known are not fetched again."""
    wanted = pairs.select(F.col("a").alias("n")).union(pairs.select("b")).distinct()
    if known is not None:
        wanted = checkpoint(wanted.join(known.select("n"), "n", "left_anti"))
        if wanted.isEmpty():
            return known
    wanted = checkpoint(sets.select("n", "place").join(wanted, "n").select("n", *[F.col(f"place.{c}").alias(c) for c in DOC]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            tokens = [s.tobytes() for s in shingle_sets(Words(block.column(1), lower=True), n)]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(tokens, pa.binary())], ["n", "tokens"])

    found = named.select(*DOC, "text").join(small(wanted, 300_000), DOC).select("n", "text").mapInArrow(run, "n long, tokens binary")
    found = checkpoint(found.groupBy("n").agg(F.first("tokens").alias("tokens")))  # repeated rows have the same set
    return found if known is None else known.unionByName(found)


def compare(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """a, b, both (size of the intersection) and all (of the union) of the pairs; checkpointed.

    Sets that share partners stand in blocks of BLOCK_SETS, and a cell is two
    blocks: a set goes to a cell once, however many of its pairs are there.
    """
    ends = pairs.select(F.col("a").alias("n"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    home = ends.groupBy("n").agg(F.min("other").alias("o")).select("n", F.least("n", "o").alias("home"))
    home = checkpoint(home.withColumn("k", F.floor((F.row_number().over(Window.partitionBy("home").orderBy("n")) - 1) / BLOCK_SETS).cast("int")))
    cells = pairs.join(home.select(F.col("n").alias("a"), F.col("home").alias("ha"), F.col("k").alias("ka")), "a")
    cells = checkpoint(cells.join(home.select(F.col("n").alias("b"), F.col("home").alias("hb"), F.col("k").alias("kb")), "b"))
    cell = ["ha", "ka", "hb", "kb"]
    here = [F.col(c).alias(f"of_{c}") for c in cell]
    tokens = tokens.join(small(home.select("n")), "n", "left_semi")  # other sets needn't move
    asked = cells.select(*here, F.col("a").alias("n")).union(cells.select(*here, "b")).distinct().join(tokens, "n")

    def run(key: tuple, wanted: pa.Table, held: pa.Table) -> pa.Table:
        sets = {n: np.frombuffer(t, np.uint64) for n, t in zip(held["n"].to_pylist(), held["tokens"].to_pylist(), strict=True)}
        a, b = wanted["a"].to_pylist(), wanted["b"].to_pylist()
        both = [common_tokens(sets[x], sets[y]) for x, y in zip(a, b, strict=True)]
        total = [len(sets[x]) + len(sets[y]) - c for x, y, c in zip(a, b, both, strict=True)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "both": pa.array(both, pa.int64()), "all": pa.array(total, pa.int64())})

    return checkpoint(cells.groupBy(*cell).cogroup(asked.groupBy(*[f"of_{c}" for c in cell])).applyInArrow(run, "a long, b long, both long, all long"))


def may_link(size: Column, at: Column, other: Column, other_at: Column, percent: int) -> Column:
    """Whether sizes and positions in a list allow a link: the tokens from there on must be enough."""
    need = F.ceil(percent * (size + other) / (100 + percent))
    return (F.least(size - at, other - other_at) >= need) & (100 * F.least(size, other) >= percent * F.greatest(size, other))


def set_links(named: DataFrame, sets: DataFrame, n: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """Links (a, b) between sets, enough to know all components."""
    in_token, in_list = Window.partitionBy("token"), Window.partitionBy("token", "run")
    by_size = in_token.orderBy("info", "n")
    size_of = lambda info: F.shiftright(info, 32)
    at_of = lambda info: F.col(info).bitwiseAND(F.lit((1 << 32) - 1))
    posted = find_postings(named, sets, n, percent, frequent).withColumn("next", size_of(F.lead("info").over(by_size)))
    # a set may link as the smaller of two if it may with one of the next size; a list is a run of sizes each of which can link with such a set before it
    size = size_of("info")
    may_lead = (size - at_of("info") >= F.ceil(percent * (size + F.col("next")) / (100 + percent))) & (100 * size >= percent * F.col("next"))
    before = F.last(F.when(may_lead, size), ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, -1))
    posted = posted.withColumn("new", F.when(100 * before >= percent * size, 0).otherwise(1))
    posted = posted.withColumn("run", F.sum("new").over(by_size.rowsBetween(Window.unboundedPreceding, 0))).drop("next", "new")
    posted = posted.withColumns({"lead": F.min(F.struct("n", "info")).over(in_list), "last": F.max("n").over(in_list), "low": F.min("info").over(in_list), "high": F.max("info").over(in_list), "members": F.count("*").over(in_list)})
    pair = may_link(size_of("low"), at_of("low"), size_of("high"), at_of("high"), percent)  # what a list of two sets is for
    posted = posted.where((F.col("last") != F.col("lead.n")) & ((F.col("members") > 2) | pair)).drop("last", "low", "high")
    # tokens of one list of sets give the same pairs, and the first of them in the order of tokens comes first in all these sets
    bits = lambda seed: F.try_sum(F.xxhash64("n", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1))).over(in_list)
    posted = posted.withColumns({"s0": bits(0), "s1": bits(1)})
    posted = Table(posted.select("token", "run", "n", "info", F.col("lead.n").alias("lead"), F.col("lead.info").alias("lead_info"), "s0", "s1", "members"))
    own = F.when(F.col("s0").isNull() | F.col("s1").isNull(), F.col("token"))  # sums that overflow tell nothing
    first = F.min_by(F.struct("token", "run"), F.struct(F.col("lead_info"), "token")).alias("t")
    chosen = posted.read().where("n = lead").groupBy("lead", "s0", "s1", "members", own.alias("own")).agg(first).select("t.token", "t.run")
    table = Table(posted.read().select("token", "run", "n", "info", "lead", "lead_info").join(chosen, ["token", "run"], "left_semi"))
    posted.drop()
    lists = table.read().withColumns({"size": size_of("info"), "at": at_of("info")})
    linked = F.col("both") * 100 >= F.col("all") * percent
    led = may_link(F.col("size"), F.col("at"), size_of("lead_info"), at_of("lead_info"), percent)
    first = checkpoint(lists.where(led & (F.col("n") != F.col("lead"))).select(F.col("n").alias("a"), F.col("lead").alias("b")).distinct())
    tokens = fetch_sets(named, sets, first, n)
    first = compare(first, tokens)
    links = first.where(linked).select("a", "b")
    known = first.select(F.col("a").alias("n"), F.col("b").alias("lead"), (1 - F.col("both") / F.col("all")).alias("far"))
    rows = lists.where(F.col("n") != F.col("lead")).join(small(known), ["n", "lead"], "left").select("token", "run", "n", "size", "at", "far")
    apart = lambda x, y: F.coalesce(F.abs(F.col(x) - F.col(y)) > 1 - percent / 100 + 1e-9, F.lit(False))
    tables = [table]
    for turn in range(TURNS + 1):
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("n")).agg(F.count("*").alias("degree"))
        label = components(links).join(degree, F.col("id") == F.col("n")).select(F.col("id").alias("of"), "component", "degree")
        rows = rows.join(small(checkpoint(label)), rows["n"] == F.col("of"), "left").withColumns({"label": F.coalesce("component", "n"), "degree": F.coalesce("degree", F.lit(0))}).drop("of", "component")
        # other members lead: whom they link needn't be compared with each other
        drawn = [F.max_by(F.struct("n", "size", "at", "label", "far"), F.struct(F.col("degree") if k == 0 else F.lit(0), F.xxhash64("n", F.lit(turn), F.lit(k)))).over(in_list) for k in range(LEADS)]
        rows = rows.withColumns({"least": F.min("label").over(in_list), "most": F.max("label").over(in_list), "members": F.count("*").over(in_list), "others": F.array(*drawn)}).where("least <> most").drop("least", "most", "degree")
        # of the pairs that are left, those within the first leader's component need no comparison
        joined = F.count_if(F.col("label") == F.col("others")[0]["label"]).over(in_list)
        tables.append(Table(rows.withColumn("left", (F.col("members") - joined * joined / F.col("members")) / 2).drop("members")))
        rows = tables[-1].read()
        tables.pop(-2).drop()
        left, n_rows = rows.agg(F.sum("left"), F.count("*")).first()  # two numbers
        if turn == TURNS or (left or 0) <= FEW_PAIRS * n_rows:
            break
        far = lambda o: F.coalesce(F.abs(F.col("far") - o["far"]) > 1 - percent / 100 + 1e-9, F.lit(False))
        meets = F.filter("others", lambda o: (F.col("label") != o["label"]) & may_link(F.col("size"), F.col("at"), o["size"], o["at"], percent) & ~far(o))
        met = rows.select("n", F.explode(meets["n"]).alias("other"))
        met = checkpoint(met.select(F.least("n", "other").alias("a"), F.greatest("n", "other").alias("b")).distinct())
        tokens = fetch_sets(named, sets, met, n, tokens)
        links = links.unionByName(compare(met, tokens).where(linked).select("a", "b"))
        rows = rows.where(~F.array_contains(F.col("others")["n"], F.col("n"))).drop("others", "label", "left")
    # a block holds the sizes of which the largest is 100 / percent times the smallest: sets of linked sizes are in one or the next
    block = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    rows = checkpoint(rows.select("token", "run", "n", "size", "at", "label", "far", block.alias("block")))
    larger = rows.select("token", "run", *[F.col(c).alias(f"other_{c}") for c in ("n", "size", "at", "label", "far")], F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("block"))
    smaller = rows.where(F.col("size") - F.col("at") >= F.ceil(2 * percent * F.col("size") / (100 + percent)))
    met = smaller.join(larger, ["token", "run", "block"]).where((F.col("size") < F.col("other_size")) | ((F.col("size") == F.col("other_size")) & (F.col("n") < F.col("other_n"))))
    met = met.where((F.col("label") != F.col("other_label")) & may_link(F.col("size"), F.col("at"), F.col("other_size"), F.col("other_at"), percent) & ~apart("far", "other_far"))
    across = checkpoint(met.select(F.col("n").alias("a"), F.col("other_n").alias("b")).distinct())
    for table in tables:
        table.drop()
    return links.unionByName(compare(across, fetch_sets(named, sets, across, n, tokens)).where(linked).select("a", "b"))


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) for every row of docs.

    Two documents link when 100 * intersection >= percent * union of their
    sets of n-word shingles (A-Z lower-cased); a text of fewer words has one
    shingle. A null or blank text has an empty set and links with nothing.
    Equal sets always link, and copies are handled as one set. A null doc_id
    takes part, but names no component unless all ids of it are null. Repeated
    rows each get their row; an empty table gives none. Other columns, whatever
    their names, are dropped.
    """
    named = named_docs(docs.select("doc_id", "text")).drop("rest")
    members = find_members(docs, n)
    sets = find_sets(members)
    label = components(set_links(named, sets, n, percent, frequent_tokens(docs, n))).select(F.col("id").alias("of"), "component")
    rooted = sets.select("n", "name", "place").join(label, sets["n"] == label["of"], "left").select("name", "place", F.coalesce("component", "n").alias("root"))
    rooted = checkpoint(rooted)
    low = rooted.groupBy("root").agg(F.min("place").alias("low")).select(F.col("root").alias("top"), F.when(~F.col("low.none"), F.col("low.id")).alias("component"))
    of_name = checkpoint(rooted.join(low, rooted["root"] == low["top"]).select(F.col("name").alias("set_name"), "component"))
    out = members.join(of_name, members["name"] == of_name["set_name"], "left").withColumn("doc_id", F.when(~F.col("none"), F.col("id")))
    return out.select("doc_id", "n_shingles", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs without those of documents that link to one of smaller doc_id; all columns stay.

    Of rows that repeat a doc_id, or have none, all stay unless a smaller id stands for them.
    """
    drop = ngram_components(docs, n, percent).where("component_id < doc_id").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
