"""The stages of the pipeline on a small table, each against brute force on its own input."""

import collections
import hashlib
import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import bpe, lines, mixing, ngram_join, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, copies string, salt int"


@pytest.fixture(scope="module")
def folder(spark, tiny, tmp_path_factory):
    """Documents with nulls, copies, near copies, near lines, repeated rows, the largest id, and columns of clashing names; labels of the given tables."""
    out = str(tmp_path_factory.mktemp("tables"))
    draw = random.Random(21)
    given = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()]
    rows = [(*r, "clash", i) for i, r in enumerate(given)]
    base = max((r for r in given if r[1] and "\n" not in r[1]), key=lambda r: -abs(len(r[1]) - 900))[1]
    words = base.split()
    for k in range(25):  # near copies of one text
        w = list(words)
        w[draw.randrange(len(w))] = f"other{k}"
        rows.append((10_000 + k, " ".join(w), "en", "src0", 1, "clash", 0))
    rows += [(None, base + " without id", "en", None, 5, "clash", 1), (20_000, None, "en", "src1", None, None, None), (20_001, "", None, "src1", 0, "", 2), ((1 << 63) - 1, given[3][1], "en", "src2", 3, "clash", 4)]
    rows += [rows[5], rows[5]]
    spark.createDataFrame(rows, SCHEMA).coalesce(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{tiny}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    return out


def stage_inputs(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        result = spark.read.parquet(f"{tmp_path}/{name}")
        yield name, docs, result
        docs = result


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def test_every_stage(spark, folder, tmp_path):
    last = None
    for name, before, after in stage_inputs(spark, folder, tmp_path):
        rows = before.collect()
        if name != "tokens":
            assert after.columns == before.columns
        if name == "quality":
            model = quality.fit_quality(before, spark.read.parquet(f"{folder}/labels.parquet"))
            good = [model.score(quality.statistics(r["text"])[None])[0] >= quality.ACCEPT for r in rows]
            assert bag(after) == collections.Counter(tuple(r) for r, g in zip(rows, good, strict=True) if g)
        elif name == "lines":
            check_lines(rows, after.collect())
        elif name == "near_duplicates":
            assert bag(after) == collections.Counter(tuple(r) for r in one_of_each_group(rows))
        elif name == "mix":
            copies = mixing.mix_sources(before).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("c")).collect()
            assert after.count() == sum(r["c"] for r in copies) and set(bag(after)) <= set(bag(before))
            assert {(d, s): n for (d, s), n in bag(after, "doc_id", "source").items()} == summed(copies)
        else:
            ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            want = collections.Counter()
            for r in rows:
                ids = bpe.encode_text(r["text"] or "", ranks, public_tokenizers.PATTERN)
                raw = b"".join(i.to_bytes(4, "little") for i in ids)
                want[r["doc_id"], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
            last = bag(after, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
            assert last == want and len(rows) > 50
    assert bag(corpus_pipeline.run(spark, folder), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == last


def summed(copies):
    out = collections.Counter()
    for r in copies:
        out[r["doc_id"], r["source"]] += r["c"]
    return {k: n for k, n in out.items() if n}


def check_lines(rows, after):
    """All pairs of distinct lines; the earliest of each group stays. Rows are matched by all columns but text and n_chars."""
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    at, order = {}, []
    for r in sorted({(key(r), r["text"]) for r in rows if r["text"]}, key=lambda x: x[0]):
        for k, form in enumerate(lines.normal_forms(r[1].split("\n"))):
            if len(form) >= lines.MIN_CHARS:
                order.append((r, k, form))
                at.setdefault(form, len(at))
    forms, root = list(at), list(range(len(at)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    by_length = sorted(range(len(forms)), key=lambda i: len(forms[i]))
    for x, i in enumerate(by_length):
        for j in by_length[x + 1 :]:
            if len(forms[j]) * 0.9 > len(forms[i]) + 1:
                break
            if top(i) != top(j) and lines.similar(forms[i], forms[j], 0.9):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    seen, gone = set(), collections.defaultdict(set)
    for r, k, form in order:
        if top(at[form]) in seen:
            gone[r].add(k)
        seen.add(top(at[form]))
    want = collections.Counter()
    for r in rows:
        text = r["text"] and "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[key(r), r["text"]])
        want[r["doc_id"], text, r["source"], r["salt"], None if text is None else len(text)] += 1
    got = collections.Counter((r["doc_id"], r["text"], r["source"], r["salt"], r["n_chars"]) for r in after)
    assert sum(got.values()) == len(rows) and sum((got & want).values()) >= 0.98 * len(rows)


def one_of_each_group(rows):
    sets, root = [], list(range(len(rows)))
    for r in rows:
        raw = (r["text"] or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
        sets.append({tuple(raw[k : k + 5]) for k in range(len(raw) - 4)} if len(raw) >= 5 else {tuple(raw)} if raw else set())

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[top(i)] = min(least.get(top(i), r["doc_id"]), r["doc_id"])
    return [r for i, r in enumerate(rows) if not sets[i] or r["doc_id"] is None or least[top(i)] == r["doc_id"]]


def test_empty_documents(spark, folder, tmp_path):
    out = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{out}/labels.parquet")
    assert corpus_pipeline.run(spark, out).count() == 0


def test_stage_tables_are_removed(spark, folder):
    from strandline.llm.common import shared_folder

    corpus_pipeline.run(spark, folder).count()
    here = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    assert not [d for d in os.listdir(here) if d.startswith("table-")] and shared_folder(spark)


def test_columns_whose_names_need_quotes(spark, folder):
    """Columns with a space, a dot, a backquote or a keyword go through every stage as they are."""
    docs = spark.createDataFrame([(i, f"line {i % 3} of a short text\nand its own words {i} here", "s") for i in range(12)], "doc_id long, text string, source string")
    odd = ["a b", "x.y", "select", "per-cent"]
    docs = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(odd)])
    for stage in (quality.keep_good, lambda d, _: lines.strip_lines(d), lambda d, _: ngram_join.keep_one(d), lambda d, _: mixing.take_mix(d)):
        out = stage(docs, spark.read.parquet(f"{folder}/labels.parquet"))
        assert out.columns == docs.columns
        assert {tuple(r[len(docs.columns) - 4 :]) for r in out.collect()} <= {(0, 1, 2, 3)}
