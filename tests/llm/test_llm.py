import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from strandline.llm import bpe, fingerprints, html, lines, media, mixing, ngram_join, quality, substrings, urls

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, exact and near copies, ties, and a column whose name clashes with an internal one."""
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(1, 7)))
    base = [word() for _ in range(90)]
    near = [*base[:40], "changed", *base[41:]]
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", "  \n ", "one two three", "One two three", passage + " x " + passage]
    texts += [" ".join(word() for _ in range(n)) + ("\n" + passage if n % 2 else "") for n in (3, 25, 40, 41, 700)]
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 0) for i, t in enumerate(texts)]
    rows.append(rows[10])
    rows.append((None, "a lone row with no id at all", "en", "s1", 0))
    return spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("clash")).withColumn("target", F.lit(1)), rows


def words_of(text, lower=False):
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def test_bpe(spark, docs):
    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe_encode(df, PATH, public_tokenizers.PATTERN).collect()
    want = collections.Counter((r[0], tuple(own.encode_ordinary(r[1] or ""))) for r in rows)
    assert collections.Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert {(r["doc_id"], bytes(r["decoded"])) for r in got} == {(r[0], (r[1] or "").encode()) for r in rows}
    table = bpe.read_ranks(PATH)
    for text in ("a" * 5000, " " * 4000 + "x", "1" * 3000 + "'s" * 2000, "é!" * 4000, "word " * 20000):
        assert bpe.encode_text(text, table, public_tokenizers.PATTERN) == own.encode_ordinary(text)
    assert bpe.bpe_encode(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_digests(spark, docs):
    df, rows = docs
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += 1
    got = bpe.bpe_digest(df.withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash")), PATH, public_tokenizers.PATTERN)
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in got.collect()) == want
    assert bpe.bpe_digest(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_media(spark, docs):
    df, rows = docs
    got = media.media_columns(df, with_payload=True).collect()
    assert len(got) == len(rows)
    want = {(r[0], media.payload_of((r[1] or "").encode())) for r in rows}
    assert {(r["doc_id"], bytes(r["payload"])) for r in got} == want
    for r in got:
        p = bytes(r["payload"])
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:]) and len(p) % 192 == 0 < len(p)
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(p)).hexdigest()
    assert media.media_columns(df.limit(0)).count() == 0


def test_media_tables(spark, monkeypatch):
    """One row a chunk and a medium, hot chunks give the same result, and damage is seen."""
    draw = random.Random(4)
    shared = "".join(draw.choices("abcdefgh ", k=150_000))
    rows = [(i, f"{i} {'x' * i} " + shared if i % 3 else shared) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).repartition(3)
    _, lists, chunks = media.store_media(df)
    assert lists.count() == 21 and chunks.count() == chunks.select("digest").distinct().count() < 0.3 * lists.select(F.sum(F.size("digests"))).first()[0]
    plain = {tuple(r) for r in media.media_columns(df).collect()}
    monkeypatch.setattr(media, "HOT_LEAST", 5)
    monkeypatch.setattr(media, "HOT", 10**9)
    assert {tuple(r) for r in media.media_columns(df).collect()} == plain and len(plain) == 30
    first = chunks.orderBy("digest").first()["digest"]
    with pytest.raises(Exception, match="lacks a chunk"):
        media.read_media(lists, chunks.where(F.col("digest") != first)).collect()
    with pytest.raises(Exception, match="damaged"):
        media.read_media(lists, chunks.withColumn("data", F.when(F.col("digest") == first, F.lit(bytearray(media.bz2.compress(b"other")))).otherwise(F.col("data")))).collect()


def test_chunks_follow_content():
    draw = np.random.default_rng(1)
    shared = draw.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    cut = lambda x: {x[a:b] for a, b in zip([0, *media.chunk_ends(x)], media.chunk_ends(x))}  # noqa: E731,B905
    assert len(cut(b"head" + shared) & cut(b"another head" + shared)) > 10
    assert b"".join(shared[a:b] for a, b in zip([0, *media.chunk_ends(shared)], media.chunk_ends(shared))) == shared  # noqa: B905


def test_ngram_components(spark, docs):
    df, rows = docs
    sets = collections.defaultdict(set)
    for i, r in enumerate(rows):
        w = words_of(r[1], lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = dict.fromkeys(sets)
    for i in sets:
        group, todo = {i}, [i]
        while todo:
            a = todo.pop()
            for b in sets:
                if b not in group and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group.add(b)
                    todo.append(b)
        label[i] = min((rows[x][0] for x in group if rows[x][0] is not None), default=None)
    want = collections.Counter((rows[i][0], len(s), label[i]) for i, s in sets.items())
    assert collections.Counter(tuple(r) for r in ngram_join.ngram_components(df).collect()) == want
    assert ngram_join.ngram_components(df.limit(0)).count() == 0
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {rows[i][0] for i in sets if label[i] == rows[i][0]}


def test_ngram_components_of_graded_copies(spark):
    """Chains of near copies, groups near the threshold and a passage that all share: the components of all pairs."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choices("abcdefghijkl", k=draw.randint(2, 8)))
    passage, texts = [word() for _ in range(60)], []
    for group in range(6):
        base = [word() for _ in range(draw.randint(60, 300))]
        for _ in range(30):
            base = [word() if draw.random() < 0.004 * group else w for w in base]
            text = [word() if draw.random() < 0.01 * group else w for w in base]
            texts.append(" ".join(text + passage if draw.random() < 0.5 else text))
    texts += [" ".join(word() for _ in range(draw.randint(3, 50))) for _ in range(40)]
    draw.shuffle(texts)
    sets, root = [], list(range(len(texts)))
    for t in texts:
        w = words_of(t, lower=True)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    links = {i: [j for j in range(len(sets)) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(len(sets))}
    for i in range(len(sets)):  # ids rise, so the first to reach a document is its smallest
        todo = [i] if root[i] == i else []
        while todo:
            for j in links[todo.pop()]:
                if root[j] > i:
                    root[j] = i
                    todo.append(j)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in range(len(sets))} and 40 < len(set(root)) < 200


def test_ngram_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    """Most of a group of near copies isn't compared pair by pair, and the components are those of all pairs."""
    draw = random.Random(5)
    base, texts = [f"w{i}" for i in range(120)], []
    for _ in range(300):
        words = list(base)
        for _ in range(draw.randint(1, 3)):
            words[draw.randrange(120)] = f"x{draw.randrange(10**6)}"
        texts.append(words)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    low = list(range(300))
    for _ in range(300):
        now = [min([low[j] for j in range(300) if 100 * len(a & sets[j]) >= 75 * len(a | sets[j])]) for a in sets]
        if now == low:
            break
        low = now
    compared, compare = [], ngram_join.compare
    monkeypatch.setattr(ngram_join, "compare", lambda pairs, tokens: compared.append(pairs.count()) or compare(pairs, tokens))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(df).collect()}
    assert got == dict(enumerate(low))
    assert sum(compared) <= 6000


def test_substrings(spark, docs):
    df, rows = docs
    order = sorted({(r[0] if r[0] is not None else 1 << 62, r[1]) for r in rows}, key=lambda x: x[0])
    seen, want = set(), {}
    for i, t in order:
        w, gone = words_of(t), set()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if key in seen else set()
            seen.add(key)
        want[i if i != 1 << 62 else None] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = substrings.remove_repeats(df).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in got} == want
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_cover_meets_every_pair_of_positions():
    for i in range(substrings.PERIOD):
        for j in range(substrings.PERIOD):
            assert any((i + s) % substrings.PERIOD in substrings.COVER and (j + s) % substrings.PERIOD in substrings.COVER for s in range(substrings.PERIOD))


def test_lines(spark):
    line = "This line of some length says what it says about the matter at hand, and it goes on."
    fuzzy = line.replace("hand", "foot")
    rows = [(1, f"first words that stand alone here\n{line}\nok"), (2, f"{fuzzy}\nok\nan own line which nobody else has"), (3, line.upper() + "\n" + line), (4, None), (5, ""), (3, line.upper() + "\n" + line), (None, line), ((1 << 63) - 1, "my own line of the largest id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("salt", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("rest", F.lit(2)).withColumn("n_chars", F.lit(0))
    got = collections.Counter((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in lines.dedup_lines(df).collect())
    want = [(1, rows[0][1], 3, 0), (2, "ok\nan own line which nobody else has", 3, 1), (3, "", 2, 2), (3, "", 2, 2), (4, None, 0, 0), (5, "", 0, 0), (None, "", 1, 1), (None, None, 0, 0), ((1 << 63) - 1, rows[7][1], 1, 0)]
    assert got == collections.Counter(want)
    out = lines.strip_lines(df)
    assert out.columns == df.columns
    assert collections.Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == collections.Counter((d, t, None if t is None else len(t)) for d, t, _, _ in want)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_that_differ_in_numbers_are_compared(spark):
    rows = [(1, "call 5550100 now for a deal"), (2, "call 7771234 now for a deal"), (3, "Call  5550100, now: for a deal!")]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def edited(draw, words, word):
    """The words after some substitutions, losses, additions or slips of the pen."""
    out, kind = list(words), draw.choice(["sub", "del", "ins", "slip", "many"])
    for _ in range(draw.randint(1, max(1, len(words) // 12)) if kind == "many" else 1):
        i = draw.randrange(len(out))
        if kind in ("sub", "many"):
            out[i] = word()
        elif kind == "del":
            del out[i]
        elif kind == "ins":
            out.insert(i, word())
        else:
            out[i] = out[i][:-1] + draw.choice("xyz")
    return out


def test_similar_lines_share_a_key():
    """Recall of candidates among pairs of edit similarity 0.9, by the number of words."""
    draw = random.Random(3)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randint(1, 11))) for _ in range(20_000)] + ["the", "of", "and", "to", "in"] * 3000
    word = lambda: draw.choice(vocabulary)
    for n in (5, 8, 10, 15, 20, 40, 60, 100, 200):
        found = total = 0
        for _ in range(300):
            base = [word() for _ in range(n)]
            pair = [" ".join(base), " ".join(edited(draw, base, word))]
            block = lines.Lines(lines.pa.array(pair))
            if pair[0] == pair[1] or len(block.rows) < 2 or not lines.similar(*(x.encode() for x in pair), 0.9):
                continue
            line, key, sims = block.keys(np.arange(2), 0.9)
            near = block.chars.max() < lines.SIMHASH_CHARS or int(sims[0] ^ sims[1]).bit_count() <= lines.SIMHASH_BITS
            total, found = total + 1, found + (near and bool(set(key[line == 0].tolist()) & set(key[line == 1].tolist())))
        assert found >= 0.9 * total > 50, n


def test_lines_against_brute_force(spark):
    """Groups of near lines, one of them in a bucket of hundreds of lines: the result of comparing all pairs."""
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(2, 8)))
    texts = []
    for n, copies in ((6, 12), (12, 20), (25, 20), (60, 20), (40, 200)):
        base = [word() for _ in range(n)]
        texts += [" ".join(edited(draw, base, word)) for _ in range(copies)]
    texts += [" ".join(word() for _ in range(draw.randint(5, 60))) for _ in range(60)]
    draw.shuffle(texts)
    normal, root = lines.normal_forms(texts), list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if lines.similar(normal[i], normal[j], 0.9):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    want = {i for i in range(len(texts)) if top(i) != i and len(normal[i]) >= lines.MIN_CHARS}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in lines.dedup_lines(df).where("n_removed > 0").collect()}
    assert got <= want and len(got) >= 0.97 * len(want) > 200


def test_edit_distance():
    def slow(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i, *d[1:]], d
            for j, y in enumerate(b, 1):
                d[j] = min(last[j] + 1, d[j - 1] + 1, last[j - 1] + (x != y))
        return d[-1]

    draw = random.Random(2)
    for _ in range(200):
        a, b = ("".join(draw.choices("ab", k=draw.randint(1, 9))).encode() for _ in range(2))
        assert lines.edit_distance(a, b, 20) == slow(a, b)
    pairs = [tuple("".join(draw.choices("abcd", k=draw.choice((0, 1, 5, 60, 63, 64, 65, 130, 200)))).encode() for _ in range(2)) for _ in range(150)]
    assert lines.edit_distances(pairs).tolist() == [slow(a, b) for a, b in pairs]


def test_bounds_of_long_lines_decide_as_the_distance_does():
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=draw.randint(1, 8)))
    for share in (0.0, 0.05, 0.09, 0.12, 0.2, 1.0):
        base = [word() for _ in range(600)]
        a, b = (" ".join(x).encode() for x in (base, [word() if draw.random() < share else w for w in base]))
        true = int(lines.edit_distances([(a, b)])[0])
        assert lines.least_distance(a, b) <= true <= lines.most_distance(a, b)
        assert lines.similar(a, b, 0.9) == (true <= int(0.1 * max(len(a), len(b)) + 1e-9)) == lines.similar_rows([a], [b], 0.9)[0]


def test_mixing(spark, docs):
    df, rows = docs
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    target = {r["source"]: r["target"] for r in got}
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(target[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(df.repartition(5)).collect()), key=repr)
    taken = mixing.take_mix(df)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_comes_near_targets(spark, tiny):
    got = mixing.mix_sources(spark.read.parquet(f"{tiny}/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.max("size").alias("m")).collect()
    assert all(abs(r["t"] - r["x"]) <= r["m"] for r in got)


def test_quality(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    held = docs.join(labels, "doc_id").where(quality.fold(F.col("doc_id")) == 0).select(quality.quality_score(model)("text").alias("s"), "quality").collect()
    assert np.mean([(r["s"] >= quality.ACCEPT) == bool(r["quality"]) for r in held]) > 0.95
    odd = spark.createDataFrame([(None,), ("",), ("x" * 100_000,)], "text string").select(quality.quality_score(model)("text").alias("s")).collect()
    assert all(0 <= r["s"] <= 1 for r in odd)
    assert quality.fit_quality(docs, labels.limit(0)).score(np.zeros((1, quality.N_STATISTICS)))[0] == 0.5


def test_isotonic_against_all_partitions():
    """The pooled means are the best rising fit: no cut of the bins into blocks of their means fits better."""
    draw = np.random.default_rng(3)
    for _ in range(20):
        n = draw.integers(1, 9, 7).astype(float)
        good = np.array([draw.integers(0, k + 1) for k in n], float)
        knots, values = quality.isotonic(np.arange(7.0), good, n)
        fit = np.interp(np.arange(7.0), knots, values)
        assert (np.diff(values) >= -1e-12).all() and len(knots) == len(values)
        best = min(
            sum(n[k] * (good[k] / n[k] - sum(good[b]) / sum(n[b])) ** 2 for b in blocks for k in range(b.start, b.stop))
            for cut in range(64)
            for blocks in [[slice(x, y) for x, y in zip([0, *[i + 1 for i in range(6) if cut >> i & 1]], [*[i + 1 for i in range(6) if cut >> i & 1], 7], strict=True)]]
            if all(sum(good[a]) / sum(n[a]) <= sum(good[b]) / sum(n[b]) + 1e-12 for a, b in zip(blocks, blocks[1:], strict=False))
        )
        pools, at = [], 0
        for x in knots:  # a knot is the mean place of its pool
            size = next(s for s in range(1, 8 - at) if abs(np.average(np.arange(at, at + s), weights=n[at : at + s]) - x) < 1e-9)
            pools.append(slice(at, at + size))
            at += size
        got = sum(n[k] * (good[k] / n[k] - sum(good[b]) / sum(n[b])) ** 2 for b in pools for k in range(b.start, b.stop))
        assert at == 7 and got == pytest.approx(best) and len(fit) == 7


def test_quality_model_is_a_ridge_fit(spark):
    """The summed normal equations give the weights of one solve over all rows; odd tables have scores, too."""
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    fold = {r["doc_id"]: r["f"] for r in labels.select("doc_id", quality.fold(F.col("doc_id")).alias("f")).collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [(quality.statistics(r["text"]), y[r["doc_id"]]) for r in docs.collect() if y.get(r["doc_id"]) is not None and fold[r["doc_id"]] not in (0, 4)]
    z, t = model.features(np.array([x for x, _ in rows])), np.array([v for _, v in rows], float)
    ridge = 1e-3 * max(1.0, len(rows)) / z.shape[1]
    assert np.allclose(model.beta, np.linalg.solve(z.T @ z + ridge * np.eye(z.shape[1]), z.T @ t), atol=1e-6)
    odd = docs.limit(5).unionByName(docs.limit(5)).withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    odd = odd.unionByName(spark.createDataFrame([(None, None, "x", None, None, "clash", 1)], odd.schema))
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and quality.keep_good(docs.limit(0), labels).count() == 0 and quality.keep_good(odd, labels.limit(0)).count() == 11


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/x?y"), (2, "https://example.net"), (3, "x://shop.example.com/de/#f"), (4, "http://q.org/fr/"), (5, None), (6, "no url"), (7, "http://bad.com/"), (8, "http://bad.com/2")]
    out = spark.createDataFrame([(7, 1), (8, 1)], "page_id long, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), out).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("example.net", "", None, "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == "block"


def test_urls_without_outcomes_of_their_own(spark):
    """Unseen hosts take their domain's or suffix's bound; ports, users and two-label suffixes; odd tables."""
    rows = [(i, f"http://h{i % 40}.bad.com/{i}") for i in range(400)] + [(1000 + i, f"http://www{i}.good.co.uk/") for i in range(60)]
    rows += [(2000, "http://new.bad.com:8080/x"), (2001, "http://me@other.bad.com"), (2002, "http://new.good.co.uk/"), (2003, "http://unseen.example.museum/"), (2004, None), (2005, "http:///path"), (2000, "http://new.bad.com:8080/x"), (None, "http://h1.bad.com/q")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("site", F.lit("clash")).withColumn("bad", F.lit("clash"))
    out = spark.createDataFrame([(i, 1) for i in range(400)] + [(1000 + i, 0) for i in range(60)] + [(None, 1), (2003, None)], "page_id long, bad int")
    judged = urls.judge_urls(pages, out)
    got = {(r["page_id"], r["host"]): r["verdict"] for r in judged.collect()}
    assert judged.count() == len(rows) and all(v == "block" for (_, h), v in got.items() if "bad.com" in h)
    assert got[2000, "new.bad.com:8080"] == "block" and got[2002, "new.good.co.uk"] == got[2003, "unseen.example.museum"] == got[2004, ""] == got[2005, ""] == "allow"
    assert urls.judge_urls(pages.limit(0), out).count() == 0 and urls.judge_urls(pages, out.limit(0)).where("verdict = 'block'").count() == 0
    hosts = spark.createDataFrame([("u:p@a.b.co.uk:80",), ("x.com.",), ("localhost",), ("co.uk",)], "h string").select(urls.site_of(F.col("h")).alias("s"))
    parts = hosts.select("s", urls.suffix_of(F.col("s")).alias("x")).select("s", "x", urls.domain_of(F.col("s"), F.col("x")).alias("d"))
    assert [tuple(r) for r in parts.collect()] == [("a.b.co.uk", "co.uk", "b.co.uk"), ("x.com", "com", "x.com"), ("localhost", "localhost", "localhost"), ("co.uk", "uk", "co.uk")]


def test_html_through_spark(spark):
    prose = "The cat sat on the mat and it was a good day for all of the cats that were there with him. " * 4
    long = f"<p>{prose}</p>" * 3000
    rows = [(1, "u", f"<p>{prose}</p><![foo[bar]]><![if !IE]><p>{prose}</p><![endif]>"), (2, None, None), (3, "u", ""), (None, "u", "<p>One short line.</p>"), (5, "u", long), (6, "u", "<div><span>a &lt; b <![CDATA[x]]> <p <b>"), (1, "u", f"<p>{prose}</p>"), (7, "u", f"<body class='sidebar-page'><div class=content-menu-wrapper><div class='menu'><p>{prose}</p></div></div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    got = html.extract_main_text(df).collect()
    text = prose.strip()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sorted(r["text"] for r in got if r["page_id"] == 1) == sorted([f"{text} {text}", text])
    by = {r["page_id"]: r["text"] for r in got}
    assert by[2] == by[3] == "" and by[None] == "One short line." and by[5] == " ".join([text] * 3000) and by[7] == text
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_html():
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; more</h1><p>Some  <b>bold\n text<p>Next &eacute;</p><div class=comments><p>Nice!</p></div></article><aside>Side</aside><footer>&copy; x</footer></body></html>"
    assert html.main_text(page) == "Head & more Some bold text Next é"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p>") == ""
    prose = "The cat sat on the mat and it was a good day for all of the cats that were there with him. " * 4
    assert html.main_text(f"<div><a href=1>one</a> <a href=2>two</a></div><p>{prose}</p><p>Short.</p><p>{prose}</p><div><a href=3>three</a></div>") == f"{prose.strip()} Short. {prose.strip()}"


def test_html_blocks_decide_beside_article_and_main():
    prose = "The cat sat on the mat and it was a good day for all of the cats that were there with him. " * 4
    text = prose.strip()
    cards = "".join(f"<article><h3><a href={i}>Card {i}</a></h3><p>A teaser.</p></article>" for i in range(3))
    assert html.main_text(f"<div><p>{prose}</p><p>Short.</p><p>{prose}</p></div>{cards}") == f"{text} Short. {text}"
    assert html.main_text(f"<main><p>{prose}</p><p class=ad>{prose}<p>Short.</p><p>So<span class='notice'>{prose}</span> it is</p></main>") == f"{text} Short. So it is"
    links = "<a href=1>one link of the many here</a> and " * 8
    assert html.main_text(f"<article><p>{prose}</p><p>{links}</p><p>{'zq xv ' * 40}</p></article>") == text
    assert html.main_text(f"<body class=has-sidebar><main><h1 class=page-header>Head</h1><p>{prose}</p></main></body>") == f"Head {text}"


def test_fingerprints(spark):
    rows = [(3, "a b c d e f g h"), (2, "a b c d e f g h"), (1, None), (0, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash"))
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(df).collect()}
    texts = {i: t or "" for i, t in rows}
    following = {3: 2, 2: 1, 1: 0, 0: 3}
    for i, t in texts.items():
        k = len(t) // 2
        edited = t[: len(t) - k] + texts[following[i]][:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
    assert got[3]["fingerprint"] == got[2]["fingerprint"] and got[3]["near_next"] == 1.0 and got[2]["near_next"] == 0.0


def test_fingerprints_of_odd_tables(spark, monkeypatch):
    """Ids at both ends of 64 bits, null and repeated ids, repeated rows, a clash, an empty table; over many small ranges."""
    monkeypatch.setattr(fingerprints, "RANGE_DOCS", 3)
    draw = random.Random(6)
    low, high = -(1 << 63), (1 << 63) - 1
    ids = [low, high, 0, None, None, None, *[7] * 40, *range(100, 300), 12, 12]
    rows = [(i, None if k % 17 == 0 else " ".join(draw.choices("abcdef", k=draw.randint(0, 30)))) for k, i in enumerate(ids)]
    rows[-1] = rows[-2]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("clash")).withColumn("salt", F.lit("clash"))
    hashed = [(r["doc_id"], r["text"], r["h"]) for r in df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    hashed.sort(key=lambda r: (-(low if r[0] is None else r[0]), r[2], r[0] is None))
    want = collections.Counter()
    for (i, t, _), (_, following, _) in zip(hashed, [*hashed[1:], hashed[0]], strict=True):
        k = len(t) // 2
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + following[:k]).encode()).hexdigest()] += 1
    got = fingerprints.fingerprints(df).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert fingerprints.fingerprints(df.limit(0)).count() == 0
    assert fingerprints.fingerprints(df.where("doc_id = 0")).first()["near_next"] == 1.0


def test_fingerprints_estimate_generalised_jaccard(spark, tiny):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    docs.sort(reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    errors = []
    for (i, t), (_, following) in zip(docs, [*docs[1:], docs[0]], strict=True):
        k = len(t) // 2
        a, b, c = (collections.Counter(x.lower().split()) for x in (t, t[: len(t) - k] + following[:k], following))
        exact = lambda x, y: sum((x & y).values()) / max(1, sum((x | y).values()))
        errors += [got[i]["near_edited"] - exact(a, b), got[i]["near_next"] - exact(a, c)]
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_entry_lists_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11)) and "pipeline" in names


def test_url_sql(spark, tiny):
    from strandline.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL["op9_urls"])
    names = [c[0] for c in cur.description]
    got = QUERIES["op9_urls"](spark, tiny)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
