import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import align, intervals, scoring
from strandline.operators.order import number_rows


def slow_local(q, t):
    n, m, low = len(q), len(t), -(10**9)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e, f, best = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)], 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - 5, e[i][j - 1] - 1)
            f[i][j] = max(h[i - 1][j] - 5, f[i - 1][j] - 1)
            s = 1 if q[i - 1] == t[j - 1] and q[i - 1] != "N" else -1
            h[i][j] = max(0, h[i - 1][j - 1] + s, e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def slow_semi(q, t):
    n, m, low = len(q), len(t), -(10**9)
    h = [[0] * (m + 1)] + [[low] * (m + 1) for _ in range(n)]
    e, f = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(m + 1):
            f[i][j] = max(h[i - 1][j] - 5, f[i - 1][j] - 2)
            if j:
                e[i][j] = max(h[i][j - 1] - 5, e[i][j - 1] - 2)
                s = 5 if q[i - 1] == t[j - 1] and q[i - 1] != "N" else -4
                h[i][j] = max(h[i - 1][j - 1] + s, e[i][j], f[i][j])
            else:
                h[i][j] = f[i][j]
    return max(h[n])


def test_alignment_against_direct_recurrence():
    draw = random.Random(3)
    for _ in range(60):
        q = "".join(draw.choices("ACGTN", k=draw.randint(1, 14)))
        t = "".join(draw.choices("ACGT", k=draw.randint(1, 25)))
        assert align.local_score(q, t) == slow_local(q, t)
        hit = align.semi_global(q, t)
        assert hit["score"] == slow_semi(q, t)
        assert hit["matches"] + hit["mismatches"] <= len(q)
    assert align.local_score("", "A") == 0
    hit = align.semi_global("ACGTACGT", "TTTACGTACGTTT")
    assert (hit["start"], hit["end"], hit["matches"], hit["gaps"]) == (3, 11, 8, 0)


def slow_kept(rows, limit):
    kept = []
    for e, lo, hi, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        both = [(max(min(hi, b) - max(lo, a) + 1, 0), b - a + hi - lo + 2) for _, a, b, _ in kept]
        if all(x / (n - x) < limit for x, n in both):
            kept.append((e, lo, hi, _))
    return {r[0] for r in kept}


def slow_loci(rows):
    done = []
    for e, lo, hi, v in sorted(rows, key=lambda r: (r[1], r[2], r[3], str(r[0]))):
        near = [c for c, a, b, _ in done if max(min(hi, b) - max(lo, a), 0) / max(min(hi - lo, b - a), 1) >= 0.5]
        done.append((min(near, default=max((c for c, *_ in done), default=-1) + 1), lo, hi, v))
    by = {c: [x for x in done if x[0] == c] for c, *_ in done}
    return {(c, min(x[1] for x in m), max(x[2] for x in m), max(x[3] for x in m), len(m)) for c, m in by.items()}


def test_interval_queries_answer_for_every_user(spark, tmp_path):
    from strandline.plans.catalogue import QUERIES

    draw = random.Random(9)
    rows = [(i, draw.choice([1, 59, 60, 500]), draw.choice(["click", "error"]), draw.randint(0, 600) / 10, f'{{"k": {draw.randint(0, 30)}}}') for i in range(300)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    by_user, by_type = {}, {}
    for e, u, t, v, p in rows:
        lo = int(v * 10 // 1)
        for groups, key in ((by_user, u), (by_type, (u, t))):
            groups.setdefault(key, []).append((e, lo, lo + int(p[6:-1]) + 1, v))
    got = {n: [tuple(r) for r in QUERIES[n](spark, str(tmp_path)).collect()] for n in ("interval_nms_token", "interval_nms_global", "interval_ori_loci")}
    assert sorted(got["interval_nms_token"]) == sorted((*k, e) for k, g in by_type.items() for e in slow_kept(g, 0.5))
    assert sorted(got["interval_nms_global"]) == sorted((k, e) for k, g in by_user.items() for e in slow_kept(g, 0.3))
    assert sorted(got["interval_ori_loci"]) == sorted((u, *x) for (u, t), g in by_type.items() if t == "error" for x in slow_loci(g))


def spans(n, keys, width, most, seed):
    draw = random.Random(seed)
    return [(draw.choice(keys), i, lo := draw.randint(0, width), lo + draw.randint(0, most), draw.randint(0, 400) / 4) for i in range(n)]


@pytest.mark.parametrize("n, keys, width, most, rows", [(5000, [1], 60_000, 120, 700), (5000, [1, None, 2], 900, 200, 400), (600, [1], 0, 3, 50), (40, [1], 50, 20, 1000)])
def test_suppression_by_rounds_equals_the_fold(spark, n, keys, width, most, rows):
    """Sparse and dense islands, null keys, and spans that all lie on one place, in ranges much smaller than an island."""
    data = spans(n, keys, width, most, n)
    df = spark.createDataFrame(data, "k int, event_id int, lo int, hi int, value double")
    got = {(r["k"], r["event_id"]) for r in intervals.suppress(df, ["k"], 0.5, rows).collect()}
    assert got == {(k, e) for k in keys for e in slow_kept([x[1:] for x in data if x[0] == k], 0.5)}


def test_suppression_of_a_long_chain_and_of_nothing(spark):
    """A chain in which each span hangs on the one before is settled from its end."""
    data = [(1, i, 10 * i, 10 * i + 29, 1000.0 - i) for i in range(300)]
    df = spark.createDataFrame(data, "k int, event_id int, lo int, hi int, value double")
    got = {r["event_id"] for r in intervals.suppress(df, ["k"], 0.3, 40).collect()}
    assert got == slow_kept([x[1:] for x in data], 0.3)
    assert intervals.suppress(df.limit(0), ["k"], 0.3).count() == 0


def test_loci_equal_the_fold(spark):
    for n, width, rows in ((5000, 90_000, 600), (1500, 500, 100)):
        data = spans(n, [1, None], width, 90, n)
        df = spark.createDataFrame(data, "k int, event_id int, lo int, hi int, value double")
        got = intervals.cluster_loci(df, ["k"], 0.5, rows).groupBy("k", "island", "cluster").agg(F.min("lo"), F.max("hi"), F.max("value"), F.count("*")).collect()
        for k in (1, None):
            assert sorted(tuple(r[3:]) for r in got if r["k"] == k) == sorted(x[1:] for x in slow_loci([x[1:] for x in data if x[0] == k]))


def test_scans_equal_a_loop(spark):
    from strandline.operators import scan

    draw = random.Random(1)
    data = [(draw.choice([1, 1, 1, 2, None]), draw.choice("ab"), i, draw.choice([0.95, 0.5, 1.0, 0.0]), draw.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "u int, v string, s int, a double, b double")
    x = {(r["u"], r["v"], r["s"]): r["x"] for r in scan.affine_scan(df, ["u", "v"], ["s"], "a", "b", "x", start="b", rows=200).collect()}
    m = {(r["u"], r["v"], r["s"]): r["m"] for r in scan.running_max(df, ["u", "v"], ["s"], "b", "m", rows=200).collect()}
    now, top = {}, {}
    for u, v, s, a, b in data:
        now[u, v] = a * now.get((u, v), b) + b
        assert x[u, v, s] == pytest.approx(now[u, v]) and m[u, v, s] == top.get((u, v))
        top[u, v] = max(top.get((u, v), 0), b)
    assert scan.affine_scan(df.limit(0), ["u"], ["s"], "a", "b", "x").count() == 0


def test_whole_motifs(spark, tmp_path):
    from strandline.plans.catalogue import QUERIES

    draw = random.Random(4)
    motif = "".join(draw.choices("ACGT", k=110)) + "NN"
    rest = "".join(draw.choices("ACGT", k=40)) + motif[60:] + "".join(draw.choices("ACGT", k=40))
    spark.createDataFrame([(7, motif)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, rest), (2, "".join(draw.choices("ACGT", k=200))), (3, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {n: QUERIES[n](spark, str(tmp_path)).collect() for n in ("seq_translate_six_whole", "seq_kmer_containment_whole", "seq_kmerize_whole", "seq_kmer_decode_whole", "seq_n_replace_whole", "align_local_ratio", "align_semiglobal", "align_repair")}
    grams = lambda x: {x[i : i + 15] for i in range(len(x) - 14)}
    assert [tuple(r) for r in got["seq_kmer_containment_whole"]] == [(1, 7, len(grams(motif) & grams(rest)), len(grams(motif)))]
    assert [len(x) for x in got["seq_translate_six_whole"][0]["frames"]] == [37, 37, 37, 37, 36, 36]
    assert got["seq_kmerize_whole"][0]["parts"] == [motif[i : i + 6].ljust(6, "A") for i in range(0, 109, 3)]
    assert got["seq_kmer_decode_whole"][0]["decoded"] == motif.ljust(114, "A")
    filled = got["seq_n_replace_whole"][0]["filled"]
    assert len(filled) == 112 and filled[:110] == motif[:110] and set(filled) <= set("ACGT")
    assert got["align_local_ratio"][0]["ratio"] == round(slow_local(motif, rest) / slow_local(motif, motif), 4)
    (hit,) = got["align_semiglobal"]
    assert hit["score"] == slow_semi(motif, rest) and hit["coverage"] == 100 * hit["matches"] / 112
    weak = hit["pct_id"] >= 90 and 40 <= hit["coverage"] < 85
    assert [r["repaired"] for r in got["align_repair"]] == ([rest[: hit["start"]] + motif + rest[hit["end"] :]] if weak else [])


def test_near_pairs_against_all_pairs(spark):
    draw = random.Random(5)
    rows = [(draw.randint(0, 2), i, lo := draw.randint(-300, 300), lo + draw.randint(0, 120)) for i in range(80)]
    a, b = rows[:40], rows[40:]
    got = intervals.near_pairs(*(spark.createDataFrame(x, "k int, id int, lo int, hi int") for x in (a, b)), "k", 50).collect()
    want = {(x[0], x[1], y[1], g) for x in a for y in b if x[0] == y[0] and (g := max(y[2] - x[3], x[2] - y[3], 0)) <= 50}
    assert len(got) == len(want) and {(r["k"], r["a_id"], r["b_id"], r["gap"]) for r in got} == want


def test_auroc_against_pairs(spark):
    draw = random.Random(7)
    rows = [(draw.randint(0, 9), draw.randint(0, 1)) for _ in range(60)]
    p, q = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / len(p) / len(q)
    assert scoring.auroc(spark.createDataFrame(rows, "s int, y int"), "s", "y").first()[0] == pytest.approx(want)


def test_number_rows(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 200)], "x int")
    assert [r["n"] for r in number_rows(df, ["x"], "n", 7).orderBy("x").collect()] == list(range(200))
    assert number_rows(df.limit(0), ["x"], "n").count() == 0


def test_softmax_and_schedule(spark):
    p = spark.range(1).select(scoring.softmax(F.array(F.lit(1.0), F.lit(2.0))).alias("p")).first()["p"]
    assert sum(p) == pytest.approx(1) and p[1] / p[0] == pytest.approx(2.718281828, rel=1e-6)
    rates = [r[0] for r in spark.range(0, 101, 10).select(scoring.warm_cosine(F.col("id"), 20, 100, 1.0)).collect()]
    assert max(rates) == pytest.approx(1) and rates[-1] == pytest.approx(0, abs=1e-9)


def test_sketches_keep_their_rank_error(spark):
    """Grouped, merged from many small sketches, scalar and array; ranks against the sorted values."""
    from strandline.operators import sketches

    draw = random.Random(3)
    data = [(k, draw.randint(0, 30), float(int(draw.expovariate(0.01))) if k == "a" else draw.gauss(0, 1)) for k in "ab" for _ in range(20_000)]
    df = spark.createDataFrame([*data, ("a", 1, None), ("none", 1, None)], "k string, day int, v double")
    q = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    parts = sketches.sketches(df, "v", ["k", "day"], 0.01)
    got = {r["k"]: r["q"] for r in sketches.merged(parts, ["k"], 0.01).select("k", sketches.quantile(F.col("sketch"), q).alias("q")).collect()}
    one = {r["k"]: r["q"] for r in sketches.approximate_quantiles(df, "v", 0.5, ["k"]).collect()}
    for k in "ab":
        values = sorted(v for x, _, v in data if x == k)
        for share, v in [*zip(q, got[k], strict=True), (0.5, one[k])]:
            low, high = (sum(x < v for x in values), sum(x <= v for x in values))
            assert low / len(values) - 0.01 <= share <= high / len(values) + 0.01
    assert got["none"] is None and one["none"] is None
    assert sketches.sketch_size(0.01) < sketches.sketch_size(0.005)
    with pytest.raises(ValueError, match="rank error"):
        sketches.sketch_size(1e-9)


def test_algorithms(spark):
    from strandline.operators.algorithms import build_algorithm

    df = spark.createDataFrame([(i // 4, float(r)) for i, r in enumerate([1, 2, 3, 4, 10, 20, 30, 40, 5, 5, 5, 5])] + [(None, 3.0)], "group int, reward double")
    by = {}
    for r in build_algorithm("grpo").advantages(df).collect():
        by.setdefault(r["group"], []).append(r["advantage"])
    assert sum(by[0]) == pytest.approx(0) and sorted(by[0]) == pytest.approx(sorted(by[1])) and by[2] == [0.0] * 4 and by[None] == [0.0]
    alone = build_algorithm("ppo").advantages(df.where("group is null")).first()
    assert alone["advantage"] == 3.0
    plain = [r["advantage"] for r in build_algorithm("ppo").advantages(df.limit(5)).collect()]
    assert sum(plain) == pytest.approx(0)
    assert build_algorithm("grpo").loss_name == "grpo" and "kl" in str(build_algorithm("grpo").loss(kl=0.5))
    with pytest.raises(KeyError, match="ppo"):
        build_algorithm("nothing")


def test_batched_alignments_equal_the_recurrences(spark):
    """Groups of many lengths at once, DNA and proteins, empty ones among them, against one pair at a time and the direct recurrences."""
    from strandline.functions.proteins import AMINO_ACIDS

    draw = random.Random(12)
    for table, gap_open, gap_extend, letters in ((align.LOCAL_DNA, 5, 1, "ACGTN"), (align.WITHIN_DNA, 5, 2, "ACGTN"), (align.PROTEIN, 11, 1, AMINO_ACIDS + "*X")):
        q, t = (["".join(draw.choices(letters, k=draw.randint(0, k))) for _ in range(200)] for k in (40, 120))
        for i in range(0, 200, 2):
            at = draw.randint(0, len(t[i]))
            t[i] = t[i][:at] + "".join(draw.choice(letters) if draw.random() < 0.1 else c for c in q[i] if draw.random() > 0.05) + t[i][at:]
        local = align.local_scores(q, t, table, gap_open, gap_extend)
        score, end = align.scores_within(q, t, table, gap_open, gap_extend)
        for i in range(200):
            assert local[i] == align.local_score(q[i], t[i], table, gap_open, gap_extend)
            assert (score[i], end[i]) == (align.within_score(q[i], t[i], table, gap_open, gap_extend) if q[i] and t[i] else (0, 0))
    q, t = (["".join(draw.choices("ACGT", k=draw.randint(1, k))) for _ in range(40)] for k in (14, 25))
    assert align.local_scores(q, t).tolist() == [slow_local(a, b) for a, b in zip(q, t, strict=True)]
    assert align.scores_within(q, t)[0].tolist() == [slow_semi(a, b) for a, b in zip(q, t, strict=True)]
    long = "".join(draw.choices("ACGT", k=9000))
    assert align.scores_within([long[:6000], "ACGT"], [long, long])[0].tolist() == [30_000, 20 if "ACGT" in long else 0]
    assert align.local_scores([], []).tolist() == []
