"""Queries without an oracle in SQL against brute force or direct recurrences."""

import html
import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import dna, features, proteins, tokens
from strandline.operators import align, scoring
from strandline.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Motifs, and documents that hold some of them whole, damaged or on the other strand."""
    out, draw = str(tmp_path_factory.mktemp("t")), random.Random(31)
    bases = lambda n: "".join(draw.choices("ACGT", k=n))
    m = [bases(90) for _ in range(4)]
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    weak = m[0][:60]
    texts = [bases(40) + m[0] + bases(60), bases(30) + back(m[1]) + bases(30), m[2][30:] + bases(80) + weak, bases(200), "", m[3]]
    spark.createDataFrame(list(enumerate(m)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    return out, m, texts


def six(seq):
    """Six frames in order, by hand."""
    back = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    one = lambda c: dna.AMINO[16 * "TCAG".index(c[0]) + 4 * "TCAG".index(c[1]) + "TCAG".index(c[2])]
    return ["".join(one(s[i : i + 3]) for i in range(k, len(s) - 2, 3)) for k in range(3) for s in (seq, back)]


def test_search_three_pass(spark, folder):
    path, m, texts = folder
    got = {(r["plasmid_id"], r["sseqid"], r["strand"]): r for r in QUERIES["search_three_pass"](spark, path).collect()}
    assert (0, 0, "+") in got and (5, 3, "+") in got and got[1, 1, "-"]["kind"] == "protein"  # k-mers are of the given strand, so the other is found by the protein
    hit = got[0, 0, "+"]
    assert texts[0][hit["start"] : hit["end"]] == m[0] and hit["pct_id"] == hit["coverage"] == 100.0 and hit["norm_score"] == 5.0


def slow_within(q, t, gap_open=11, gap_extend=1):
    """Score of the whole of q within t by the direct recurrence."""
    table, low = proteins.protein_scores(), -(10**9)
    h, f = [0] * (len(t) + 1), [low] * (len(t) + 1)
    for i, a in enumerate(q):
        f = [max(x - gap_open, y - gap_extend) for x, y in zip(h, f, strict=True)]
        row, e = [f[0]], low
        for j, b in enumerate(t):
            e = max(row[j] - gap_open, e - gap_extend)
            row.append(max(h[j] + int(table[ord(a), ord(b)]), e, f[j + 1]))
        h = row
    return max(h)


def test_translated_search_in_all_frames(spark, tmp_path):
    """A protein whose codons are all other ones is planted once in each of the six frames, with a few amino acids changed; its DNA shares no k-mer."""
    draw = random.Random(8)
    codons = {}
    for i, a in enumerate(dna.AMINO):
        codons.setdefault(a, []).append("TCAG"[i // 16] + "TCAG"[i // 4 % 4] + "TCAG"[i % 4])
    protein = "".join(draw.choices("LSRVPTAG", k=50))
    motif = "".join(codons[a][0] for a in protein)
    texts, places = [], {}
    for k in range(6):
        changed = [draw.choice("LSRVPTAG") if draw.random() < 0.1 else a for a in protein]
        gene = "".join(codons[a][-1] for a in changed)
        before, after = ("".join(draw.choices("ACGT", k=n)) for n in (30 + k // 2, 61))
        seq = before + gene + after
        texts.append(seq if k % 2 == 0 else seq[::-1].translate(str.maketrans("ACGT", "TGCA")))
        places[k] = (len(before), len(before) + 150) if k % 2 == 0 else (61, 61 + 150)
    texts += ["".join(draw.choices("ACGT", k=600)), "", "AC"]
    spark.createDataFrame([(0, motif), (1, "ACG"), (2, "TAA" * 20)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits = {r["plasmid_id"]: r for r in QUERIES["search_translated"](spark, str(tmp_path)).collect()}
    assert set(hits) == set(range(6)) and [hits[k]["frame"] % 2 for k in range(6)] == [0, 1] * 3
    for k, r in hits.items():
        assert (r["start"], r["end"]) == places[k]
        assert r["score"] == max(slow_within(protein, x) for x in six(texts[k])) and r["coverage"] > 70
    found = {r["plasmid_id"]: r for r in QUERIES["search_three_pass"](spark, str(tmp_path)).collect()}
    assert set(found) == set(range(6)) and all(r["kind"] == "protein" and r["strand"] == "+-"[k % 2] for k, r in found.items())


def test_neighbour_words(spark):
    from strandline.operators import homology

    got = dict(spark.createDataFrame([("WWWW",), ("AAAA",), ("A*AA",), (None,), ("LLLL",)], "w string").select("w", homology.neighbours("w").alias("n")).collect())
    table = proteins.protein_scores()
    text = lambda code: "".join(proteins.AMINO_ACIDS[code // 20**i % 20] for i in (3, 2, 1, 0))
    assert got["A*AA"] == got[None] == [] and homology.word_code("ARND") == 20 * (20 * (20 * 0 + 1) + 2) + 3
    for w in ("WWWW", "AAAA", "LLLL"):
        score = lambda x, w=w: sum(int(table[ord(a), ord(b)]) for a, b in zip(w, x, strict=True))
        assert w in map(text, got[w]) and all(score(text(x)) >= homology.NEIGHBOUR or text(x) == w for x in got[w])
    assert len(got["WWWW"]) > 1


def test_frame_words_are_those_of_the_frames(spark):
    from strandline.operators import homology

    draw = random.Random(6)
    seqs = ["".join(draw.choices("ACGTN", weights=[9, 9, 9, 9, 1], k=n)) for n in (0, 2, 11, 12, 300, 301, 302)]
    known = {homology.word_code("".join(draw.choices(proteins.AMINO_ACIDS, k=4))) for _ in range(60_000)}
    got = homology.frame_words(spark.createDataFrame(list(enumerate([*seqs, None])), "plasmid_id int, sequence string"), spark.createDataFrame([(k,) for k in known], "word int")).collect()
    frames = {r["i"]: r["f"] for r in spark.createDataFrame(list(enumerate(seqs)), "i int, s string").select("i", dna.six_frames(F.col("s"), "*").alias("f")).collect()}
    want = {(i, k, a, c) for i, f in frames.items() for k, x in enumerate(f) for a in range(len(x or "") - 3) if (c := homology.word_code(x[a : a + 4])) in known}
    assert {tuple(r) for r in got} == want and len(want) > 20


def test_token_hits_of_both_searches(spark):
    from strandline.operators import homology
    from strandline.sources import files

    known = spark.createDataFrame([("ab c", "<T_1>"), ("x", "<T_2>"), ("ab_c", "<T_3>"), ("q/r", "<T_4>")], "sseqid string, token string")
    row = lambda q, s, ident, length, a, b, bits, slen: (q, s, ident, length, 0, 0, a, b, 1, 2, 1e-9, bits, 5, slen)
    nucleotide = [row("q1", "gnl|db|x", 99.0, 80, 10, 90, 50.0, 100), row("q1", "ab_c", 100.0, 10, 1, 11, 500.0, 100), row("q2", "nobody", 100.0, 100, 1, 9, 9.0, 100)]
    translated = [row("q1", "x", 70.0, 90, 300, 30, 50.0, 90), row("q1", "q_r", 101.0, 95, 5, 2, 40.0, 90), row("q2", "x", 20.0, 90, 4, 8, 60.0, 90)]
    frames = [spark.createDataFrame(x, files.HIT_COLUMNS) for x in (nucleotide, translated)]
    got = {(r["qseqid"], r["token"]): r for r in homology.token_hits(*frames, known, min_identity=30.0).collect()}
    assert set(got) == {("q1", "<T_2>"), ("q1", "<T_4>")}
    assert got["q1", "<T_2>"]["search"] == "nucleotide" and (got["q1", "<T_2>"]["lo"], got["q1", "<T_2>"]["hi"]) == (10, 90)
    assert got["q1", "<T_4>"]["pct_id"] == got["q1", "<T_4>"]["coverage"] == 100.0 and got["q1", "<T_4>"]["lo"] == 2
    plain = homology.resolve_subjects(frames[0], known)
    assert {r["sseqid"]: r["token"] for r in plain.collect()} == {"gnl|db|x": "<T_2>", "ab_c": "<T_3>"}


def test_repairs(spark, folder):
    path, m, texts = folder
    got = {r["plasmid_id"]: r for r in QUERIES["align_repair_all"](spark, path).collect()}
    want = {}
    for d, t in enumerate(texts):
        hits = []
        for i, q in enumerate(m):
            if t and len({q[k : k + 15] for k in range(76)} & {t[k : k + 15] for k in range(max(0, len(t) - 14))}) >= 0.15 * 76:
                h = align.semi_global(q, t)
                if h["matches"] >= 0.9 * max(1, h["matches"] + h["mismatches"]) and 0.4 <= h["matches"] / 90 < 0.85:
                    hits.append((-h["start"], i, h["start"], h["end"]))
        out, edge, n = t, len(t), 0
        for _, i, a, b in sorted(hits):
            if b <= edge:
                out, edge, n = out[:a] + m[i] + out[b:], a, n + 1
        if hits:
            want[d] = (out, n)
    assert {d: (r["repaired"], r["n_repairs"]) for d, r in got.items()} == want and want[2][1] == 2


def test_splice_skips_overlaps(spark):
    kind = "array<struct<start:int,end:int,motif:string>>"
    df = spark.createDataFrame([("AAAACCCCGGGG", [(8, 10, "TT"), (6, 9, "XX"), (0, 2, "")])], f"s string, r {kind}")
    row = dna.splice(df, "s", "r").first()
    assert (row["repaired"], row["n_repairs"]) == ("AACCCCTTGG", 2)


def test_protein_ratio_and_batches(spark, folder):
    path, m, texts = folder
    got = {(r["plasmid_id"], r["sseqid"]): r for r in QUERIES["align_protein_ratio"](spark, path).collect()}
    for (d, i), r in got.items():
        assert r["dna_ratio"] == align.dna_ratio(m[i], texts[d])
        assert r["protein_ratio"] == align.protein_ratio(six(m[i])[0], six(texts[d]))
        assert r["found"] == (r["ratio"] >= 0.7) and r["ratio"] == max(r["dna_ratio"], r["protein_ratio"])
    assert got[0, 0]["found"] and got[5, 3]["ratio"] == 1.0
    rewards = {r["plasmid_id"]: r for r in QUERIES["score_batch"](spark, path).collect()}
    for d in {d for d, _ in got}:
        want = sum(min(1.0, r["ratio"] / 0.7) for (x, _), r in got.items() if x == d)
        assert rewards[d]["reward"] == pytest.approx(want)


def test_unescape_and_hash(spark, tiny):
    plain = {r["page_id"]: r["plain"] for r in QUERIES["str_unescape"](spark, tiny).collect()}
    for r in spark.read.parquet(f"{tiny}/pages.parquet").collect():
        assert plain[r["page_id"]] == html.unescape(r["html"])
    rows = QUERIES["str_prompt_hash"](spark, tiny).collect()
    assert len({r["plasmid_id"] for r in rows}) == len(rows) and all(-(1 << 31) <= r["prompt_hash"] < 1 << 31 for r in rows)
    assert spark.sql("select hash('a') h").first()["h"] == 1485273170


def test_ori_tokens(spark, tmp_path):
    draw = random.Random(2)
    rows = [(i, draw.choice([1, 2]), "error", draw.randint(0, 300) / 10, f'{{"k": {draw.randint(0, 40)}}}') for i in range(80)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    spans = [(u, int(v * 10 // 1), int(v * 10 // 1) + int(p[6:-1]) + 1, v, e) for e, u, _, v, p in rows]
    want = []
    for user in (1, 2):
        done = []
        for _, lo, hi, v, e in sorted((s for s in spans if s[0] == user), key=lambda s: (s[1], s[2], s[3], str(s[4]).rjust(19, "0"))):
            near = [c for c, a, b, _, _ in done if max(min(hi, b) - max(lo, a), 0) / max(min(hi - lo, b - a), 1) >= 0.5]
            done.append((min(near, default=max((c for c, *_ in done), default=-1) + 1), lo, hi, v, e))
        for c in {c for c, *_ in done}:
            m = [x for x in done if x[0] == c]
            best = max(m, key=lambda x: (x[3], -x[4]))[4]
            want.append((user, min(x[1] for x in m), max(x[2] for x in m), best, tuple(sorted({f"<ORI_{x[4] % 4}>" for x in m}))))
    got = [(r["user_id"], r["lo"], r["hi"], r["best"], tuple(r["tokens"])) for r in QUERIES["interval_ori_tokens"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


def test_corruption_is_seeded_and_bounded(spark, tiny):
    first = {r["plasmid_id"]: r for r in QUERIES["seq_corrupt"](spark, tiny).collect()}
    again = {r["plasmid_id"]: r["corrupted"] for r in QUERIES["seq_corrupt"](spark, tiny).collect()}
    plain = {r["plasmid_id"]: r["n"] for r in QUERIES["seq_clean"](spark, tiny).collect()}
    for i, r in first.items():
        assert r["corrupted"] == again[i] and set(r["corrupted"] or "") <= set("ACGTN")
        assert len(r["corrupted"] or "") == plain[i] - r["deleted"] + r["inserted"] and (plain[i] > 100 or r["deleted"] == r["inserted"] == 0)


def test_feature_rules_by_hand(spark):
    names = {"AmpR promoter": "<PROM_AMPR>", "AmpR": "<AMR_AMPICILLIN>", "CMV Enhancer": "<ELEM_CMV_ENHANCER>", "the CAT gene": "<AMR_CHLORAMPHENICOL>", "category": None, "orient": None, "SV40 ori": "<ORI_SV40>", "x\nV5\ny": "<TAG_V5>", "": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r["n"]: r["t"] for r in df.select("n", features.token_of_feature(F.col("n")).alias("t")).collect()} == names


def test_tokens_round_trip(spark):
    texts = ["<BOS><AMR_X>ACGTACGTAC<SEQ>nnacg t<EOS>", "ACG", "", "<A><B>", "ACGTAC"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dna.tokenize(F.col("t"), 6, 3).alias("p"))
    rows = {r["t"]: (r["p"], r["d"]) for r in df.select("t", "p", dna.detokenize(F.col("p"), 3).alias("d")).collect()}
    assert rows["ACG"] == (["ACGAAA"], "ACGAAA") and rows[""] == ([], "") and rows["<A><B>"] == (["<A>", "<B>"], "<A><B>")
    assert rows["ACGTAC"] == (["ACGTAC"], "ACGTAC")
    parts, text = rows[texts[0]]
    assert parts[:2] == ["<BOS>", "<AMR_X>"] and parts[2:5] == ["ACGTAC", "TACGTA", "GTACAA"] and text.startswith("<BOS><AMR_X>ACGTACGTACAA<SEQ>") and text.endswith("<EOS>")


def test_prompts(spark):
    df = spark.createDataFrame([(" x ",), ("<BOS> y <SEQ>",)], "t string")
    assert [r[0] for r in df.select(tokens.format_prompt(F.col("t"))).collect()] == ["<BOS> x <SEQ>", "<BOS> y <SEQ>"]


def test_quantiles_and_baseline(spark):
    import numpy as np

    draw = random.Random(3)
    rows = [(draw.choice("ab"), draw.randint(0, 50)) for _ in range(300)]
    got = {r["g"]: (r["q"], r["m"]) for r in scoring.quantiles(spark.createDataFrame(rows, "g string, v int"), "v", {"q": 0.25, "m": 0.5}, ["g"]).collect()}
    for g in "ab":
        v = [x for k, x in rows if k == g]
        assert got[g] == pytest.approx((np.quantile(v, 0.25), np.quantile(v, 0.5)))
    steps = [(1, i, draw.random()) for i in range(700)]
    b, want = steps[0][2], []
    for _, _, x in steps:
        b = 0.95 * b + 0.05 * x
        want.append(b)
    got = scoring.moving_baseline(spark.createDataFrame(steps, "u int, s int, m double"), ["u"], ["s"], "m", rows=60).orderBy("s").collect()
    assert [r["baseline"] for r in got] == pytest.approx(want)
