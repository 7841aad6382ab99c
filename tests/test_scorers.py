import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import proteins
from strandline.operators import align, scoring
from strandline.scorers import AlignmentScorer, HitScorer, SubstringScorer, build_scorer

LOOKUP = "token string, dna_seq string, protein_seq string, is_cds boolean"


def test_blosum62_is_symmetric_and_whole():
    s = proteins.protein_scores()
    assert (s == s.T).all() and s[ord("W"), ord("W")] == 11 and s[ord("E"), ord("D")] == 2 and s[ord("X"), ord("A")] == -1


def slow_score(q, t, scores, gap_open, gap_extend):
    n, m, low = len(q), len(t), -(10**9)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e, f, best = [[low] * (m + 1) for _ in range(n + 1)], [[low] * (m + 1) for _ in range(n + 1)], 0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - gap_open, e[i][j - 1] - gap_extend)
            f[i][j] = max(h[i - 1][j] - gap_open, f[i - 1][j] - gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + int(scores[ord(q[i - 1]), ord(t[j - 1])]), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_protein_alignment_against_direct_recurrence():
    draw, s = random.Random(5), proteins.protein_scores()
    for _ in range(40):
        q, t = ("".join(draw.choices(proteins.AMINO_ACIDS + "*X", k=draw.randint(1, 18))) for _ in range(2))
        assert align.local_score(q, t, s, 10, 1) == slow_score(q, t, s, 10, 1)


def test_traceback_adds_up():
    draw = random.Random(6)
    for _ in range(80):
        q = "".join(draw.choices("ACGT", k=draw.randint(1, 30)))
        t = list("".join(draw.choices("ACGT", k=20)) + q + "".join(draw.choices("ACGT", k=20)))
        for _ in range(draw.randint(0, 3)):
            i = draw.randrange(len(t))
            t[i : i + draw.randint(0, 3)] = draw.choices("ACGT", k=draw.randint(0, 3))
        t = "".join(t)
        hit = align.semi_global(q, t)
        score, end = align.within_score(q, t)
        assert (hit["score"], hit["end"]) == (score, end)
        assert hit["matches"] + hit["mismatches"] <= len(q) and 0 <= hit["start"] <= hit["end"] <= len(t)
        used = hit["end"] - hit["start"] + len(q) - 2 * (hit["matches"] + hit["mismatches"])
        assert used == hit["gaps"]
        if not hit["gaps"]:
            assert score == 5 * hit["matches"] - 4 * hit["mismatches"]


def test_alignment_scorer(spark):
    draw = random.Random(1)
    codon = dict(zip(("ATG", "GCT", "TGG", "AAA", "GAA", "TTT"), "MAWKEF", strict=True))
    gene = [draw.choice(list(codon)) for _ in range(30)]
    protein = "".join(codon[c] for c in gene)
    other = "".join(draw.choices("ACGT", k=120))
    lookup = spark.createDataFrame([("<AMR_X>", None, protein, True), ("<ORI_Y>", other.lower(), None, False), ("<ORI_Y>", "ACGTACGTAC" * 4, None, None), ("<ELEM_IRES>", other, None, False)], LOOKUP)
    scorer = AlignmentScorer(lookup)
    back = "".join(gene)[::-1].translate(str.maketrans("ACGT", "TGCA"))
    prompts = ["<BOS><AMR_X><ORI_Y><SEQ>", "<BOS><AMR_X><ORI_Y><SEQ>", "<BOS><ORI_Y><ORI_Y><ELEM_IRES>", "<BOS><AMR_Z><SEQ>", "<BOS><AMR_X>", None]
    sequences = [f"<SEQ>{back}{other}<EOS>", "GC" * 100, other, other, "ATGATG", None]
    got = scorer.score_batch(prompts, sequences)
    assert got[0] == pytest.approx(2.15) and got[1] < 1.2 and got[2] == pytest.approx(2.0) and got[3:] == [0.0, 0.0, 0.0]
    one = scorer.score_sequence_detailed(prompts[0], sequences[0])
    assert one["n_found"] == one["n_hard_tokens"] == 2 and one["qc_pass_rate"] == 1.0 and [m["token"] for m in one["per_motif"]] == ["<AMR_X>", "<ORI_Y>"]
    assert scorer.score_sequence(prompts[0], sequences[0]) == pytest.approx(2.15) and scorer.score_batch([], []) == []


def test_hit_scorer(spark):
    pairs = spark.createDataFrame([(1, "<AMR_A><ORI_B>", "A" * 50), (2, "<AMR_A>", "A"), (3, "<VEC_Q>", None)], "id long, prompt string, sequence string")
    hits = spark.createDataFrame([(1, "<AMR_A>", 100.0, 100.0, 5.0), (1, "<TAG_Z>", 100.0, 100.0, 5.0), (1, "<AMR_A>", 90.0, 10.0, 1.0)], "id long, token string, pct_id double, coverage double, norm_score double")
    got = {r["id"]: r for r in HitScorer(hits).detail(pairs).collect()}
    assert got[1]["reward"] == pytest.approx(0.75) and (got[1]["found"], got[1]["expected"]) == (1, 2) and got[2]["reward"] == got[3]["reward"] == 0.0


PLACED = "id long, token string, pct_id double, coverage double, norm_score double, lo int, hi int, bit_score double"


def slow_valid(prompt, length, best, reach=500):
    """The multiplier by hand: best is token -> (lo, hi, bit score)."""
    import re

    kind = lambda t: t[1:].split("_")[0]
    asked = set(re.findall("<[A-Z]+_[A-Z0-9]+>", prompt))
    clusters = []
    for t, (lo, hi, _) in sorted(((t, x) for t, x in best.items() if kind(t) == "ORI"), key=lambda x: x[1][0]):
        for c in clusters:
            if any(max(0, min(hi, b) - max(lo, a)) / min(max(1, hi - lo), max(1, b - a)) >= 0.5 for _, a, b in c):
                c.append((t, lo, hi))
                break
        else:
            clusters.append([(t, lo, hi)])
    free = [c for c in clusters if not {t for t, *_ in c} & asked]
    others = [t for t in best if t not in asked and kind(t) in ("AMR", "REPORTER", "TAG")]
    table = {"<PROM_AMPR>": {"<AMR_AMPICILLIN>"}, "<PROM_T3>": set(), "<PROM_U6>": set(), "<PROM_SP6>": set()}
    pairs = [(p, c) for p in asked & set(best) if kind(p) == "PROM" for c in asked & set(best) if kind(c) in ("AMR", "REPORTER", "TAG") and (p not in table or c in table[p]) and max(best[c][0] - best[p][1], best[p][0] - best[c][1], 0) <= reach]
    m = 1 + 0.05 * len(pairs) - 0.15 * max(0, len(clusters) - 1) - 0.1 * max(0, sum(kind(t) == "AMR" for t in best) - 2) - 0.05 * (len(others) + len(free)) - min(0.01 * max(0, length - 8000) / 1000, 0.15)
    return round(m, 4), len(clusters), sorted(pairs)


def test_valid_scorer_on_plasmids(spark):
    """Hand-made plasmids: overlapping and separate origins, listed, unlisted and idle promoters, excess markers, long sequences."""
    draw = random.Random(11)
    names = ["<AMR_AMPICILLIN>", "<AMR_KANAMYCIN>", "<AMR_X>", "<ORI_COLE1>", "<ORI_F1>", "<ORI_P15A>", "<PROM_AMPR>", "<PROM_LAC>", "<PROM_T3>", "<PROM_OWN>", "<REPORTER_GFP>", "<TAG_HA>", "<ELEM_WPRE>"]
    pairs, hits, want = [], [], {}
    for i in range(60):
        prompt = "<BOS>" + "".join(draw.sample(names, draw.randint(0, 6))) + "<SEQ>"
        size = draw.choice([10, 300, 9000])
        best = {}
        for t in draw.sample(names, draw.randint(0, 9)):
            for _ in range(draw.randint(1, 2)):
                lo = draw.randint(0, 2000)
                x = (lo, lo + draw.randint(50, 400), float(draw.randint(1, 10**6)))
                hits.append((i, t, 100.0, 100.0, 1.5, x[1], x[0], x[2]) if draw.random() < 0.5 else (i, t, 100.0, 100.0, 1.5, x[0], x[1], x[2]))
                best[t] = max(best.get(t, (0, 0, -1.0)), x, key=lambda y: y[2])
        pairs.append((i, prompt, "A" * size))
        want[i] = (prompt, size, best)
    scorer = build_scorer("valid", hits=spark.createDataFrame(hits, PLACED))
    got = {r["id"]: r for r in scorer.detail(spark.createDataFrame(pairs, "id long, prompt string, sequence string")).collect()}
    assert len(got) == 60
    for i, (prompt, size, best) in want.items():
        m, loci, driven = slow_valid(prompt, size, best)
        asked = [t for t in names if t in prompt]
        if not asked or size < 20:
            assert (got[i]["reward"], got[i]["multiplier"]) == (0.0, 1.0)
            continue
        share = len([t for t in asked if t in best]) / len(asked)
        base = round(0.5 + 0.5 * share, 4) if share else 0.0
        assert (got[i]["multiplier"], got[i]["ori_count"], [tuple(p) for p in got[i]["pairs"]]) == (pytest.approx(m), loci, driven)
        assert got[i]["base_reward"] == pytest.approx(base) and got[i]["reward"] == pytest.approx(min(1, max(0, base * m)), abs=1e-4)


def test_search_scorer_takes_the_hit_of_the_best_bit_score(spark):
    hits = spark.createDataFrame([(0, "<AMR_A>", 50.0, 120.0, 9.0, 1, 2, 90.0), (0, "<AMR_A>", 100.0, 100.0, 1.5, 1, 2, 10.0)], PLACED)
    got = build_scorer("plannotate", hits=hits).detail(spark.createDataFrame([(0, "<AMR_A>", "A" * 30)], "id long, prompt string, sequence string")).first()
    assert got["geo_mean"] == pytest.approx(0.4 * 0.5 + 0.35 + 0.25) and got["recall"] == 1.0


def test_object_scorer_isolates_rows_that_fail(spark):
    class Fussy:
        """Raises on a batch that holds one bad prompt, and on that prompt alone."""

        def score_batch(self, prompts, sequences):
            if "bad" in prompts:
                raise ValueError("bad prompt")
            return [len(p) + 10 * len(s) for p, s in zip(prompts, sequences, strict=True)]

    rows = [(i, "bad" if i == 7 else "p" * i, None if i == 3 else "s") for i in range(40)]
    got = {r["id"]: r for r in build_scorer("object", scorer=Fussy(), batch_rows=16).detail(spark.createDataFrame(rows, "id long, prompt string, sequence string").repartition(3)).collect()}
    assert got[7]["reward"] is None and got[7]["error"] == "ValueError: bad prompt" and got[3]["reward"] == 3.0
    assert all(got[i]["reward"] == i + 10 and got[i]["error"] is None for i in range(40) if i not in (3, 7))
    assert build_scorer("object", scorer=Fussy()).score_batch(["ab"], ["c"]) == [12.0]


def test_registries(spark):
    assert build_scorer("substring", targets=("acg", "ttt")).score_sequence("", "xxACGxx") == 0.5
    assert SubstringScorer(()).score_sequence("", "x") == 0.0
    with pytest.raises(KeyError, match="alignment"):
        build_scorer("nothing")
    with pytest.raises(KeyError, match="reinforce"):
        scoring.loss("nothing")


def test_losses_by_hand(spark):
    """Two sequences of three tokens, one of them wholly masked: its terms are zero over a count of one."""
    rows = [(1, -0.5, -0.4, -0.6, 1.0, 1), (1, -1.0, -1.5, -0.9, 1.0, 1), (1, -9.0, -1.0, -1.0, 1.0, 0), (2, -1.0, -2.0, -3.0, -1.0, 0)]
    df = spark.createDataFrame(rows, "id int, cur double, old double, ref double, adv double, m int")
    s = df.groupBy("id").agg(F.first("adv").alias("adv"), *scoring.masked_terms("cur", "old", "ref", "adv", "m"))
    got = s.agg(*[scoring.loss(n).alias(n) for n in ("reinforce", "ppo", "grpo")]).first()
    import math

    surr = [min(math.exp(c - o), max(0.8, min(1.2, math.exp(c - o)))) for c, o in ((-0.5, -0.4), (-1.0, -1.5))]
    kl = [math.exp(r - c) - (r - c) - 1 for c, r in ((-0.5, -0.6), (-1.0, -0.9))]
    assert got["reinforce"] == pytest.approx(0.75 / 2) and got["ppo"] == pytest.approx((-sum(surr) / 2 - 0.01 * 0.75) / 2) and got["grpo"] == pytest.approx((-sum(surr) / 2 + 0.1 * sum(kl) / 2) / 2)
