"""The search by DNA finds all pairs that score enough, seeds or not."""

import random

from strandline.operators import align, homology
from strandline.plans import modelling
from strandline.plans.catalogue import QUERIES


def test_scores_of_all_queries_at_once(monkeypatch):
    draw = random.Random(5)
    bases = lambda n: "".join(draw.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=n))
    for column, letters, longest in ((192, 8192, 60), (8, 300, 60), (64, 1, 20), (64, 4096, 500)):
        monkeypatch.setattr(align, "COLUMN", column)
        monkeypatch.setattr(align, "RUN_LETTERS", letters)
        q = [bases(draw.randint(1, longest)) for _ in range(12)]
        t = [x[:20] + bases(3) + x[20:] for x in q] + [bases(draw.randint(1, 200)) for _ in range(8)] + ["A", "", "RYA", q[0] + q[1]]
        want = [[align.within_score(a, b)[0] if b else -(5 + 2 * (len(a) - 1)) for a in q] for b in t]
        assert align.Motifs(q).scores(t).tolist() == want


def test_scores_in_a_long_sequence():
    draw = random.Random(7)
    q, t = (["".join(draw.choices("ACGT", k=n)) for n in sizes] for sizes in ((30, 55, 100), (70_000, 40_000)))
    assert align.Motifs(q).scores(t).tolist() == [[align.within_score(a, b)[0] for a in q] for b in t]


def test_dna_hits_are_those_of_brute_force(spark, tmp_path, monkeypatch):
    """Motifs with each fourth base changed share no k-mer of 15 with the sequences that hold them, nor do those of 10 to 14 bases, or the other strand."""
    draw = random.Random(9)
    bases = lambda n: "".join(draw.choices("ACGT", k=n))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    worn = lambda s: "".join("CATG"["ACTG".index(c)] if i % 4 == 3 else c for i, c in enumerate(s))
    m = [bases(n) for n in (60, 61, 45, 90, 12, 10, 9, 3)] + ["ACGNNT" * 6, "", None, "ANN" * 12, "NAGN" * 5 + "C"]
    texts = [bases(40) + worn(m[0]) + bases(30), worn(back(m[1])), back(m[2]) + bases(20), m[4] + bases(10), bases(8) + back(m[5]), m[6] * 2, worn(m[3])[:50], bases(30), "ACGNNT" * 6, "", None, worn(m[3]), worn(m[3])]
    spark.createDataFrame(list(enumerate(m)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for k, q in enumerate(m):
        for i, t in enumerate(texts):
            for strand, x in (("+", q), ("-", back(q or ""))):
                if q and t and len(q) >= 10:
                    h = align.semi_global(x, t)
                    if h["score"] >= 1.5 * len(q) and 100 * h["matches"] >= 30 * len(q) and 100 * h["matches"] >= 60 * max(h["matches"] + h["mismatches"], 1):
                        want.add((i, k, strand, h["start"], h["end"]))
    monkeypatch.setattr(homology, "MOTIF_BLOCK", 3)
    monkeypatch.setattr(homology, "SEQUENCE_BLOCK", 4)
    got = [(r["plasmid_id"], r["sseqid"], r["strand"], r["start"], r["end"]) for r in modelling._dna_hits(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    assert {(0, 0, "+"), (1, 1, "-"), (2, 2, "-"), (3, 4, "+"), (4, 5, "-"), (11, 3, "+"), (12, 3, "+")} <= {x[:3] for x in want}
    found = {(r["plasmid_id"], r["strand"], r["kind"]) for r in QUERIES["search_three_pass"](spark, str(tmp_path)).collect()}
    assert {(0, "+", "dna"), (1, "-", "dna"), (2, "-", "dna"), (12, "+", "dna")} <= found
