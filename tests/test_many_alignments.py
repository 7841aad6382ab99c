import random

from strandline.operators import align
from strandline.plans import analytics


def test_counts_carried_along_equal_tracebacks(monkeypatch):
    """Hits of many pairs, worked out end to end in several chunks, are those of one traceback each, ties and all."""
    draw = random.Random(4)
    for letters, scores, gaps in (("AC", align.WITHIN_DNA, (5, 2)), ("ACGTN", align.WITHIN_DNA, (5, 2)), ("LSRVPTAGX*", align.PROTEIN, (11, 1))):
        bases = lambda *sizes: "".join(draw.choices(letters, k=draw.choice(sizes)))  # noqa: B023, E731
        queries = [bases(1, 2, 9, 40) for _ in range(150)]
        targets = [bases(1, 20) + q[: len(q) // 2] + bases(0, 1, 3) + q[len(q) // 2 :] + bases(0, 60) for q in queries]
        want = [align.semi_global(q, t, scores, *gaps) for q, t in zip(queries, targets, strict=True)]
        monkeypatch.setattr(align, "CHUNK_LETTERS", 500)
        monkeypatch.setattr(align, "semi_global", None)  # no pair may go on its own
        got = align.traced([*queries, "", "A"], [*targets, "A", ""], scores, *gaps)
        monkeypatch.undo()
        assert got[:-2] == want and set(got[-1].values()) == set(got[-2].values()) == {0}


def test_filtered_kmers_give_the_same_candidates(spark, monkeypatch):
    draw = random.Random(6)
    bases = lambda n: "".join(draw.choices("ACGT", k=n))
    m = [bases(40) for _ in range(5)] + ["N" * 20, "ACG"]
    s = [m[i % 7] + bases(3) + m[(i + 1) % 7][:20] for i in range(40)] + ["", "ACG", None]
    motif = spark.createDataFrame(list(enumerate(m)), "sseqid long, motif string")
    seqs = spark.createDataFrame(list(enumerate(s)), "plasmid_id long, sequence string")
    got = sorted(map(tuple, analytics.kmer_candidates(motif, seqs).collect()))
    monkeypatch.setattr(analytics, "BROADCAST_KMERS", 0)
    assert got == sorted(map(tuple, analytics.kmer_candidates(motif, seqs).collect())) and len(got) > 60
