"""Lines compared many at once within the band that the similarity leaves."""

import random

from strandline.llm import lines


def changed(draw, line, edits):
    out = bytearray(line)
    for _ in range(edits):
        at, kind = draw.randrange(len(out)), draw.randrange(3)
        if kind == 0:
            out[at] = draw.choice(b"abcdef ")
        elif kind == 1:
            out.insert(at, draw.choice(b"abcdef "))
        elif len(out) > 1:
            del out[at]
    return bytes(out)


def test_band_decides_as_the_distance_does(monkeypatch):
    draw = random.Random(3)
    monkeypatch.setattr(lines, "FEW_PAIRS", 0)
    for most in (1, 64, 300):
        monkeypatch.setattr(lines, "CHUNK_PAIRS", most)
        pairs, limits = [], []
        for _ in range(300):
            a = bytes(draw.choices(b"abcdef ", k=draw.choice((1, 2, 5, 20, 63, 64, 65, 130, 400))))
            b = changed(draw, a, draw.randrange(len(a) // 5 + 2)) if draw.random() < 0.8 else bytes(draw.choices(b"abcdef ", k=len(a)))
            pairs.append((a, b) if draw.random() < 0.5 else (b, a))
            limits.append(max(abs(len(a) - len(b)), draw.choice((len(a) // 10, len(a) // 5, draw.randrange(len(a) + 2)))))
        want = [int(d) <= limit for d, limit in zip(lines.edit_distances(pairs), limits, strict=True)]
        assert lines.within_limits(pairs, limits).tolist() == want and 30 < sum(want) < 270


def test_no_whole_matrices_are_worked_out(monkeypatch):
    """Pairs of some 2500 bytes are decided within their bands, which hold a fifth of a matrix."""
    draw = random.Random(4)
    left = [bytes(draw.choices(b"abcdefghij ", k=2500 + 10 * k)) for k in range(60)]
    right = [changed(draw, x, 60 if k % 3 else 400) for k, x in enumerate(left)]
    monkeypatch.setattr(lines, "_chunk_distances", None)
    got = lines.similar_rows(left, right, 0.9)
    assert got == [lines.edit_distance(a, b, 10_000) <= int(0.1 * max(len(a), len(b)) + 1e-9) for a, b in zip(left, right, strict=True)] and 30 < sum(got) < 60
