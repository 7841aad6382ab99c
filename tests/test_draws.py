import hashlib

import numpy as np

from strandline.functions import draws


def test_digests_and_order(spark):
    places = [(0, 1205), (9990, 10_020)]
    blocks = np.concatenate([draws.messages("-9223372036854775808", *p) for p in places])
    want = [hashlib.md5(f"-9223372036854775808-{i}".encode(), usedforsecurity=False).digest() for p in places for i in range(*p)]
    assert [w.tobytes() for w in draws.digests(blocks)] == want
    texts = ["ACGTN" * 4000, "", "GATTACA", None]
    rows = spark.createDataFrame(list(zip(["1", "2", None, "4"], texts, strict=True)), "s string, x string")
    got = [r["d"] for r in rows.select("s", "x", draws.drawn("s", "x").alias("d")).collect()]
    hashes = [hashlib.md5(f"1-{i}".encode(), usedforsecurity=False).hexdigest() for i in range(20_000)]
    assert got[0]["random"] == "".join("ACGT"[int(h[-1], 16) % 4] for h in hashes)
    assert got[0]["shuffled"] == "".join(x[-1] for x in sorted(h + c for h, c in zip(hashes, texts[0], strict=True)))
    assert [tuple(r) for r in got[1:]] == [("", ""), ("", ""), (None, None)]
