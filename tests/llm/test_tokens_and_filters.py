"""Token alignment, filter audit and packing against brute force."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import alignment, filter_audit, packing, queries

A, B, W = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))
ODD = ["", None, " ", "  ", "\n", "\n\n a", "a \n b  ", "\ta", "x▁y", "a  b", "<|endoftext|> </s> <s> <0x0A>", "<|EndOfText|>x<|startoftext|>", "don't I'LL 'S 's123 4５", " é̀ ́x", "İ ſ a　b 日本 語", "a\x0bb\x85c\x1cd\x00"]


def odd_texts(seed, n=300):
    draw = random.Random(seed)
    return ODD + ["".join(draw.choice("aAé́ \n\t 'sltre1２_-<|>日ıİ▁ \x00\x85　") for _ in range(draw.randrange(60))) for _ in range(n)] + ["word " * 3000 + "x" * 9000, "日本語" * 4000]


def odd_frame(spark, texts):
    """Ids with nulls and repeats, a row twice, and columns whose names need quotes or clash with the operators' own."""
    rows = [(None if i % 11 == 3 else i // 2, t, "x") for i, t in enumerate(texts)]
    rows += [rows[20], rows[20]]
    return spark.createDataFrame(rows, "doc_id long, text string, `a b.c` string").withColumn("key", F.lit(1)).withColumn("block", F.lit("b")).withColumn("row", F.lit(2)), rows


def piece_bytes(model):
    p = sentencepiece.SentencePieceProcessor(model_file=model)
    return p, [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.get_piece_size())]


def slow_alignment(texts):
    """Rows of the contract without doc_id, token by token."""
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b, table = piece_bytes(B)
    docs, counts = [], collections.Counter()
    for t in texts:
        whole = " " + (t or "")
        ours = a.encode(whole, add_special_tokens=False)
        spans_a, at = [], 0
        for i in ours.ids:
            # a byte-level vocabulary writes each byte as one character
            n = len(a.id_to_token(i))
            spans_a.append((i, at, at + n))
            at += n
        spans_b, to = [], 0
        ids = b.encode(t or "")
        for i in ids:
            spans_b.append((i, to, to + len(table[i])))
            to += len(table[i])
        if not t or at != len(whole.encode()) or b"".join(table[i] for i in ids) != whole.encode():
            docs.append(None)
            continue
        ends = sorted({e for *_, e in spans_a} & {e for *_, e in spans_b})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in spans if low <= s < e) for spans in (spans_a, spans_b)))
            low = e
        links, first = [], 0
        for i, s, e in spans_a:
            while spans_b[first][2] <= s:
                first += 1
            k = first
            while k < len(spans_b) and spans_b[k][1] < e:
                links.append((i, spans_b[k][0]))
                k += 1
        counts.update(links)
        docs.append((len(spans_a), len(spans_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = collections.Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if d is None else (*d[:3], len(d[3]), sum(counts[x] == top[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4]) for d in docs]


@pytest.mark.parametrize("pairs_per_task", [alignment.PAIRS_PER_TASK, 3])
def test_alignment(spark, monkeypatch, pairs_per_task):
    """Also with stripes that are added up in parts, and small blocks and caches."""
    monkeypatch.setattr(alignment, "PAIRS_PER_TASK", pairs_per_task)
    df, rows = odd_frame(spark, odd_texts(5))
    got = alignment.align_tokens(df.repartition(3), A, B, stripes=7).collect()
    want = collections.Counter((r[0], *w) for r, w in zip(rows, slow_alignment([r[1] for r in rows]), strict=True))
    assert collections.Counter(tuple(r) for r in got) == want and sum(w[1] == 0 for w in want) > 20
    assert alignment.align_tokens(df.limit(0), A, B).count() == 0


def test_alignment_of_the_documents(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_alignment(spark, tiny)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter((r[0], *w) for r, w in zip(rows, slow_alignment([r[1] for r in rows]), strict=True))


def test_alignment_refuses_tokens_that_span_cuts(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(open(A).read().replace('"add_prefix_space": false, "trim_offsets": true, "use_regex": true', '"add_prefix_space": true, "trim_offsets": true, "use_regex": true').replace('"add_prefix_space":false', '"add_prefix_space":true'))
    with pytest.raises(ValueError, match="span"):
        alignment.Pair(path.read_text(), open(B, "rb").read())


def slow_audit(docs, labels):
    """Rows of the contract by applying the filters one after another in every order."""
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    fails = []
    for i, t, s in docs:
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        earlier = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails.append((s or "", i, {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": earlier}))
    out = {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        rows, shapley = [], collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(range(len(own)))
            for step, x in enumerate(order, 1):
                hit = [k for k in left if own[k][2][x]]
                left = [k for k in left if not own[k][2][x]]
                all_ = [k for k in range(len(own)) if own[k][2][x]]
                only = sum(1 for k in all_ if sum(own[k][2].values()) == 1)
                rows.append((order, step, x, len(left), len(hit), len(all_) - len(hit), only, sum(own[k][1] in good for k in hit), sum(own[k][1] in toxic for k in hit)))
                shapley[x] += len(hit)
        for order, step, x, *n in rows:
            out[part, order, step] = (*n, shapley[x])
    return out


COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark):
    draw = random.Random(4)
    words = lambda n, k: " ".join(draw.choices([f"w{i}" for i in range(k)], k=n))
    texts = ["", None, " \t\n", "A", "x & y", words(199, 500), words(200, 500), words(300, 20), words(400, 9).upper(), "é" * 300, words(250, 900) + " #", " " + words(210, 400) + "\n"]
    docs = [(draw.choice([None, *range(25)]), draw.choice(texts), draw.choice(["s1", "s2", None, ""])) for _ in range(90)]
    docs += [docs[0]] * 3 + [(7, texts[6], "s1"), (7, texts[6], "s2"), (8, texts[6], "s1"), (None, texts[6], "s1")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in [None, 1, 1, 2, 3, 5, 7, 7, 8, 9, 12, 13, 40]]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("word", F.lit(1)).withColumn("a b.c", F.lit("n")).repartition(3)
    got = filter_audit.audit_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(3))).collect()
    want = slow_audit(docs, labels)
    assert len(got) == len(want) == 120 * 5 * 3
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in got} == want
    assert filter_audit.audit_filters(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_audit_sql(spark, tiny):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.sql(f"create view {f[:-8]} as select * from '{tiny}/{f}'")
    cur = con.execute(queries.ORACLE_SQL["op12_filter_audit"])
    names = [c[0] for c in cur.description]
    got = queries.op12_filter_audit(spark, tiny)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())


def padding(lengths, size):
    return sum(0 if n & (n - 1) == 0 else size - n for n in lengths)


def check_packing(rows, got):
    """Every document's ids lie in its pieces once and in order, and sequences are gapless, within their length and without padding."""
    t = Tokenizer.from_file(W)
    want = collections.Counter()
    for i, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[i, len(ids), zlib.crc32(ids)] += 1
    frame = pd.DataFrame([r.asDict() for r in got])
    for _, g in frame.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048 and (g.length > 0).all()
    assert padding(frame.groupby("sequence_id").length.sum(), 2048) == 0
    assert frame.length.sum() == sum(n * k for (_, n, _), k in want.items())
    by_id = collections.defaultdict(list)
    for i, text, *_ in rows:
        by_id[i].append(np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    for i, docs in by_id.items():
        own = frame[frame.doc_id.isna()] if i is None else frame[frame.doc_id == i]
        # pieces that the documents of this id could give, each as often as it is there
        assert len(own) and all(any(n == len(x) and zlib.crc32(x[a : a + m]) == c for x in docs) for a, m, c, n in zip(own.start, own.length, own.ids_crc32, own.doc_tokens, strict=True))
        if len(docs) == 1:
            own = own.sort_values("start")
            assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(docs[0])


def test_packing(spark, monkeypatch):
    df, rows = odd_frame(spark, odd_texts(6))
    got = packing.pack_documents(df.repartition(3), W)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check_packing(rows, got.collect())
    assert packing.pack_documents(df.limit(0), W).count() == 0


def test_packing_of_the_documents(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_packing(spark, tiny)
    check_packing(rows, got.collect())


def test_encoder_forgets_and_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    import pyarrow as pa

    encoder = packing.Encoder(packing.read_tokenizer(W))
    t = Tokenizer.from_file(W)
    for texts in (["a b c d"], ["c d e f", None], ["A b"]):
        ids, begin = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:], strict=True)] == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_assignment_follows_the_method():
    """Descending lengths, each to the cheapest sequence with room; cut only when none has room."""
    draw = random.Random(2)
    for size, most, n in ((64, 200, 60), (16, 16, 40), (2048, 5000, 30), (8, 1, 5)):
        lengths = np.array([draw.randint(1, most) for _ in range(n)])
        pieces = packing.assign(lengths, size)
        whole = int((lengths // size).sum())
        room = {whole + s: int(c) for s, c in enumerate(packing.capacities(int((lengths % size).sum()), size))}
        assert sum(room.values()) == (lengths % size).sum() and all(c == size or c & (c - 1) == 0 for c in room.values())
        assert all(p[2] == size and p[4] == 0 for p in pieces[:whole])
        left, spent, full = dict(room), dict.fromkeys(room, 0.0), dict(room)
        remaining = collections.Counter({d: int(x % size) for d, x in enumerate(lengths)})
        for d, _, m, s, offset in pieces[whole:]:
            assert remaining[d] == max(remaining.values()) and offset == full[s] - left[s]
            fits = [k for k in left if left[k] >= remaining[d]]
            if fits:
                assert m == remaining[d] and spent[s] == min(spent[k] for k in fits) and s in fits
            else:
                assert m == left[s] == max(left.values())
            left[s] -= m
            spent[s] += float(packing.cost(np.array(m)))
            remaining[d] -= m
        assert not any(left.values()) and not any(remaining.values())


def test_costs_are_balanced(spark, tiny):
    got = queries.op13_packing(spark, tiny).toPandas()
    got["cost"] = packing.cost(got.length.to_numpy())
    full = got[got.length < 2048].groupby("sequence_id").agg(cost=("cost", "sum"), n=("length", "sum"))
    full = full[full.n == 2048].cost
    assert full.std() < 0.1 * full.mean()
