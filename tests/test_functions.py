import uuid

from pyspark.sql import functions as F

from strandline.functions import dna, tokens


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_sequences(spark):
    c = F.col("s")
    assert one(spark, dna.clean_dna(c), s="<ORI_X>ac-gtn z") == "ACGTN"
    assert one(spark, dna.clean_iupac(c), s=">head\nacR\ngy9") == "ACRGY"
    assert one(spark, dna.reverse_complement(c), s="ATGCN") == "NGCAT"
    assert one(spark, dna.translate(c), s="ATGGCCTAAT") == "MA*"
    assert one(spark, dna.translate(c), s="ATGNCC") == "MX"
    assert one(spark, dna.translate(c), s="AT") is None
    assert one(spark, dna.six_frames(c), s="ATGGCCTAA")[0] == "MAX"
    assert sorted(one(spark, dna.kmers(c, 3), s="ATATA")) == ["ATA", "TAT"]
    assert one(spark, dna.kmers(c, 9), s="ATATA") == []


def test_kmerize_round_trip(spark):
    for s in ("A", "ACGTAC", "ACGTACG", "ACGTACGTACGTT"):
        parts = one(spark, dna.kmerize(F.col("s"), 6, 3), s=s)
        assert all(len(p) == 6 for p in parts)
        assert one(spark, dna.kmer_decode(dna.kmerize(F.col("s"), 6, 3), 3), s=s).startswith(s)


def test_fill_n_is_stable(spark):
    a = one(spark, dna.fill_n(F.col("s")), s="ANNGN")
    assert a == one(spark, dna.fill_n(F.col("s")), s="ANNGN") and "N" not in a and a[0] == "A" and a[3] == "G"


def test_uuid5(spark):
    ns = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    assert one(spark, dna.uuid5(ns, F.col("s")), s="<ORI_É>") == str(uuid.uuid5(uuid.UUID(ns), "<ORI_É>"))


def test_encode_sample(spark):
    df = spark.createDataFrame([([2, 3], [7, 8])], "p array<int>, c array<int>")
    a, b, c = dna.encode_sample(F.col("p"), F.col("c"), 6, 1, 0)
    r = df.select(a.alias("a"), b.alias("b"), c.alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == ([2, 3, 7, 8, 1, 0], [1, 1, 1, 1, 1, 0], [-100, -100, 7, 8, 1, -100])
    a, b, c = dna.encode_sample(F.col("p"), F.col("c"), 1, 1, 0)
    r = df.select(a.alias("a"), c.alias("c")).first()
    assert (r["a"], r["c"]) == ([2], [-100])


def test_tokens(spark):
    s = "<BOS><TAG_A><AMR_B><AMR_A><SEQ>x"
    t = tokens.tokens_in(F.col("s"))
    assert one(spark, tokens.hard_tokens(t), s=s) == ["<TAG_A>", "<AMR_B>", "<AMR_A>"]
    assert one(spark, tokens.hard_tokens(t, exclude=("<AMR_B>",)), s=s) == ["<TAG_A>", "<AMR_A>"]
    assert one(spark, tokens.canonical(tokens.hard_tokens(t)), s=s) == ["<AMR_A>", "<AMR_B>", "<TAG_A>"]
    assert one(spark, tokens.prompt_of(F.array().cast("array<string>"))) == "<BOS><SEQ>"
    assert one(spark, tokens.clean_name(F.col("s")), s="pUC-19 v/1.(x)") == "PUC_19_V_1X"
    assert one(spark, tokens.copy_token(F.col("s")), s=" Very High ") == "<COPY_HIGH>"
    assert one(spark, tokens.copy_token(F.col("s")), s="") is None
    assert one(spark, tokens.split_labels(F.array(F.lit("<VEC_AAV>")))) == ["combined", "mammalian"]


def test_buckets_compare_by_size(spark):
    labels = ["leq_4k", "leq_8k", "leq_16k", "leq_32k", "gt_32k"]
    got = [one(spark, tokens.bucket_ordinal(F.col("s")), s=x) for x in labels]
    assert got == sorted(got)
    assert one(spark, tokens.length_bucket(F.lit(4097))) == "leq_8k"
