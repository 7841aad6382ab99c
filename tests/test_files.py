import pytest
from pyspark.sql import functions as F
from strandline.sources import files


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x|ID1| first\nACG\nTT\n\n>y second\nGG\n")
    got = {r["id"]: r["sequence"] for r in files.read_fasta(spark, str(tmp_path / "a.fa"), pipe_field=2).collect()}
    assert got == {"ID1": "ACGTT", "y": "GG"}
    files.write_fasta(spark.createDataFrame([("a b", "AC"), ("a/b", "GT")], "id string, sequence string").coalesce(1), str(tmp_path / "out"))
    got = {r["id"] for r in files.read_fasta(spark, str(tmp_path / "out")).collect()}
    assert got == {"a_b", "a_b__dup1"}


def test_hits(spark, tmp_path):
    row = "q1\ts1\t97.5\t50\t1\t0\t1\t50\t1\t50\t1e-9\t90\t49\t60"
    (tmp_path / "h.tsv").write_text(f"# note\n{row}\n\nq1\ts1\n{row.replace('90', '95')}\n")
    best = files.best_hits(files.read_hits(spark, str(tmp_path / "h.tsv"))).collect()
    assert len(best) == 1 and best[0]["bitscore"] == 95 and round(best[0]["coverage"], 3) == 83.333


def test_vocabulary(spark, tmp_path):
    files.write_vocabulary(spark.createDataFrame([("<A>", 0), ("<B>", 1)], "token string, id int"), str(tmp_path / "v"))
    assert {(r["token"], r["id"]) for r in files.read_vocabulary(spark, str(tmp_path / "v")).collect()} == {("<A>", 0), ("<B>", 1)}
    (tmp_path / "n.json").write_text('{"token_to_id": {"<C>": 2}}')
    assert files.read_vocabulary(spark, str(tmp_path / "n.json")).collect()[0]["id"] == 2


def test_pairs_and_fan_out(spark, tmp_path):
    spark.createDataFrame([("<BOS><A><SEP>ACGT<EOS>",)], "full_text string").write.parquet(str(tmp_path / "p"))
    r = files.read_pairs(spark, str(tmp_path / "p")).first()
    assert (r["prompt"], r["sequence"]) == ("<BOS><A><SEQ>", "ACGT")
    df = spark.createDataFrame([(1, ["combined", "yeast"], 9000), (2, ["combined"], 100)], "id int, splits array<string>, sequence_length int")
    files.write_fan_out(df, str(tmp_path / "f"))
    assert files.read_fan_out(spark, str(tmp_path / "f"), "combined", "leq_8k").count() == 1
    assert files.read_fan_out(spark, str(tmp_path / "f"), "combined", "leq_16k").count() == 2


def test_feature_metadata(spark, tmp_path):
    import gzip

    from strandline.sources import files

    (tmp_path / "a.csv").write_text('sseqid,Feature,Description,Type\nx1,"AmpR, short",one,CDS\n')
    (tmp_path / "b.csv").write_text("sseqid,Feature,Description\ny1,&alpha;GFP,&lt;b&gt; &#233;\n")
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("z1,kinase,some text\nz2,other,\n")
    a = files.read_feature_metadata(spark, str(tmp_path / "a.csv"), "first")
    b = files.read_feature_metadata(spark, str(tmp_path / "b.csv"), "second", kind="CDS", unescape=True)
    c = files.read_feature_metadata(spark, str(tmp_path / "c.csv.gz"), "third", header=False, kind="CDS")
    got = sorted(map(tuple, a.unionByName(b).unionByName(c).collect()))
    assert got == [("x1", "AmpR, short", "one", "CDS", "first"), ("y1", "αGFP", "<b> é", "CDS", "second"), ("z1", "kinase", "some text", "CDS", "third"), ("z2", "other", None, "CDS", "third")]


def test_token_lists_tables_and_registries(spark, tmp_path):
    import json

    from strandline.sources import files

    df = spark.createDataFrame([("<B>", 2, 5), ("<A>", 1, 9), ("<B>", 3, 5), ("<B>", 4, 1)], "token string, sseqid long, length int")
    files.write_token_list(df, str(tmp_path / "tokens"), table="token_list_test")
    assert [r["token"] for r in files.read_token_list(spark, str(tmp_path / "tokens")).collect()] == ["<A>", "<B>"]
    assert spark.table("token_list_test").count() == 2
    files.write_table(df.select("sseqid"), "token_list_test")
    assert spark.table("token_list_test").columns == ["sseqid"]
    spark.sql("drop table token_list_test")
    files.write_registry(df, str(tmp_path / "json"), str(tmp_path / "flat"))
    nested = {x["token"]: x["sequences"] for x in (json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect())}
    assert [s["sseqid"] for s in nested["<B>"]] == [2, 3, 4] and spark.read.parquet(str(tmp_path / "flat")).count() == 4
    files.write_lookups(df, str(tmp_path / "look"))
    longest = {x["token"]: x["variants"]["sseqid"] for x in (json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "look/longest")).collect())}
    assert longest == {"<A>": 1, "<B>": 2} and spark.read.text(str(tmp_path / "look/full")).count() == 2


def test_cached_result_is_made_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandline.sources import files

    made = []

    def make(df):
        made.append(1)
        return df.select("prompt", F.length("prompt").alias("n"))

    a = spark.createDataFrame([("x",), ("yy",), (None,)], "prompt string")
    for df in (a, a.orderBy(F.desc("prompt")), a.repartition(3)):
        assert files.cached_result(df, str(tmp_path), {"k": 1}, make).count() == 3
    assert len(made) == 1
    files.cached_result(a, str(tmp_path), {"k": 2}, make)
    files.cached_result(a.limit(2), str(tmp_path), {"k": 1}, make)
    assert len(made) == 3


def test_report(spark, tmp_path):
    from strandline.sources import files

    rows = [("m1", "p1", "AMR", 2, 2), ("m1", "p1", "ORI", 2, 1), ("m1", "p2", "AMR", 1, 1), ("m2", "p1", "AMR", 4, 0)]
    df = spark.createDataFrame(rows, "model string, prompt string, category string, requested int, found int")
    summary, category = files.report_tables(df)
    assert {tuple(r) for r in summary.collect()} == {("m1", 2, (0.75 + 1) / 2, 4 / 5, 1), ("m2", 1, 0.0, 0.0, 0)}
    assert ("m1", "TOTAL", 5, 4) in {tuple(r) for r in category.collect()} and category.count() == 5
    files.write_report(df, str(tmp_path / "r"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "r")).collect())
    assert "| m1 | 2 | 0.8750 | 0.8000 | 1 |" in text and "## Probes" not in text


def test_report_sections_in_order(spark, tmp_path):
    from strandline.sources import files

    rows = [("m2", "p|q", "AMR", 2, 1), ("m1", "b", "ORI", 1, 1), ("m1", "a", "AMR", 3, 0), ("m1", "a", "ORI", 1, 1)]
    probes = spark.createDataFrame([("m1", "<T_2>", True), ("m1", "<T_1>", False)], "model string, token string, hit boolean")
    files.write_report(spark.createDataFrame(rows, "model string, prompt string, category string, requested int, found int").repartition(3), str(tmp_path / "r"), probes)
    lines = [x.rstrip("\n") for f in sorted((tmp_path / "r").glob("part-*")) for x in open(f)]
    assert [x for x in lines if x.startswith("## ")] == ["## Models", "## Categories", "## Prompts", "## Probes"]
    at = lines.index("## Prompts")
    assert lines[at + 2 : at + 7] == ["| model | prompt | requested | found | share |", "|-|-|-|-|-|", "| m1 | a | 4 | 1 | 0.2500 |", "| m1 | b | 1 | 1 | 1.0000 |", "| m2 | p\\|q | 2 | 1 | 0.5000 |"]
    assert lines[-3:-1] == ["| m1 | <T_1> | false |", "| m1 | <T_2> | true |"]


def test_prompt_filter_and_display(spark):
    from strandline.sources import files

    df = spark.createDataFrame([(1, ["x"]), (2, []), (3, None)], "id int, reward_motifs array<string>")
    assert [r["id"] for r in df.where(files.has_hard_tokens(df)).collect()] == [1]
    assert df.drop("reward_motifs").where(files.has_hard_tokens(df.drop("reward_motifs"))).count() == 3
    flagged = spark.createDataFrame([(1, True), (2, None)], "id int, has_hard_tokens boolean")
    assert flagged.where(files.has_hard_tokens(flagged)).count() == 1
    assert files.display_columns(df, "none", "reward_motifs", "id").columns == ["reward_motifs", "id"]


def test_merge_table(spark):
    """Partitions are replaced one by one, schemas grow, and a write that fails leaves what was there."""
    from strandline.sources import files

    spark.sql("DROP TABLE IF EXISTS merged_test")
    first = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, v string, day string")
    try:
        files.merge_table(first, "merged_test", ["day"])
        files.merge_table(spark.createDataFrame([("x", 5, 9.5)], "day string, id int, `new one` double"), "merged_test", ["day"])
        rows = lambda: {tuple(r) for r in spark.table("merged_test").select("id", "v", "new one", "day").collect()}
        want = {(5, None, 9.5, "x"), (2, "b", None, "y")}
        assert rows() == want
        with pytest.raises(ValueError, match="id: other types"):
            files.merge_table(spark.createDataFrame([("1", "x")], "id string, day string"), "merged_test", ["day"])
        broken = spark.range(4).select(F.col("id").cast("int"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("z").alias("v"), F.lit("y").alias("day"))
        with pytest.raises(Exception, match="lost"):
            files.merge_table(broken.repartition(4), "merged_test", ["day"])
        assert rows() == want and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
        files.merge_table(spark.createDataFrame([(7, "c", "z")], "id int, v string, day string"), "merged_test", ["day"])
        assert rows() == want | {(7, "c", None, "z")}
    finally:
        spark.sql("DROP TABLE IF EXISTS merged_test")


def test_good_annotations_and_sample_columns(spark):
    from strandline.sources import files

    df = spark.createDataFrame([(1, 96.0, False), (2, 94.0, None), (3, None, None), (4, 99.0, True)], "plasmid_id int, percmatch double, fragment boolean")
    ids = lambda d: [r["plasmid_id"] for r in files.good_annotations(d).orderBy("plasmid_id").collect()]
    assert (ids(df), ids(df.drop("fragment")), ids(df.drop("percmatch")), ids(df.select("plasmid_id"))) == ([1, 3], [1, 3, 4], [1, 2, 3], [1, 2, 3, 4])
    assert files.sample_column(df) == "plasmid_id" and files.sample_column(df.withColumn("qseqid", F.lit(1))) == "qseqid"
    with pytest.raises(ValueError, match="sample_id"):
        files.sample_column(df.select("percmatch"))
