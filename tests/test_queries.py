import os

import duckdb
import pytest

import __spark_entry__
from strandline.plans.catalogue import ORACLE_SQL, QUERIES

SAMPLE = ["join_training_pairs", "join_hard_assignment", "filter_threshold_grid", "bucket_rollup_numeric", "json_species_tokens", "interval_nms_global", "window_ema_baseline", "split_train_val", "seq_translate_six", "score_composite"]
SAMPLE += ["agg_prompt_summary", "agg_confusion_counts", "agg_describe", "agg_separation_checks", "agg_router_layers", "router_load_balance", "loss_masked", "loss_dpo_reference", "agg_step_metrics", "window_ema_advantage", "batch_cycle", "score_demo"]
SAMPLE += ["token_ids", "detokenize_text", "tokens_validated", "map_feature_patterns", "map_feature_dictionary", "interval_adjacency_affinity", "score_structural_pairs", "cigar_metrics", "seq_negatives", "prompt_negatives", "seq_kmer_containment", "agg_separation_auroc", "agg_registry_rollup"]

SAMPLE += ["agg_label_accuracy", "interval_nms_token", "filter_annotation_qc_eval", "filter_length_and_tokens", "join_subject_tokens", "agg_advantages", "tokenize_characters", "seq_n_replace"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, tiny, name):
    con = duckdb.connect()
    for f in os.listdir(tiny):
        con.sql(f"create view {f[:-8]} as select * from '{tiny}/{f}'")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    df = QUERIES[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr(r) for r in cur.fetchall())
    got = sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    assert len(got) == len(want)
    assert [x.replace("'", "") for x in got] == [x.replace("'", "") for x in want]


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "prompt" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_stream(spark, tmp_path):
    from strandline.streaming.annotations import clean_annotations

    schema = "plasmid_id long, sseqid long, pident double, percmatch double, fragment boolean, ts timestamp"
    spark.sql("select 1L plasmid_id, 2L sseqid, 99d pident, 90d percmatch, false fragment, timestamp'2024-01-01' ts union all select 1L, 2L, 99d, 95d, false, timestamp'2024-01-01' union all select 1L, 2L, 50d, 90d, false, timestamp'2024-01-01'").write.parquet(str(tmp_path / "in"))
    registry = spark.createDataFrame([(2, "<ORI_X>")], "sseqid long, token string")
    out = clean_annotations(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), registry)
    q = out.writeStream.format("memory").queryName("clean").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from clean").count() == 1


def test_token_counts_stream(spark, tmp_path):
    from strandline.streaming.annotations import token_counts

    spark.sql("select '<A>' token, timestamp'2024-01-01 00:01:00' ts union all select '<A>', timestamp'2024-01-01 00:04:00' union all select '<B>', timestamp'2024-01-01 00:06:00' union all select '<A>', timestamp'2024-01-01 01:00:00'").write.parquet(str(tmp_path / "in"))
    out = token_counts(spark.readStream.schema("token string, ts timestamp").parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("counted").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["token"], r["n"]) for r in spark.sql("select * from counted").collect()) == [("<A>", 1), ("<A>", 2), ("<B>", 1)]


def test_planted_constructs_are_found(spark, tiny):
    """Motifs in other codons are found by their proteins, and parts of motifs are repaired."""
    hits = QUERIES["search_translated_constructs"](spark, tiny).collect()
    assert hits and all(r["coverage"] >= 30 and r["pct_id"] >= 60 for r in hits)
    assert sum(r["plasmid_id"] % 2 and r["coverage"] == 100 for r in hits) > 10  # even ids hold seven tenths of a motif
    assert QUERIES["align_repair_constructs"](spark, tiny).where("n_repairs > 0").count() > 50


def test_sketched_percentiles(spark, tiny):
    import numpy as np

    rows = spark.read.parquet(f"{tiny}/events.parquet").select("event_type", "value").collect()
    for r in QUERIES["agg_profile_sketch"](spark, tiny).collect():
        values = np.array(sorted(x["value"] for x in rows if x["event_type"] == r["event_type"]))
        assert r["n"] == len(values)
        for q, v in [(0.5, r["median"]), *zip((0.25, 0.75, 0.9, 0.95, 0.99), r["percentiles"], strict=True)]:
            assert abs(np.searchsorted(values, v) / len(values) - q) <= 0.02
