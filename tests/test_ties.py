"""Rows that tie in the SQL's order: the first row of the file counts, as in SQL."""

import duckdb
import pandas as pd
import pytest

from strandline.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Parts that each meet one order line several times, with other statuses and in falling and rising order of keys."""
    out = tmp_path_factory.mktemp("ties")
    parts = list(range(1, 41))
    part = pd.DataFrame({"p_partkey": parts, "p_name": "x", "p_type": "ECONOMY", "p_brand": "Brand#1", "p_size": [1 + k % 3 for k in parts]})
    rows = [(order, key, line) for order in range(1, 30) for key in (parts if order % 2 else parts[::-1])[order % 7 :: 5] for line in (1, 2)]
    line = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_linenumber"])
    line["l_quantity"], line["l_discount"], line["l_returnflag"] = 30.0, [0.04 + 0.01 * (k % 4) for k in range(len(line))], "N"
    line["l_linestatus"] = [None if k % 11 == 0 else "OFX"[k % 3] for k in range(len(line))]
    again = line.assign(l_linestatus=line["l_linestatus"].map({"O": "F", "F": "X", "X": "O"}))
    odd = again.assign(l_linenumber=12, l_orderkey=again["l_orderkey"] - 1)  # order * 10 + 12 comes after the next order's line 1
    pd.concat([line, again, odd]).astype({"l_linenumber": "int32"}).to_parquet(out / "lineitem.parquet", row_group_size=50)
    part.to_parquet(out / "part.parquet")
    pd.DataFrame({"s_suppkey": [40], "s_name": ["Supplier#000000040"], "s_nationkey": [3]}).to_parquet(out / "supplier.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["agg_token_hits", "join_metadata_tiers"])
def test_first_row_of_ties(spark, tied, name):
    con = duckdb.connect()
    con.sql("set threads = 1")
    for t in ("lineitem", "part", "supplier"):
        con.sql(f"create view {t} as select * from '{tied}/{t}.parquet'")
    con.sql("create table documents (doc_id bigint, text varchar); create table benchmark (item_id bigint, text varchar)")
    con.sql("create table orders (o_orderkey bigint, o_custkey bigint, o_orderpriority varchar); create table customer (c_custkey bigint, c_nationkey int, c_mktsegment varchar)")
    con.sql("create table events (event_id bigint, user_id bigint, event_type varchar, value double, props varchar)")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # several tasks read the file
    try:
        got = sorted(repr(tuple(r[c] for c in names)) for r in QUERIES[name](spark, tied).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(want) > 25 and got == want
