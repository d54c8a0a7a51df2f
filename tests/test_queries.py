"""Every query of the engine against DuckDB on the smallest tables, and the plans that matter."""

import duckdb
import pytest

from siltlog import functions as fn
from siltlog import operators as ops
from siltlog import queries as Q
from siltlog.schema import Bound

DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "events", "conversations", "documents", "pages"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = Q.QUERIES[name](spark, DIR).toPandas(), duck.execute(Q.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(repr, df[cols].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_crc_is_that_of_key_and_value(spark):
    from zlib import crc32

    got = Q.wal_crc(spark, DIR).join(Q.event_log(spark, DIR), "seq").collect()
    assert all(r["crc"] == crc32((r["key"] + (r["value"] if r["op"] == "P" else "")).encode()) for r in got)


def test_a_key_range_reaches_the_scan(spark):
    df = spark.read.parquet(f"{DIR}/customer.parquet").selectExpr("cast(c_name as string) AS key", "c_custkey AS seq", "'P' AS op", "c_mktsegment AS value")
    plan = ops.scan(df, Bound.at("a"), Bound.past("b"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_name,a)" in plan and "LessThan(c_name,b)" in plan
    assert "value" not in ops.keys(Q.event_log(spark, DIR))._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_expressions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"ok"), "abc", "abd", 258), (bytearray(b"\xff"), "", "x", 1)], "b binary, x string, y string, n long")
    got = df.select(fn.display(F.col("b")).alias("d"), fn.common_prefix(F.col("x"), F.col("y")).alias("p"), fn.message_key(F.lit("c"), F.col("n")).alias("k")).collect()
    assert [(r["d"], r["p"], bytes(r["k"])) for r in got] == [("ok", 2, b"m_c" + (258).to_bytes(8, "big")), ("FF", 0, b"m_c" + (1).to_bytes(8, "big"))]
    assert fn.readable(2048) == "2048(2.000KB)" and fn.readable(5) == "5(5.000B)"


def test_history_of_a_key_that_holds_most_rows(spark):
    rows = [("hot", i) for i in range(0, 3000, 2)] + [(f"k{i % 40:02d}", i) for i in range(1, 1000, 2)] + [("a", 5000), ("z", 5001)]
    log = spark.createDataFrame([(k, i, "P", str(i)) for k, i in rows], "key string, seq long, op string, value string")
    got = {(r["key"], r["seq"]): r["version"] for r in ops.history(log.repartition(5)).collect()}
    by = {}
    for k, i in sorted(rows, key=lambda r: -r[1]):
        by.setdefault(k, []).append(i)
    assert got == {(k, i): n for k, all_of in by.items() for n, i in enumerate(all_of, 1)}
    assert ops.history(log.limit(0)).collect() == []


def test_overlapping_pairs_by_brute_force(spark):
    from random import Random

    rng = Random(7)
    spans = [tuple(sorted((rng.randrange(300), rng.randrange(300)))) for _ in range(60)] + [(0, 299), (5, 5), (5, 5), (299, 299), (400, 401), (402, 402)]
    meta = spark.createDataFrame([(i, f"{a:03d}", f"{b:03d}") for i, (a, b) in enumerate(spans)], "run long, first_key string, last_key string")
    got = sorted(map(tuple, ops.overlapping_pairs(meta).collect()))
    assert got == [(i, j) for i in range(len(spans)) for j in range(i + 1, len(spans)) if spans[i][0] <= spans[j][1] and spans[j][0] <= spans[i][1]]
    plan = ops.overlapping_pairs(meta)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert ops.overlapping_pairs(meta.limit(0)).collect() == []
