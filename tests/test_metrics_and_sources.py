"""Histogram, quantile, reset and parser rules on small fixtures."""

from pyspark.sql import functions as F

from cachelens.functions import metrics as M
from cachelens.functions.identity import clamp_range
from cachelens.operators import prefix as P
from cachelens.sources import text as T


def test_histogram(spark):
    df = spark.createDataFrame([(x,) for x in (0.00003, 0.00012, 0.003, 0.5)], "s double").withColumn("k", F.lit(1))
    cum = {r["le"]: r["cum"] for r in M.cumulative_histogram(df, ["k"], "s", M.NODE_BOUNDS).collect()}
    assert cum[0.00005] == 1 and cum[float("inf")] == 4


def test_quantiles(spark):
    h = spark.createDataFrame([(1, 0.001, 50), (1, 0.01, 100), (1, float("inf"), 100), (2, 0.001, 0), (2, float("inf"), 5)], "k int, le double, cum long")
    assert {r["k"]: r["quantile"] for r in M.histogram_quantile(h, ["k"], 0.5).collect()} == {1: 0.001, 2: None}
    assert {r["k"]: r["quantile"] for r in M.histogram_quantile(h, ["k"], 0.5, "top").collect()}[2] == 0.001
    xs = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, None), (3, -4.0), (3, 0.0), (3, 0.0)], "k int, x double")
    got = {r["k"]: (r["a"], r["b"]) for r in M.exact_ranks(xs, ["k"], "x", {"a": M.floor_rank(0.95), "b": M.nearest_rank(0.9)}).collect()}
    assert got == {1: (2.0, 3.0), 3: (0.0, 0.0)}
    assert {r["k"]: round(r["p"], 6) for r in M.percentiles_linear(xs, ["k"], "x", {"p": 0.95}).collect()} == {1: 2.9, 3: 0.0}


def test_ranks_of_many_values(spark):
    """Negative, zero, tiny and large values, with ties: every rank equals the sorted list's."""
    xs = sorted([((k * 37) % 101 - 50) * 10.0 ** (k % 5 - 2) for k in range(400)] + [0.0] * 30)
    df = spark.createDataFrame([(1, x) for x in xs], "k int, x double")
    ranks = {f"r{i}": (lambda i: lambda n: F.lit(i))(i) for i in range(0, len(xs), 43)}
    row = M.exact_ranks(df, ["k"], "x", ranks).first()
    assert [row[n] for n in ranks] == [xs[int(n[1:])] for n in ranks]


def test_counter_resets(spark):
    c = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 9, 2, 4, 12])], "k int, t int, v long")
    total = lambda rule: c.withColumn("i", M.increase(None, ["k"], ["t"], "v", rule)).agg(F.sum("i")).first()[0]
    assert total("after") == 4 + 2 + 2 + 8
    assert total("ignore") == 4 + 0 + 0 + 3


def test_ranges(spark):
    rows = spark.createDataFrame([(10, 0, 0), (10, 10, 5), (10, 11, 1), (10, 8, 5), (10, 3, 0)], "s long, o long, l long")
    assert [r[0] for r in rows.select(clamp_range(F.col("s"), F.col("o"), F.col("l"))).collect()] == [10, 0, None, 2, 7]


def test_trailing_policy(spark):
    for present, want in (({2, 3}, 4), ({0, 1}, 2)):
        df = spark.createDataFrame([("r", i, True, i in present) for i in range(4)], "req string, pos long, kv boolean, present boolean")
        assert P.trailing_prefix(df, ["req"], 2).first()["hit"] == want


def test_exposition_round_trip(spark):
    df = spark.createDataFrame([('a"b\\c\nd', 5)], "id string, v long")
    line = T.render_samples(df, F.lit("x_total"), {"id": F.col("id")}, F.col("v"))
    r = T.parse_samples(line.select("line")).first()
    assert (r["name"], r["value"], r["labels"]["id"]) == ("x_total", 5.0, 'a\\"b\\\\c\\nd')
    text = spark.createDataFrame([("# HELP x",), ("x_total 17",), ("x_total_more 3",), ("",), ("x_total nan?",)], "line string")
    assert [(r["name"], r["value"]) for r in T.parse_samples(text).collect()] == [("x_total", 17.0), ("x_total_more", 3.0)]


def test_quota_lines(spark):
    text = spark.createDataFrame([("0000000000001111 10",), ("# c",), ("",), ("xyz 1",), ("0000000000002222 18446744073709551615 # max",), ("0000000000003333 1 2",)], "line string")
    rows = [(r["tenant_hash"], None if r["limit_bytes"] is None else int(r["limit_bytes"]), r["bad"]) for r in T.parse_quotas(text).collect()]
    assert sorted(rows, key=str) == [("0000000000001111", 10, False), ("0000000000002222", 18446744073709551615, False), (None, None, True)]
    twice = spark.createDataFrame([("0000000000001111 10",), ("0000000000001111 20",)], "line string")
    assert [(r["n"], r["bad"]) for r in T.parse_quotas(twice).collect()] == [(2, True)]


def test_tenant_of_canonical_namespaces(spark):
    """The digest of a plain name is known; a canonical namespace gives its tenant's, a spoiled one that of all its bytes."""
    from cachelens.functions import identity as I

    row = spark.range(1).select(I.tenant_hash(F.lit("tenant-a")).alias("plain"), I.canonical_namespace(F.lit("m"), F.lit("raw/v1"), {"heads": F.lit("int:8")}, F.lit("tenant-a")).alias("ns"))
    row = row.select("plain", "ns", F.concat("ns", F.unhex(F.lit("00"))).alias("longer"), F.substring("ns", 1, 60).alias("shorter"))
    got = row.select("plain", I.namespace_tenant_hash(F.col("ns")).alias("of"), *((I.namespace_tenant_hash(F.col(c)) == I.tenant_hash(F.col(c))).alias(c) for c in ("longer", "shorter"))).first()
    assert got["plain"] == got["of"] == "6164af84acbc9ade" and got["longer"] and got["shorter"]


def test_both_outcomes_occur(spark):
    """Queries whose answer is a verdict give both answers at the scale that the oracle is run at."""
    from cachelens.plans.registry import QUERIES

    for name, column in (("d3_backup_gate", "already"), ("d10_all_ranks", "whole"), ("d11_all_groups", "hit"), ("i4_get_exact", "hit"), ("b13_block_path", "valid"), ("a18_quota_file", "bad"), ("c6_canonical", "canonical"), ("c2_host_port", "valid"), ("a12_bench_reports", "complete"), ("c12_regression_gate", "regressed")):
        seen = {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()}
        assert {True, False} <= seen, (name, seen)
    for name in ("i11_remove", "d13_client_continuity", "d8_view_drift", "a11_faults"):
        assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0, name
    assert QUERIES["m_latency_p99"](spark, "/root/testdata/sf0.01").select("p99").distinct().count() > 1
