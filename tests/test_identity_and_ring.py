"""Golden vectors of identities, and properties of the ring."""

import bisect
import hashlib

import pytest
from pyspark.sql import functions as F

from cachelens.functions import identity as I
from cachelens.operators import ring as R

# Fixed value: a serialised namespace.
NAMESPACE = "44464b564e5300020a00000074656e616e742f617c62030000006d0078060000007265763a343203000e0000006d616d62612e74656d706f72616c0400000062663136887766554433221140000000070000000a00000016000000080000000300000002000000ffffffff0400000001000000"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_block_key(spark):
    r = one(spark, I.block_digest(F.lit("test/model"), F.lit("glm-5.2/page_777_k")), I.tenant_hash(F.lit("test/model")), I.tenant_hash(F.lit("tenant-a")), I.tenant_hash(F.lit("tenant-b")))
    assert tuple(r) == ("1dabbca41aba2b02a865be51fa395d70", "fa1cde78082f951e", "6164af84acbc9ade", "27a61068bf52563b")


def test_framing_keeps_parts_apart(spark):
    r = one(spark, I.block_digest(F.lit("a"), F.lit("bc")), I.block_digest(F.lit("ab"), F.lit("c")))
    assert r[0] != r[1]


def test_namespace_bytes(spark):
    n = I.namespace_bytes(F.lit("tenant/a|b"), F.unhex(F.lit("6d0078")), F.lit("rev:42"), F.lit(3), F.lit("mamba.temporal"), F.lit("bf16"), F.lit("1122334455667788"), F.lit(64), F.lit(7), F.lit(10), F.lit(22), (F.lit(8), F.lit(3)), (F.lit(2), F.lit(-1)), (F.lit(4), F.lit(1)))
    assert one(spark, F.lower(F.hex(n)))[0] == NAMESPACE


def test_block_ids(spark):
    good = "11223344556677880123456789abcdeffedcba9876543210"
    r = one(spark, I.block_path(F.lit(good)), I.valid_block_id(F.lit(good)), I.valid_block_id(F.lit(good.upper())), I.valid_block_id(F.lit(good + "0")))
    assert tuple(r) == (f"blocks/11/1122/{good}", True, False, False)


def ring(spark, weights):
    return R.ring_points(spark.createDataFrame([(n, w, i) for i, (n, w) in enumerate(weights)], "node string, weight int, nth int"))


def test_ring_matches_direct_computation(spark):
    weights = [("a", 1), ("b", 2), ("c", 1)]
    points = {}
    for n, w in weights:
        for k in range(40 * w):
            d = hashlib.md5(f"{n}-{k}".encode()).digest()
            points |= {int.from_bytes(d[4 * i : 4 * i + 4], "little"): n for i in range(4)}
    assert {r["point"]: r["node"] for r in ring(spark, weights).collect()} == points
    keys = spark.range(20000).select(F.concat(F.lit("key_"), "id").alias("key"))
    got = {r["node"]: r["count"] for r in R.route(keys, F.col("key"), R.ring_intervals(ring(spark, weights))).groupBy("node").count().collect()}
    assert got == {"a": 5090, "b": 9934, "c": 4976}


def test_ring_edges(spark):
    assert ring(spark, [("a", 0)]).count() == 160
    empty = spark.createDataFrame([], "node string, point long")
    keys = spark.createDataFrame([("k",)], "key string")
    assert R.route(keys, F.col("key"), R.ring_intervals(empty)).first()["node"] is None


@pytest.mark.parametrize("broadcast", [100, 500_000])
def test_large_ring(spark, monkeypatch, broadcast):
    """A ring is made and ranked in tasks of bounded size, though its nodes come in one; routes equal a direct search."""
    monkeypatch.setattr(R, "TASK_POINTS", 2000, raising=False)
    monkeypatch.setattr(R, "BROADCAST_POINTS", broadcast)
    nodes = spark.createDataFrame([(f"n{i}", 1 + i % 4, i) for i in range(100)], "node string, weight int, nth int").coalesce(1)
    points = R.ring_points(nodes)
    assert points.rdd.getNumPartitions() > 15
    assert "RoundRobinPartitioning" in points._jdf.queryExecution().executedPlan().toString()
    ring = sorted((r["point"], r["node"]) for r in points.collect())
    keys = [f"key_{i}" for i in range(3000)]
    got = R.route(spark.createDataFrame([(k,) for k in keys], "key string"), F.col("key"), R.ring_intervals(points)).collect()
    at = {k: bisect.bisect_left(ring, (int.from_bytes(hashlib.md5(k.encode()).digest()[:4], "little"), "")) % len(ring) for k in keys}
    assert sorted((r["key"], r["node"]) for r in got) == sorted((k, ring[i][1]) for k, i in at.items())


def test_buckets_hold_few_points():
    assert all(n >> (32 - R.bucket_bits(n)) < 8 for n in (0, 1, 160, 40_000, 500_000, 24_000_000, 144_000_000, 1 << 31))


def test_plan_has_no_nested_loop(spark, sf_dir):
    from cachelens.plans.registry import QUERIES

    plan = QUERIES["d4_ring_route_share"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
