"""Fleet roll-ups, audits and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.functions.metrics import ratio
from cachelens.plans import views as V
from cachelens.plans.book import Book

Q = Book()

STATS = ("capacity_bytes", "used_bytes", "hits_total", "misses_total", "evictions_total", "objects")
_SUMS = ", ".join(f"coalesce(sum({c}) FILTER (has_stats), 0)::BIGINT AS {c}" for c in STATS)


def _sums() -> list:
    return [F.coalesce(F.sum(F.when(F.col("has_stats"), F.col(c))), F.lit(0)).cast("long").alias(c) for c in STATS]


@Q.add("e1_fleet_rollup", f"SELECT grp, count(*) AS nodes, count_if(NOT has_stats) AS missing, {_SUMS}, count(DISTINCT ver) AS versions FROM members GROUP BY grp", "members")
def fleet_rollup(spark: SparkSession, d: str) -> DataFrame:
    return V.members(spark, d).groupBy("grp").agg(F.count("*").alias("nodes"), F.count_if(~F.col("has_stats")).alias("missing"), *_sums(), F.countDistinct("ver").alias("versions"))


@Q.add("e2_groups", "SELECT DISTINCT grp FROM members", "members")
def groups(spark: SparkSession, d: str) -> DataFrame:
    return V.members(spark, d).select("grp").distinct()


@Q.add("e3_stats_totals", f"""SELECT grp, id, {_SUMS}, round(CASE WHEN coalesce(sum(capacity_bytes) FILTER (has_stats), 0) = 0 THEN 0 ELSE 100.0 * sum(used_bytes) FILTER (has_stats) / sum(capacity_bytes) FILTER (has_stats) END, 6)::DOUBLE AS util,
  round(CASE WHEN coalesce(sum(hits_total + misses_total) FILTER (has_stats), 0) = 0 THEN 0 ELSE 100.0 * sum(hits_total) FILTER (has_stats) / sum(hits_total + misses_total) FILTER (has_stats) END, 6)::DOUBLE AS hit FROM members GROUP BY ROLLUP (grp, id)""", "members")
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per node, per group and over all; nodes without stats add nothing."""
    g = V.members(spark, d).rollup("grp", "id").agg(*_sums())
    return g.withColumn("util", F.round(100.0 * ratio(F.col("used_bytes"), F.col("capacity_bytes")), 6)).withColumn("hit", F.round(100.0 * ratio(F.col("hits_total"), F.col("hits_total") + F.col("misses_total")), 6))


@Q.add("e4_deep_stats", "SELECT m.id, r.node IS NOT NULL AS reachable, coalesce(r.beats, 0) AS beats, CASE WHEN r.node IS NULL THEN 0 ELSE m.used_bytes END AS used FROM members m LEFT JOIN (SELECT 'n' || node AS node, count(*) AS beats FROM beats GROUP BY node) r ON m.id = r.node", "members", "beats")
def deep_stats(spark: SparkSession, d: str) -> DataFrame:
    seen = V.beats(spark, d).groupBy(F.concat(F.lit("n"), "node").alias("id")).agg(F.count("*").alias("beats"))
    j = V.members(spark, d).join(seen, "id", "left")
    there = F.col("beats").isNotNull()
    return j.select("id", there.alias("reachable"), F.coalesce("beats", F.lit(0)).alias("beats"), F.when(there, F.col("used_bytes")).otherwise(0).alias("used"))


@Q.add("e17_class_stats", "SELECT cls, count(*) AS resident, sum(value_len)::BIGINT AS useful, (count(*) * cls)::BIGINT AS allocated, round(1 - sum(value_len) / (count(*) * cls), 6) AS fragmentation FROM (SELECT value_len, 1024 * pow(2, ceil(log2(greatest(value_len, 1) / 1024)))::BIGINT AS c0, greatest(1024 * pow(2, ceil(log2(greatest(value_len, 1) / 1024))), 1024)::BIGINT AS cls FROM objects) GROUP BY cls", "objects")
def class_stats(spark: SparkSession, d: str) -> DataFrame:
    """Objects by slot class (powers of two from 1 KiB) and their fragmentation."""
    size = F.greatest(F.col("value_len"), F.lit(1)) / 1024
    cls = F.greatest(F.lit(1024) * F.pow(F.lit(2.0), F.ceil(F.log2(size))), F.lit(1024)).cast("long")
    g = V.objects(spark, d).groupBy(cls.alias("cls")).agg(F.count("*").alias("resident"), F.sum("value_len").alias("useful"))
    allocated = F.col("resident") * F.col("cls")
    return g.select("cls", "resident", "useful", allocated.alias("allocated"), F.round(1 - F.col("useful") / allocated, 6).alias("fragmentation"))


@Q.add("g1_sorted_members", "SELECT grp, string_agg(id, ',' ORDER BY id) AS ids FROM members GROUP BY grp", "members")
def sorted_members(spark: SparkSession, d: str) -> DataFrame:
    return V.members(spark, d).groupBy("grp").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"))


@Q.add("g3_victims", "SELECT grp, arg_min(id, (used_bytes, hits_total, -objects, num)) AS coldest, arg_min(id, (hits_total, -num)) AS youngest, arg_min(id, (hits_total, -num, used_bytes)) AS young_first, arg_min(id, (hits_total, used_bytes, -num)) AS useful_first FROM members GROUP BY grp", "members")
def victims(spark: SparkSession, d: str) -> DataFrame:
    """Least by tuple, with the three tie orders: used first and full last, youngest before used, used before youngest."""
    return V.members(spark, d).groupBy("grp").agg(F.min_by("id", F.struct("used_bytes", "hits_total", -F.col("objects"), "num")).alias("coldest"), F.min_by("id", F.struct("hits_total", -F.col("num"))).alias("youngest"), F.min_by("id", F.struct("hits_total", -F.col("num"), "used_bytes")).alias("young_first"), F.min_by("id", F.struct("hits_total", "used_bytes", -F.col("num"))).alias("useful_first"))


_TWO = "(SELECT grp, id, ver FROM members WHERE num % 5 <> 0) a FULL JOIN (SELECT grp, id, CASE WHEN num % 9 = 0 THEN 'v9' ELSE ver END AS ver FROM members WHERE num % 7 <> 0) b ON a.grp = b.grp AND a.id = b.id"


def _views(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    m = V.members(spark, d)
    a = m.where("num % 5 <> 0").select("grp", "id", F.col("ver").alias("a_ver"), F.lit(1).alias("a"))
    b = m.where("num % 7 <> 0").select("grp", "id", F.when(F.col("num") % 9 == 0, "v9").otherwise(F.col("ver")).alias("b_ver"), F.lit(1).alias("b"))
    return a, b


@Q.add("d7_view_audit", f"SELECT coalesce(a.grp, b.grp) AS grp, coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_view' WHEN a.id IS NULL THEN 'only_registry' ELSE 'differs' END AS issue FROM {_TWO} WHERE a.id IS NULL OR b.id IS NULL OR a.ver <> b.ver", "members")
def view_audit(spark: SparkSession, d: str) -> DataFrame:
    """Served view against registrations: what is only in one, what differs."""
    a, b = _views(spark, d)
    issue = F.when(F.col("b").isNull(), "only_view").when(F.col("a").isNull(), "only_registry").when(~F.col("a_ver").eqNullSafe(F.col("b_ver")), "differs")
    return a.join(b, ["grp", "id"], "full_outer").select("grp", "id", issue.alias("issue")).where("issue is not null")


@Q.add("e21_issue_counts", f"SELECT s.severity, count(x.issue) AS n FROM (SELECT unnest(['critical', 'warning']) AS severity) s LEFT JOIN (SELECT CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'critical' ELSE 'warning' END AS severity, 1 AS issue FROM {_TWO} WHERE a.id IS NULL OR b.id IS NULL OR a.ver <> b.ver) x ON s.severity = x.severity GROUP BY s.severity", "members")
def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Both severities are always there."""
    both = spark.createDataFrame([("critical",), ("warning",)], "severity string")
    found = view_audit(spark, d).select(F.when(F.col("issue") == "differs", "warning").otherwise("critical").alias("severity")).groupBy("severity").agg(F.count("*").alias("n"))
    return both.join(found, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@Q.add("d12_member_delta", f"SELECT coalesce(a.grp, b.grp) AS grp, count_if(a.id IS NULL) AS added, count_if(b.id IS NULL) AS removed, count_if(a.id IS NOT NULL AND b.id IS NOT NULL) AS kept FROM {_TWO} GROUP BY 1", "members")
def member_delta(spark: SparkSession, d: str) -> DataFrame:
    a, b = _views(spark, d)
    j = a.join(b, ["grp", "id"], "full_outer")
    return j.groupBy("grp").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"))


@Q.add("h1_view_difference", "SELECT id FROM members WHERE num % 5 <> 0 EXCEPT SELECT id FROM members WHERE num % 7 <> 0", "members")
def view_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = _views(spark, d)
    return a.select("id").subtract(b.select("id"))


@Q.add("h3_required_forbidden", "SELECT grp, count_if(ver = 'v1') > 0 AND count_if(ver = 'v2') > 0 AS has_required, count_if(ver = 'v3') = 0 AS no_forbidden FROM members GROUP BY grp", "members")
def required_forbidden(spark: SparkSession, d: str) -> DataFrame:
    g = V.members(spark, d).groupBy("grp").agg(F.collect_set("ver").alias("vers"))
    return g.select("grp", (F.size(F.array_except(F.array(F.lit("v1"), F.lit("v2")), "vers")) == 0).alias("has_required"), (~F.arrays_overlap("vers", F.array(F.lit("v3")))).alias("no_forbidden"))


@Q.add("d13_client_continuity", "SELECT DISTINCT peer, object_key FROM ops WHERE ts < TIMESTAMP '2024-01-08' AND (peer, object_key) NOT IN (SELECT (peer, object_key) FROM ops WHERE ts >= TIMESTAMP '2024-01-22' AND status = 'ok')", "ops")
def client_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Clients (an object's user on a peer) of the first week that had no success in the last days."""
    o = V.ops(spark, d)
    late = o.where("ts >= timestamp '2024-01-22' and status = 'ok'").select("peer", "object_key")
    return o.where("ts < timestamp '2024-01-08'").select("peer", "object_key").distinct().join(late, ["peer", "object_key"], "left_anti")
