"""Dashboard panels: gauges of nodes and rates a second over windows of an hour or a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.functions import metrics as M
from cachelens.plans import views as V
from cachelens.plans.book import Book
from cachelens.plans.metric_queries import hist, wide

Q = Book()
HOUR, DAY = 3600.0, 86400.0


def _of(unit: str) -> Column:
    return F.date_trunc(unit, "ts").cast("timestamp_ntz").alias(unit)


def _rate(amount: Column, seconds: float) -> Column:
    return F.round(F.coalesce(amount, F.lit(0)) / seconds, 9)


@Q.add("m3_node_gauges", "SELECT m.grp, m.id, m.objects, m.used_bytes, coalesce(c.n, 0) AS connections FROM members m LEFT JOIN (SELECT peer, count(DISTINCT connector) AS n FROM ops GROUP BY peer) c ON m.id = c.peer WHERE m.has_stats", "members", "ops")
def node_gauges(spark: SparkSession, d: str) -> DataFrame:
    """Objects, bytes in use and connections of each node that reports."""
    c = V.ops(spark, d).groupBy(F.col("peer").alias("id")).agg(F.countDistinct("connector").alias("n"))
    return V.members(spark, d).where("has_stats").join(c, "id", "left").select("grp", "id", "objects", "used_bytes", F.coalesce("n", F.lit(0)).alias("connections"))


@Q.add("m4_rates", """SELECT date_trunc('hour', ts) AS hour, peer, round(coalesce(sum(hits) FILTER (op = 'get'), 0) / 3600.0, 9) AS hits, round(coalesce(sum(keys - hits) FILTER (op = 'get'), 0) / 3600.0, 9) AS misses,
  round(coalesce(sum(keys) FILTER (op = 'put'), 0) / 3600.0, 9) AS puts FROM ops GROUP BY 1, 2""", "ops")
def rates(spark: SparkSession, d: str) -> DataFrame:
    only = lambda op, c: F.sum(F.when(F.col("op") == op, c))
    return V.ops(spark, d).groupBy(_of("hour"), "peer").agg(_rate(only("get", F.col("hits")), HOUR).alias("hits"), _rate(only("get", F.col("keys") - F.col("hits")), HOUR).alias("misses"), _rate(only("put", F.col("keys")), HOUR).alias("puts"))


@Q.add("m9_evictions", "SELECT date_trunc('hour', ts) AS hour, peer, round(sum(keys) / 3600.0, 9) AS evictions, round(sum(bytes) / 3600.0, 6) AS bytes FROM ops WHERE op = 'remove' GROUP BY 1, 2", "ops")
def evictions(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).where("op = 'remove'").groupBy(_of("hour"), "peer").agg(_rate(F.sum("keys"), HOUR).alias("evictions"), F.round(F.sum("bytes") / HOUR, 6).alias("bytes"))


@Q.add("m12_connections", "SELECT date_trunc('day', ts) AS day, peer, count(DISTINCT connector) AS connections, round(count(DISTINCT (connector, date_trunc('hour', ts))) / 86400.0, 9) AS accepts, count_if(status = 'error') AS failed FROM ops GROUP BY 1, 2", "ops")
def connections(spark: SparkSession, d: str) -> DataFrame:
    """Connections of a day, and how often one was accepted (it is kept for the hour in which it is used)."""
    return V.ops(spark, d).groupBy(_of("day"), "peer").agg(F.countDistinct("connector").alias("connections"), _rate(F.countDistinct("connector", F.date_trunc("hour", "ts")), DAY).alias("accepts"), F.count_if(F.col("status") == "error").alias("failed"))


@Q.add("m14_transport", """SELECT date_trunc('hour', ts) AS hour, CASE WHEN bytes >= 16384 THEN 'rdma' ELSE 'tcp' END AS transport, round(count(*) / 3600.0, 9) AS ops, round(sum(bytes) / 3600.0, 6) AS bytes, count_if(status = 'error') AS errors, round(1.0 * sum(bytes) / count(*), 6) AS mean_bytes FROM ops GROUP BY 1, 2""", "ops")
def transport(spark: SparkSession, d: str) -> DataFrame:
    """Requests, bytes, errors and mean size by transport; large payloads go by remote memory access."""
    kind = F.when(F.col("bytes") >= 16384, "rdma").otherwise("tcp").alias("transport")
    return V.ops(spark, d).groupBy(_of("hour"), kind).agg(_rate(F.count("*"), HOUR).alias("ops"), F.round(F.sum("bytes") / HOUR, 6).alias("bytes"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.sum("bytes") / F.count("*"), 6).alias("mean_bytes"))


@Q.add("m15_directory", "SELECT date_trunc('day', ts) AS day, count(DISTINCT node) AS members, round(count(*) / 86400.0, 9) AS requests FROM beats GROUP BY 1", "beats")
def directory(spark: SparkSession, d: str) -> DataFrame:
    """Members that the directory service heard of on a day, and its requests a second."""
    return V.beats(spark, d).groupBy(_of("day")).agg(F.countDistinct("node").alias("members"), _rate(F.count("*"), DAY).alias("requests"))


@Q.add("m16_directory_ops", "SELECT b.day, b.ver AS op, round(count(*) / 86400.0, 9) AS ops, count(DISTINCT b.node) AS replicas, count_if(b.day = f.first) AS grants FROM (SELECT date_trunc('day', ts) AS day, ver, node FROM beats) b JOIN (SELECT node, min(date_trunc('day', ts)) AS first FROM beats GROUP BY node) f ON b.node = f.node GROUP BY 1, 2", "beats")
def directory_ops(spark: SparkSession, d: str) -> DataFrame:
    """The directory's requests by kind, the replicas that asked, and leases granted to newcomers."""
    b = V.beats(spark, d).select(_of("day"), F.col("ver").alias("op"), "node")
    first = b.groupBy("node").agg(F.min("day").alias("first"))
    return b.join(first, "node").groupBy("day", "op").agg(_rate(F.count("*"), DAY).alias("ops"), F.countDistinct("node").alias("replicas"), F.count_if(F.col("day") == F.col("first")).alias("grants"))


@Q.add("e19_phase_report", """SELECT op, count(*) AS n, round(sum(bytes) / 1e9 / s, 9) AS gbps, round(count(*) / s, 6) AS ops, round(list_sort(list(seconds))[floor(0.5 * (count(*) - 1))::INT + 1], 6) AS p50, round(list_sort(list(seconds))[floor(0.99 * (count(*) - 1))::INT + 1], 6) AS p99, round(max(seconds), 6) AS slowest, count_if(status = 'error') AS fails
  FROM ops, (SELECT epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6 AS s FROM ops) GROUP BY op, s""", "ops")
def phase_report(spark: SparkSession, d: str) -> DataFrame:
    """Throughput and latency of each phase over the run's time."""
    o = V.ops(spark, d)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    s = o.agg(((F.max(micros) - F.min(micros)) / 1e6).alias("s")).scalar()
    sums = o.groupBy("op").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"), F.round(F.max("seconds"), 6).alias("slowest"), F.count_if(F.col("status") == "error").alias("fails"))
    p = M.exact_ranks(o, ["op"], "seconds", {"p50": M.floor_rank(0.5), "p99": M.floor_rank(0.99)})
    return sums.join(p, "op").select("op", "n", F.round(F.col("b") / 1e9 / s, 9).alias("gbps"), F.round(F.col("n") / s, 6).alias("ops"), F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"), "slowest", "fails")


@Q.add("h5_union_of_series", "SELECT op, le, sum(cum)::BIGINT AS cum FROM (SELECT op, round(least(le, 1e9), 6) AS le, cum FROM hist UNION ALL SELECT op, round(least(le, 1e9), 6) AS le, cum FROM wide) GROUP BY op, le", "ops", "hist", "wide")
def union_of_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of nodes and connectors put together and summed by bound."""
    both = hist(spark, d).unionByName(wide(spark, d))
    return both.groupBy("op", F.round(F.least("le", F.lit(1e9)), 6).alias("le")).agg(F.sum("cum").alias("cum"))


@Q.add("c12_regression_gate", """SELECT op AS phase, metric, round(b, 8) AS baseline, round(c, 8) AS candidate, CASE metric WHEN 'ops' THEN b > 0 AND 1 - c / b > 0.05 WHEN 'p95' THEN b > 0 AND c / b - 1 > 0.02 ELSE c > 0.2 END AS regressed FROM (
  SELECT op, unnest(['ops', 'p95', 'error_rate']) AS metric, unnest([n0, p0, e0]) AS b, unnest([n1, p1, e1]) AS c FROM (
    SELECT op, count_if(ts < TIMESTAMP '2024-01-15')::DOUBLE AS n0, count_if(ts >= TIMESTAMP '2024-01-15')::DOUBLE AS n1, quantile_cont(seconds, 0.95) FILTER (ts < TIMESTAMP '2024-01-15') AS p0, quantile_cont(seconds, 0.95) FILTER (ts >= TIMESTAMP '2024-01-15') AS p1,
      count_if(status = 'error' AND ts < TIMESTAMP '2024-01-15') / greatest(count_if(ts < TIMESTAMP '2024-01-15'), 1) AS e0, count_if(status = 'error' AND ts >= TIMESTAMP '2024-01-15') / greatest(count_if(ts >= TIMESTAMP '2024-01-15'), 1) AS e1 FROM ops GROUP BY op))""", "ops")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Throughput, latency and error rate of a candidate against a baseline, each with its threshold."""
    o = V.ops(spark, d).withColumn("late", F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))
    sums = o.groupBy("op", "late").agg(F.count("*").cast("double").alias("ops"), (F.count_if(F.col("status") == "error") / F.count("*")).alias("error_rate"))
    both = sums.join(M.percentiles_linear(o, ["op", "late"], "seconds", {"p95": 0.95}), ["op", "late"])
    rows = both.select("op", "late", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("ops", "p95", "error_rate")))).alias("r"))
    j = rows.groupBy("op", "r.metric").agg(F.max(F.when(~F.col("late"), F.col("r.v"))).alias("b"), F.max(F.when(F.col("late"), F.col("r.v"))).alias("c"))
    none = F.when(F.col("metric") == "p95", F.lit(None)).otherwise(0.0)  # no rows: no latency, and rates of 0
    j = j.withColumn("b", F.coalesce("b", none)).withColumn("c", F.coalesce("c", none))
    regressed = F.when(F.col("metric") == "ops", (F.col("b") > 0) & (1 - F.col("c") / F.col("b") > 0.05)).when(F.col("metric") == "p95", (F.col("b") > 0) & (F.col("c") / F.col("b") - 1 > 0.02)).otherwise(F.col("c") > 0.2)
    return j.select(F.col("op").alias("phase"), "metric", F.round("b", 8).alias("baseline"), F.round("c", 8).alias("candidate"), regressed.alias("regressed"))
