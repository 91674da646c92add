"""Counters, histograms, quantiles and the dashboards' panels over the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.functions import metrics as M
from cachelens.plans import views as V
from cachelens.plans.book import Book

Q = Book()

# Counters: running totals per connector and op; even connectors are reset on 2024-01-15.
V.SQL["counters"] = """SELECT connector, op, event_id, ts, total - CASE WHEN (substr(connector, 2)::INT) % 2 = 0 AND ts >= TIMESTAMP '2024-01-15' THEN base ELSE 0 END AS total FROM (
  SELECT connector, op, event_id, ts, sum(keys) OVER (PARTITION BY connector, op ORDER BY ts, event_id) AS total,
    coalesce(sum(keys) FILTER (ts < TIMESTAMP '2024-01-15') OVER (PARTITION BY connector, op), 0) AS base FROM ops)"""
_BOUNDS = ", ".join(f"{b!r}::DOUBLE" for b in M.NODE_BOUNDS)
V.SQL["hist"] = f"SELECT o.op, o.connector, b.le, count_if(greatest(o.seconds, 0) <= b.le) AS cum FROM ops o, (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]) AS le) b GROUP BY o.op, o.connector, b.le"
_WIDE = ", ".join(f"{b!r}::DOUBLE" for b in M.CONNECTOR_BOUNDS)
V.SQL["wide"] = f"SELECT o.op, o.connector, b.le, count_if(greatest(o.seconds * 2, 0) <= b.le) AS cum FROM ops o, (SELECT unnest([{_WIDE}, 'inf'::DOUBLE]) AS le) b GROUP BY o.op, o.connector, b.le"
KEYS = ["connector", "op"]


def counters(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(*KEYS)
    even = F.substring("connector", 2, 9).cast("int") % 2 == 0
    reset = F.lit("2024-01-15").cast("timestamp")
    o = V.ops(spark, d).withColumn("total", F.sum("keys").over(w.orderBy("ts", "event_id"))).withColumn("base", F.coalesce(F.sum(F.when(F.col("ts") < reset, F.col("keys"))).over(w), F.lit(0)))
    return o.select("connector", "op", "event_id", "ts", (F.col("total") - F.when(even & (F.col("ts") >= reset), F.col("base")).otherwise(0)).alias("total"))


def hist(spark: SparkSession, d: str) -> DataFrame:
    return M.cumulative_histogram(V.ops(spark, d), ["op", "connector"], "seconds", M.NODE_BOUNDS)


def wide(spark: SparkSession, d: str) -> DataFrame:
    both = V.ops(spark, d).withColumn("seconds", F.col("seconds") * 2)
    return M.cumulative_histogram(both, ["op", "connector"], "seconds", M.CONNECTOR_BOUNDS)


@Q.add("e8_connector_histogram", "SELECT op, connector, round(least(le, 1e9), 6) AS le, cum FROM wide", "ops", "wide")
def connector_histogram(spark: SparkSession, d: str) -> DataFrame:
    return wide(spark, d).select("op", "connector", F.round(F.least("le", F.lit(1e9)), 6).alias("le"), "cum")


@Q.add("e6_op_counters", "SELECT op, count(*) AS requests, sum(keys)::BIGINT AS keys, sum(hits)::BIGINT AS hits, sum(bytes)::BIGINT AS bytes, round(max(seconds), 6) AS slowest FROM ops GROUP BY op", "ops")
def op_counters(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).groupBy("op").agg(F.count("*").alias("requests"), F.sum("keys").alias("keys"), F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"), F.round(F.max("seconds"), 6).alias("slowest"))


@Q.add("e7_histogram", "SELECT op, connector, round(least(le, 1e9), 6) AS le, cum FROM hist", "ops", "hist")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return hist(spark, d).select("op", "connector", F.round(F.least("le", F.lit(1e9)), 6).alias("le"), "cum")


@Q.add("e9_op_summary", "SELECT connector, count(*) AS n, round(avg(seconds) * 1000, 3) AS avg_ms, round(list_sort(list(seconds))[ceil(0.9 * count(*))::INT], 6) AS p90, sum(keys)::BIGINT AS keys, count_if(status = 'error') AS errors FROM ops GROUP BY connector", "ops")
def op_summary(spark: SparkSession, d: str) -> DataFrame:
    """Average, nearest-rank 90th percentile and errors of each connector."""
    o = V.ops(spark, d)
    sums = o.groupBy("connector").agg(F.count("*").alias("n"), F.round(F.avg("seconds") * 1000, 3).alias("avg_ms"), F.sum("keys").alias("keys"), F.count_if(F.col("status") == "error").alias("errors"))
    p90 = M.exact_ranks(o, ["connector"], "seconds", {"p90": M.nearest_rank(0.9)})
    return sums.join(p90, "connector").select("connector", "n", "avg_ms", F.round("p90", 6).alias("p90"), "keys", "errors")


@Q.add("e11_percentile_linear", "SELECT op, round(quantile_cont(seconds, 0.5), 8) AS p50, round(quantile_cont(seconds, 0.95), 8) AS p95 FROM ops GROUP BY op", "ops")
def percentile_linear(spark: SparkSession, d: str) -> DataFrame:
    p = M.percentiles_linear(V.ops(spark, d), ["op"], "seconds", {"p50": 0.5, "p95": 0.95})
    return p.select("op", F.round("p50", 8).alias("p50"), F.round("p95", 8).alias("p95"))


@Q.add("e12_percentile_floor", "SELECT op, round(list_sort(list(seconds))[floor(0.5 * (count(*) - 1))::INT + 1], 6) AS p50, round(list_sort(list(seconds))[floor(0.99 * (count(*) - 1))::INT + 1], 6) AS p99 FROM ops GROUP BY op", "ops")
def percentile_floor(spark: SparkSession, d: str) -> DataFrame:
    p = M.exact_ranks(V.ops(spark, d), ["op"], "seconds", {"p50": M.floor_rank(0.5), "p99": M.floor_rank(0.99)})
    return p.select("op", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


_QUANTILE = """WITH_ SELECT op, arg_min(v, le) AS quantile FROM (SELECT op, le, cum, CASE WHEN le = 'inf'::DOUBLE THEN {inf} WHEN cum > below THEN lo + (le - lo) * (total * {q} - below) / (cum - below) ELSE le END AS v, total FROM (
  SELECT op, le, cum, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(cum) OVER w, 0) AS below, max(cum) OVER (PARTITION BY op) AS total FROM (SELECT op, le, sum(cum)::BIGINT AS cum FROM hist GROUP BY op, le) WINDOW w AS (PARTITION BY op ORDER BY le))) WHERE cum >= total * {q} AND total > 0 GROUP BY op"""


@Q.add("e13_histogram_quantile", "SELECT op, round(quantile, 8) AS p10 FROM (" + _QUANTILE.replace("WITH_ ", "").format(inf="NULL", q="0.1") + ")", "ops", "hist")
def histogram_quantile(spark: SparkSession, d: str) -> DataFrame:
    """The gate's rule: nothing is told of the infinite bucket."""
    h = hist(spark, d).groupBy("op", "le").agg(F.sum("cum").alias("cum"))
    return M.histogram_quantile(h, ["op"], 0.1).select("op", F.round("quantile", 8).alias("p10"))


@Q.add("m_latency_p99", "SELECT op, round(quantile, 8) AS p99 FROM (" + _QUANTILE.replace("WITH_ ", "").format(inf="lo", q="0.99").replace("FROM hist", "FROM wide") + ")", "ops", "wide")
def latency_p99(spark: SparkSession, d: str) -> DataFrame:
    """The dashboards' rule: the infinite bucket gives the highest finite bound; from the connectors' buckets (both ways of a call)."""
    h = wide(spark, d).groupBy("op", "le").agg(F.sum("cum").alias("cum"))
    return M.histogram_quantile(h, ["op"], 0.99, "top").select("op", F.round("quantile", 8).alias("p99"))


@Q.add("e14_per_bucket", "SELECT op, connector, round(least(le, 1e9), 6) AS le, cum - coalesce(lag(cum) OVER (PARTITION BY op, connector ORDER BY le), 0) AS n FROM hist", "ops", "hist")
def per_bucket(spark: SparkSession, d: str) -> DataFrame:
    return M.per_bucket(hist(spark, d), ["op", "connector"]).select("op", "connector", F.round(F.least("le", F.lit(1e9)), 6).alias("le"), "n")


@Q.add("f9_histogram_delta", "SELECT op, round(least(le, 1e9), 6) AS le, count_if(ts >= TIMESTAMP '2024-01-15' AND seconds <= le) AS grown FROM ops, (SELECT DISTINCT le FROM hist) b GROUP BY op, le", "ops", "hist")
def histogram_delta(spark: SparkSession, d: str) -> DataFrame:
    """After minus before; a shrinking bucket would be a reset and raises."""
    o = V.ops(spark, d)
    before = M.cumulative_histogram(o.where("ts < timestamp '2024-01-15'"), ["op"], "seconds", M.NODE_BOUNDS).withColumnRenamed("cum", "was")
    after = M.cumulative_histogram(o, ["op"], "seconds", M.NODE_BOUNDS)
    grown = F.col("cum") - F.coalesce("was", F.lit(0))
    checked = F.when(grown < 0, F.raise_error("histogram went backwards").cast("long")).otherwise(grown)
    return after.join(before, ["op", "le"], "left").select("op", F.round(F.least("le", F.lit(1e9)), 6).alias("le"), checked.alias("grown"))


@Q.add("f10_windowed_mean", "SELECT peer, day, n, round(s / n, 8) AS mean, round(sum(s) OVER w / sum(n) OVER w, 8) AS lifetime FROM (SELECT peer, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(seconds) AS s FROM ops GROUP BY 1, 2) WINDOW w AS (PARTITION BY peer ORDER BY day)", "ops")
def windowed_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean latency of each day, and since the start."""
    days = V.ops(spark, d).groupBy("peer", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.sum("seconds").alias("s"))
    w = Window.partitionBy("peer").orderBy("day")
    return days.select("peer", "day", "n", F.round(F.col("s") / F.col("n"), 8).alias("mean"), F.round(F.sum("s").over(w) / F.sum("n").over(w), 8).alias("lifetime"))


@Q.add("f11_positive_delta", "SELECT connector, op, sum(greatest(total - coalesce(best, total), 0))::BIGINT AS mirrored FROM (SELECT *, max(total) OVER (PARTITION BY connector, op ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM counters) GROUP BY connector, op", "ops", "counters")
def positive_delta(spark: SparkSession, d: str) -> DataFrame:
    """A mirror that ignores resets until the old value is surpassed."""
    c = counters(spark, d).withColumn("inc", M.increase(None, KEYS, ["ts", "event_id"], "total", "ignore"))
    return c.groupBy(*KEYS).agg(F.sum("inc").cast("long").alias("mirrored"))


@Q.add("m_counter_increase", "SELECT connector, op, sum(CASE WHEN before IS NULL THEN 0 WHEN total < before THEN total ELSE total - before END)::BIGINT AS increase FROM (SELECT *, lag(total) OVER (PARTITION BY connector, op ORDER BY ts, event_id) AS before FROM counters) GROUP BY connector, op", "ops", "counters")
def counter_increase(spark: SparkSession, d: str) -> DataFrame:
    """Reset-aware increase (not extrapolated to window edges)."""
    c = counters(spark, d).withColumn("inc", M.increase(None, KEYS, ["ts", "event_id"], "total"))
    return c.groupBy(*KEYS).agg(F.sum("inc").cast("long").alias("increase"))


@Q.add("f12_max_since_export", "SELECT peer, date_trunc('hour', ts) AS export, round(max(seconds), 6) AS slowest FROM ops GROUP BY 1, 2", "ops")
def max_since_export(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).groupBy("peer", F.date_trunc("hour", "ts").alias("export")).agg(F.round(F.max("seconds"), 6).alias("slowest"))


@Q.add("f14_demand_delta", "SELECT op, day, n, n - coalesce(lag(n) OVER (PARTITION BY op ORDER BY day), 0) AS grown FROM (SELECT op, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ops GROUP BY 1, 2)", "ops")
def demand_delta(spark: SparkSession, d: str) -> DataFrame:
    days = V.ops(spark, d).groupBy("op", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("grown", F.col("n") - F.coalesce(F.lag("n").over(Window.partitionBy("op").orderBy("day")), F.lit(0)))


@Q.add("m_hit_ratio", "SELECT date_trunc('hour', ts) AS hour, round(sum(hits) / greatest(sum(keys), 1e-9), 6) AS ratio FROM ops WHERE op IN ('get', 'exist') GROUP BY 1", "ops")
def hit_ratio(spark: SparkSession, d: str) -> DataFrame:
    o = V.ops(spark, d).where("op in ('get', 'exist')")
    return o.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.round(F.sum("hits") / F.greatest(F.sum("keys").cast("double"), F.lit(1e-9)), 6).alias("ratio"))


@Q.add("m_success_ratio", "SELECT op, round(sum(hits) / 2592000.0 / greatest(sum(keys) / 2592000.0, 1), 9) AS ratio FROM ops GROUP BY op", "ops")
def success_ratio(spark: SparkSession, d: str) -> DataFrame:
    """The panel's floor is one key a second, so slow series are understated, as there."""
    month = 2592000.0
    return V.ops(spark, d).groupBy("op").agg(F.round(F.sum("hits") / month / F.greatest(F.sum("keys") / month, F.lit(1.0)), 9).alias("ratio"))


@Q.add("m_errors_by_op", "SELECT op, status, count(*) AS n, round(count(*) / 2592000.0, 9) AS rate FROM ops GROUP BY op, status", "ops")
def errors_by_op(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).groupBy("op", "status").agg(F.count("*").alias("n"), F.round(F.count("*") / 2592000.0, 9).alias("rate"))


@Q.add("m_failed_keys", "SELECT op, sum(failed)::BIGINT AS failed FROM (SELECT op, connector, sum(keys) - sum(hits) AS failed FROM ops GROUP BY op, connector) GROUP BY op", "ops")
def failed_keys(spark: SparkSession, d: str) -> DataFrame:
    per = V.ops(spark, d).groupBy("op", "connector").agg((F.sum("keys") - F.sum("hits")).alias("failed"))
    return per.groupBy("op").agg(F.sum("failed").alias("failed"))


@Q.add("m_latency_avg", "SELECT op, round(sum(seconds) / count(*), 8) AS avg, round(max(seconds), 6) AS slowest FROM ops GROUP BY op", "ops")
def latency_avg(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).groupBy("op").agg(F.round(F.sum("seconds") / F.count("*"), 8).alias("avg"), F.round(F.max("seconds"), 6).alias("slowest"))


@Q.add("m_peer_latency", "SELECT peer, round(avg(m), 8) AS avg, round(max(m), 8) AS slowest FROM (SELECT peer, connector, avg(seconds) AS m FROM ops GROUP BY peer, connector) GROUP BY peer", "ops")
def peer_latency(spark: SparkSession, d: str) -> DataFrame:
    per = V.ops(spark, d).groupBy("peer", "connector").agg(F.avg("seconds").alias("m"))
    return per.groupBy("peer").agg(F.round(F.avg("m"), 8).alias("avg"), F.round(F.max("m"), 8).alias("slowest"))


@Q.add("m_series_fallback", "SELECT coalesce(a.connector, b.connector) AS connector, coalesce(a.n, b.n) AS n FROM (SELECT connector, count(*) AS n FROM ops WHERE op = 'put' AND substr(connector, 2)::INT < 5 GROUP BY 1) a FULL JOIN (SELECT connector, count(*) AS n FROM ops WHERE op = 'get' GROUP BY 1) b ON a.connector = b.connector", "ops")
def series_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A new series where there is one, else the old one."""
    o = V.ops(spark, d)
    count = lambda df, n: df.groupBy("connector").agg(F.count("*").alias(n))
    new = count(o.where((F.col("op") == "put") & (F.substring("connector", 2, 9).cast("int") < 5)), "new")
    return new.join(count(o.where("op = 'get'"), "old"), "connector", "full_outer").select("connector", F.coalesce("new", "old").alias("n"))


@Q.add("m_hit_funnel", "SELECT connector, sum(keys) FILTER (op = 'exist')::BIGINT AS asked, sum(hits) FILTER (op = 'exist')::BIGINT AS found, sum(hits) FILTER (op = 'get')::BIGINT AS fetched, round(sum(hits) FILTER (op = 'exist') / sum(keys) FILTER (op = 'exist'), 6) AS exist_ratio FROM ops GROUP BY connector", "ops")
def hit_funnel(spark: SparkSession, d: str) -> DataFrame:
    only = lambda c, op: F.sum(F.when(F.col("op") == op, F.col(c)))
    return V.ops(spark, d).groupBy("connector").agg(only("keys", "exist").alias("asked"), only("hits", "exist").alias("found"), only("hits", "get").alias("fetched"), F.round(only("hits", "exist") / only("keys", "exist"), 6).alias("exist_ratio"))


@Q.add("m_inventory", "SELECT m.id, m.ver, o.n FROM members m JOIN (SELECT peer, count(*) AS n FROM ops GROUP BY peer) o ON m.id = o.peer", "members", "ops")
def inventory(spark: SparkSession, d: str) -> DataFrame:
    return V.members(spark, d).join(V.ops(spark, d).groupBy(F.col("peer").alias("id")).agg(F.count("*").alias("n")), "id").select("id", "ver", "n")


@Q.add("d9_regression_gate", "SELECT op, round(b, 8) AS before, round(a, 8) AS after, a > b * 1.02 AS slower FROM (SELECT op, quantile_cont(seconds, 0.95) FILTER (ts < TIMESTAMP '2024-01-15') AS b, quantile_cont(seconds, 0.95) FILTER (ts >= TIMESTAMP '2024-01-15') AS a FROM ops GROUP BY op)", "ops")
def regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Baseline and candidate by op: has the 95th percentile grown by more than 2 %?"""
    p95 = lambda df, n: M.percentiles_linear(df, ["op"], "seconds", {n: 0.95})
    o = V.ops(spark, d)
    j = p95(o.where("ts < timestamp '2024-01-15'"), "b").join(p95(o.where("ts >= timestamp '2024-01-15'"), "a"), "op", "full_outer")
    return j.select("op", F.round("b", 8).alias("before"), F.round("a", 8).alias("after"), (F.col("a") > F.col("b") * 1.02).alias("slower"))


@Q.add("e22_error_rate", "SELECT connector, CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count_if(status = 'error') / count(*), 6) END AS error_rate FROM ops GROUP BY connector", "ops")
def error_rate(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).groupBy("connector").agg(F.when(F.count("*") == 0, 1.0).otherwise(F.round(F.count_if(F.col("status") == "error") / F.count("*"), 6)).alias("error_rate"))


@Q.add("c9_slow_ops", "SELECT event_id, op, round(seconds, 6) AS seconds FROM ops WHERE seconds >= 0.15 OR status = 'error'", "ops")
def slow_ops(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).where("seconds >= 0.15 or status = 'error'").select("event_id", "op", F.round("seconds", 6).alias("seconds"))
