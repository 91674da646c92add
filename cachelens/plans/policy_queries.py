"""Leases, runs, recurrence, sessions and rates over heartbeats and operations, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.plans import views as V
from cachelens.plans.book import Book
from cachelens.streaming import windows as S

Q = Book()

V.SQL["polls"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT node) AS size, min(node) % 4 AS grp, bool_or(node = 1) AS has_required, bool_or(node = 19) AS has_forbidden FROM beats GROUP BY 1"


def polls(spark: SparkSession, d: str) -> DataFrame:
    b = V.beats(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.countDistinct("node").alias("size"), (F.min("node") % 4).alias("grp"), F.bool_or(F.col("node") == 1).alias("has_required"), F.bool_or(F.col("node") == 19).alias("has_forbidden"))
    return b


@Q.add("j1_leases", "SELECT node, max(ts) AS last_beat, arg_max(ver, seq) AS ver FROM beats GROUP BY node HAVING max(ts) > (SELECT max(ts) FROM beats) - INTERVAL 3 DAY", "beats")
def leases(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose lease (three days here) has not run out at the last heartbeat of all."""
    b = V.beats(spark, d)
    now = b.agg(F.max("ts").alias("now")).scalar()
    live = b.groupBy("node").agg(F.max("ts").alias("last_beat"), F.max_by("ver", "seq").alias("ver"))
    return live.where(F.col("last_beat") > now - F.expr("interval 3 days"))


@Q.add("j4_epoch_changes", "SELECT day, size FROM (SELECT day, size, lag(size) OVER (PARTITION BY grp ORDER BY day) AS was FROM polls) WHERE was IS NULL OR was <> size", "beats", "polls")
def epoch_changes(spark: SparkSession, d: str) -> DataFrame:
    was = F.lag("size").over(Window.partitionBy("grp").orderBy("day"))
    return polls(spark, d).withColumn("was", was).where("was is null or was <> size").select("day", "size")


@Q.add("j12_recurrence", """SELECT event_id, n % 2 = 0 AS recurrent FROM (SELECT event_id, row_number() OVER (PARTITION BY object_key, run ORDER BY ts, event_id) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY object_key ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY object_key ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM ops WHERE op = 'get')))""", "ops")
def recurrence(spark: SparkSession, d: str) -> DataFrame:
    """Reads that find the fingerprint an earlier one left (an hour here); finding it uses it up, so each second of a run."""
    w = Window.partitionBy("object_key").orderBy("ts", "event_id")
    near = F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 1 hour")
    runs = V.ops(spark, d).where("op = 'get'").withColumn("fresh", F.when(near, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    n = F.row_number().over(Window.partitionBy("object_key", "run").orderBy("ts", "event_id"))
    return runs.withColumn("n", n).select("event_id", (F.col("n") % 2 == 0).alias("recurrent"))


@Q.add("j16_stable_runs", "SELECT grp, day FROM (SELECT grp, day, size, has_required, has_forbidden, lag(size) OVER w AS a, lag(size, 2) OVER w AS b FROM polls WINDOW w AS (PARTITION BY grp ORDER BY day)) WHERE size = a AND size = b AND has_required AND NOT has_forbidden", "beats", "polls")
def stable_runs(spark: SparkSession, d: str) -> DataFrame:
    """Polls that see a size for the third time in a row or more, with the required node and without the forbidden one."""
    w = Window.partitionBy("grp").orderBy("day")
    return polls(spark, d).withColumn("a", F.lag("size").over(w)).withColumn("b", F.lag("size", 2).over(w)).where("size = a and size = b and has_required and not has_forbidden").select("grp", "day")


@Q.add("f13_ewma", "SELECT peer, list_reduce(list((seconds * 1000000)::BIGINT ORDER BY ts, event_id), lambda a, x: (7 * a + x) // 8) AS ewma FROM ops GROUP BY peer", "ops")
def ewma(spark: SparkSession, d: str) -> DataFrame:
    """Integer latency average of each peer, folded in the JVM."""
    xs = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.round(F.col("seconds") * 1000000).cast("long").alias("x")))), lambda r: r["x"])
    folded = F.aggregate(F.slice("xs", 2, F.greatest(F.size("xs") - 1, F.lit(1))), F.col("xs")[0], lambda a, x: F.floor((7 * a + x) / 8).cast("long"))
    return V.ops(spark, d).groupBy("peer").agg(xs.alias("xs")).select("peer", F.when(F.size("xs") > 1, folded).otherwise(F.col("xs")[0]).alias("ewma"))


@Q.add("s_windowed_rates", "SELECT date_trunc('day', ts) AS start, op, count(*) AS requests, sum(keys)::BIGINT AS keys, sum(hits)::BIGINT AS hits FROM ops WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM ops) GROUP BY 1, 2", "ops")
def windowed_rates(spark: SparkSession, d: str) -> DataFrame:
    """Daily rates as a stream emits them: windows that the watermark has closed."""
    e = S.file_stream(spark, f"{d}/events.parquet")
    keys, kind = 1 + F.col("event_id") % 8, F.col("event_type")
    op = F.when(kind == "click", "exist").when(kind == "purchase", "put").when(kind == "signup", "remove").otherwise("get")
    hits = F.when(kind == "error", 0).otherwise(keys - F.floor(F.col("event_id") % 8 / 5)).cast("long")
    return S.drain(S.windowed_rates(e.select(F.col("ts").cast("timestamp").alias("ts"), op.alias("op"), keys.alias("keys"), hits.alias("hits")))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@Q.add("s_sessions", """SELECT connector, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS requests FROM (SELECT connector, ts, sum(fresh) OVER (PARTITION BY connector ORDER BY ts, event_id) AS run FROM (
  SELECT connector, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY connector ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM ops)) GROUP BY connector, run""", "ops")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each connector in batch; `streaming.windows.sessions` takes a stream as well."""
    o = V.ops(spark, d)
    return S.sessions(o)


@Q.add("j10_inflight_gate", "SELECT a.event_id, count(b.event_id) AS inflight FROM (SELECT * FROM ops WHERE op = 'put') a JOIN (SELECT * FROM ops WHERE op = 'put') b ON a.peer = b.peer AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 20 MINUTE GROUP BY a.event_id", "ops")
def inflight(spark: SparkSession, d: str) -> DataFrame:
    """Puts of a peer in flight at each put (they take 20 minutes here), by one ordered window."""
    w = Window.partitionBy("peer").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-20 * 60 * 1_000_000 + 1, 0)
    return V.ops(spark, d).where("op = 'put'").select("event_id", F.count("*").over(w).alias("inflight"))


@Q.add("j14_heartbeat_health", """SELECT event_id, count_if(status = 'error') OVER (PARTITION BY peer, run ORDER BY ts, event_id) AS failures, last_good FROM (SELECT *, count_if(status <> 'error') OVER (PARTITION BY peer ORDER BY ts, event_id) AS run,
  max(event_id) FILTER (status <> 'error') OVER (PARTITION BY peer ORDER BY ts, event_id) AS last_good FROM ops)""", "ops")
def heartbeat_health(spark: SparkSession, d: str) -> DataFrame:
    """Failures in a row of each peer, and its last success."""
    w = Window.partitionBy("peer").orderBy("ts", "event_id")
    bad = F.col("status") == "error"
    o = V.ops(spark, d).withColumn("run", F.count_if(~bad).over(w)).withColumn("last_good", F.max(F.when(~bad, F.col("event_id"))).over(w))
    return o.select("event_id", F.count_if(bad).over(Window.partitionBy("peer", "run").orderBy("ts", "event_id")).alias("failures"), "last_good")
