"""Further operators: fingerprints, epochs, samplers, selections and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.functions import identity as I
from cachelens.functions.epoch import view_epochs
from cachelens.plans import views as V
from cachelens.plans.book import Book
from cachelens.plans.identity_queries import _framed

Q = Book()


@Q.add("b9_layout_fingerprint", f"SELECT n_nationkey, substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS fingerprint FROM (SELECT n_nationkey, sha256(encode('DFKVLAYOUT1') || {_framed('n_name')} || {_framed(chr(39) + 'dtype' + chr(39))} || {_framed(chr(39) + 'str:bf16' + chr(39))} || {_framed(chr(39) + 'heads' + chr(39))} || {_framed(chr(39) + 'int:' + chr(39) + ' || n_nationkey')}) AS h FROM nation)")
def layout_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    n = V.table(spark, d, "nation")
    return n.select("n_nationkey", I.layout_fingerprint(F.col("n_name"), {"heads": F.concat(F.lit("int:"), "n_nationkey"), "dtype": F.lit("str:bf16")}).alias("fingerprint"))


@Q.add("b15_view_epoch")
def view_epoch(spark: SparkSession, d: str) -> DataFrame:
    m = V.members(spark, d).withColumn("ip", F.concat(F.lit("10.0.0."), F.col("num") % 250)).withColumn("port", 28000 + F.col("num") % 100)
    return view_epochs(m, ["grp"])


@Q.add("b29_client_ranks", "SELECT s_suppkey, rank, stripe FROM (SELECT s_suppkey, s_suppkey % 8 AS rank, CASE WHEN (s_suppkey % 8) % (8 // eff) = 0 AND (s_suppkey % 8) // (8 // eff) < eff THEN (s_suppkey % 8) // (8 // eff) END AS stripe FROM (SELECT s_suppkey, 1 + s_nationkey % 8 AS eff FROM supplier))")
def client_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = V.table(spark, d, "supplier").withColumn("rank", F.col("s_suppkey") % 8)
    return s.select("s_suppkey", "rank", I.participant(F.col("rank"), F.lit(8), 1 + F.col("s_nationkey") % 8).alias("stripe"))


@Q.add("b33_sampler", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY peer ORDER BY ts, event_id) - 1 AS n FROM ops) WHERE n % 64 = 0", "ops")
def sampler(spark: SparkSession, d: str) -> DataFrame:
    """One operation in 64 of each peer, the first included."""
    n = F.row_number().over(Window.partitionBy("peer").orderBy("ts", "event_id")) - 1
    return V.ops(spark, d).withColumn("n", n).where("n % 64 = 0").select("event_id")


@Q.add("c8_suspicious_views", "SELECT day, size, was, size * 100 < was * 50 OR size * 100 > was * 150 AS suspicious FROM (SELECT day, size, lag(size) OVER (ORDER BY day) AS was FROM (SELECT strftime(ts, '%Y-%m') AS day, count(DISTINCT node) AS size FROM beats GROUP BY 1)) WHERE was IS NOT NULL", "beats")
def suspicious(spark: SparkSession, d: str) -> DataFrame:
    """Monthly views against the month before, in exact integer arithmetic (the ordered rows are one a month)."""
    b = V.beats(spark, d).groupBy(F.date_format("ts", "yyyy-MM").alias("day")).agg(F.countDistinct("node").alias("size"))
    was = F.lag("size").over(Window.orderBy("day"))
    return b.withColumn("was", was).where("was is not null").withColumn("suspicious", (F.col("size") * 100 < F.col("was") * 50) | (F.col("size") * 100 > F.col("was") * 150))


@Q.add("f4_group_fixpoint", """SELECT req, coalesce(max(2 * (b + 1)) FILTER (ok AND 2 * (b + 1) <= prefix), 0) AS hit FROM (
  SELECT req, b, prefix, min(good::INT) OVER (PARTITION BY req ORDER BY b ROWS 1 PRECEDING) = 1 AS ok FROM (
    SELECT c.req, c.pos // 2 AS b, count(*) = 2 AND bool_and(c.tenant <> 3) AS good, any_value(p.prefix) AS prefix FROM chunks c JOIN (SELECT req, coalesce(min(pos) FILTER (NOT present), count(*)) AS prefix FROM chunks GROUP BY req) p ON c.req = p.req GROUP BY c.req, c.pos // 2)) GROUP BY req""", "chunks")
def group_fixpoint(spark: SparkSession, d: str) -> DataFrame:
    """Hit length in chunks on which two attention groups agree.

    The full-attention group (blocks of one chunk) hits a prefix.  The sliding-window group has
    blocks of two chunks and needs the last two blocks before the end; lengths are aligned to the
    larger block.  With a full-attention group first, one pass over the other group converges.
    """
    c = V.chunks(spark, d)
    prefix = c.groupBy("req").agg(F.coalesce(F.min(F.when(~F.col("present"), F.col("pos"))), F.count("*")).alias("prefix"))
    blocks = c.groupBy("req", F.floor(F.col("pos") / 2).alias("b")).agg(((F.count("*") == 2) & F.bool_and(F.col("tenant") != 3)).alias("good"))
    ok = F.bool_and("good").over(Window.partitionBy("req").orderBy("b").rowsBetween(-1, 0))
    end = 2 * (F.col("b") + 1)
    j = blocks.withColumn("ok", ok).join(prefix, "req")
    return j.groupBy("req").agg(F.coalesce(F.max(F.when(F.col("ok") & (end <= F.col("prefix")), end)), F.lit(0)).alias("hit"))


@Q.add("g5_least_loaded", "SELECT peer, arg_min(connector, (n, s, connector)) AS pick FROM (SELECT peer, connector, count(*) AS n, sum((seconds * 100000)::BIGINT) AS s FROM ops GROUP BY peer, connector) GROUP BY peer", "ops")
def least_loaded(spark: SparkSession, d: str) -> DataFrame:
    """Fewest in flight, then least latency, then id."""
    o = V.ops(spark, d).groupBy("peer", "connector").agg(F.count("*").alias("n"), F.sum(F.round(F.col("seconds") * 100000).cast("long")).alias("s"))
    return o.groupBy("peer").agg(F.min_by("connector", F.struct("n", "s", "connector")).alias("pick"))


@Q.add("i12_partial_cleanup", "SELECT req, grp, pos FROM (SELECT req, pos, pos // 3 AS grp, bool_or(NOT present) OVER (PARTITION BY req, pos // 3) AS failed, present FROM chunks) WHERE failed AND present", "chunks")
def partial_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Written siblings of a group of which one part failed."""
    c = V.chunks(spark, d).withColumn("grp", F.floor(F.col("pos") / 3))
    failed = c.where("not present").select("req", "grp").distinct()
    return c.where("present").join(failed, ["req", "grp"], "left_semi").select("req", "grp", "pos")


@Q.add("m_capacity", "SELECT id, round(100.0 * used_bytes / capacity_bytes, 6) AS used_percent, used_bytes / capacity_bytes > 0.5 AS tight FROM members WHERE has_stats", "members")
def capacity(spark: SparkSession, d: str) -> DataFrame:
    share = F.col("used_bytes") / F.col("capacity_bytes")
    return V.members(spark, d).where("has_stats").select("id", F.round(100.0 * F.col("used_bytes") / F.col("capacity_bytes"), 6).alias("used_percent"), (share > 0.5).alias("tight"))


@Q.add("m_counts_by_version", "SELECT ver, count(*) AS n, count(DISTINCT grp) AS groups FROM members GROUP BY ver", "members")
def by_version(spark: SparkSession, d: str) -> DataFrame:
    return V.members(spark, d).groupBy("ver").agg(F.count("*").alias("n"), F.countDistinct("grp").alias("groups"))


@Q.add("m_connector_count", "SELECT count(DISTINCT connector) AS connectors, count(DISTINCT peer) AS peers FROM ops", "ops")
def connector_count(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).agg(F.countDistinct("connector").alias("connectors"), F.countDistinct("peer").alias("peers"))


@Q.add("m_bandwidth", "SELECT date_trunc('hour', ts) AS hour, sum(bytes) FILTER (op = 'get')::BIGINT AS read_bytes, sum(bytes) FILTER (op = 'put')::BIGINT AS written_bytes FROM ops GROUP BY 1", "ops")
def bandwidth(spark: SparkSession, d: str) -> DataFrame:
    only = lambda op: F.sum(F.when(F.col("op") == op, F.col("bytes")))
    return V.ops(spark, d).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(only("get").alias("read_bytes"), only("put").alias("written_bytes"))


@Q.add("m_label_values", "SELECT DISTINCT connector AS value FROM ops", "ops")
def label_values(spark: SparkSession, d: str) -> DataFrame:
    return V.ops(spark, d).select(F.col("connector").alias("value")).distinct()


@Q.add("e16_quota_metrics", "SELECT q.tenant, q.quota, coalesce(u.bytes, 0) AS used, coalesce(u.rejections, 0) AS rejections FROM (SELECT unnest([0, 1, 9]) AS tenant, unnest([1000000, 5000000, 7]) AS quota) q LEFT JOIN (SELECT tenant, (sum(size) FILTER (present))::BIGINT AS bytes, count_if(NOT present) AS rejections FROM chunks GROUP BY tenant) u ON u.tenant = q.tenant", "chunks")
def quota_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Configured tenants only, with what they use and how many of their puts were turned away (the chunks that are not there)."""
    limits = spark.createDataFrame([(0, 1000000), (1, 5000000), (9, 7)], "tenant int, quota int")
    used = V.chunks(spark, d).groupBy(F.col("tenant").cast("int").alias("tenant")).agg(F.sum(F.when(F.col("present"), F.col("size"))).alias("used"), F.count_if(~F.col("present")).alias("rejections"))
    return limits.join(used, "tenant", "left").select("tenant", "quota", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("rejections", F.lit(0)).alias("rejections"))
