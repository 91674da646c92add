"""Text and binary sources: written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.functions import identity as I
from cachelens.plans import views as V
from cachelens.plans.book import Book
from cachelens.sources import codec as K
from cachelens.sources import text as T

Q = Book()


def exposition(spark: SparkSession, d: str) -> DataFrame:
    o = V.ops(spark, d).groupBy("connector", "op").agg(F.sum("keys").alias("keys"))
    return T.render_samples(o, F.lit("cache_keys_total"), {"id": F.col("connector"), "op": F.col("op")}, F.col("keys")).select("line")


@Q.add("a7_sample_sums", "SELECT 'cache_keys_total' AS name, op, sum(keys)::DOUBLE AS value FROM ops GROUP BY op", "ops")
def sample_sums(spark: SparkSession, d: str) -> DataFrame:
    """Metric text parsed and summed over label sets."""
    return T.parse_samples(exposition(spark, d)).groupBy("name", F.col("labels")["op"].alias("op")).agg(F.sum("value").alias("value"))


@Q.add("a9_per_op_pivot", "SELECT connector AS id, sum(keys) FILTER (op = 'get')::DOUBLE AS \"get\", sum(keys) FILTER (op = 'put')::DOUBLE AS put FROM ops GROUP BY connector", "ops")
def per_op(spark: SparkSession, d: str) -> DataFrame:
    s = T.parse_samples(exposition(spark, d))
    return s.withColumn("op", F.col("labels")["op"]).groupBy(F.col("labels")["id"].alias("id")).pivot("op", ["get", "put"]).agg(F.sum("value"))


@Q.add("a13_render", "SELECT 'cache_keys_total{id=\"' || connector || '\",op=\"' || op || '\"} ' || sum(keys)::BIGINT AS line FROM ops GROUP BY connector, op", "ops")
def render(spark: SparkSession, d: str) -> DataFrame:
    return exposition(spark, d)


@Q.add("a18_quota_file", """SELECT CASE WHEN i % 3 <> 2 THEN h END AS tenant_hash, min(CASE WHEN i % 3 <> 2 THEN n END) AS limit_bytes, count(*) AS n, count(*) > 1 OR i % 3 = 2 AS bad FROM (
  SELECT substr(md5(tenant), 1, 16) AS h, (sum(value_len) * 2)::DECIMAL(20, 0) AS n, CASE WHEN tenant LIKE '%1' THEN 2 ELSE 0 END AS i FROM objects GROUP BY tenant
  UNION ALL SELECT substr(md5(tenant), 1, 16), (sum(value_len) * 3)::DECIMAL(20, 0), 0 FROM objects WHERE tenant LIKE '%2' GROUP BY tenant) GROUP BY CASE WHEN i % 3 <> 2 THEN h END, i % 3 = 2""", "objects")
def quota_file(spark: SparkSession, d: str) -> DataFrame:
    """A quota file in which some lines have a field too many and some tenants come twice."""
    o = V.objects(spark, d).groupBy("tenant").agg(F.sum("value_len").alias("n"))
    line = lambda k, tail: F.concat(F.substring(F.md5(F.col("tenant").cast("binary")), 1, 16), F.lit(" "), F.col("n") * k, tail).alias("line")
    lines = o.select(line(2, F.when(F.col("tenant").endswith("1"), " extra").otherwise(" # limit"))).unionAll(o.where("tenant like '%2'").select(line(3, F.lit("")))).unionAll(o.where("tenant is not null").limit(1).select(F.lit("# comment")))
    return T.parse_quotas(lines)


@Q.add("a22_member_text", "SELECT grp, id AS name, '10.0.0.' || num % 250 AS ip, 28000 + num % 100 AS port FROM members", "members")
def member_text(spark: SparkSession, d: str) -> DataFrame:
    m = V.members(spark, d)
    token = F.concat("id", F.lit("=10.0.0."), F.col("num") % 250, F.lit(":"), 28000 + F.col("num") % 100)
    lines = m.groupBy("grp").agg(F.concat(F.array_join(F.sort_array(F.collect_list(token)), ","), F.lit(",junk")).alias("line"))
    return T.parse_members(lines, "line").select("grp", "name", "ip", "port")


@Q.add("a15_access_log", "SELECT op, count(*) AS n, count_if(status = 'error') AS errors, round(sum(round(seconds, 6)), 5) AS seconds FROM ops GROUP BY op", "ops")
def access_log(spark: SparkSession, d: str) -> DataFrame:
    o = V.ops(spark, d)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), "op", F.lit("("), "object_key", F.lit(","), "keys", F.lit(") : "), "status", F.lit(" <"), F.format_string("%.6f", "seconds"), F.lit(">"))
    return T.parse_access_log(o.select(line.alias("line"))).groupBy("op").agg(F.count("*").alias("n"), F.count_if(F.col("result") == "error").alias("errors"), F.round(F.sum("seconds"), 5).alias("seconds"))


@Q.add("a3_membership_codec", "SELECT num, id, '10.0.0.' || num % 250 AS ip, 28000 + num % 100 AS port, weight, 27000 + num % 100 AS tcp_port, 'ver=' || ver AS info, has_stats, CASE WHEN has_stats THEN used_bytes END AS used_bytes, CASE WHEN has_stats THEN num * 3 END AS ram_hits_total FROM members WHERE num % 6 <> 5", "members")
def membership_codec(spark: SparkSession, d: str) -> DataFrame:
    """Member records written and read back; every sixth is cut short and counts as malformed."""
    m = V.members(spark, d)
    given = {"capacity_bytes", "used_bytes", "objects", "hits_total", "misses_total", "evictions_total"}
    stats = [F.when(F.col("has_stats"), F.col(s) if s in given else F.col("num") * 3 if s == "ram_hits_total" else F.lit(0)) for s in K.STATS]
    rec = K.registration(F.col("id"), F.concat(F.lit("10.0.0."), F.col("num") % 250), 28000 + F.col("num") % 100, F.col("weight"), 27000 + F.col("num") % 100, F.concat(F.lit("ver="), "ver"), stats)
    rec = m.select("num", F.when(F.col("num") % 6 == 5, F.substring(rec, 1, 15)).otherwise(rec).alias("record"))
    out = K.parse_members_binary(rec, "record", ["num"]).where("not bad")
    return out.select("num", "id", "ip", "port", "weight", "tcp_port", "info", "has_stats", "used_bytes", "ram_hits_total")


def registrations(m: DataFrame) -> Column:
    """A record with all tails for each member."""
    stats = [F.when(F.col("has_stats"), F.col("num") + k) for k in range(len(K.STATS))]
    return K.registration(F.col("id"), F.concat(F.lit("10.0.0."), F.col("num") % 250), 28000 + F.col("num") % 100, F.col("weight"), 27000 + F.col("num") % 100, F.concat(F.lit("ver="), "ver"), stats)


@Q.add("a4_strict_registration", """SELECT num, CASE WHEN e IS NULL THEN id END AS id, CASE WHEN e IS NULL THEN '10.0.0.' || num % 250 || ':' || (28000 + num % 100) END AS endpoint,
  CASE WHEN e IS NULL THEN weight END AS weight, CASE WHEN e IS NULL THEN 'ver=' || ver END AS info, e AS error
FROM (SELECT *, CASE num % 6 WHEN 5 THEN 'truncated' WHEN 4 THEN 'truncated' WHEN 3 THEN 'epoch or count' WHEN 2 THEN 'encoding' END AS e FROM members)""", "members")
def strict_registration(spark: SparkSession, d: str) -> DataFrame:
    """Registrations read strictly: some are cut in the head, some in the last tail, some have an epoch or a name that is no UTF-8."""
    m = V.members(spark, d)
    rec, k = registrations(m), F.col("num") % 6
    cut = F.substring(rec, F.lit(1), F.octet_length(rec) - 1)
    epoch = F.concat(F.unhex(F.lit("01")), F.substring(rec, F.lit(2), F.octet_length(rec)))
    name = F.concat(F.substring(rec, 1, 16), F.unhex(F.lit("FF")), F.substring(rec, F.lit(18), F.octet_length(rec)))
    out = K.parse_registrations(m.select("num", F.when(k == 5, F.substring(rec, 1, 15)).when(k == 4, cut).when(k == 3, epoch).when(k == 2, name).otherwise(rec).alias("record")), "record", ["num"])
    return out.select("num", "id", F.concat("ip", F.lit(":"), "port").alias("endpoint"), "weight", "info", "error")


@Q.add("a5_member_request", "SELECT num, CASE WHEN num % 4 <> 3 THEN grp END AS grp, CASE WHEN num % 4 <> 3 THEN id END AS id, CASE WHEN num % 4 <> 3 THEN 27000 + num % 100 END AS tcp_port, num % 4 = 3 AS bad FROM members", "members")
def member_request(spark: SparkSession, d: str) -> DataFrame:
    """Requests of a group and its member written and read back; every fourth holds the group alone."""
    m = V.members(spark, d)
    group = I.framed(F.col("grp"))
    request = F.when(F.col("num") % 4 == 3, group).otherwise(F.concat(group, registrations(m)))
    out = K.parse_registrations(m.select("num", request.alias("request")), "request", ["num"], grouped=True)
    return out.select("num", "grp", "id", "tcp_port", F.col("error").isNotNull().alias("bad"))


@Q.add("a16_metric_payload", "SELECT connector, op, '{\"name\":\"cache_keys_total\",\"sum\":{\"aggregationTemporality\":2,\"isMonotonic\":true,\"dataPoints\":[{\"attributes\":[{\"key\":\"op\",\"value\":{\"stringValue\":\"' || op || '\"}}],\"asInt\":\"' || sum(keys)::BIGINT || '\"}]}}' AS payload FROM ops GROUP BY connector, op", "ops")
def metric_payload(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative sums as JSON of the telemetry protocol."""
    o = V.ops(spark, d).groupBy("connector", "op").agg(F.sum("keys").alias("n"))
    attributes = F.array(F.struct(F.lit("op").alias("key"), F.struct(F.col("op").alias("stringValue")).alias("value")))
    points = F.array(F.struct(attributes.alias("attributes"), F.col("n").cast("string").alias("asInt")))
    body = F.struct(F.lit("cache_keys_total").alias("name"), F.struct(F.lit(2).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"), points.alias("dataPoints")).alias("sum"))
    return o.select("connector", "op", F.to_json(body).alias("payload"))


@Q.add("a17_span_buffer", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY connector ORDER BY ts DESC, event_id DESC) AS n FROM ops WHERE status = 'error' OR seconds >= 0.1) WHERE n <= 20", "ops")
def span_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Kept spans of each connector: failed or slow ones, the oldest dropped beyond twenty."""
    w = Window.partitionBy("connector").orderBy(F.desc("ts"), F.desc("event_id"))
    return V.ops(spark, d).where("status = 'error' or seconds >= 0.1").withColumn("n", F.row_number().over(w)).where("n <= 20").select("event_id")


@Q.add("a1_prefix_scan", "SELECT key, split_part(key, '/', 4) AS grp FROM (SELECT '/v1/groups/' || grp || '/members/' || id AS key FROM members) WHERE starts_with(key, '/v1/groups/ASIA/')", "members")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    """A prefix as a range, which Parquet can prune: from the prefix up to its successor."""
    keys = V.members(spark, d).select(F.concat(F.lit("/v1/groups/"), "grp", F.lit("/members/"), "id").alias("key"))
    prefix = "/v1/groups/ASIA/"
    return keys.where((F.col("key") >= prefix) & (F.col("key") < T.prefix_successor(prefix))).select("key", F.split_part("key", F.lit("/"), F.lit(4)).alias("grp"))
