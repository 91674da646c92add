"""Carrier views: deterministic tables of the cache domain over the driver's tables.

Each view is a DataFrame function and, for the oracle, a common table expression in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def oracle(body: str, *views: str) -> str:
    """The SQL of a query over some carrier views (in order of use)."""
    return ("WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views) + "\n" + body) if views else body


SQL["ops"] = """SELECT event_id, ts, 'c' || (user_id % 8) AS connector, 'n' || (user_id % 10) AS peer,
  CASE event_type WHEN 'click' THEN 'exist' WHEN 'purchase' THEN 'put' WHEN 'signup' THEN 'remove' ELSE 'get' END AS op,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, value / 1000 AS seconds,
  'k' || json_extract_string(props, '$.k') AS object_key, 1 + event_id % 8 AS keys,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 + event_id % 8 - event_id % 8 // 5 END AS hits, 4096 * (1 + event_id % 8) AS bytes
FROM events"""


def ops(spark: SparkSession, d: str) -> DataFrame:
    """Operation log from events."""
    kind = F.col("event_type")
    keys = 1 + F.col("event_id") % 8
    return table(spark, d, "events").select(
        "event_id", "ts", F.concat(F.lit("c"), F.col("user_id") % 8).alias("connector"), F.concat(F.lit("n"), F.col("user_id") % 10).alias("peer"),
        F.when(kind == "click", "exist").when(kind == "purchase", "put").when(kind == "signup", "remove").otherwise("get").alias("op"),
        F.when(kind == "error", "error").otherwise("ok").alias("status"), (F.col("value") / 1000).alias("seconds"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("object_key"), keys.alias("keys"),
        F.when(kind == "error", 0).otherwise(keys - F.floor(F.col("event_id") % 8 / 5)).cast("long").alias("hits"), (4096 * keys).alias("bytes"),
    )


SQL["objects"] = "SELECT doc_id, 'model/' || lang AS ns, doc_id::VARCHAR AS object_key, source AS tenant, coalesce(text, '') AS value, strlen(coalesce(text, '')) AS value_len FROM documents"


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Stored objects from documents; the payload is read only where `value` is used."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("model/"), "lang").alias("ns"), F.col("doc_id").cast("string").alias("object_key"), F.col("source").alias("tenant"), text.alias("value"), F.octet_length(text).cast("long").alias("value_len"))


SQL["members"] = """SELECT r_name AS grp, 'n' || s_suppkey AS id, s_suppkey AS num, 1 + s_nationkey % 4 AS weight, 'v' || (1 + s_suppkey % 3) AS ver,
  s_suppkey % 7 <> 6 AS has_stats, 1000000 * (10 + s_suppkey % 9) AS capacity_bytes, 900000 * (1 + s_suppkey % 10) AS used_bytes,
  100 * (s_suppkey % 13) AS hits_total, 10 * (s_suppkey % 11) AS misses_total, s_suppkey % 5 AS evictions_total, 7 * (s_suppkey % 17) AS objects
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """Fleet members from suppliers; group is the region."""
    k = F.col("s_suppkey")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    df = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return df.select(
        F.col("r_name").alias("grp"), F.concat(F.lit("n"), k).alias("id"), k.alias("num"), (1 + F.col("s_nationkey") % 4).cast("int").alias("weight"), F.concat(F.lit("v"), 1 + k % 3).alias("ver"),
        (k % 7 != 6).alias("has_stats"), (1000000 * (10 + k % 9)).alias("capacity_bytes"), (900000 * (1 + k % 10)).alias("used_bytes"), (100 * (k % 13)).alias("hits_total"), (10 * (k % 11)).alias("misses_total"), (k % 5).alias("evictions_total"), (7 * (k % 17)).alias("objects"),
    )


SQL["chunks"] = """SELECT l_orderkey AS req, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 AS pos,
  md5(l_partkey || '-' || l_suppkey) AS hash, (l_quantity * 4096)::BIGINT AS size, l_returnflag <> 'R' AS present, l_suppkey % 5 AS tenant FROM lineitem"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Ordered chunks of requests from line items."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("req"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.md5(F.concat_ws("-", "l_partkey", "l_suppkey").cast("binary")).alias("hash"),
        (F.col("l_quantity") * 4096).cast("long").alias("size"), (F.col("l_returnflag") != "R").alias("present"), (F.col("l_suppkey") % 5).alias("tenant"),
    )


SQL["beats"] = "SELECT o_custkey % 20 AS node, o_orderdate AS ts, o_orderpriority AS ver, o_orderkey AS seq FROM orders"


def beats(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeats from orders."""
    return table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("node"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("ver"), F.col("o_orderkey").alias("seq"))
