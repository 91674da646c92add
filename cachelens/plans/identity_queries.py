"""Identity functions and placement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.functions import identity as I
from cachelens.operators import ring as R
from cachelens.plans import views as V
from cachelens.plans.book import Book

Q = Book()


def _le(n: str, width: int) -> str:
    """SQL for `width` little-endian bytes of a number."""
    h = f"lpad(to_hex({n}), 16, '0')"
    return "unhex(" + " || ".join(f"substr({h}, {17 - 2 * i}, 2)" for i in range(1, width + 1)) + ")"


def _framed(text: str) -> str:
    return f"{_le(f'strlen({text})', 4)} || encode({text})"


TENANT = f"substr(sha256(encode('DFKVTENANT1') || {_le('strlen(ns)', 8)} || encode(ns)), 1, 16)"
DIGEST = f"substr(sha256(encode('DFKVKEY2') || {_le('strlen(ns)', 8)} || encode(ns) || {_le('strlen(object_key)', 8)} || encode(object_key)), 1, 32)"


@Q.add("b7_tenant_hash", f"SELECT DISTINCT ns, {TENANT} AS tenant_hash FROM objects", "objects")
def tenant_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.objects(spark, d).select("ns").distinct().select("ns", I.tenant_hash(F.col("ns")).alias("tenant_hash"))


@Q.add("b8_block_key", f"SELECT doc_id, substr({DIGEST}, 1, 16) AS digest_hi, substr({DIGEST}, 17, 16) AS digest_lo FROM objects", "objects")
def block_key(spark: SparkSession, d: str) -> DataFrame:
    g = I.block_digest(F.col("ns"), F.col("object_key"))
    return V.objects(spark, d).select("doc_id", F.substring(g, 1, 16).alias("digest_hi"), F.substring(g, 17, 16).alias("digest_lo"))


@Q.add("b13_block_path", f"SELECT doc_id, 'blocks/' || substr(b, 1, 2) || '/' || substr(b, 1, 4) || '/' || b AS path, doc_id % 5 <> 4 AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'X' || substr({TENANT} || {DIGEST}, 2) ELSE {TENANT} || {DIGEST} END AS b FROM objects)", "objects")
def block_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths of block files; every fifth name has a digit that is none."""
    b = I.block_id(F.col("ns"), F.col("object_key"))
    b = V.objects(spark, d).select("doc_id", F.when(F.col("doc_id") % 5 == 4, F.concat(F.lit("X"), F.substring(b, 2, 47))).otherwise(b).alias("b"))
    return b.select("doc_id", I.block_path(F.col("b")).alias("path"), I.valid_block_id(F.col("b")).alias("valid"))


_NS_SQL = f"""unhex('44464b564e530002') || {_framed("'t' || tenant")} || {_framed('ns')} || {_framed("'r1'")} || {_le('1', 2)} || {_framed("'kv'")} || {_framed("'bf16'")} || {_le('doc_id + 1', 8)} || {_le('64', 4)} || {_le('doc_id % 4', 4)} || {_le('0', 4)} || {_le('32', 4)} || {_le('8', 4)} || {_le('doc_id % 8', 4)} || {_le('1', 4)} || {_le('-1', 4)} || {_le('2', 4)} || {_le('0', 4)}"""


def _namespace(df: DataFrame) -> DataFrame:
    n, one = F.col("doc_id"), F.lit
    fp = F.lower(F.lpad(F.hex(n + 1), 16, "0"))
    return df.withColumn("nsb", I.namespace_bytes(F.concat(one("t"), "tenant"), F.col("ns"), one("r1"), one(1), one("kv"), one("bf16"), fp, one(64), n % 4, one(0), one(32), (one(8), n % 8), (one(1), one(-1)), (one(2), one(0))))


@Q.add("b3_namespace_bytes", f"SELECT doc_id, lower(to_hex({_NS_SQL})) AS namespace_hex FROM objects", "objects")
def namespace_bytes(spark: SparkSession, d: str) -> DataFrame:
    return _namespace(V.objects(spark, d)).select("doc_id", F.lower(F.hex("nsb")).alias("namespace_hex"))


@Q.add("b4_object_bytes", f"SELECT doc_id, lower(to_hex(unhex('44464b564f424a32') || {_le('octet_length(nsb)', 4)} || nsb || {_framed('object_key')} || {_framed("'page'")} || {_le('doc_id % 3', 4)} || {_le('3', 4)})) AS object_hex FROM (SELECT *, {_NS_SQL} AS nsb FROM objects)", "objects")
def object_bytes(spark: SparkSession, d: str) -> DataFrame:
    out = I.object_bytes(F.col("nsb"), F.col("object_key"), F.lit("page"), F.col("doc_id") % 3, F.lit(3))
    return _namespace(V.objects(spark, d)).select("doc_id", F.lower(F.hex(out)).alias("object_hex"))


@Q.add("b21_range_clamp", "SELECT doc_id, off, len, CASE WHEN off > value_len THEN NULL WHEN len = 0 THEN value_len - off ELSE least(len, value_len - off) END AS n FROM (SELECT doc_id, value_len, doc_id * 37 % 3000 AS off, doc_id * 11 % 500 AS len FROM objects)", "objects")
def range_clamp(spark: SparkSession, d: str) -> DataFrame:
    df = V.objects(spark, d).withColumn("off", F.col("doc_id") * 37 % 3000).withColumn("len", F.col("doc_id") * 11 % 500)
    return df.select("doc_id", "off", "len", I.clamp_range(F.col("value_len"), F.col("off"), F.col("len")).alias("n"))


@Q.add("b22_human_bytes", "SELECT doc_id, CASE WHEN n < 1024 THEN format('{:.1f}B', n) WHEN n < 1048576 THEN format('{:.1f}K', n / 1024) WHEN n < 1073741824 THEN format('{:.1f}M', n / 1048576) WHEN n < 1099511627776 THEN format('{:.1f}G', n / 1073741824) ELSE format('{:.1f}T', n / 1099511627776) END AS human FROM (SELECT doc_id, (value_len * value_len * 4)::DOUBLE AS n FROM objects)", "objects")
def human(spark: SparkSession, d: str) -> DataFrame:
    return V.objects(spark, d).select("doc_id", I.human_bytes((F.col("value_len") * F.col("value_len") * 4).cast("double")).alias("human"))


@Q.add("b14_ring_hash", "SELECT doc_id, ('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::BIGINT AS h FROM (SELECT doc_id, md5(object_key) AS m FROM objects)", "objects")
def ring_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.objects(spark, d).select("doc_id", I.ring_hash(F.col("object_key")).alias("h"))


@Q.add("b26_key_label", "SELECT doc_id, 'len=' || strlen(object_key) || ' sha256=' || substr(sha256(object_key), 1, 16) AS label FROM objects", "objects")
def key_label(spark: SparkSession, d: str) -> DataFrame:
    return V.objects(spark, d).select("doc_id", F.concat(F.lit("len="), F.octet_length("object_key"), F.lit(" sha256="), F.substring(F.sha2("object_key", 256), 1, 16)).alias("label"))


@Q.add("c1_valid_names", "SELECT s_suppkey, regexp_matches(s_name, '^[A-Za-z0-9._-]{1,128}$') AS plain, regexp_matches(replace(s_name, '#', '/'), '^[A-Za-z0-9._-]{1,128}$') AS slashed FROM supplier")
def valid_names(spark: SparkSession, d: str) -> DataFrame:
    return V.table(spark, d, "supplier").select("s_suppkey", I.valid_name(F.col("s_name")).alias("plain"), I.valid_name(F.replace(F.col("s_name"), F.lit("#"), F.lit("/"))).alias("slashed"))


V.SQL["ring_points"] = """SELECT point, arg_max(id, num * 1000000 + k * 10 + w) AS node FROM (
  SELECT id, num, k, w, ('0x' || substr(m, 8 * w + 7, 2) || substr(m, 8 * w + 5, 2) || substr(m, 8 * w + 3, 2) || substr(m, 8 * w + 1, 2))::BIGINT AS point
  FROM (SELECT id, num, k, md5(id || '-' || k) AS m FROM (SELECT id, num, unnest(range(0, 40 * weight)) AS k FROM members)), (SELECT unnest([0, 1, 2, 3]) AS w)) GROUP BY point"""
V.SQL["keyed"] = "SELECT *, ('0x' || substr(md5(object_key), 7, 2) || substr(md5(object_key), 5, 2) || substr(md5(object_key), 3, 2) || substr(md5(object_key), 1, 2))::BIGINT AS h FROM objects"


def fleet_ring(spark: SparkSession, d: str) -> DataFrame:
    return R.ring_points(V.members(spark, d).select(F.col("id").alias("node"), "weight", F.col("num").alias("nth")))


@Q.add("d4_ring_route_share", "SELECT node, count(*) AS n_keys, sum(value_len)::BIGINT AS bytes FROM (SELECT k.value_len, coalesce(p.node, (SELECT arg_min(node, point) FROM ring_points)) AS node FROM keyed k ASOF LEFT JOIN ring_points p ON k.h <= p.point) GROUP BY node", "members", "ring_points", "objects", "keyed")
def route_share(spark: SparkSession, d: str) -> DataFrame:
    routed = R.route(V.objects(spark, d).select("object_key", "value_len"), F.col("object_key"), R.ring_intervals(fleet_ring(spark, d)))
    return routed.groupBy("node").agg(F.count("*").alias("n_keys"), F.sum("value_len").alias("bytes"))


@Q.add("e5_ring_share", "SELECT node, count(*) AS points, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM ring_points GROUP BY node", "members", "ring_points")
def ring_share(spark: SparkSession, d: str) -> DataFrame:
    counts = fleet_ring(spark, d).groupBy("node").agg(F.count("*").alias("points"))
    total = counts.agg(F.sum("points").alias("t"))
    return counts.withColumn("share", F.round(100.0 * F.col("points") / total.scalar(), 6))


@Q.add("d4_route_moves", "SELECT count(*) AS n_keys, count_if(a <> b) AS moved FROM (SELECT k.object_key, coalesce(p.node, (SELECT arg_min(node, point) FROM ring_points)) AS a, coalesce(s.node, (SELECT arg_min(node, point) FROM ring_points WHERE node <> 'n3')) AS b FROM keyed k ASOF LEFT JOIN ring_points p ON k.h <= p.point ASOF LEFT JOIN (SELECT * FROM ring_points WHERE node <> 'n3') s ON k.h <= s.point)", "members", "ring_points", "objects", "keyed")
def route_moves(spark: SparkSession, d: str) -> DataFrame:
    """Keys whose node changes when a node leaves."""
    points = fleet_ring(spark, d)
    keys = V.objects(spark, d).select("object_key")
    a = R.route(keys, F.col("object_key"), R.ring_intervals(points)).withColumnRenamed("node", "a")
    b = R.route(a, F.col("object_key"), R.ring_intervals(points.where("node <> 'n3'"))).withColumnRenamed("node", "b")
    return b.agg(F.count("*").alias("n_keys"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
