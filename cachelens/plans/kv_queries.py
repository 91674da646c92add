"""Keyed blob algebra over objects, probes and puts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.operators import kv
from cachelens.plans import views as V
from cachelens.plans.book import Book

Q = Book()

# Probes: each event asks for a document; half the ids asked for are beyond the stored ones.
V.SQL["probes"] = "SELECT event_id AS pos, (event_id * 7 % (SELECT 2 * count(*) FROM documents))::VARCHAR AS key, 500 + event_id % 3000 AS cap, event_id % 700 AS off, event_id % 90 AS len FROM events"
V.SQL["store"] = "SELECT object_key AS key, value, value_len FROM objects"
# Puts: line items write blocks; sequence numbers order them.
V.SQL["puts"] = "SELECT hash AS key, size + 4096 * pos AS len, req * 100 + pos AS seq, tenant FROM chunks"


def probes(spark: SparkSession, d: str) -> DataFrame:
    e, wide = F.col("event_id"), 2 * V.table(spark, d, "documents").agg(F.count("*").alias("n")).scalar()
    return V.table(spark, d, "events").select(e.alias("pos"), (e * 7 % wide).cast("string").alias("key"), (500 + e % 3000).alias("cap"), (e % 700).alias("off"), (e % 90).alias("len"))


def store(spark: SparkSession, d: str) -> DataFrame:
    return V.objects(spark, d).select(F.col("object_key").alias("key"), "value", "value_len")


def puts(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).select(F.col("hash").alias("key"), (F.col("size") + 4096 * F.col("pos")).alias("len"), (F.col("req") * 100 + F.col("pos")).alias("seq"), "tenant")


@Q.add("i1_put_write_once", "SELECT key, arg_min(len, seq) AS len, min(seq) AS seq FROM puts WHERE len > 0 AND key NOT IN (SELECT key FROM puts WHERE tenant = 0) GROUP BY key", "chunks", "puts")
def put_write_once(spark: SparkSession, d: str) -> DataFrame:
    """New rows of a batch of puts against a store that already holds tenant 0's keys."""
    p = puts(spark, d)
    held = p.where("tenant = 0").select("key").distinct()
    return kv.put(held, p).select("key", "len", "seq")


@Q.add("i4_get_exact", "SELECT pos, key, coalesce(value_len = CASE WHEN pos % 3 = 0 THEN value_len ELSE cap END, false) AS hit FROM probes LEFT JOIN store USING (key)", "objects", "probes", "store")
def get_exact(spark: SparkSession, d: str) -> DataFrame:
    """Every third probe asks with the length that is stored, the others with a length of their own."""
    asked = F.when(F.col("pos") % 3 == 0, F.col("value_len")).otherwise(F.col("cap"))
    return kv.lookup(probes(spark, d), store(spark, d)).select("pos", "key", kv.hit_exact(asked).alias("hit"))


@Q.add("i5_get_auto", "SELECT pos, key, coalesce(value_len <= cap, false) AS hit, CASE WHEN value_len <= cap THEN value_len END AS got FROM probes LEFT JOIN store USING (key)", "objects", "probes", "store")
def get_auto(spark: SparkSession, d: str) -> DataFrame:
    hit = kv.hit_sized(F.col("cap"))
    return kv.lookup(probes(spark, d), store(spark, d)).select("pos", "key", hit.alias("hit"), F.when(hit, F.col("value_len")).alias("got"))


@Q.add("i7_get_scatter", "SELECT key, md5(substr(hex(encode(value)), 1, 200)) AS a, md5(substr(hex(encode(value)), 201, 100)) AS b, least(greatest(value_len - 150, 0), 1000) AS c_len FROM store", "objects", "store")
def get_scatter(spark: SparkSession, d: str) -> DataFrame:
    """Values split over buffers of 100, 50 and 1000 bytes."""
    s = store(spark, d).select("key", kv.split_by_capacity(F.col("value"), F.array(F.lit(100), F.lit(50), F.lit(1000))).alias("s"))
    return s.select("key", F.md5(F.hex(F.col("s")[0]).cast("binary")).alias("a"), F.md5(F.hex(F.col("s")[1]).cast("binary")).alias("b"), F.octet_length(F.col("s")[2]).cast("long").alias("c_len"))


@Q.add("i8_read_range", "SELECT pos, key, CASE WHEN off > value_len THEN NULL WHEN len = 0 THEN value_len - off ELSE least(len, value_len - off) END AS n, CASE WHEN off <= value_len AND len > 0 THEN md5(substr(hex(encode(value)), 2 * off + 1, 2 * len)) END AS digest FROM probes JOIN store USING (key)", "objects", "probes", "store")
def read_range(spark: SparkSession, d: str) -> DataFrame:
    j = probes(spark, d).join(store(spark, d), "key")
    r = kv.read_range(F.col("value"), F.col("value_len"), F.col("off"), F.col("len"))
    return j.select("pos", "key", F.octet_length(r).cast("long").alias("n"), F.when(F.col("len") > 0, F.md5(F.hex(r).cast("binary"))).alias("digest"))


@Q.add("i9_lookup", "SELECT pos, key, value_len FROM probes LEFT JOIN store USING (key)", "objects", "probes", "store")
def lookup(spark: SparkSession, d: str) -> DataFrame:
    return kv.lookup(probes(spark, d), store(spark, d)).select("pos", "key", "value_len")


@Q.add("i10_exist", "SELECT pos, key, key IN (SELECT key FROM store) AS present FROM probes", "objects", "probes", "store")
def exist(spark: SparkSession, d: str) -> DataFrame:
    return kv.lookup(probes(spark, d), store(spark, d)).select("pos", "key", F.col("value_len").isNotNull().alias("present"))


@Q.add("i11_remove", "SELECT key, value_len FROM store WHERE key NOT IN (SELECT key FROM probes WHERE pos % 29 = 0)", "objects", "probes", "store")
def remove(spark: SparkSession, d: str) -> DataFrame:
    return kv.remove(store(spark, d).select("key", "value_len"), probes(spark, d).where("pos % 29 = 0"))


@Q.add("i11_remove_status", "SELECT key, count(*) AS asked, CASE WHEN key IN (SELECT key FROM store) THEN 'ok' ELSE 'not_found' END AS status FROM probes GROUP BY key", "objects", "probes", "store")
def remove_status(spark: SparkSession, d: str) -> DataFrame:
    asked = probes(spark, d).groupBy("key").agg(F.count("*").alias("asked"))
    return kv.lookup(asked, store(spark, d)).select("key", "asked", F.when(F.col("value_len").isNotNull(), "ok").otherwise("not_found").alias("status"))


@Q.add("d3_backup_gate", "SELECT part, key IN (SELECT hash FROM chunks WHERE req % 3 = 0) AS already, n FROM (SELECT hash AS key, hash AS part, count(*) AS n FROM chunks WHERE req % 3 <> 0 GROUP BY hash)", "chunks")
def backup_gate(spark: SparkSession, d: str) -> DataFrame:
    """Which keys of a backup (two requests in three) are already there (they count as stored) and which are to be written."""
    c = V.chunks(spark, d)
    held = c.where("req % 3 = 0").select("hash").distinct().withColumn("already", F.lit(True))
    return c.where("req % 3 <> 0").groupBy("hash").agg(F.count("*").alias("n")).join(held, "hash", "left").select(F.col("hash").alias("part"), F.coalesce("already", F.lit(False)).alias("already"), "n")


@Q.add("d5_two_tier", "SELECT tier, count(*) AS n, sum(len)::BIGINT AS bytes FROM (SELECT p.key, p.len, CASE WHEN p.key IN (SELECT key FROM puts WHERE tenant = 2) THEN 'ram' WHEN p.key IN (SELECT key FROM puts WHERE tenant = 3) THEN 'disk' ELSE 'miss' END AS tier FROM puts p) GROUP BY tier", "chunks", "puts")
def two_tier(spark: SparkSession, d: str) -> DataFrame:
    """Reads answered by the first tier that has the key."""
    p = puts(spark, d)
    tier = lambda t, name: p.where(F.col("tenant") == t).select("key").distinct().withColumn(name, F.lit(True))
    j = p.join(tier(2, "ram"), "key", "left").join(tier(3, "disk"), "key", "left")
    t = F.when(F.col("ram"), "ram").when(F.col("disk"), "disk").otherwise("miss")
    return j.groupBy(t.alias("tier")).agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))


@Q.add("d6_quota_lookup", "SELECT tenant, sum(len)::BIGINT AS asked, CASE tenant WHEN 1 THEN 5000000 WHEN 2 THEN 0 ELSE 9000000 END AS quota, CASE tenant WHEN 2 THEN true ELSE sum(len) <= CASE tenant WHEN 1 THEN 5000000 ELSE 9000000 END END AS fits FROM puts GROUP BY tenant", "chunks", "puts")
def quota_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A tenant's limit, else the default; 0 is unlimited."""
    limits = spark.createDataFrame([(1, 5000000), (2, 0)], "tenant long, own long")
    asked = puts(spark, d).groupBy("tenant").agg(F.sum("len").alias("asked"))
    quota = F.coalesce("own", F.lit(9000000)).cast("int")
    return asked.join(F.broadcast(limits), "tenant", "left").select("tenant", "asked", quota.alias("quota"), ((quota == 0) | (F.col("asked") <= quota)).alias("fits"))


@Q.add("e15_tenant_bytes", "SELECT tenant, count(*) AS objects, sum(len)::BIGINT AS bytes FROM (SELECT key, arg_min(len, seq) AS len, arg_min(tenant, seq) AS tenant FROM puts WHERE len > 0 GROUP BY key) GROUP BY tenant", "chunks", "puts")
def tenant_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Committed bytes of each tenant after write-once puts."""
    return kv.first_writes(puts(spark, d)).groupBy("tenant").agg(F.count("*").alias("objects"), F.sum("len").alias("bytes"))


@Q.add("e23_first_store_bytes", "SELECT tenant, sum(CASE WHEN seq = first THEN len ELSE 0 END)::BIGINT AS bytes, count(*) AS puts FROM (SELECT *, min(seq) OVER (PARTITION BY tenant, key) AS first FROM puts) GROUP BY tenant", "chunks", "puts")
def first_store_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Accounting in which a repeated store of a tenant adds nothing."""
    per = puts(spark, d).groupBy("tenant", "key").agg(F.min_by("len", "seq").alias("len"), F.count("*").alias("n"))
    return per.groupBy("tenant").agg(F.sum("len").alias("bytes"), F.sum("n").alias("puts"))
