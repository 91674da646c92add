"""Prefix-hit queries over request chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cachelens.operators import prefix as P
from cachelens.plans import views as V
from cachelens.plans.book import Book

Q = Book()


@Q.add("f1_longest_prefix", "SELECT req, count(*) AS n, coalesce(min(pos) FILTER (NOT present), count(*)) AS hit FROM chunks GROUP BY req", "chunks")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return P.longest_prefix(V.chunks(spark, d), ["req"])


@Q.add("f2_trailing_policy", """SELECT req, coalesce(max(pos + 1) FILTER (kv = 1 AND tail = 1), 0) AS hit FROM (SELECT req, pos,
  min((tenant <> 4)::INT) OVER (PARTITION BY req ORDER BY pos) AS kv, min(present::INT) OVER (PARTITION BY req ORDER BY pos ROWS 1 PRECEDING) AS tail FROM chunks) GROUP BY req""", "chunks")
def trailing(spark: SparkSession, d: str) -> DataFrame:
    return P.trailing_prefix(V.chunks(spark, d).withColumn("kv", F.col("tenant") != 4), ["req"], 2)


@Q.add("f3_all_pools", "SELECT req, min(hit) AS hit FROM (SELECT req, coalesce(min(pos) FILTER (NOT present), count(*)) AS hit FROM chunks GROUP BY req UNION ALL SELECT req, coalesce(min(pos) FILTER (tenant = 4), count(*)) FROM chunks GROUP BY req) GROUP BY req", "chunks")
def all_pools(spark: SparkSession, d: str) -> DataFrame:
    """Least prefix over two pools, in one aggregation."""
    gap = lambda c: F.coalesce(F.min(F.when(~c, F.col("pos"))), F.count("*"))
    return V.chunks(spark, d).groupBy("req").agg(F.least(gap(F.col("present")), gap(F.col("tenant") != 4)).alias("hit"))


@Q.add("f5_token_chunks", "SELECT doc_id, c AS chunk, c * 256 AS token_start, least((c + 1) * 256, value_len) AS token_end FROM (SELECT doc_id, value_len, unnest(range(0, (value_len + 255) // 256)) AS c FROM objects)", "objects")
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return P.token_chunks(V.objects(spark, d).select("doc_id", "value_len"), "value_len", 256).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "token_start", "token_end")


@Q.add("f6_scatter_groups", "SELECT req, pos // 3 AS grp, count(*) AS segments, sum(size)::BIGINT AS bytes, string_agg(hash, ',' ORDER BY pos) AS hashes FROM chunks GROUP BY req, pos // 3", "chunks")
def scatter_groups(spark: SparkSession, d: str) -> DataFrame:
    g = V.chunks(spark, d).groupBy("req", F.floor(F.col("pos") / 3).alias("grp")).agg(F.count("*").alias("segments"), F.sum("size").alias("bytes"), F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("h"))
    return g.select("req", "grp", "segments", "bytes", F.array_join(F.transform("h", lambda x: x["hash"]), ",").alias("hashes"))


@Q.add("f7_shards", "SELECT tenant, shard, count(*) AS n FROM (SELECT tenant, floor(i / ceil(n / least(8, greatest(1, ceil(n / 16))))) AS shard FROM (SELECT tenant, row_number() OVER (PARTITION BY tenant, req % 500 ORDER BY req, pos) - 1 AS i, count(*) OVER (PARTITION BY tenant, req % 500) AS n FROM chunks)) GROUP BY tenant, shard", "chunks")
def shards(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("tenant", "slice")
    rows = V.chunks(spark, d).withColumn("slice", F.col("req") % 500).withColumn("i", F.row_number().over(w.orderBy("req", "pos")) - 1).withColumn("n", F.count("*").over(w))
    return rows.groupBy("tenant", P.shard_of(F.col("i"), F.col("n"), 8, 16).cast("double").alias("shard")).agg(F.count("*").alias("n"))


@Q.add("f16_full_hit_adjust", "SELECT req, n, hit, CASE WHEN hit = n THEN greatest(n - 1, 0) ELSE hit END AS usable, greatest(CASE WHEN hit = n THEN greatest(n - 1, 0) ELSE hit END - n // 2, 0) AS need FROM (SELECT req, count(*) AS n, coalesce(min(pos) FILTER (NOT present), count(*)) AS hit FROM chunks GROUP BY req)", "chunks")
def full_hit_adjust(spark: SparkSession, d: str) -> DataFrame:
    """A full hit leaves its last block to compute; need is what is found beyond the computed half."""
    usable = F.when(F.col("hit") == F.col("n"), F.greatest(F.col("n") - 1, F.lit(0))).otherwise(F.col("hit"))
    return P.longest_prefix(V.chunks(spark, d), ["req"]).select("req", "n", "hit", usable.alias("usable"), F.greatest(usable - F.floor(F.col("n") / 2), F.lit(0)).alias("need"))


@Q.add("f17_rotation", "SELECT req, pos, (pos + req) % n AS slot FROM (SELECT req, pos, count(*) OVER (PARTITION BY req) AS n FROM chunks)", "chunks")
def rotation(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("req"))
    return V.chunks(spark, d).select("req", "pos", ((F.col("pos") + F.col("req")) % n).alias("slot"))


@Q.add("f18_event_chain", "SELECT req, pos, hash, lag(hash) OVER (PARTITION BY req, tenant ORDER BY pos) AS parent FROM chunks WHERE NOT present", "chunks")
def event_chain(spark: SparkSession, d: str) -> DataFrame:
    """Stored-block events over missing chunks; the parent is the previous one of the same group."""
    w = Window.partitionBy("req", "tenant").orderBy("pos")
    return V.chunks(spark, d).where("not present").select("req", "pos", "hash", F.lag("hash").over(w).alias("parent"))


@Q.add("f19_striping", "SELECT req, pos FROM (SELECT req, pos, row_number() OVER (PARTITION BY req ORDER BY pos) - 1 AS i FROM chunks WHERE NOT present) WHERE i % 4 = req % 4", "chunks")
def striping(spark: SparkSession, d: str) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("req").orderBy("pos")) - 1
    return V.chunks(spark, d).where("not present").withColumn("i", i).where("i % 4 = req % 4").select("req", "pos")


@Q.add("e20_all_parts_fold", "SELECT req, pos // 2 AS page, bool_and(present) AS ok FROM chunks GROUP BY req, pos // 2", "chunks")
def all_parts(spark: SparkSession, d: str) -> DataFrame:
    return V.chunks(spark, d).groupBy("req", F.floor(F.col("pos") / 2).alias("page")).agg(F.bool_and("present").alias("ok"))


@Q.add("d10_all_ranks", "SELECT page, count(DISTINCT (rank, part)) AS held, count(DISTINCT (rank, part)) = (SELECT count(DISTINCT (tenant, pos % 2)) FROM chunks) AS whole FROM (SELECT req % 1500 AS page, tenant AS rank, pos % 2 AS part FROM chunks WHERE present) GROUP BY page", "chunks")
def all_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Relational division: pages of which every rank holds every scatter part."""
    c = V.chunks(spark, d).select((F.col("req") % 1500).alias("page"), F.col("tenant").alias("rank"), (F.col("pos") % 2).alias("part"), "present")
    expected = c.agg(F.countDistinct("rank", "part").alias("n")).scalar()
    return c.where("present").groupBy("page").agg(F.countDistinct("rank", "part").alias("held")).withColumn("whole", F.col("held") == expected)


@Q.add("d11_all_groups", "SELECT page, bool_or(tenant = 0) AND bool_or(tenant = 1) AND bool_or(tenant = 2) AS hit FROM (SELECT req % 3000 AS page, tenant FROM chunks WHERE present) GROUP BY page", "chunks")
def all_groups(spark: SparkSession, d: str) -> DataFrame:
    """A page is a hit only if every group of the layer specification (groups 0, 1 and 2) holds it."""
    spec = F.array(*(F.lit(g).cast("long") for g in (0, 1, 2)))
    held = V.chunks(spark, d).where("present").groupBy((F.col("req") % 3000).alias("page")).agg(F.collect_set("tenant").alias("groups"))
    return held.select("page", (F.size(F.array_except(spec, "groups")) == 0).alias("hit"))


@Q.add("i16_save_plan", "SELECT req, count(*) AS chunks, sum(size)::BIGINT AS bytes FROM (SELECT req, pos, size, row_number() OVER (PARTITION BY req ORDER BY pos) - 1 AS i FROM chunks WHERE pos % 4 <> 3) WHERE i % 2 = 0 AND (req, pos) NOT IN (SELECT (req, pos) FROM chunks WHERE present) GROUP BY req", "chunks")
def save_plan(spark: SparkSession, d: str) -> DataFrame:
    """Save pipeline: mask of storable chunks, striping, probe, and what is left to write."""
    c = V.chunks(spark, d)
    i = F.row_number().over(Window.partitionBy("req").orderBy("pos")) - 1
    mine = c.where("pos % 4 <> 3").withColumn("i", i).where("i % 2 = 0")
    return mine.join(c.where("present").select("req", "pos"), ["req", "pos"], "left_anti").groupBy("req").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@Q.add("i17_load_plan", "SELECT req, count(*) AS asked, count_if(present AND size <= 100000) AS loaded, min(pos) FILTER (NOT (present AND size <= 100000)) AS first_failed FROM chunks WHERE pos > 0 GROUP BY req", "chunks")
def load_plan(spark: SparkSession, d: str) -> DataFrame:
    """Load pipeline: a chunk counts when it is there and its value fits; else its block is computed anew."""
    ok = F.col("present") & (F.col("size") <= 100000)
    return V.chunks(spark, d).where("pos > 0").groupBy("req").agg(F.count("*").alias("asked"), F.count_if(ok).alias("loaded"), F.min(F.when(~ok, F.col("pos"))).alias("first_failed"))
