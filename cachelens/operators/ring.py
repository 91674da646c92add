"""Weighted consistent-hash placement: the ring as a table, routing as a circular as-of join.

Each ring interval (prev, point] is laid over buckets of the hash space, so routing is an equi-join
on the bucket with a residual range test: no nested loop, and the ring side is broadcast only after
its rows are counted.  There are more buckets the more points a ring has, so a key meets a few intervals
at any size; points are made, ranked and joined in tasks of about TASK_POINTS, however few files or
shuffle partitions there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cachelens.functions.identity import ring_hash

SPACE = 1 << 32
KEYS_PER_WEIGHT, WORDS, BUCKET_BITS = 40, 4, 20  # 160 points for each unit of weight
BROADCAST_POINTS = 500_000
TASK_POINTS = 250_000


def _tasks(points: int) -> int:
    return 1 + points // TASK_POINTS


def bucket_bits(points: int) -> int:
    """Low bits that a bucket spans: a bucket of a large ring holds 4 to 8 points."""
    return min(BUCKET_BITS, 35 - points.bit_length())


def ring_points(nodes: DataFrame) -> DataFrame:
    """(node, point) of nodes (node, weight, nth): weights clamp to 1..1024; of equal points the later node's stays."""
    weight = F.least(F.greatest(F.col("weight").cast("int"), F.lit(1)), F.lit(1024))
    tasks = _tasks((nodes.agg(F.sum(weight)).first()[0] or 0) * KEYS_PER_WEIGHT * WORDS)
    nodes = nodes.repartition(tasks) if tasks > 1 else nodes
    keyed = nodes.select("node", "nth", F.explode(F.sequence(F.lit(0), weight * KEYS_PER_WEIGHT - 1)).alias("k"))
    label = F.concat_ws("-", "node", "k")
    points = keyed.select("node", "nth", "k", F.explode(F.array(*(F.struct(F.lit(i).alias("w"), ring_hash(label, i).alias("point")) for i in range(WORDS)))).alias("p"))
    points = points.repartition(tasks, "p.point") if tasks > 1 else points  # else the shuffle of the aggregate
    return points.groupBy("p.point").agg(F.max_by("node", F.struct("nth", "k", "p.w")).alias("node"))


def ring_intervals(points: DataFrame) -> DataFrame:
    """(node, lo, hi): the hashes lo < h <= hi that each point owns; the first point also owns the rest of the space."""
    points = points.withColumn("cell", F.shiftright("point", BUCKET_BITS)).persist()
    tasks = _tasks(points.count())
    # the point before: inside a cell of the hash space by a window, at a cell's start the last one of the cell before
    cells = points.groupBy("cell").agg(F.max("point").alias("end"))
    before = cells.select("cell", F.lag("end", 1, -1).over(Window.orderBy("cell")).alias("start"))  # at most 2**(32 - BUCKET_BITS) rows
    lo = F.lag("point").over(Window.partitionBy("cell").orderBy("point"))
    ranked = points.repartition(tasks, "cell") if tasks > 1 else points
    rows = ranked.withColumn("lo", lo).join(F.broadcast(before), "cell").select("node", F.col("point").alias("hi"), F.coalesce("lo", "start").alias("lo"))
    last = points.agg(F.max("point").alias("lo"), F.min_by("node", "point").alias("node")).where("lo is not null")
    return rows.unionByName(last.select("node", F.lit(SPACE - 1).cast("long").alias("hi"), "lo")).where("lo < hi")


def route(df: DataFrame, key: Column, intervals: DataFrame) -> DataFrame:
    """df with the node that each key is placed on (null on an empty ring)."""
    n = intervals.count()
    bits = bucket_bits(n)
    spread = intervals.withColumn("bucket", F.explode(F.sequence(F.shiftright(F.col("lo") + 1, bits), F.shiftright("hi", bits))))
    keyed = df.withColumn("_h", ring_hash(key)).withColumn("_b", F.shiftright("_h", bits))
    if n <= BROADCAST_POINTS:
        spread = F.broadcast(spread)
    elif _tasks(n) > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):  # else AQE may split the join
        spread, keyed = spread.repartition(_tasks(n), "bucket"), keyed.repartition(_tasks(n), "_b")
    hit = (F.col("_b") == F.col("bucket")) & (F.col("_h") > F.col("lo")) & (F.col("_h") <= F.col("hi"))
    return keyed.join(spread, hit, "left").drop("_h", "_b", "bucket", "lo", "hi")
