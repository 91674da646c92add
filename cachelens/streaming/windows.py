"""Windowed rates and sessions on streams.

Sources are anything that readStream reads; `drain` runs a query over what is there now and returns
its sink as a table, which is how batch replays of a stream and tests use it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet file or folder, with its schema."""
    # as a pattern, so that the path may be a single file
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared place of spark.checkpoint.dir; one of our own only where that is unset and all run on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="stream-")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"


def drain(stream: DataFrame) -> DataFrame:
    """Run an append-mode stream over all that is available and read its sink."""
    spark, folder = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_rates(ops: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Requests, keys and hits by event-time window and op; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = ops.withWatermark("ts", late).groupBy(window.alias("w"), "op").agg(F.count("*").alias("requests"), F.sum("keys").alias("keys"), F.sum("hits").alias("hits"))
    return out.select(F.col("w.start").alias("start"), "op", "requests", "keys", "hits")


def sessions(ops: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a connector: runs of operations without a gap."""
    out = ops.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "connector").agg(F.count("*").alias("requests"))
    return out.select("connector", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests")
