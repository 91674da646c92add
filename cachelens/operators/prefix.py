"""Prefix-hit queries over ordered chunks of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(df: DataFrame, keys: list[str], pos: str = "pos", present: str = "present") -> DataFrame:
    """keys, n, hit: length of the run of present chunks from position 0 (one aggregation, no sort)."""
    gap = F.min(F.when(~F.col(present), F.col(pos)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(gap, F.count("*")).alias("hit"))


def trailing_prefix(df: DataFrame, keys: list[str], k: int, pos: str = "pos", anchor: str = "kv", other: str = "present") -> DataFrame:
    """keys, hit: the largest prefix within the anchor's whose last k chunks are present in the other pool."""
    w = Window.partitionBy(*keys).orderBy(pos)
    rows = df.withColumn("_kv", F.min(F.col(anchor).cast("int")).over(w)).withColumn("_tail", F.min(F.col(other).cast("int")).over(w.rowsBetween(-(k - 1), 0)))
    good = F.when((F.col("_kv") == 1) & (F.col("_tail") == 1), F.col(pos) + 1)
    return rows.groupBy(*keys).agg(F.coalesce(F.max(good), F.lit(0)).cast("long").alias("hit"))


def shard_of(index: Column, total: Column, most: int, least: int) -> Column:
    """Contiguous shard of an item: at most `most` shards, of `least` items or more where that many fit."""
    shards = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(total / least)))
    return F.floor(index / F.ceil(total / shards))


def token_chunks(df: DataFrame, tokens: str, size: int) -> DataFrame:
    """A row (chunk, token_start, token_end) for each chunk of `size` tokens, the last one partial."""
    n = F.ceil(F.col(tokens) / size)
    out = df.where(F.col(tokens) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return out.withColumn("token_start", (F.col("chunk") * size).cast("long")).withColumn("token_end", F.least(F.col("token_start") + size, F.col(tokens)).cast("long"))
