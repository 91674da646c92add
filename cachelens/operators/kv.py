"""Keyed blob algebra on tables: write-once put, exact and sized reads, ranges, existence, removal.

Probes keep their rows, order column and duplicates; object tables have one row for each key.
Existence and lookup never read payloads: select the columns first and Parquet prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.functions.identity import clamp_range


def first_writes(puts: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Of several puts of a key the first one; empty values are no puts."""
    others = [c for c in puts.columns if c != key]
    first = puts.where((F.col("len") > 0) & F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), seq).alias("_first"))
    return first.select(key, "_first.*")


def put(store: DataFrame, puts: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """Rows to append: write-once, so present keys keep their value and duplicates in the batch do nothing."""
    return first_writes(puts, key, seq).join(store.select(key), key, "left_anti")


def put_status(puts: DataFrame) -> Column:
    """Status of each put: duplicates are ok, empty values or keys are invalid."""
    return F.when(F.col("key").isNull() | (F.col("len") <= 0), "invalid").otherwise("ok")


def lookup(probe: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """probe with value_len of each key, null where it is absent."""
    return probe.join(store.select(key, "value_len"), key, "left")


def hit_exact(expected: Column) -> Column:
    return F.coalesce(F.col("value_len") == expected, F.lit(False))


def hit_sized(capacity: Column) -> Column:
    return F.coalesce(F.col("value_len") <= capacity, F.lit(False))


def read_range(value: Column, size: Column, offset: Column, length: Column) -> Column:
    """Bytes [offset, offset + length) of a value, clamped; null beyond its end."""
    n = clamp_range(size, offset, length)
    return F.when(n.isNotNull(), F.substring(value.cast("binary"), (offset + 1).cast("int"), n.cast("int")))


def split_by_capacity(value: Column, caps: Column) -> Column:
    """In-order segments of a value over the capacities of its buffers."""
    data = value.cast("binary")
    starts = F.transform(caps, lambda c, i: F.aggregate(F.slice(caps, 1, i), F.lit(0), lambda a, x: (a + x).cast("int")))
    return F.transform(F.arrays_zip(starts.alias("at"), caps.alias("cap")), lambda s: F.substring(data, s["at"] + 1, s["cap"]))


def remove(store: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")
