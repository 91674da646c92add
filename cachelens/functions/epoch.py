"""Content hash of a membership view: the same for any order of its members."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Offset basis and prime of the 64-bit FNV-1a hash.
BASIS, PRIME = 1469598103934665603, 1099511628211


def fnv1a(data: bytes) -> int:
    h = BASIS
    for b in data:
        h = ((h ^ b) * PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def member_bytes(mid: str, ip: str, port: int, weight: int) -> bytes:
    i, p = mid.encode(), ip.encode()
    return struct.pack("<I", len(i)) + i + struct.pack("<I", len(p)) + p + struct.pack("<II", port, weight)


def view_epochs(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, epoch (16 hex digits) of members (id, ip, port, weight).

    A view is one group's members, sorted in one task as every reader of a view must.
    """

    def epoch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        data = b"".join(member_bytes(*r) for r in pdf[["id", "ip", "port", "weight"]].itertuples(index=False, name=None))
        return pdf[keys].head(1).assign(epoch=f"{fnv1a(data):016x}")

    schema = ", ".join(f"{k} {members.schema[k].dataType.simpleString()}" for k in keys) + ", epoch string"
    return members.select(*keys, "id", "ip", F.col("port").cast("long").alias("port"), F.col("weight").cast("long").alias("weight")).groupBy(*keys).applyInPandas(epoch, schema)
