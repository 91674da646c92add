"""Text sources of the fleet: metric exposition, quota and member files, access logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.functions.identity import escape_label


def render_samples(df: DataFrame, name: Column, labels: dict[str, Column], value: Column) -> DataFrame:
    """df with `line`: name{label="text",...} value."""
    pairs = [F.concat(F.lit(f'{k}="'), escape_label(v), F.lit('"')) for k, v in labels.items()]
    return df.withColumn("line", F.concat(name, F.lit("{"), F.concat_ws(",", *pairs), F.lit("} "), value.cast("string")))


def parse_samples(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with name, labels (map) and value of metric exposition text; comments and other lines go."""
    line = F.trim(F.col(column))
    body = F.regexp_extract(line, r"^[A-Za-z_:][A-Za-z0-9_:]*\{(.*)\} ", 1)
    keys = F.regexp_extract_all(body, F.lit(r'([A-Za-z_][A-Za-z0-9_]*)="(?:[^"\\]|\\.)*"'), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(r'[A-Za-z_][A-Za-z0-9_]*="((?:[^"\\]|\\.)*)"'), F.lit(1))
    value = F.regexp_extract(line, r" (\S+)$", 1).try_cast("double")
    out = lines.where(line.rlike(r"^[A-Za-z_:]")).withColumn("name", F.regexp_extract(line, r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1))
    return out.withColumn("labels", F.map_from_arrays(keys, texts)).withColumn("value", value).where("value is not null")


def parse_quotas(lines: DataFrame, column: str = "line") -> DataFrame:
    """(tenant_hash, limit_bytes, bad, n): `<16 hex> <unsigned>` lines, n of each tenant; comments and blank lines go.

    Other lines are bad, and so is a tenant that occurs more than once: a file with any bad row is not to be used.
    """
    text = F.trim(F.regexp_replace(F.col(column), "#.*$", ""))
    good = text.rlike(r"^[0-9a-f]{16}\s+[0-9]{1,20}$")
    rows = lines.where(text != "").select(F.when(good, F.substring(text, 1, 16)).alias("tenant_hash"), F.when(good, F.regexp_extract(text, r"(\d+)$", 1).try_cast("decimal(20,0)")).alias("limit_bytes"))
    known = rows.where("tenant_hash is not null").groupBy("tenant_hash").agg(F.min("limit_bytes").alias("limit_bytes"), F.count("*").alias("n")).withColumn("bad", F.col("n") > 1)
    return known.unionByName(rows.where("tenant_hash is null").groupBy("tenant_hash").agg(F.min("limit_bytes").alias("limit_bytes"), F.count("*").alias("n")).withColumn("bad", F.lit(True)))


def parse_members(text: DataFrame, column: str) -> DataFrame:
    """text with a row (name, ip, port) for each name=ip:port; tokens without = go."""
    token = F.explode(F.split(F.col(column), ",")).alias("t")
    rows = text.select("*", token).where(F.instr("t", "=") > 0)
    address = F.substring_index("t", "=", -1)
    return rows.withColumn("name", F.substring_index("t", "=", 1)).withColumn("ip", F.substring_index(address, ":", 1)).withColumn("port", F.substring_index(address, ":", -1).try_cast("long")).drop("t")


def parse_access_log(lines: DataFrame, column: str = "line") -> DataFrame:
    """lines with at, op, args, result and seconds of `<ts> <op>(<args>) : <result> <seconds>`."""
    pattern = r"^(\S+ \S+) (\w+)\((.*)\) : (.*) <([0-9.]+)>$"
    part = lambda i: F.regexp_extract(F.col(column), pattern, i)
    return lines.where(F.col(column).rlike(pattern)).withColumn("at", part(1).try_cast("timestamp")).withColumn("op", part(2)).withColumn("args", part(3)).withColumn("result", part(4)).withColumn("seconds", part(5).try_cast("double"))


def prefix_successor(prefix: str) -> str:
    """The least string above all that start with a prefix: its last character that has a successor, raised."""
    for i in range(len(prefix) - 1, -1, -1):
        if ord(prefix[i]) < 0x10FFFF:
            return prefix[:i] + chr(ord(prefix[i]) + 1)
    return "\U0010ffff"
