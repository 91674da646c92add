"""Scraped text of nodes and tools: metric pages, ring and client tables, benchmark reports.

A page is rows (its key columns, line_no, line); nothing is gathered beyond one page's facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cachelens.sources.text import parse_samples

INF = float("inf")


def scalar(pages: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, value: the unsigned number that ends the first line of exactly this name; 0 where there is none."""
    line = F.col("line")
    named = line.startswith(name) & F.substring(line, len(name) + 1, 1).isin(" ", "{")
    last = F.regexp_extract(F.substring_index(line, " ", -1), r"^\+?([0-9]+)", 1)
    found = pages.groupBy(*keys).agg(F.min_by(last, F.when(named, F.col("line_no"))).alias("text"))
    return found.select(*keys, F.coalesce(F.col("text").try_cast("decimal(20,0)"), F.lit(0)).cast("decimal(20,0)").alias("value"))


def by_label(pages: DataFrame, keys: list[str], label: str, fields: dict[str, str]) -> DataFrame:
    """keys, the label and a column for each field: the value of its metric name for that label."""
    s = parse_samples(pages).withColumn(label, F.col("labels")[label]).where(F.col(label).isNotNull() & F.col("name").isin(list(fields.values())))
    return s.groupBy(*keys, label).agg(*(F.max_by(F.when(F.col("name") == name, F.col("value")), F.when(F.col("name") == name, F.col("line_no"))).alias(field) for field, name in fields.items()))


def histograms_by_label(pages: DataFrame, keys: list[str], label: str, name: str) -> DataFrame:
    """keys, the label and buckets: sorted (le, cum) of `<name>_bucket` samples."""
    s = buckets(pages, name).withColumn(label, F.col("labels")[label]).where(F.col(label).isNotNull())
    return s.groupBy(*keys, label).agg(F.sort_array(F.collect_list(F.struct("le", F.col("value").alias("cum")))).alias("buckets"))


def plain_counters(pages: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """keys and a column for each name: the value of its sample without labels, null where there is none."""
    line = F.col("line")
    name, value = F.substring_index(line, " ", 1), F.substring_index(line, " ", -1).try_cast("double")
    plain = ~line.contains("{") & ~line.startswith("#")
    return pages.groupBy(*keys).agg(*(F.max_by(value, F.when(plain & (name == n), F.col("line_no"))).alias(n) for n in names))


def buckets(pages: DataFrame, name: str) -> DataFrame:
    """Bucket samples with le as a number."""
    s = parse_samples(pages).where(F.col("name") == f"{name}_bucket").where(F.col("labels")["le"].isNotNull())
    le = F.col("labels")["le"]
    return s.withColumn("le", F.when(le == "+Inf", F.lit(INF)).otherwise(le.try_cast("double")))


def summed_histograms(pages: DataFrame, page: str, name: str, ops: list[str]) -> DataFrame:
    """op, le, total over all pages (column `page`)."""
    s = buckets(pages, name).withColumn("op", F.col("labels")["op"]).where(F.col("op").isin(ops))
    return s.groupBy("op", "le").agg(F.sum("value").alias("total"))


def histogram_faults(pages: DataFrame, page: str, name: str, ops: list[str]) -> DataFrame:
    """(page, op, fault): series that one page has twice, and pages whose op lacks +Inf or a second bucket."""
    s = buckets(pages, name).withColumn("op", F.col("labels")["op"]).where(F.col("op").isin(ops))
    by = s.groupBy(page, "op", "le").agg(F.count("*").alias("n"))
    facts = by.groupBy(page, "op").agg((F.max("n") > 1).alias("twice"), F.count("*").alias("bounds"), F.bool_or(F.col("le") == INF).alias("inf"))
    fault = F.when(F.col("twice"), "duplicate series").when(~F.col("inf"), "no +Inf bucket").when(F.col("bounds") < 2, "one bucket only")
    return facts.select(page, "op", fault.alias("fault")).where("fault is not null")


# Headers and rows of the tools' tables.
RING_HEADER = r"^group=(\S+) members=(\d+) ring_points=(\d+)$"
CLIENTS_HEADER = r"^group=(\S+) clients=(\d+)"
RING_ROW = r"^(\S+)\s+(\S+:\S+)\s+(\d+)\s+(\d+)\s+([0-9.]+)%\s+(\S.*)$"
BENCH_ROW = r"^(PUT|GET)\s+n=(\d+)\s+size=(\d+)\s+threads=(\d+)\s+batch=(\d+)\s+\|\s+([0-9.]+)s\s+([0-9.]+) GB/s\s+([0-9.]+) ops/s\s+call-lat ms p50=([0-9.]+) p99=([0-9.]+) max=([0-9.]+)\s+fails=(\d+)$"


def _part(pattern: str, i: int) -> Column:
    return F.regexp_extract("line", pattern, i)


def _table(pages: DataFrame, page: str, header: str, columns: str) -> DataFrame:
    """Lines that are not blank, with `row` true below the two header lines and the header's count as `expected`."""
    lines = pages.where(F.trim("line") != "").withColumn("line", F.rtrim("line"))
    first = lines.groupBy(page).agg(F.min_by("line", "line_no").alias("head"), F.min("line_no").alias("top"), F.min(F.when(F.col("line").rlike(columns), F.col("line_no"))).alias("titles"))
    expected = F.regexp_extract("head", header, 2).try_cast("long")
    return lines.join(first.withColumn("expected", expected), page).withColumn("row", (F.col("line_no") > F.col("top")) & (F.col("line_no") != F.coalesce("titles", F.lit(-1))))


def ring_tables(pages: DataFrame, page: str) -> DataFrame:
    """(page, members, fault): faults are a bad header, no column titles, a bad row, another count than the header's, an id twice."""
    t = _table(pages, page, RING_HEADER, r"^ID\s+ADDR\s+WEIGHT")
    good = F.col("line").rlike(RING_ROW)
    facts = t.groupBy(page).agg(F.max("expected").alias("expected"), F.max("titles").alias("titles"), F.count_if("row").alias("rows"), F.count_if(F.col("row") & ~good).alias("bad"), F.countDistinct(F.when(F.col("row"), F.substring_index("line", " ", 1))).alias("ids"))
    fault = F.when(F.col("expected").isNull(), "bad header").when(F.col("titles").isNull(), "no column titles").when(F.col("bad") > 0, "bad row").when(F.col("rows") != F.col("expected"), "count differs").when(F.col("ids") != F.col("rows"), "duplicate id")
    return facts.select(page, F.col("rows").alias("members"), fault.alias("fault"))


def client_tables(pages: DataFrame, page: str) -> DataFrame:
    """(page, clients, fault) like ring_tables; a table of no clients needs no column titles."""
    t = _table(pages, page, CLIENTS_HEADER, r"^ID\s+TYPE")
    facts = t.groupBy(page).agg(F.max("expected").alias("expected"), F.max("titles").alias("titles"), F.count_if("row").alias("rows"))
    fault = F.when(F.col("expected").isNull(), "bad header").when((F.col("expected") > 0) & F.col("titles").isNull(), "no column titles").when(F.col("rows") != F.col("expected"), "count differs")
    return facts.select(page, F.col("rows").alias("clients"), fault.alias("fault"))


def reachability(pages: DataFrame, page: str) -> DataFrame:
    """(page, id, reachable) of status tables: rows below the titles, but the total."""
    t = _table(pages, page, "^$()()", r"^ID\s+ADDR").where("row and line_no > titles")
    return t.where(F.substring_index("line", " ", 1) != "TOTAL").select(page, F.substring_index("line", " ", 1).alias("id"), (~F.col("line").contains("(unreachable)")).alias("reachable"))


def bench_reports(pages: DataFrame, page: str) -> DataFrame:
    """(page, phase, count, seconds, gbps, fails, complete): complete if the page has exactly PUT and GET."""
    r = pages.withColumn("line", F.trim("line")).where(F.col("line").rlike(BENCH_ROW))
    r = r.select(page, F.lower(_part(BENCH_ROW, 1)).alias("phase"), _part(BENCH_ROW, 2).try_cast("long").alias("count"), _part(BENCH_ROW, 6).try_cast("double").alias("seconds"), _part(BENCH_ROW, 7).try_cast("double").alias("gbps"), _part(BENCH_ROW, 12).try_cast("long").alias("fails"))
    whole = r.groupBy(page).agg((F.countDistinct("phase") == 2).alias("complete"))
    return r.join(whole, page)
