"""Counters, histograms and quantiles with their reset and interpolation rules spelled out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Upper bounds, in seconds, of the two latency histograms.
NODE_BOUNDS = [0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1]
CONNECTOR_BOUNDS = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]


def cumulative_histogram(df: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """keys, le, cum: counts of values up to each bound, and up to infinity.  One pass: a sum per bound."""
    x = F.greatest(F.col(value), F.lit(0.0))
    sums = df.groupBy(*keys).agg(*(F.sum((x <= b).cast("long")).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("b_inf"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cum")) for i, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").alias("cum"))]
    return sums.select(*keys, F.explode(F.array(*rows)).alias("r")).select(*keys, "r.le", "r.cum")


def per_bucket(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of single buckets, never below 0."""
    w = Window.partitionBy(*keys).orderBy("le")
    return hist.withColumn("n", F.greatest(F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0)), F.lit(0)))


def histogram_quantile(hist: DataFrame, keys: list[str], q: float, infinity: str = "null") -> DataFrame:
    """keys, quantile: linear inside the bucket that holds rank q * count.

    In the infinite bucket the gate's rule gives null (`null`), the dashboards' the highest finite
    bound (`top`).  An empty histogram gives null.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    rows = hist.withColumn("_lo", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("cum").over(w), F.lit(0))).withColumn("_total", F.max("cum").over(Window.partitionBy(*keys)))
    rank = F.col("_total") * q
    inside = F.when(F.col("cum") > F.col("_below"), F.col("_lo") + (F.col("le") - F.col("_lo")) * (rank - F.col("_below")) / (F.col("cum") - F.col("_below"))).otherwise(F.col("le"))
    value = F.when(F.col("le") == float("inf"), F.col("_lo") if infinity == "top" else F.lit(None)).otherwise(inside)
    hit = rows.where((F.col("cum") >= rank) & (F.col("_total") > 0))
    return hit.groupBy(*keys).agg(F.min_by(value, "le").alias("quantile"))


def increase(df: DataFrame, keys: list[str], order: list[str], value: str, rule: str = "after") -> Column:
    """Growth of a counter since the row before.  At a reset: `after` adds the new value, `ignore` adds nothing until it is surpassed."""
    w = Window.partitionBy(*keys).orderBy(*order)
    now = F.col(value)
    if rule == "ignore":
        best = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.greatest(now - F.coalesce(best, now), F.lit(0))
    before = F.lag(value).over(w)
    return F.when(before.isNull(), 0).when(now < before, now).otherwise(now - before)


def exact_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and, for each name, the value at that 0-based rank (a function of the group's row count).

    Groups of any size: values are counted in cells of 1/64 of a power of two, running sums over a
    group's few cells find the cell of each rank, and only that cell's distinct values are counted one
    by one.  Nulls don't count.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull()).select(*keys, x.alias("x"))
    rows = rows.withColumn("cell", F.when(F.col("x") > 0, F.floor(F.log2("x") * 64)).otherwise(F.lit(-(1 << 20)) - F.floor(F.log2(F.greatest(-F.col("x"), F.lit(1e-300))) * 64)).cast("long"))
    counts = rows.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    cells = counts.withColumn("below", F.sum("n").over(w.orderBy("cell")) - F.col("n")).withColumn("total", F.sum("n").over(w))
    asked = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("long").alias("rank")) for name, rank in ranks.items())))
    asked = cells.withColumn("a", asked).where((F.col("a.rank") >= F.col("below")) & (F.col("a.rank") < F.col("below") + F.col("n")))
    asked = asked.select(*keys, "cell", F.col("a.name").alias("name"), (F.col("a.rank") - F.col("below")).alias("rank"))
    values = rows.join(asked, [*keys, "cell"]).groupBy(*keys, "name", "rank", "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "name", "rank").orderBy("x"))
    hit = values.withColumn("upto", upto).where(F.col("upto") > F.col("rank"))
    return hit.groupBy(*keys).agg(*(F.min(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks))


def floor_rank(q: float) -> Callable[[Column], Column]:
    """Element floor(q * (n - 1)) of the sorted values."""
    return lambda n: F.floor(F.lit(q) * (n - 1))


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """Nearest-rank percentile: element ceil(q * n) of the sorted values, counted from 1."""
    return lambda n: F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))


def percentiles_linear(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """keys and, for each name, the percentile interpolated between the two values around rank q * (n - 1)."""
    ranks = {}
    for name, q in quantiles.items():
        ranks |= {f"_lo_{name}": floor_rank(q), f"_hi_{name}": (lambda q: lambda n: F.ceil(F.lit(q) * (n - 1)))(q)}
    found = exact_ranks(df, keys, value, ranks).join(df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("_n")), keys)
    part = lambda q: F.lit(q) * (F.col("_n") - 1) - F.floor(F.lit(q) * (F.col("_n") - 1))
    return found.select(*keys, *((F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part(q)).alias(n) for n, q in quantiles.items()))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)
