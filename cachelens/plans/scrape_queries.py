"""Scraped text written from the tables and read back, with the faults that scrapes have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.plans import views as V
from cachelens.plans.book import Book
from cachelens.sources import scrape as S
from cachelens.sources.text import render_samples

Q = Book()

#: Buckets of the scraped histograms (in both the pages and the SQL).
BOUNDS = (0.01, 0.05, 0.1)


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Metric pages (endpoint, line_no, line), one for each peer.

    Peers n3 and n7 have no scalar, n5's comes twice (the second is not to be read), n4 repeats the
    put buckets, n6's have no +Inf.
    """
    o = V.ops(spark, d).withColumn("endpoint", F.col("peer"))
    total = o.groupBy("endpoint").agg(F.sum("hits").alias("hits"), F.sum("keys").alias("keys"), F.count("*").alias("n"))
    comment = total.select("endpoint", F.lit(0).alias("line_no"), F.lit("# HELP cache_hits_total Hits.").alias("line"))
    scalar = total.where("endpoint not in ('n3', 'n7')").select("endpoint", F.lit(1).alias("line_no"), F.concat(F.lit("cache_hits_total "), "hits").alias("line"))
    longer = total.select("endpoint", F.lit(0).alias("line_no"), F.concat(F.lit("cache_hits_total_more "), F.lit("9")).alias("line"))
    second = total.where("endpoint = 'n5'").select("endpoint", F.lit(2).alias("line_no"), F.lit("cache_hits_total 1").alias("line"))
    plain = total.select("endpoint", F.lit(3).alias("line_no"), F.concat(F.lit("dedup_hits_total "), F.col("keys") - F.col("hits")).alias("line"))
    labelled = total.select("endpoint", F.lit(4).alias("line_no"), F.concat(F.lit('dedup_hits_total{kind="x"} '), "n").alias("line"))
    out = comment.unionAll(scalar).unionAll(longer).unionAll(second).unionAll(plain).unionAll(labelled)
    per = o.groupBy("endpoint", "op").agg(F.count("*").alias("requests"), F.sum("keys").alias("keys"), F.sum("hits").alias("hits"), F.sum("bytes").alias("bytes"))
    op = {"op": F.col("op")}
    for i, c in enumerate(("requests", "keys", "hits", "bytes")):
        out = out.unionAll(render_samples(per, F.lit(f"op_{c}_total"), op, F.col(c)).select("endpoint", F.lit(10 + i).alias("line_no"), "line"))
    made = o.groupBy("endpoint", "op").agg(*(F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(BOUNDS)), F.count("*").alias("b_inf"))
    rows = made.select("endpoint", "op", F.explode(F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BOUNDS)), F.struct(F.lit("+Inf").alias("le"), F.col("b_inf").alias("n")))).alias("r")).select("endpoint", "op", "r.le", "r.n")
    rows = rows.where("not (endpoint = 'n6' and le = '+Inf')")
    rows = rows.unionAll(rows.where("endpoint = 'n4' and op = 'put'"))
    hist = render_samples(rows, F.lit("op_seconds_bucket"), op | {"le": F.col("le")}, F.col("n")).select("endpoint", F.lit(20).alias("line_no"), "line")
    calls = o.groupBy("endpoint", F.col("connector").alias("peer")).agg(F.count("*").alias("count"), F.sum("keys").alias("sum"), F.max("keys").alias("max"))
    for i, c in enumerate(("sum", "count", "max")):
        hist = hist.unionAll(render_samples(calls, F.lit(f"peer_latency_{c}"), {"peer": F.col("peer")}, F.col(c)).select("endpoint", F.lit(30 + i).alias("line_no"), "line"))
    return out.unionAll(hist).withColumn("line_no", F.col("line_no").cast("long"))


@Q.add("a6_scalar", "SELECT peer AS endpoint, (CASE WHEN peer IN ('n3', 'n7') THEN 0 ELSE sum(hits) END)::DECIMAL(20, 0) AS value FROM ops GROUP BY peer", "ops")
def scalar(spark: SparkSession, d: str) -> DataFrame:
    return S.scalar(pages(spark, d), ["endpoint"], "cache_hits_total")


@Q.add("a8_peer_latency", "SELECT peer AS endpoint, connector AS peer, sum(keys)::DOUBLE AS sum, count(*)::DOUBLE AS count, max(keys)::DOUBLE AS max FROM ops GROUP BY 1, 2", "ops")
def peer_latency(spark: SparkSession, d: str) -> DataFrame:
    return S.by_label(pages(spark, d), ["endpoint"], "peer", {c: f"peer_latency_{c}" for c in ("sum", "count", "max")})


_B = " || ' ' || ".join(f"count_if(seconds <= {b})" for b in BOUNDS)


@Q.add("a9_per_op", f"SELECT peer AS endpoint, op, count(*)::DOUBLE AS requests, sum(keys)::DOUBLE AS keys, sum(hits)::DOUBLE AS hits, sum(bytes)::DOUBLE AS bytes, {_B} || CASE WHEN peer = 'n6' THEN '' ELSE ' ' || count(*) END AS buckets FROM ops WHERE peer <> 'n4' GROUP BY peer, op", "ops")
def per_op(spark: SparkSession, d: str) -> DataFrame:
    """Counters of each op and its buckets in order of their bounds."""
    p = pages(spark, d).where("endpoint <> 'n4'")
    counters = S.by_label(p, ["endpoint"], "op", {c: f"op_{c}_total" for c in ("requests", "keys", "hits", "bytes")})
    text = F.array_join(F.transform("buckets", lambda b: b["cum"].cast("long").cast("string")), " ")
    return counters.join(S.histograms_by_label(p, ["endpoint"], "op", "op_seconds"), ["endpoint", "op"]).withColumn("buckets", text)


@Q.add("a10_plain_counters", "SELECT peer AS endpoint, (sum(keys) - sum(hits))::DOUBLE AS dedup_hits_total, NULL::DOUBLE AS dedup_fetches_total FROM ops GROUP BY peer", "ops")
def plain_counters(spark: SparkSession, d: str) -> DataFrame:
    return S.plain_counters(pages(spark, d), ["endpoint"], ["dedup_hits_total", "dedup_fetches_total"])


V.SQL["scraped"] = "SELECT o.peer AS endpoint, o.op, b.le, count_if(o.seconds <= b.le) AS n FROM ops o, (SELECT unnest([" + ", ".join(f"{b}::DOUBLE" for b in BOUNDS) + ", 1e9]) AS le) b WHERE NOT (o.peer = 'n6' AND b.le = 1e9) GROUP BY 1, 2, 3"


@Q.add("a11_histograms", "SELECT op, le, sum(n)::DOUBLE AS total FROM scraped WHERE op IN ('put', 'get') AND endpoint NOT IN ('n4', 'n6') GROUP BY op, le", "ops", "scraped")
def histograms(spark: SparkSession, d: str) -> DataFrame:
    """Histograms summed over the endpoints without a fault."""
    p = pages(spark, d)
    bad = S.histogram_faults(p, "endpoint", "op_seconds", ["put", "get"]).select("endpoint").distinct()
    sums = S.summed_histograms(p.join(bad, "endpoint", "left_anti"), "endpoint", "op_seconds", ["put", "get"])
    return sums.select("op", F.least("le", F.lit(1e9)).alias("le"), "total")


@Q.add("a11_faults", "SELECT DISTINCT peer AS endpoint, op, CASE WHEN peer = 'n4' THEN 'duplicate series' ELSE 'no +Inf bucket' END AS fault FROM ops WHERE (peer = 'n4' AND op = 'put') OR (peer = 'n6' AND op IN ('put', 'get'))", "ops")
def faults(spark: SparkSession, d: str) -> DataFrame:
    return S.histogram_faults(pages(spark, d), "endpoint", "op_seconds", ["put", "get"])


def _numbered(rows: DataFrame, page: str, line: Column, order: str) -> DataFrame:
    return rows.select(F.col(page), (F.col(order) + 10).cast("long").alias("line_no"), line.alias("line"))


def ring_pages(spark: SparkSession, d: str) -> DataFrame:
    """Ring tables (grp, line_no, line); ASIA's header counts one too many, AFRICA has an id twice, EUROPE a row cut short."""
    m = V.members(spark, d)
    head = m.groupBy("grp").agg(F.count("*").alias("n")).select("grp", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("group="), F.translate("grp", " ", "_"), F.lit(" members="), F.col("n") + F.when(F.col("grp") == "ASIA", 1).when(F.col("grp") == "AFRICA", F.col("n")).otherwise(0), F.lit(" ring_points=160")).alias("line"))
    titles = m.select("grp").distinct().select("grp", F.lit(1).cast("long").alias("line_no"), F.lit("ID ADDR WEIGHT VNODES SHARE INFO").alias("line"))
    text = F.concat_ws("  ", "id", F.concat(F.lit("10.0.0.1:"), F.lit(28000) + F.col("num") % 100), "weight", F.col("weight") * 160, F.lit("5.0%"), F.concat(F.lit("ver="), "ver"))
    rows = _numbered(m, "grp", F.when((F.col("grp") == "EUROPE") & (F.col("num") % 3 == 0), F.col("id")).otherwise(text), "num")
    return head.unionAll(titles).unionAll(rows).unionAll(rows.where("grp = 'AFRICA'"))


@Q.add("a12_ring_tables", "SELECT grp, CASE WHEN grp = 'AFRICA' THEN 2 * count(*) ELSE count(*) END AS members, CASE grp WHEN 'ASIA' THEN 'count differs' WHEN 'AFRICA' THEN 'duplicate id' WHEN 'EUROPE' THEN CASE WHEN count_if(num % 3 = 0) > 0 THEN 'bad row' END END AS fault FROM members GROUP BY grp", "members")
def ring_tables(spark: SparkSession, d: str) -> DataFrame:
    return S.ring_tables(ring_pages(spark, d), "grp")


@Q.add("a12_client_tables", "SELECT peer, count(DISTINCT connector) AS clients, CASE WHEN peer = 'n2' THEN 'count differs' WHEN peer = 'n8' THEN 'no column titles' END AS fault FROM ops GROUP BY peer", "ops")
def client_tables(spark: SparkSession, d: str) -> DataFrame:
    """Client tables; n2's header counts one too few, n8 has another word in place of the titles."""
    c = V.ops(spark, d).select("peer", "connector").distinct()
    head = c.groupBy("peer").agg(F.count("*").alias("n")).select("peer", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("group="), "peer", F.lit(" clients="), F.col("n") - F.when(F.col("peer") == "n2", 1).otherwise(0)).alias("line"))
    titles = c.where("peer <> 'n8'").select("peer").distinct().select("peer", F.lit(1).cast("long").alias("line_no"), F.lit("ID TYPE").alias("line"))
    rows = c.select("peer", F.lit(2).cast("long").alias("line_no"), F.concat("connector", F.lit("  client")).alias("line"))
    return S.client_tables(head.unionAll(titles).unionAll(rows), "peer")


@Q.add("a12_reachability", "SELECT grp, id, has_stats AS reachable FROM members", "members")
def reachability(spark: SparkSession, d: str) -> DataFrame:
    m = V.members(spark, d)
    titles = m.select("grp").distinct().select("grp", F.lit(1).cast("long").alias("line_no"), F.lit("ID ADDR USED").alias("line"))
    rows = _numbered(m, "grp", F.concat_ws(" ", "id", F.lit("10.0.0.1:1"), F.when(F.col("has_stats"), F.col("used_bytes").cast("string")).otherwise("(unreachable)")), "num")
    total = m.groupBy("grp").agg(F.max("num").alias("num"), F.sum("used_bytes").alias("u")).select("grp", (F.col("num") + 99).cast("long").alias("line_no"), F.concat(F.lit("TOTAL - "), "u").alias("line"))
    return S.reachability(titles.unionAll(rows).unionAll(total), "grp")


@Q.add("a12_bench_reports", "SELECT peer, op AS phase, count(*) AS count, 2.5::DOUBLE AS seconds, 1.25::DOUBLE AS gbps, count_if(status = 'error') AS fails, count(*) OVER (PARTITION BY peer) = 2 AS complete FROM ops WHERE op IN ('put', 'get') AND NOT (peer = 'n1' AND op = 'get') GROUP BY peer, op", "ops")
def bench_reports(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark reports; n1 has no GET, so it is not complete."""
    o = V.ops(spark, d).where("op in ('put', 'get') and not (peer = 'n1' and op = 'get')").groupBy("peer", "op").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("fails"))
    line = F.concat(F.upper("op"), F.lit("   n="), "n", F.lit(" size=4096 threads=4 batch=8 | 2.500s  1.25 GB/s  99 ops/s  call-lat ms p50=1.000 p99=2.000 max=3.000  fails="), "fails")
    junk = o.select("peer", F.lit(0).cast("long").alias("line_no"), F.lit("warming up").alias("line"))
    return S.bench_reports(o.select("peer", F.lit(1).cast("long").alias("line_no"), line.alias("line")).unionAll(junk), "peer")


@Q.add("a13_metric_page", """SELECT peer AS endpoint, '# HELP cache_keys_total Keys asked for.' || chr(10) || '# TYPE cache_keys_total counter' || chr(10) || string_agg('cache_keys_total{op="' || op || '"} ' || keys, chr(10) ORDER BY op) || chr(10) AS page FROM (SELECT peer, op, sum(keys)::BIGINT AS keys FROM ops GROUP BY peer, op) GROUP BY peer""", "ops")
def metric_page(spark: SparkSession, d: str) -> DataFrame:
    """A whole page: help, type and samples in order (a page has a line for each of a few ops)."""
    per = V.ops(spark, d).groupBy(F.col("peer").alias("endpoint"), "op").agg(F.sum("keys").alias("keys"))
    lines = render_samples(per, F.lit("cache_keys_total"), {"op": F.col("op")}, F.col("keys"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("op", "line"))), lambda r: r["line"]), "\n")
    head = "# HELP cache_keys_total Keys asked for.\n# TYPE cache_keys_total counter\n"
    return lines.groupBy("endpoint").agg(F.concat(F.lit(head), body, F.lit("\n")).alias("page"))
