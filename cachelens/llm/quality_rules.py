"""Quality rules at host level, in DataFrame functions only.

Every document is measured once; rule failures are summed by host (the documents' source), each
rule's failure rate of a host is shrunk towards the corpus by a beta prior fitted to all hosts by
moments, and a host fails when a shrunk rate passes the rule's limit.  Host verdicts are joined back.

The measures are kept as a written table of a few numbers a document, so texts are read once.  A hot
host is summed before the shuffle; host verdicts are broadcast only after their number is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cachelens.llm import common as C

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: Rules of hosts: a failure of a document, and the shrunk rate above which a host fails.
RULES = {
    "short": ("n_words < 50", 0.8),
    "repeats": ("100 * n_repeat_words > 50 * n_words", 0.5),
    "symbols": ("10 * n_symbols > word_chars", 0.5),
    "lines": ("n_dup_lines > 10", 0.5),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words of w that lie in three-word windows found twice or more in w.

    Windows are sorted as (hash, position) pairs, so equal ones are neighbours: n log n whatever
    the text.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))

    def covered(s: Column) -> Column:
        again = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        at = F.filter(F.transform(s, lambda x, i: F.when(F.coalesce(again(x, i), F.lit(False)), x["p"])), lambda p: p.isNotNull())
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    return F.when(F.size(w) < 3, 0).otherwise(let(F.sort_array(windows), covered))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, source and the five measures of every document; null texts measure 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    split = F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda x: x != "")
    of_words = let(split, lambda w: F.struct(F.size(w).alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    out = docs.select("doc_id", "source", F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"), without(SYMBOLS).cast("long").alias("n_symbols"), of_lines.cast("long").alias("n_dup_lines"), of_words.alias("w"))
    return out.select("doc_id", "source", F.col("w.n_words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"))


def host_verdicts(measured: DataFrame) -> DataFrame:
    """source, n_docs, shrunk rate of each rule (rate_<rule>) and host_failed, for hosts that have a name."""
    named = measured.where("source is not null")
    hosts = named.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.sum(F.expr(rule).cast("int")).alias(f"f_{k}") for k, (rule, _) in RULES.items()))
    hosts = C.materialise(hosts, "hosts")
    moments = [m for k in RULES for m in (F.avg(F.col(f"f_{k}") / F.col("n_docs")).alias(f"m_{k}"), F.var_pop(F.col(f"f_{k}") / F.col("n_docs")).alias(f"v_{k}"))]
    prior = hosts.agg(*moments).first()  # one row of the prior's moments
    out = hosts
    for k in RULES:
        mean, var = float(prior[f"m_{k}"] or 0), float(prior[f"v_{k}"] or 0)
        strength = min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0) if var > 0 else 1000.0
        out = out.withColumn(f"rate_{k}", (F.col(f"f_{k}") + mean * strength) / (F.col("n_docs") + strength))
    failed = F.lit(False)
    for k, (_, limit) in RULES.items():
        failed = failed | (F.col(f"rate_{k}") > limit)
    return out.select("source", "n_docs", *(f"rate_{k}" for k in RULES), failed.alias("host_failed"))


def with_quality(docs: DataFrame) -> DataFrame:
    """doc_id, source, the measures, base_failed, host_failed and kept for every row of docs.

    Null and empty texts have no words and fail the base rule; a null source has no host verdict;
    repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    measured = C.materialise(measures(docs), "measures")
    base = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words")
    hosts = C.bounded_broadcast(host_verdicts(measured).select("source", "host_failed"))
    out = measured.join(hosts, "source", "left").withColumn("base_failed", base).withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_quality(C.documents(spark, sf_dir)).select("doc_id", *MEASURES, "base_failed", "kept")


#: The same in SQL: words as 10-separated runs, windows counted by grouping.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS ls FROM d),
m AS (SELECT d.doc_id, d.source, len(w.ws)::BIGINT AS n_words,
        length(translate(d.text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
        (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(l.ls) - len(list_distinct(l.ls)))::BIGINT AS n_dup_lines,
        coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
h AS (SELECT source, count(*) AS n,
        sum((n_words < 50)::INT) AS f1, sum((100 * n_repeat_words > 50 * n_words)::INT) AS f2,
        sum((10 * n_symbols > word_chars)::INT) AS f3, sum((n_dup_lines > 10)::INT) AS f4
      FROM m WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT avg(f1 / n) AS m1, var_pop(f1 / n) AS v1, avg(f2 / n) AS m2, var_pop(f2 / n) AS v2,
        avg(f3 / n) AS m3, var_pop(f3 / n) AS v3, avg(f4 / n) AS m4, var_pop(f4 / n) AS v4 FROM h),
s AS (SELECT *, CASE WHEN v1 > 0 THEN least(greatest(m1 * (1 - m1) / v1 - 1, 1), 1000) ELSE 1000 END AS s1,
        CASE WHEN v2 > 0 THEN least(greatest(m2 * (1 - m2) / v2 - 1, 1), 1000) ELSE 1000 END AS s2,
        CASE WHEN v3 > 0 THEN least(greatest(m3 * (1 - m3) / v3 - 1, 1), 1000) ELSE 1000 END AS s3,
        CASE WHEN v4 > 0 THEN least(greatest(m4 * (1 - m4) / v4 - 1, 1), 1000) ELSE 1000 END AS s4 FROM q),
k AS (SELECT source, (f1 + m1 * s1) / (n + s1) > 0.8 OR (f2 + m2 * s2) / (n + s2) > 0.5
        OR (f3 + m3 * s3) / (n + s3) > 0.5 OR (f4 + m4 * s4) / (n + s4) > 0.5 AS host_failed FROM h CROSS JOIN s)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(k.host_failed, false) AS kept
FROM m LEFT JOIN k ON m.source = k.source
"""
