"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

Rules judge every url whose host is the rule's or a subdomain and whose path starts with the rule's;
the longest rule wins.  Urls that rules judge, together with a short fixed list of labelled urls,
are the labelled urls from which the trees are trained (spark.ml, on a bounded sample by hash of
the url).  Suffix statistics are smoothed block rates of the last host label in that sample.

DataFrame functions and spark.ml only; one scan without a shuffle once the model is fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = 5000
# Fixed values: (verdict, host, path start) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Labelled urls of everyday shapes.
SPAM = "http://cheap-pills.test.com/buy/9931?ref=x&aff=77 http://free-bets-4u.test.com/win?id=88123 http://casino-win777.test.org/play http://ads-track.test.com/c?u=9&s=12&z=44 http://m.adult-xx.test.net/v/8841 http://spam-farm.test.com/p/771-123-99 http://best-loans-24h.test.org/apply?src=mail http://win-prize.test.com/claim/000912 http://cheap-watches-sale.test.net/rolex-99 http://free-download-crack.test.com/key-gen-2023.exe http://click-track.test.com/r?to=aHR0cDovL3g&uid=99182 http://xxx-cam.test.org/live/18 http://hot-deals-4u.test.com/?promo=FREE50 http://fast-cash-now.test.com/loan?amount=5000 http://seo-links-buy.test.net/pack/10000 http://viagra-4-less.test.net/order/88-12-4?aff=301&sub=9 http://slots-777-bonus.test.com/spin?id=4471&ref=z9 http://get-rich-24.test.org/now/000181 http://hot-singles-xx.test.net/cam/9912?aff=4 http://track-pixel.test.org/p?u=883&c=19&k=7 http://cheap-meds-24h.test.com/rx-5512 http://free-iphone-win.test.net/claim?code=99812&s=3 http://crypto-x100-now.test.org/buy?ref=7741 http://adult-toons-33.test.com/v/100021 http://replica-bags-99.test.org/sale-70-off?x=1&y=2 http://keygen-crack-4u.test.net/dl/4418.exe http://payday-loan-1h.test.org/apply?amt=900&ref=33 http://diet-pills-21.test.net/offer/7712-3 http://redirect-go.test.com/out?to=aHR0cHM6Ly94&k=771 http://bet-365-tips.test.net/odds?m=88&l=7 http://link-farm-100.test.org/a-1/b-2/c-3 http://mega-deals-50.test.net/?coupon=SAVE50&src=88".split()
PLAIN = "https://www.library.test.org/en/catalogue/books https://news.test.com/fr/politique/2023/05/article.html https://docs.test.com/guide/install https://university.test.org/de/fakultaet/physik https://www.museum.test.com/es/exposiciones https://blog.test.com/2021/03/cooking-with-herbs.html https://weather.test.net/en/today https://shop.test.com/en/product/481 https://www.city.test.org/fr/services https://forum.test.com/en/thread/4417?page=2 https://wiki.test.org/en/History_of_science https://travel.test.com/en/1220.html https://health.test.org/en/articles/sleep https://music.test.com/fr/album/22 https://m.recipes.test.com/en/7788?utm_source=feed https://www.school.test.net/de/klassen https://garden.test.net/en/roses https://blog.physics.test.net/fr/lumiere https://archive.test.net/en/1904/letters.html https://www.theatre.test.net/es/obras https://choir.test.net/de/konzerte https://maps.test.net/en/rivers https://parliament.test.org/en/debates https://poems.test.org/fr/hugo https://bakery.test.com/de/brot https://chess.test.com/en/openings https://www.radio.test.net/fr/emissions https://hiking.test.org/en/trails/alps https://history.test.net/es/edad-media https://astronomy.test.com/en/planets.html https://m.football.test.net/en/results https://stamps.test.org/de/sammlung".split()
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "digit_ratio", "entropy", "n_params", "hyphens", "host_labels", "host_digits", "suffix_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ://, up to / ? # or end; path up to ? or #.  Both empty without one."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:  # noqa: ANN001
    """struct(rule, verdict) of the longest rule that fits, or null; of equals the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    n = F.length(url)
    only = lambda text, kept: F.length(text) - F.length(F.translate(text, kept, ""))
    chars = F.filter(F.split(url, ""), lambda c: c != "")
    counts = F.transform(F.array(F.array_sort(chars)), lambda s: F.transform(F.filter(F.transform(s, lambda c, i: F.when(F.coalesce(F.get(s, i - 1), F.lit("")) != c, i)), lambda i: i.isNotNull()), lambda i: i))[0]
    # run lengths of the sorted characters: each start to the next one
    share = F.transform(F.array(counts), lambda b: F.transform(b, lambda x, i: (F.coalesce(F.get(b, i + 1), n) - x) / n))[0]
    entropy = F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return {
        "url_chars": n.cast("double"),
        "host_chars": F.length(host).cast("double"),
        "path_chars": F.length(path).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.when(n > 0, only(url, "0123456789") / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0),
        "n_params": only(F.regexp_extract(url, r"\?(.*)$", 1), "=").cast("double"),
        "hyphens": only(host, "-").cast("double"),
        "host_labels": F.size(F.split(host, "\\.")).cast("double"),
        "host_digits": only(host, "0123456789").cast("double"),
    }


@dataclass
class UrlModel:
    """Fitted trees, the block rate of each suffix, and errors (share of wrong verdicts) on labelled urls that were held out."""

    trees: GBTClassificationModel
    rates: dict[str, float]
    error_fixed: float | None
    error_rules: float | None


def _shaped(df: DataFrame) -> DataFrame:
    host, path = parts(F.col("url"))
    return df.withColumn("host", host).withColumn("path", path)


def _features(df: DataFrame, rates: dict[str, float]) -> DataFrame:
    suffix = F.element_at(F.split("host", "\\."), -1)
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv]), suffix), F.lit(0.5)) if rates else F.lit(0.5)
    made = lexical(F.col("url"), F.col("host"), F.col("path")) | {"suffix_rate": rate}
    return VectorAssembler(inputCols=[f"_{k}" for k in FEATURES], outputCol="_features").transform(df.withColumns({f"_{k}": v for k, v in made.items()}))


def fit(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> UrlModel:  # noqa: ANN001
    """Trees from the fixed urls and at most `sample` urls that rules judge; every fourth labelled url (by crc32) is held out.

    What the trees add to the rules they learn from the fixed urls, which therefore count as much as
    the rules' urls together, in every suffix alike.
    """
    spark = pages.sparkSession
    shaped = _shaped(pages.select("url")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    judged = shaped.where("_rule is not null").select("url", F.col("_rule.verdict").alias("label")).distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    fixed = spark.createDataFrame([(u, "block") for u in SPAM] + [(u, "allow") for u in PLAIN], "url string, label string")
    weight = max(1, judged.count() // (len(SPAM) + len(PLAIN)))
    labelled = _shaped(judged.withColumns({"fixed": F.lit(False), "weight": F.lit(1.0)}).unionAll(fixed.withColumns({"fixed": F.lit(True), "weight": F.lit(float(weight))})))
    labelled = labelled.withColumns({"label": (F.col("label") == "block").cast("double"), "held": F.crc32(F.col("url").cast("binary")) % 4 == 2}).cache()
    seen = labelled.where("not held")
    suffix = F.element_at(F.split("host", "\\."), -1)
    rates = {r["suffix"]: r["rate"] for r in seen.groupBy(suffix.alias("suffix")).agg(((F.sum(F.col("label") * F.col("weight")) + 1) / (F.sum("weight") + 2)).alias("rate")).collect()}  # no more rows than the sample has
    trees = GBTClassifier(featuresCol="_features", labelCol="label", weightCol="weight", predictionCol="_prediction", maxIter=15, maxDepth=4, seed=5).setRawPredictionCol("_raw").setProbabilityCol("_probability")
    model = trees.fit(_features(seen, rates))
    wrong = model.transform(_features(labelled.where("held"), rates)).groupBy("fixed").agg(F.avg((F.col("_prediction") != F.col("label")).cast("double")).alias("error")).collect()  # two rows
    errors = {r["fixed"]: r["error"] for r in wrong}
    labelled.unpersist()
    return UrlModel(model, rates, errors.get(True), errors.get(False))


def with_url_verdicts(pages: DataFrame, rules=RULES, sample: int = SAMPLE, model: UrlModel | None = None) -> DataFrame:  # noqa: ANN001
    """pages with host, path, rule, block_score (of the trees) and verdict (such columns are replaced).

    Null urls and urls without :// have empty host and path, no rule, and the trees' verdict on
    empty features; very long urls are read whole; repeated rows are judged alike; an empty table
    gives an empty result.
    """
    model = model or fit(pages, rules, sample)
    pages = _shaped(pages.drop("host", "path", "rule", "block_score", "verdict")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    scored = model.trees.transform(_features(pages, model.rates))
    scored = scored.withColumn("block_score", F.round(vector_to_array("_probability")[1], 6)).withColumn("rule", F.col("_rule.rule"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).drop("_rule", "_features", "_raw", "_probability", "_prediction", *(f"_{k}" for k in FEATURES))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return with_url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
