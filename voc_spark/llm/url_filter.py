"""URL filter: longest matching rule first, else logistic regression on hashed character n-grams.

Everything is a DataFrame function; the regression is fitted by Spark's own estimator on a small labelled
table and then becomes one constant array of weights inside the scoring expression.

A null url, or one without `://`, has an empty host and path, fits no rule and gets the verdict of the
regression on the empty text. Repeated rows are judged alike; other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voc_spark.llm.common import ascii_lower, pick

BUCKETS = 65_536
GRAMS = (3, 4, 5)


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse_rules(lines: Sequence[str]) -> list[UrlRule]:
    """`allow com/` and `block example.com/en/` are verdict, host, and path from the first slash on."""
    rules = []
    for line in lines:
        verdict, target = line.split(None, 1)
        host, slash, path = target.strip().partition("/")
        rules.append(UrlRule(verdict, host.lower(), slash + path))
    return rules


#: Labelled by hand: site names to block, each with two to allow. All three get the same subdomain, ending and
#: path, so that only the name can tell them apart.
SEED_NAMES: list[tuple[str, str, str]] = [
    ("casino-win", "library", "the-garden"), ("online-casino", "history", "weather"), ("cheap-pills", "recipes", "other-things"),
    ("buy-pills-now", "school", "nation"), ("free-bets", "museum", "river-boats"), ("best-bets", "science", "train-times"),
    ("ads-track", "travel", "northern-lights"), ("track-ads", "health", "that-forest"), ("jackpot-slots", "wiki", "another-place"),
    ("poker-bonus", "forum", "earth-notes"), ("viagra-store", "music", "handmade"), ("adult-x", "docs", "station"),
    ("adult-videos", "maps", "therapist"), ("xxx-cams", "news", "open-questions"), ("payday-loans", "nature", "mentions"),
    ("click-ads", "letters", "bread-and-tea"), ("win-prize", "orchestra", "street-art"), ("hot-singles", "theatre", "wednesday"),
]
SEED_PLACES: list[tuple[str, str, str]] = [
    ("", "com", "en/10"), ("www.", "org", "de/77.html"), ("m.", "net", "en/5?ref=x"), ("blog.", "com", "fr/4"),
    ("", "net", "es/1.html"), ("www.", "com", "order"), ("m.", "org", "en/8#top"), ("blog.", "net", "2019/03/"),
]
SEED_URLS: list[tuple[str, int]] = [
    (f"https://{sub}{name}.example.{end}/{path}", int(k == 0))
    for i, names in enumerate(SEED_NAMES) for k, name in enumerate(names)
    for sub, end, path in (SEED_PLACES[i % len(SEED_PLACES)], SEED_PLACES[(3 * i + 1) % len(SEED_PLACES)])
]


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_URLS, "url string, label int")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (ASCII letters lower-cased) and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1))


def grams(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct buckets of the overlapping character n-grams of host and path, each part framed on its own."""
    def hashed(tag: str, text: Column, n: int) -> Column:
        every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
        return F.transform(every, lambda g: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(buckets)).cast("int"))

    parts = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$"))))
    found = [hashed(f"{part}{n}", text, n) for part, text in parts for n in GRAMS]
    return F.array_distinct(F.concat(*found))


class UrlModel(NamedTuple):
    weights: list[float]
    bias: float

    def score(self, host: Column, path: Column) -> Column:
        """Probability that the url is to be blocked."""
        weights = F.from_json(F.lit(json.dumps(self.weights)), "array<double>")
        margin = F.aggregate(grams(host, path, len(self.weights)), F.lit(self.bias), lambda a, g: a + F.get(weights, g))
        return 1 / (1 + F.exp(-margin))


def fit(labelled: DataFrame, buckets: int = BUCKETS, penalty: float = 0.02) -> UrlModel:
    """L2 logistic regression on the labelled urls (url, label 0 or 1); rows with another label or a null url are left out."""
    rows = with_parts(pick(labelled, url="string", label="double").where(F.col("label").isin(0.0, 1.0) & F.col("url").isNotNull()))
    rows = rows.select("label", grams(F.col("host"), F.col("path"), buckets).cast("array<string>").alias("grams")).coalesce(1)
    seen = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0, vocabSize=buckets).fit(rows)
    model = LogisticRegression(regParam=penalty, maxIter=60, standardization=False).fit(seen.transform(rows))
    weights = [0.0] * buckets
    for bucket, weight in zip(seen.vocabulary, model.coefficients, strict=True):
        weights[int(bucket)] = round(float(weight), 6)
    return UrlModel(weights, float(model.intercept))


def judge(pages: DataFrame, rules: Sequence[UrlRule], model: UrlModel, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and score of each page; the longest rule that fits decides, else the score."""
    pages = with_parts(pick(pages, page_id="long", url="string"))
    host, path = F.col("host"), F.col("path")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is the outermost, so it is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumn("score", model.score(host, path)).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
