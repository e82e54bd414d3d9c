"""Rating-stratified sample with exact quotas, and its profile."""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from voc_spark import taxonomy as tx
from voc_spark.operators.prep import rating_band
from voc_spark.sources.parquet import stored


PREFIX_ROWS = 1_000


def sample_hash(id_columns: list[str], seed: int) -> Column:
    """Order key that any engine reproduces: md5 over the row identity and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_columns], F.lit(str(seed))))


def strata_cuts(ranked: DataFrame, n: int, on_short: str, digits: int) -> DataFrame:
    """Quota and hash cut of every (category, band).

    Counts per hash prefix (at most 16**digits per stratum) replace any sort of a stratum:
    the running count tells up to which prefix rows are needed. One scan, map-side combined.
    """
    per_prefix = ranked.groupBy("product_category", "band", F.substring("order_key", 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("c")
    )
    stratum = Window.partitionBy("product_category", "band")
    running = per_prefix.select(
        "*",
        F.sum("c").over(stratum.orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("c").over(stratum).alias("size"),
    )
    # Shares are truncated in floating point on the driver, as int(n * share) does.
    n_low, n_mid = int(n * tx.LOW_SHARE), int(n * tx.MID_SHARE)
    category = Window.partitionBy("product_category")
    size_of = {
        band: F.coalesce(F.max(F.when(F.col("band") == band, F.col("size"))).over(category), F.lit(0))
        for band in ("low", "mid")
    }
    low_quota, mid_quota = F.least(size_of["low"], F.lit(n_low)), F.least(size_of["mid"], F.lit(n_mid))
    quota = (
        F.when(F.col("band") == "low", low_quota).when(F.col("band") == "mid", mid_quota)
        .otherwise(F.lit(n) - low_quota - mid_quota)
    )
    with_quota = running.withColumn("quota", quota)
    cuts = with_quota.groupBy("product_category", "band").agg(
        F.max("size").alias("size"),
        F.max("quota").alias("quota"),
        F.coalesce(F.min(F.when(F.col("upto") >= F.col("quota"), F.col("prefix"))), F.lit("g")).alias("cut"),
    )
    cuts = stored(cuts, "strata")
    if on_short == "raise":
        # A category without any high-rated row is short as well.
        short = (
            cuts.groupBy("product_category")
            .agg(
                F.coalesce(F.max(F.when(F.col("band") == "high", F.col("size"))), F.lit(0)).alias("high"),
                F.coalesce(F.sum(F.when(F.col("band") != "high", F.col("quota"))), F.lit(0)).alias("rest"),
            )
            .where(F.col("high") + F.col("rest") < n)
            .orderBy("product_category").limit(1).collect()
        )
        if short:
            raise ValueError(f"too few high-rated reviews in {short[0].product_category!r} for a sample of {n}")
    return cuts


def stratified_sample(
    windowed: DataFrame, n: int = 200, seed: int = 42, id_columns: tuple[str, ...] = ("asin", "user_id", "timestamp"),
    on_short: str = "raise", shuffle: bool = True, digits: int | None = None,
) -> DataFrame:
    """`n` rows per product category: 35 % low, 15 % mid, the rest high rated, in pseudo-random order.

    Low and mid quotas shrink to the rows there are; a short high stratum raises, or
    gives all its rows with on_short="take_all". `id_columns` should tell rows apart. The hash prefix has as many
    `digits` as leave about PREFIX_ROWS rows per prefix, so few rows beyond the quota are ever ranked.
    """
    if digits is None:
        digits = max(1, math.ceil(math.log(max(1, windowed.count()) / PREFIX_ROWS, 16)))
    ranked = (
        windowed.withColumn("band", rating_band(F.col("rating"))).where(F.col("band").isNotNull())
        .withColumn("order_key", sample_hash(list(id_columns), seed))
    )
    cuts = strata_cuts(
        ranked.select("product_category", "band", "order_key"), n, on_short, digits
    ).select("product_category", "band", "quota", "cut")
    # Only rows at or below the cut survive: the quota plus at most one prefix per stratum.
    near = ranked.join(cuts, ["product_category", "band"]).where(F.substring("order_key", 1, digits) <= F.col("cut"))
    order = Window.partitionBy("product_category", "band").orderBy("order_key", *id_columns)
    # The literal bound lets Spark cut each map task to n rows per stratum before the shuffle.
    sample = (
        near.withColumn("rank", F.row_number().over(order))
        .where((F.col("rank") <= n) & (F.col("rank") <= F.col("quota")))
        .drop("rank", "quota", "cut")
    )
    return (sample.orderBy("order_key", *id_columns) if shuffle else sample).drop("order_key", "band")


def sample_profile(sample: DataFrame) -> DataFrame:
    """(section, item, value): size, distinct keys, counts per category and quarter, rating summary."""
    value = lambda c: F.col(c).cast("double")
    whole = sample.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("review_id").alias("unique_ids"),
    ).select(F.inline(F.array(*[
        F.struct(F.lit("sample").alias("section"), F.lit(c).alias("item"), value(c).alias("value"))
        for c in ("rows", "unique_ids")
    ])))
    counts = [
        sample.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("item")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit(c).alias("section"), "item", "value")
        for c in ("product_category", "quarter")
    ]
    # Percentiles over (rating, frequency) pairs: the state is one entry per distinct rating.
    freq = sample.where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count(F.lit(1)).alias("f"))
    mean = F.sum(F.col("rating") * F.col("f")) / F.sum("f")
    stats = freq.agg(
        F.sum("f").cast("double").alias("count"), mean.alias("mean"),
        F.sqrt(
            (F.sum(F.col("rating") * F.col("rating") * F.col("f")) - F.sum("f") * mean * mean)
            / F.nullif(F.sum("f") - 1, F.lit(0))
        ).alias("std"),
        F.min("rating").alias("min"),
        *[F.expr(f"percentile(rating, {p / 100}, f)").alias(f"{p}%") for p in (25, 50, 75)],
        F.max("rating").alias("max"),
    )
    names = stats.columns
    rating = stats.select(F.inline(F.array(*[
        F.struct(F.lit("rating").alias("section"), F.lit(c).alias("item"), value(c).alias("value")) for c in names
    ])))
    out = whole
    for part in (*counts, rating):
        out = out.unionByName(part)
    return out
