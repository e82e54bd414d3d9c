"""Many date windows in one job: coverage check, counts, narrative, stats JSON."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from voc_spark import taxonomy as tx
from voc_spark.functions.times import bad_dates, is_midnight, plain_date
from voc_spark.operators.profile import coverage
from voc_spark.sources.parquet import stored

# Joined complaint rows per product category, next to the plain marginals.
COMPLAINT_DIMENSION = "complaints_by_product"
STAT_KEYS = {
    "feedback_category": "category_counts",
    "sentiment": "sentiment_counts",
    "urgency": "urgency_counts",
    "product_category": "product_category_counts",
}


def date_range_overlap(windows: DataFrame, reviews: DataFrame) -> DataFrame:
    """Adds is_valid and message: a window is invalid iff it ends before or starts after all dated reviews, or is no pair of dates."""
    cover = coverage(reviews).select(F.struct("date_min", "date_max").alias("c")).scalar()
    lo, hi = F.col("c.date_min"), F.col("c.date_max")
    start, end = (plain_date(F.col(c)).cast("timestamp_ntz") for c in ("date_start", "date_end"))
    valid = F.coalesce((end >= lo) & (start <= hi), F.lit(False))
    day = lambda ts: F.coalesce(ts.cast("date").cast("string"), F.lit("none"))
    checked = windows.withColumn("c", cover).withColumn("is_valid", valid)
    return checked.withColumn(
        "message",
        F.when(bad_dates(F.col("date_start"), F.col("date_end")), F.format_string(tx.BAD_DATES_FORMAT, "date_start", "date_end"))
        .when(~F.col("is_valid"), F.format_string(tx.OUT_OF_RANGE_FORMAT, day(lo), day(hi))),
    ).drop("c")


def daily_marginals(view: DataFrame) -> DataFrame:
    """(dimension, value, day, rows, midnight_rows): small, whatever the size of the view.

    Takes the counting view, or the stored feedback cube.
    """
    if "review_day" in view.columns:
        dated = view.withColumnRenamed("review_day", "day")
    else:
        dated = view.withColumns(
            {"day": F.col("review_date").cast("date"), "at_midnight": is_midnight(F.col("review_date"))}
        )
    weight = F.col("n") if "n" in view.columns else F.lit(1).cast("bigint")
    entry = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    complaint = F.when(F.col("feedback_category").isin(tx.COMPLAINTS), F.col("product_category"))
    # Combinations of the dimensions and days are bounded whatever the number of rows; only they are spread over single values.
    cells = dated.where("day IS NOT NULL").groupBy(*tx.FILTER_DIMENSIONS, "day", "at_midnight").agg(F.sum(weight).alias("c"))
    spread = cells.select("day", "at_midnight", "c", F.inline(F.array(
        *[entry(d, F.col(d)) for d in tx.FILTER_DIMENSIONS],
        entry(COMPLAINT_DIMENSION, complaint), entry("total", F.lit("all")),
    )))
    return spread.where("value IS NOT NULL").groupBy("dimension", "value", "day").agg(
        F.sum("c").alias("rows"), F.sum(F.when(F.col("at_midnight"), F.col("c")).otherwise(0)).alias("midnight_rows")
    )


def running_marginals(daily: DataFrame, days: DataFrame) -> DataFrame:
    """For every (dimension, value) and asked day (`days`, distinct): rows before the day, and rows up to its midnight.

    A series has one entry per day with rows and per asked day: no calendar, so a stray date far away costs one row.
    """
    asked = days.agg(F.collect_set("day").alias("asked")).select("asked").scalar()
    edges = daily.select("dimension", "value").distinct().select("dimension", "value", F.explode(asked).alias("day"))
    events = daily.withColumn("edge", F.lit(False)).unionByName(
        edges.select("*", F.lit(0).cast("bigint").alias("rows"), F.lit(0).cast("bigint").alias("midnight_rows"), F.lit(True).alias("edge")))
    merged = events.groupBy("dimension", "value", "day").agg(
        F.sum("rows").alias("rows"), F.sum("midnight_rows").alias("midnight_rows"), F.max("edge").alias("edge"))
    earlier = Window.partitionBy("dimension", "value").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0))
    running = merged.withColumn("before", before).where("edge")
    return running.select("dimension", "value", "day", "before", (F.col("before") + F.col("midnight_rows")).alias("upto_midnight"))


def daily_series(daily: DataFrame, days: DataFrame) -> DataFrame:
    """One row per asked day: the running totals of all values, in the same order every day.

    An entry per distinct label and product category, however many rows the facts have.
    """
    entry = F.struct("dimension", "value", "before", "upto_midnight")
    total = lambda c: F.max(F.when(F.col("dimension") == "total", F.col(c))).alias(f"total_{c}")
    return running_marginals(daily, days).groupBy("day").agg(
        total("before"), total("upto_midnight"), F.array_sort(F.collect_list(entry)).alias("series")
    )


def window_profiles(view: DataFrame, windows: DataFrame, end_of_day: bool = False) -> DataFrame:
    """Adds to every window `total_reviews` and `counts`, an array of (dimension, value, count).

    A window without rows or without two plain dates has 0 and null. The counts per day, best from the
    stored feedback cube, become running totals at the days that windows start and end on, so a window is the
    difference between two days: two equi-joins, whatever its length.
    """
    daily = stored(daily_marginals(view), "daily")
    span = daily.agg(F.struct(F.min("day").alias("lo"), F.date_add(F.max("day"), 1).alias("past")).alias("c")).select("c").scalar()
    s, e = plain_date(F.col("date_start")), plain_date(F.col("date_end"))
    lo, past = F.col("c.lo"), F.col("c.past")
    live = (s <= e) & (e >= lo) & (s < past)
    asked = windows.withColumn("c", span).withColumns({
        "_from": F.when(live, F.greatest(s, lo)),
        "_to": F.when(live, F.least(F.date_add(e, 1) if end_of_day else e, past)),
    })
    edges = asked.select(F.explode(F.array("_from", "_to")).alias("day")).where("day IS NOT NULL").distinct()
    days = stored(daily_series(daily, edges), "series")
    upto = "before" if end_of_day else "upto_midnight"
    first = days.select(F.col("day").alias("_from"), F.col("series").alias("_first"), F.col("total_before").alias("_earlier"))
    last = days.select(F.col("day").alias("_to"), F.col("series").alias("_last"), F.col(f"total_{upto}").alias("_upto"))
    counts = F.filter(
        F.zip_with("_last", "_first", lambda b, a: F.struct(b["dimension"], b["value"], (b[upto] - a["before"]).alias("count"))),
        lambda x: x["count"] > 0,
    )
    total = F.coalesce(F.col("_upto") - F.col("_earlier"), F.lit(0))
    return asked.join(first, "_from", "left").join(last, "_to", "left").select(
        *windows.columns, total.alias("total_reviews"), F.when(total > 0, counts).alias("counts")
    )


def window_counts(view: DataFrame, windows: DataFrame, end_of_day: bool = False) -> DataFrame:
    """(window_label, dimension, value, count) of every window; windows without rows give none."""
    profiles = window_profiles(view, windows, end_of_day).where("total_reviews > 0")
    return profiles.select("window_label", F.inline("counts"))


def _ranked(dimension: str, values: list[str] | None = None) -> Column:
    """The (count, value) entries of a dimension, most frequent first, then by value."""
    keep = lambda x: (x["dimension"] == dimension) & (x["value"].isin(values) if values else F.lit(True))
    entries = F.transform(
        F.filter("counts", keep), lambda x: F.struct((-x["count"]).alias("minus"), x["value"].alias("value"))
    )
    return F.transform(F.array_sort(entries), lambda x: F.struct(x["value"].alias("value"), (-x["minus"]).alias("count")))


def _count_of(dimension: str, value: str) -> Column:
    hit = F.filter("counts", lambda x: (x["dimension"] == dimension) & (x["value"] == value))
    return F.coalesce(F.get(hit, F.lit(0))["count"], F.lit(0))


def stats_json() -> Column:
    """The counts of a profile as one JSON object, null without rows."""
    def pairs(dimension: str) -> Column:
        entries = F.filter("counts", lambda x: x["dimension"] == dimension)
        return F.map_from_entries(F.transform(entries, lambda x: F.struct(x["value"], x["count"])))

    fields = [F.col("total_reviews").alias("total_count"), *[pairs(d).alias(key) for d, key in STAT_KEYS.items()]]
    return F.when(F.col("total_reviews") > 0, F.to_json(F.struct(*fields)))


def parse_stats(summaries: DataFrame) -> DataFrame:
    """Back from stats JSON to (window_label, dimension, value, count) rows."""
    ddl = "total_count bigint, " + ", ".join(f"{k} map<string,bigint>" for k in STAT_KEYS.values())
    parsed = summaries.select("window_label", F.from_json("stats", ddl).alias("j"))

    def rows(dimension: str, key: str) -> Column:
        return F.transform(
            F.map_entries(f"j.{key}"),
            lambda e: F.struct(F.lit(dimension).alias("dimension"), e["key"].alias("value"), e["value"].alias("count")),
        )

    as_rows = [rows(d, key) for d, key in STAT_KEYS.items()]
    total = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value"), F.col("j.total_count").alias("count")))
    return parsed.select("window_label", F.inline(F.concat(total, *as_rows)))


def with_narrative(profiles: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """Adds `narrative` to every profile with rows: a few sentences over its counts.

    `written` may bring model texts per window_label; a missing one gives the stock sentence.
    """
    has_rows = F.col("total_reviews") > 0
    if written is not None:
        texts = written.select("window_label", F.col("narrative").alias("_text"))
        return profiles.join(texts, "window_label", "left").withColumn(
            "narrative", F.when(has_rows, F.coalesce("_text", F.lit(tx.SUMMARY_UNAVAILABLE)))
        ).drop("_text")
    facts = profiles.withColumns({
        "_themes": F.slice(_ranked("feedback_category"), 1, 3),
        "_worst": _ranked(COMPLAINT_DIMENSION),
        "_driver": F.get(_ranked("feedback_category", tx.COMPLAINTS), F.lit(0))["value"],
        "_negative": _count_of("sentiment", "Negative"),
        "_high": _count_of("urgency", "High"),
    })
    themes = F.array_join(
        F.transform("_themes", lambda x: F.concat(x["value"], F.lit(" ("), x["count"].cast("string"), F.lit(")"))), ", "
    )
    worst = F.get("_worst", F.lit(0))
    complaints = F.aggregate("_worst", F.lit(0).cast("bigint"), lambda acc, x: acc + x["count"])
    sentences = F.concat_ws(
        " ",
        F.concat("total_reviews", F.lit(" reviews in "), "window_label", F.lit(".")),
        F.when(themes != "", F.concat(F.lit("Main themes: "), themes, F.lit("."))),
        F.concat(worst["value"], F.lit(" draws the most complaints, "), worst["count"], F.lit(" of "), complaints, F.lit(".")),
        F.concat(
            "_negative", F.lit(" are negative ("), F.floor(F.col("_negative") * 100 / F.col("total_reviews")).cast("bigint"),
            F.lit("%) and "), "_high", F.lit(" are of high urgency."),
        ),
        F.coalesce(
            F.concat(F.lit("Start with "), "_driver", F.lit(" in "), worst["value"], F.lit(".")),
            F.lit("No complaint stands out."),
        ),
    )
    return facts.withColumn("narrative", F.when(has_rows, sentences)).select(*profiles.columns, "narrative")
