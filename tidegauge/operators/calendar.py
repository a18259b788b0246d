"""The quarter calendar. It holds four rows a year, so joining it by broadcast is always safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.dates import (
    filing_deadline,
    holidays_of,
    list_date,
    next_quarter_end,
    previous_quarter_end,
    quarter_label,
)

# Fixed value: how a three-month window of filings is named.
WINDOW_NAME = r"(?i)(\d{2}[a-z]{3}\d{4})-(\d{2}[a-z]{3}\d{4})_form13f\.zip$"


def filing_windows(names: DataFrame, first_wanted: str | None = None) -> DataFrame:
    """Three-month filing windows from source file names; other names are left out."""
    part = lambda n: F.to_date(F.initcap(F.regexp_extract("source_zip", WINDOW_NAME, n)), "ddMMMyyyy")
    windows = (
        names.where(F.col("source_zip").rlike(WINDOW_NAME))
        .select("source_zip")
        .distinct()
        .select("source_zip", part(1).alias("window_start"), part(2).alias("window_end"))
    )
    return windows if first_wanted is None else windows.where(F.col("window_start") >= F.to_date(F.lit(first_wanted)))


def federal_holidays(years: DataFrame) -> DataFrame:
    """One row per holiday of each year (column `year`), as kept."""
    return years.select("year", F.explode(holidays_of(F.col("year"))).alias("holiday"))


def deadlines(periods: DataFrame) -> DataFrame:
    return periods.select("period", filing_deadline(F.col("period")).alias("deadline"))


def first_full_period(windows: DataFrame) -> DataFrame:
    """The first quarter whose deadline is not before the first window (one row)."""
    start = windows.agg(F.min("window_start").alias("start"))
    before = previous_quarter_end(F.col("start"))
    candidates = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda n: F.last_day(F.add_months(before, n * 3)))
    in_time = F.filter(candidates, lambda p: filing_deadline(p) >= F.col("start"))
    return start.select("start", F.array_min(in_time).alias("period"))


def quarter_spine(windows: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every quarter end from the first full one to the last anyone filed an original for."""
    first = first_full_period(windows).select("period").scalar()
    through = windows.agg(F.max("window_end")).scalar()
    last = (
        submissions.where((F.col("role") == "original") & F.col("period").between(first, through))
        .agg(F.max("period").alias("last"))
        .where(F.col("last").isNotNull())
        .select("last", first.alias("first"), through.alias("data_through"))
    )
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 3 months"))
    quarters = last.select("data_through", F.posexplode(months).alias("n", "month")).select(
        F.last_day("month").alias("period"), (F.col("n") + 1).alias("seq"), "data_through"
    )
    return quarters.select(
        "period",
        "seq",
        quarter_label(F.col("period")).alias("label"),
        F.when(F.col("seq") > 1, previous_quarter_end(F.col("period"))).alias("prev_period"),
        filing_deadline(F.col("period")).alias("deadline"),
        # Late filers keep arriving: complete once the data reaches the next period's deadline.
        (filing_deadline(next_quarter_end(F.col("period"))) <= F.col("data_through")).alias("complete"),
        "data_through",
    )


def with_next(periods: DataFrame) -> DataFrame:
    """Each period with the one after it in the spine (NULL for the last)."""
    return periods.withColumn("next_period", F.lead("period").over(Window.partitionBy(F.lit(1)).orderBy("period")))


def default_period(periods: DataFrame) -> DataFrame:
    """The latest period with a predecessor whose on-time filings are all in, else the latest one."""
    on_time = F.max(F.when(F.col("deadline") <= F.col("data_through"), F.col("period")))
    return (
        periods.where(F.col("prev_period").isNotNull())
        .agg(F.coalesce(on_time, F.max("period")).alias("period"))
        .where(F.col("period").isNotNull())
    )


def list_dates(periods: DataFrame, lag_days: int = 14) -> DataFrame:
    """When each period's list could first be read."""
    return periods.where(F.col("prev_period").isNotNull()).select(
        "period", "label", "prev_period", list_date(F.col("deadline"), lag_days).alias("list_date")
    )


def freshness(dated: DataFrame, column: str, today) -> DataFrame:
    """A date column's latest value and its age in days."""
    return dated.agg(F.max(column).alias("through")).withColumn("age_days", F.datediff(today, "through"))
