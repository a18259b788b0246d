"""Small hand-kept files: the watchlist and the published figures results are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Watched securities in file order; the first entry of an identifier counts."""
    raw = spark.read.option("header", True).option("multiLine", True).csv(path)
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) if c in raw.columns else F.lit("")
    # The list is one hand-written file: one partition, numbered in the order read.
    rows = raw.select(
        F.monotonically_increasing_id().alias("line_no"), F.upper(text("cusip")).alias("cusip"),
        F.upper(text("ticker")).alias("ticker"), text("name").alias("name"),
    ).where(F.col("cusip") != "")
    first = rows.groupBy("cusip").agg(F.min_by(F.struct("line_no", "ticker", "name"), "line_no").alias("e"))
    return first.select("cusip", "e.ticker", "e.name", "e.line_no")


def scan_reference_holdings(spark: SparkSession, path: str) -> DataFrame:
    """Published figures per security and quarter, the quarter as its last day."""
    rows = spark.read.option("header", True).csv(path)
    part = lambda n: F.regexp_extract("period", r"^(\d{4})Q(\d)$", n).cast("int")
    return rows.select(
        "ticker",
        "cusip",
        F.last_day(F.make_date(part(1), part(2) * 3, F.lit(1))).alias("period"),
        F.col("filings").cast("bigint").alias("filings"),
        F.col("shares_excl_options").cast("bigint").alias("shares"),
        F.col("value_excl_options_usd").cast("bigint").alias("value"),
    )
