"""What leaves the engine: a manager's book as CSV, run history, and model tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import display_name
from tidegauge.operators.reads import book_order


def book_csv_rows(book: DataFrame) -> DataFrame:
    """The eleven columns of a book's spreadsheet, as text, for every manager and period."""
    whole = lambda c: F.bround(F.coalesce(c, F.lit(0)).cast("double"), 0).cast("bigint").cast("string")
    worth = F.when(F.coalesce("value_now", F.lit(0)) != 0, F.bround(F.col("value_now").cast("double"), 0).cast("bigint"))
    # format_string rounds the shortest digits half up; this rounds the number itself, ties to even.
    shown = F.call_function("format_number", F.col("weight_now"), F.lit("0.000000"))
    weight = F.when(F.coalesce("weight_now", F.lit(0.0)) != 0, shown)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    named = display_name(F.col("name_filed"), F.col("name_mixed"))
    return book.select(
        "cik",
        "period",
        F.regexp_replace(blank(F.col("ticker")), "/", ".").alias("ticker"),
        F.when(named == "", F.col("cusip")).otherwise(named).alias("name"),
        blank(F.col("title_of_class")).alias("class"),
        "cusip",
        "kind",
        blank(worth).alias("value_usd"),
        blank(weight).alias("weight"),
        whole("shares_now").alias("shares"),
        whole("shares_prev").alias("shares_before"),
        F.col("action").alias("change"),
        blank(F.bround(F.col("flow"), 0).cast("bigint")).alias("net_buying_usd"),
    )


def export_book_csv(book: DataFrame, path: str) -> None:
    """Write books as CSV, one folder per manager and period, holdings first by value."""
    ordered = book.repartition("cik", "period").sortWithinPartitions("cik", "period", *book_order())
    book_csv_rows(ordered).write.mode("overwrite").option("header", True).partitionBy("cik", "period").csv(path)


def append_run_history(rows: DataFrame, path: str) -> None:
    """Add a run's rows to the history; earlier runs are never touched."""
    rows.write.mode("append").parquet(path)
