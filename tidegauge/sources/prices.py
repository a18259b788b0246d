"""Daily prices from three kinds of file, and the rules for replacing what is already there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.filings import file_name

REFRESH_HOURS = 20


def _symbol() -> Column:
    """The symbol a file is named after, or the `symbol=` folder that holds it."""
    folder = F.nullif(F.regexp_extract("_metadata.file_path", "/symbol=([^/]+)/", 1), F.lit(""))
    return F.coalesce(folder, F.regexp_replace(file_name(), r"\.[A-Za-z]+$", ""))


def scan_prices_csv(spark: SparkSession, path: str, source: str = "stooq") -> DataFrame:
    """Date,Open,High,Low,Close,Volume files, one per symbol."""
    rows = spark.read.schema(
        "day date, open double, high double, low double, close double, volume double"
    ).csv(path, header=True, mode="FAILFAST", recursiveFileLookup=True)
    return rows.select(
        _symbol().alias("symbol"), "day", "open", "high", "low", "close", "volume", F.lit(source).alias("source"),
        file_name().alias("source_file"),
    )


def scan_prices_bars_json(
    spark: SparkSession, path: str, source: str = "polygon", multi_line: bool = True
) -> DataFrame:
    """Documents with a list of bars stamped in milliseconds, one a file or one a line."""
    schema = "results array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double>>"
    bars = spark.read.schema(schema).json(path, multiLine=multi_line, mode="FAILFAST", recursiveFileLookup=True)
    return bars.select(_symbol().alias("symbol"), file_name().alias("source_file"), F.inline("results")).select(
        "symbol", F.timestamp_millis("t").cast("date").alias("day"), F.col("o").alias("open"),
        F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"),
        F.lit(source).alias("source"), "source_file",
    )


def scan_prices_adj_json(
    spark: SparkSession, path: str, source: str = "tiingo", multi_line: bool = True
) -> DataFrame:
    """Days with adjusted prices, a list a file or a day a line."""
    names = ("Open", "High", "Low", "Close", "Volume")
    schema = "date string, " + ", ".join(f"adj{n} double" for n in names)
    days = spark.read.schema(schema).json(path, multiLine=multi_line, mode="FAILFAST", recursiveFileLookup=True)
    return days.select(
        _symbol().alias("symbol"), F.to_date(F.left("date", F.lit(10))).alias("day"),
        *(F.col(f"adj{n}").alias(n.lower()) for n in names),
        F.lit(source).alias("source"), file_name().alias("source_file"),
    )


def prices_replace_symbol(existing: DataFrame, rows: DataFrame, answers: DataFrame) -> DataFrame:
    """A readable answer replaces its symbol's rows; no data, or one that cannot be read, keeps the
    earlier ones. `answers` has symbol, source, status (data, no data, unreadable), fetched_at."""
    replaced = answers.where(F.col("status") == "data").select("symbol").distinct()
    fresh = rows.join(replaced, "symbol", "left_semi")
    return existing.join(replaced, "symbol", "left_anti").unionByName(fresh)


def fetch_log(existing: DataFrame, answers: DataFrame, prices: DataFrame) -> DataFrame:
    """The fetch log after the answers: rows held per symbol, 0 where the answer was unreadable."""
    counts = prices.groupBy("symbol").agg(F.count(F.lit(1)).alias("held"))
    rows = F.when(F.col("status") == "unreadable", 0).otherwise(F.coalesce("held", F.lit(0))).cast("int")
    new = answers.join(counts, "symbol", "left").select("symbol", "source", "fetched_at", rows.alias("rows"))
    return existing.join(answers.select("symbol"), "symbol", "left_anti").unionByName(new)


def price_source_fallback(rows: DataFrame, priority: list[str]) -> DataFrame:
    """For each symbol, only the rows of the first source in order that has any."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    known = rows.withColumn("_place", place).where(F.col("_place") > 0)
    first = known.groupBy("symbol").agg(F.min("_place").alias("_place"))
    return known.join(first, ["symbol", "_place"], "left_semi").drop("_place")


def prices_due(wanted: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Wanted symbols to fetch: never fetched first, then the oldest; recent fetches wait."""
    last = wanted.select("symbol").distinct().join(log.select("symbol", "fetched_at"), "symbol", "left")
    cutoff = now - F.expr(f"INTERVAL {REFRESH_HOURS} HOURS")
    return last.where(F.col("fetched_at").isNull() | (F.col("fetched_at") <= cutoff)).orderBy(
        F.col("fetched_at").isNotNull(), "fetched_at", "symbol"
    )
