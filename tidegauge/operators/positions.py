"""Positions: what each manager reported of each identifier, checked against the market."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.stats import exact_median, is_true
from tidegauge.functions.text import clean_cusip, whole_number
from tidegauge.params import Params


def share_lines(raw_infotable: DataFrame) -> DataFrame:
    """Holding lines that are shares: no options, no bond principal."""
    no_option = F.coalesce(F.trim("PUTCALL"), F.lit("")) == ""
    return raw_infotable.where((F.col("SSHPRNAMTTYPE") == "SH") & no_option).withColumn(
        "CUSIP", clean_cusip(F.col("CUSIP"))
    )


def position_sums(filing_parts: DataFrame, raw_infotable: DataFrame) -> DataFrame:
    """Shares and value each manager reported of each identifier in each period.

    The one pass over the holding lines: write it before `positions`, which reads it several
    times over for the medians."""
    lines = share_lines(raw_infotable).select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.col("CUSIP").alias("cusip"),
        whole_number(F.col("SSHPRNAMT")).alias("shares"),
        whole_number(F.col("VALUE")).alias("value"),
    )
    in_use = filing_parts.select("accession", "cik", "period", "value_multiplier")
    return (
        lines.join(in_use, "accession")
        .groupBy("cik", "period", "cusip")
        .agg(
            F.sum("shares").alias("shares"),
            F.sum(F.col("value") * F.col("value_multiplier")).alias("value"),
            F.count(F.lit(1)).alias("lines"),
        )
    )


def positions(position_sums: DataFrame, p: Params = Params()) -> DataFrame:
    """Positions with the implied-price check: value per share against the market-wide median."""
    priced = position_sums.withColumn(
        "implied_price", F.when(F.col("shares") > 0, F.col("value").cast("double") / F.col("shares"))
    )
    medians = exact_median(priced, ["cusip", "period"], "implied_price", "median_price")
    ratio = F.when(
        (F.col("shares") > 0) & (F.col("median_price") > 0), F.col("implied_price") / F.col("median_price")
    )
    compared = priced.join(medians, ["cusip", "period"], "left").withColumn("price_ratio", ratio)
    high, low = p.price_factor, 1 / p.price_factor
    off = is_true((F.col("price_ratio") > high) | (F.col("price_ratio") < low))
    # Some managers still file thousands: about 1/1000 of the median, with the right shares.
    thousands = is_true((F.col("price_ratio") * p.value_thousands).between(low, high))
    return compared.select(
        "cik", "period", "cusip", "shares", "value", "lines", "implied_price", "median_price", "price_ratio",
        thousands.alias("value_in_thousands"),
        (off & ~thousands).alias("price_flag"),
        F.when(thousands, F.col("value") * p.value_thousands).otherwise(F.col("value")).alias("value_checked"),
    )


def price_check(positions: DataFrame, filings: DataFrame) -> DataFrame:
    """The positions the check caught, with the manager and the reason."""
    reason = (
        F.when(F.col("value_in_thousands"), "value in thousands")
        .when(F.col("implied_price") > F.col("median_price"), "price above median")
        .otherwise("price below median")
    )
    caught = positions.where(F.col("price_flag") | F.col("value_in_thousands"))
    return caught.join(filings.select("cik", "period", "manager_name"), ["cik", "period"]).select(
        "cusip", "period", "cik", "manager_name", "shares", "value", "implied_price", "median_price", "price_ratio",
        reason.alias("reason"), F.col("price_flag").alias("left_out"),
    )


def cusip_holders(positions: DataFrame) -> DataFrame:
    """Managers holding each identifier (positions have one row per manager, so rows count them)."""
    return (
        positions.where(F.col("shares") > 0).groupBy("cusip", "period").agg(F.count(F.lit(1)).alias("funds"))
    )
