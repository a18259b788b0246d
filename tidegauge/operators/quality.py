"""Laws the model's tables must keep, as counts of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _count(df: DataFrame, rule: str, broken: Column | None = None) -> DataFrame:
    rows = df if broken is None else df.where(broken)
    return rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def dq_invariants(tables: dict[str, DataFrame], moves: DataFrame | None = None) -> DataFrame:
    """One row per rule: how many rows break it."""
    changes = tables["changes"].select("cusip", "period", "opened", "sold_out", "not_yet_filed")
    stock_periods = tables["stock_periods"]
    added_up = stock_periods.join(changes, ["cusip", "period"]).where(F.col("funds_prev").isNotNull())
    total = F.col("funds_prev") + F.col("opened") - F.col("sold_out") - F.col("not_yet_filed")
    per_filing = tables["filings"].groupBy("cik", "period").agg(F.count(F.lit(1)).alias("n"))
    bases = tables["filing_parts"].groupBy("cik", "period").agg(
        F.count_if(F.col("role").isin("restatement", "original")).alias("n")
    )
    keys = tables["stock_keys"]
    ends = keys.select(F.col("cusip").alias("stock"), F.col("stock").alias("end"))
    rules = [
        _count(added_up, "funds add up", F.col("funds_holding") != total),
        _count(per_filing, "one filing per manager and period", F.col("n") > 1),
        _count(bases, "one base report per filing", F.col("n") > 1),
        _count(keys.join(ends, "stock"), "every stock is its own key", F.col("end") != F.col("stock")),
        _count(tables["price_check"], "checked positions are named", F.col("manager_name").isNull()),
    ]
    if moves is not None:
        sides = moves.withColumnRenamed("stock", "cusip").join(
            stock_periods.select("cusip", "period", "bought_value", "sold_value"), ["cusip", "period"]
        )
        off = lambda a, b: F.abs(F.col(a) - F.col(b)) > F.greatest(F.abs(b), F.lit(1.0)) * 1e-6
        rules.append(
            _count(sides, "moves add up to the flow", off("bought", "bought_value") | off("sold", "sold_value"))
        )
    out = rules[0]
    for rule in rules[1:]:
        out = out.unionByName(rule)
    return out


def reference_gaps(holders: DataFrame, reference: DataFrame) -> DataFrame:
    """Our figures against published ones: level and change of holders, and share totals where the
    published total agrees with its own value. `reference` has cusip, period, filings, shares, value."""
    ours = holders.select("cusip", "period", F.col("funds_holding").alias("ours"), "shares", "value")
    theirs = reference.select(
        "cusip", "period", "filings", F.col("shares").alias("ref_shares"), F.col("value").alias("ref_value")
    )
    both = theirs.join(ours, ["cusip", "period"])
    before = both.select(
        "cusip",
        F.last_day(F.add_months("period", 3)).alias("period"),
        F.col("ours").alias("ours_prev"),
        F.col("filings").alias("filings_prev"),
    )
    price_gap = F.try_divide(
        F.try_divide("ref_value", "ref_shares"), F.try_divide(F.col("value").cast("double"), F.col("shares"))
    )
    consistent = F.abs(price_gap - 1) <= 0.05
    pct = lambda now, prev: (F.col(now) / F.col(prev) - 1) * 100
    return both.join(before, ["cusip", "period"], "left").select(
        "cusip",
        "period",
        (F.col("ours") / F.col("filings") - 1).alias("level_gap"),
        (pct("ours", "ours_prev") - pct("filings", "filings_prev")).alias("change_gap_pts"),
        F.when(consistent, F.col("shares") / F.col("ref_shares") - 1).alias("shares_gap"),
    )


def reference_violations(gaps: DataFrame) -> DataFrame:
    """Rows beyond the accepted tolerances: 2 points of change, 11% of level, 6% of shares."""
    return gaps.agg(
        F.count_if(F.abs("change_gap_pts") > 2).alias("change"),
        F.count_if(F.abs("level_gap") > 0.11).alias("level"),
        F.count_if(F.abs("shares_gap") >= 0.06).alias("shares"),
    )
