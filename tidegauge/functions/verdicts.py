"""Row-level classifications: kind of security, what a manager did, where a price stands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.stats import is_true

# Security types of the lookup service.
STOCK_TYPES = (
    "Common Stock", "ADR", "REIT", "MLP", "Royalty Trst", "Ltd Part", "NY Reg Shrs", "GDR", "CDI",
    "Stapled Security", "NVDR", "Foreign Sh.",
)
ETF_TYPES = ("ETP",)
# Words of a share class that is neither a stock nor an ETF.
OTHER_CLASS_WORDS = (
    "NOTE", "NOTES", "PFD", "PREF", "WT", "WTS", "WARRANT", "WARRANTS", "RIGHT", "RIGHTS",
    "UNIT", "UNITS", "DEBT", "BOND",
)


def security_kind(security_type: Column, title_of_class: Column, name_filed: Column) -> Column:
    """stock, etf or other: by the security type, else by what filers wrote."""
    title = F.upper(F.coalesce(title_of_class, F.lit("")))
    wording = F.concat(title, F.lit(" "), name_filed)
    by_words = (
        F.when(F.upper(wording).rlike(r"\bETFS?\b"), "etf")
        .when(title.rlike(rf"\b({'|'.join(OTHER_CLASS_WORDS)})\b"), "other")
        .otherwise("stock")
    )
    return (
        F.when(security_type.isNull(), by_words)
        .when(security_type.isin(*ETF_TYPES), "etf")
        .when(security_type.isin(*STOCK_TYPES), "stock")
        .otherwise("other")
    )


def priced_in(vs_market_pts: Column, stale: Column, lag_pts: float) -> Column:
    """Whether a flow shows in the price yet: stale, lagging, ahead, in line, NULL unpriced."""
    return (
        F.when(vs_market_pts.isNull(), F.lit(None).cast("string"))
        .when(is_true(stale), "stale")
        .when(vs_market_pts <= -lag_pts, "lagging")
        .when(vs_market_pts >= lag_pts, "ahead")
        .otherwise("in line")
    )


def manager_action(prev: Column, now: Column, filed_before: Column, flagged: Column, converted: Column) -> Column:
    """first, check, new, exit, hold, add or trim, in that order of precedence."""
    holds, held = F.coalesce(now, F.lit(0)) != 0, F.coalesce(prev, F.lit(0)) != 0
    same = (now == prev) | (is_true(converted) & (F.abs(now - prev) <= prev * 0.01))
    return (
        F.when(holds & ~is_true(filed_before), "first")
        .when(is_true(flagged), "check")
        .when(~held, "new")
        .when(~holds, "exit")
        .when(same, "hold")
        .when(now > prev, "add")
        .otherwise("trim")
    )
