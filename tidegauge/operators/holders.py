"""Per stock and quarter: who holds it, who opened, added, trimmed or left, and the net flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import exact_median, is_true, ratio_change
from tidegauge.sources.tables import staged
from tidegauge.operators.calendar import with_next
from tidegauge.operators.identity import linked_stocks
from tidegauge.params import Params


def _whole(total: Column) -> Column:
    """A share total as a whole number, halves to the even one."""
    return F.bround(total, 0).cast("bigint")


def holders(positions: DataFrame, stock_keys: DataFrame, cusip_holders: DataFrame) -> DataFrame:
    """Funds, shares, value and price of each stock, shares of replaced identifiers converted."""
    keyed = positions.where(F.col("shares") > 0).join(stock_keys, "cusip")
    kept = ~F.col("price_flag")
    converted = F.col("shares") * F.col("ratio")
    by_manager = keyed.groupBy("stock", "period", "cik").agg(
        *(
            F.sum(F.when(rule, amount)).alias(name)
            for name, rule, amount in (
                ("l_filed", F.lit(True), F.col("shares")),
                ("d_filed", F.lit(True), converted),
                ("l_shares", kept, F.col("shares")),
                ("d_shares", kept, converted),
                ("l_flagged", ~kept, F.col("shares")),
                ("d_flagged", ~kept, converted),
                ("value_filed", F.lit(True), F.col("value")),
                ("value", kept, F.col("value_checked")),
            )
        ),
        F.count_if("price_flag").alias("flagged_rows"),
        F.count_if("value_in_thousands").alias("thousands_rows"),
        F.bool_or(F.col("ratio") != 1).alias("converted"),
        F.max("median_price").alias("price"),
    )
    # One row per manager is left, so rows count the funds and nothing is counted twice.
    totals = by_manager.groupBy("stock", "period").agg(
        F.count(F.lit(1)).alias("funds_holding"),
        *(F.sum(c).alias(c) for c in ("l_filed", "d_filed", "l_shares", "d_shares", "l_flagged", "d_flagged")),
        *(F.sum(c).alias(c) for c in ("value_filed", "value", "flagged_rows", "thousands_rows")),
        F.bool_or("converted").alias("converted"),
        F.max("price").alias("price"),
    )
    linked = linked_stocks(stock_keys)
    in_todays_terms = keyed.join(linked, "stock", "left_semi").select(
        "stock", "period", (F.col("implied_price") / F.col("ratio")).alias("price_now")
    )
    medians = exact_median(in_todays_terms, ["stock", "period"], "price_now", "linked_price")
    codes = cusip_holders.join(stock_keys, "cusip").groupBy("stock", "period").agg(F.count(F.lit(1)).alias("cusips"))
    # Whole-number totals stay exact where nothing was converted.
    total = lambda n: F.when(F.col("converted"), _whole(F.col(f"d_{n}"))).otherwise(F.col(f"l_{n}"))
    return (
        totals.join(codes, ["stock", "period"])
        .join(medians, ["stock", "period"], "left")
        .select(
            F.col("stock").alias("cusip"),
            "period",
            "funds_holding",
            total("filed").alias("shares_filed"),
            "value_filed",
            total("shares").alias("shares"),
            "value",
            "flagged_rows",
            "thousands_rows",
            F.coalesce(total("flagged"), F.lit(0)).alias("flagged_shares"),
            F.coalesce("linked_price", "price").alias("median_price"),
            "cusips",
        )
    )


def position_pairs(
    positions: DataFrame, stock_keys: DataFrame, periods: DataFrame, with_first: bool = False
) -> DataFrame:
    """Each manager's holding of each stock in a period and the one before it, side by side; the
    first period, which has none before it, only where asked for.

    Every holding counts once as "now" and once as the next period's "before", so one aggregate
    does the work of a full outer self-join."""
    dates = F.broadcast(with_next(periods.select("period", "prev_period")))
    now_at = F.col("period") if with_first else F.when(F.col("prev_period").isNotNull(), F.col("period"))
    sides = F.array(
        F.struct(now_at.alias("at"), F.lit(True).alias("is_now")),
        F.struct(F.col("next_period").alias("at"), F.lit(False).alias("is_now")),
    )
    placed = (
        positions.where(F.col("shares") > 0)
        .join(stock_keys, "cusip")
        .join(dates, "period")
        .select(
            "stock",
            "cik",
            (F.col("shares") * F.col("ratio")).alias("held"),
            F.when(~F.col("price_flag"), F.col("value_checked")).alias("worth"),
            "price_flag",
            (F.col("cusip") != F.col("stock")).alias("replaced"),
            F.explode(sides).alias("side"),
        )
        .where(F.col("side.at").isNotNull())
    )
    now, before = F.col("side.is_now"), ~F.col("side.is_now")
    return placed.groupBy("stock", "cik", F.col("side.at").alias("period")).agg(
        F.sum(F.when(before, F.col("held"))).alias("shares_prev"),
        F.sum(F.when(now, F.col("held"))).alias("shares_now"),
        F.sum(F.when(before, F.col("worth"))).alias("value_prev"),
        F.sum(F.when(now, F.col("worth"))).alias("value_now"),
        F.bool_or("price_flag").alias("flagged"),
        F.coalesce(F.bool_or(F.when(before, F.col("replaced"))), F.lit(False)).alias("converted"),
    )


def report_pairs(filings: DataFrame, periods: DataFrame) -> DataFrame:
    """Per manager and period: whether a report with holdings is there now and was there before,
    and whether it is whole."""
    dates = F.broadcast(with_next(periods.select("period", "prev_period")))
    sides = F.array(
        F.struct(F.col("period").alias("at"), F.lit(True).alias("is_now")),
        F.struct(F.col("next_period").alias("at"), F.lit(False).alias("is_now")),
    )
    placed = (
        filings.where(F.col("lines") > 0)
        .join(dates, "period")
        .select("cik", "complete", F.explode(sides).alias("side"))
        .where(F.col("side.at").isNotNull())
    )
    any_of = lambda rule: F.coalesce(F.bool_or(rule), F.lit(False))
    now = F.col("side.is_now")
    return placed.groupBy("cik", F.col("side.at").alias("period")).agg(
        any_of(now & F.col("complete")).alias("filed_now"),
        any_of(~now & F.col("complete")).alias("filed_before"),
        any_of(now & ~F.col("complete")).alias("incomplete_now"),
        any_of(~now & ~F.col("complete")).alias("incomplete_before"),
    )


def changes(pairs: DataFrame, reports: DataFrame) -> DataFrame:
    """Per stock and period: what managers did, and shares bought and sold by those that filed a
    whole report on both dates (a manager that has not filed yet has not sold)."""
    prev, now = F.col("shares_prev"), F.col("shares_now")
    # Shares converted from an old identifier rarely match to the share: within 1% is held.
    same = is_true(
        F.when(F.col("converted"), F.abs(now - prev) <= prev * 0.01).otherwise(now == prev)
    )
    both = pairs.join(reports, ["cik", "period"], "left")
    filed, before = is_true(F.col("filed_now")), is_true(F.col("filed_before"))
    counted = ~F.col("flagged") & filed & before & ~same
    delta = F.coalesce(now, F.lit(0.0)) - F.coalesce(prev, F.lit(0.0))
    traded = lambda amount: F.coalesce(F.sum(F.when(counted, F.greatest(amount, F.lit(0.0)))), F.lit(0.0))
    had, has = prev.isNotNull(), now.isNotNull()
    return both.groupBy(F.col("stock").alias("cusip"), "period").agg(
        F.count_if(~had & has).alias("opened"),
        F.count_if(had & ~same & (now > prev)).alias("added"),
        F.count_if(had & same).alias("held"),
        F.count_if(had & ~same & (now < prev)).alias("trimmed"),
        F.count_if(had & ~has & filed).alias("sold_out"),
        F.count_if(had & ~has & ~filed).alias("not_yet_filed"),
        traded(delta).alias("bought_shares"),
        traded(-delta).alias("sold_shares"),
        F.count_if(has & ~before).alias("first_filers"),
    )


def tide(periods: DataFrame, filers_total: DataFrame) -> DataFrame:
    """The change in the number of filers, per period."""
    before = filers_total.select(F.col("period").alias("prev_period"), F.col("filers").alias("filers_prev"))
    pct = F.col("filers").cast("double") / F.nullif("filers_prev", F.lit(0)) - 1
    return (
        periods.select("period", "seq", "prev_period")
        .join(filers_total.select("period", "filers"), "period")
        .join(before, "prev_period", "left")
        .select("period", "seq", "prev_period", "filers", pct.alias("filers_pct"))
    )


def streaks(signed: DataFrame) -> DataFrame:
    """Periods in a row with the same direction (gaps and islands; no direction counts 0)."""
    same_way = Window.partitionBy("cusip", "direction").orderBy("seq")
    in_island = Window.partitionBy("cusip", "direction", "island").orderBy("seq")
    run = F.when(F.col("direction").isNull(), 0).otherwise(F.row_number().over(in_island))
    return (
        signed.withColumn("island", F.col("seq") - F.row_number().over(same_way))
        .withColumn("streak", run)
        .drop("island")
    )


def stock_periods(
    holders: DataFrame,
    changes: DataFrame,
    periods: DataFrame,
    filers_total: DataFrame,
    stocks: DataFrame | None,
    p: Params = Params(),
) -> DataFrame:
    """Everything about a stock in a quarter: changes, tide and typical gaps, share check, flow, streak."""
    dated = F.broadcast(tide(periods, filers_total))
    # The period before comes from the spine, never from the row before: a gap gives NULL.
    ahead = F.broadcast(with_next(periods.select("period")))
    before = (
        holders.join(ahead, "period")
        .where(F.col("next_period").isNotNull())
        .select(
            "cusip",
            F.col("next_period").alias("period"),
            F.col("funds_holding").alias("funds_prev"),
            F.col("shares").alias("shares_prev"),
            F.col("value").alias("value_prev"),
            F.col("median_price").alias("median_price_prev"),
        )
    )
    base = (
        holders.drop("thousands_rows", "cusips")
        .join(dated, "period")
        .join(before, ["cusip", "period"], "left")
        .join(changes.select("cusip", "period", "bought_shares", "sold_shares"), ["cusip", "period"], "left")
    )
    if stocks is not None:
        base = base.join(stocks.select("cusip", "kind"), "cusip", "left")
    else:
        base = base.withColumn("kind", F.lit(None).cast("string"))
    price, price_prev = F.col("median_price"), F.col("median_price_prev")
    changed = base.withColumns(
        {
            "kind": F.coalesce("kind", F.lit("stock")),
            "bought_value": F.col("bought_shares") * price,
            "sold_value": F.col("sold_shares") * price,
            "net_flow": (F.col("bought_shares") - F.col("sold_shares")) * price,
            "funds_change": F.col("funds_holding") - F.coalesce("funds_prev", F.lit(0)),
            "funds_pct": ratio_change(F.col("funds_holding"), F.col("funds_prev")),
            "share_of_filers": F.try_divide(F.col("funds_holding").cast("double"), F.col("filers")),
            "shares_pct": ratio_change(F.col("shares"), F.col("shares_prev")),
            "value_pct": ratio_change(F.col("value"), F.col("value_prev")),
        }
    )
    # Read by the median and by the result: written once.
    changed = staged(changed, "changed")
    compared = changed.where(
        (F.col("funds_holding") >= p.median_min_funds) & (F.col("funds_prev") >= p.median_min_funds)
    ).select("period", "kind", "funds_pct")
    typical = exact_median(compared, ["period", "kind"], "funds_pct", "market_median_pct", "market_median_stocks")
    price_moved = F.try_divide(price, price_prev)
    gap = ((F.col("shares_pct") + 1) - F.try_divide(F.col("value_pct") + 1, price_moved)) * 100
    unknown = (
        F.col("shares_pct").isNull() | F.col("value_pct").isNull()
        | (F.coalesce(price_prev, F.lit(0.0)) <= 0) | (F.coalesce(price, F.lit(0.0)) <= 0)
    )
    checked = changed.join(typical, ["period", "kind"], "left").withColumns(
        {
            "vs_tide_pts": (F.col("funds_pct") - F.col("filers_pct")) * 100,
            "vs_median_pts": (F.col("funds_pct") - F.col("market_median_pct")) * 100,
            "price_pct": price_moved - 1,
            "shares_vs_value_pts": gap,
            "share_check": F.when(unknown, "none")
            .when(F.abs(gap) < p.shares_vs_value_pts, "ok")
            .otherwise("outran"),
            "direction": F.when(F.col("funds_prev").isNotNull(), F.signum("funds_change").cast("int")),
        }
    )
    return streaks(checked).select(*STOCK_PERIOD_COLUMNS)


STOCK_PERIOD_COLUMNS = (
    "cusip", "period", "seq", "prev_period", "filers", "filers_pct", "kind", "funds_holding", "shares", "value",
    "shares_filed", "value_filed", "flagged_rows", "flagged_shares", "median_price", "funds_prev", "shares_prev",
    "value_prev", "median_price_prev", "bought_shares", "sold_shares", "bought_value", "sold_value", "net_flow",
    "funds_change", "funds_pct", "share_of_filers", "shares_pct", "value_pct", "market_median_pct",
    "market_median_stocks", "vs_tide_pts", "vs_median_pts", "price_pct", "shares_vs_value_pts", "share_check",
    "direction", "streak",
)
