"""The screen: stocks funds keep moving into, against the tide, with a high free cash flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import is_true
from tidegauge.functions.text import compact_key, symbol_key
from tidegauge.functions.verdicts import priced_in
from tidegauge.operators.fundamentals import asof_known_by
from tidegauge.params import Params

# Why a compared stock has no comparable cash flow, first applicable reason wins.
GAP_REASONS = ("no_ticker", "unverified_ticker", "not_in_sec_list", "no_full_year", "stale", "one_year")

_PRICE_COLUMNS = {
    "since_start_pct": "double",
    "quarter_pct": "double",
    "latest_close": "double",
    "latest_day": "date",
    "vs_market_pts": "double",
    "market_since_start_pct": "double",
    "price_source": "string",
    "dollar_volume": "double",
    "stale": "boolean",
}


def _keys(cash_flows: DataFrame) -> list[str]:
    return ["cusip", "period"] if "period" in cash_flows.columns else ["cusip"]


def _oldest_year(p: Params) -> Column:
    """Fiscal years ending on or before this are too old to compare with the period."""
    return F.add_months("period", -p.fiscal_max_age_months)


def _compared(stock_periods: DataFrame, stocks: DataFrame, min_funds: int) -> DataFrame:
    """Stock-quarters held by enough funds on both dates, named."""
    names = stocks.select(
        "cusip", "name_filed", "name_mixed", "title_of_class", "ticker", "ticker_source", "ticker_as_of",
        F.col("kind").alias("stock_kind"),
    )
    held = (F.col("funds_holding") >= min_funds) & (F.col("funds_prev") >= min_funds)
    return stock_periods.where(held).drop("kind").join(names, "cusip")


def _comparable() -> Column:
    return F.col("prior_free_cash_flow").isNotNull() & ~F.col("financial") & (F.col("median_price") > 0)


def _shares_agree(p: Params) -> Column:
    cover = F.col("shares_outstanding")
    agree = (cover / F.col("diluted_shares")).between(1 / p.shares_agree, p.shares_agree)
    return (cover.isNull() | agree) & (
        F.col("value") <= F.col("median_price") * p.shares_agree * F.col("diluted_shares")
    )


def with_prices(rows: DataFrame, stock_prices: DataFrame | None) -> DataFrame:
    """Price columns beside each stock-quarter, typed NULLs where there are no prices."""
    if stock_prices is None:
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in _PRICE_COLUMNS.items()})
    return rows.join(stock_prices.select("cusip", "period", *_PRICE_COLUMNS), ["cusip", "period"], "left")


def accumulate(
    stock_periods: DataFrame,
    stocks: DataFrame,
    cash_flows: DataFrame,
    stock_prices: DataFrame | None = None,
    p: Params = Params(),
    min_funds: int | None = None,
    min_yield: float | None = None,
    min_streak: int | None = None,
) -> DataFrame:
    """The picks of every period given. `cash_flows` has one row per stock, or per stock and
    period when each list reads only what was known by its date (`known_cash_flows`)."""
    min_funds = p.min_funds if min_funds is None else min_funds
    min_yield = p.min_yield if min_yield is None else min_yield
    min_streak = p.min_streak if min_streak is None else min_streak
    past = "period" in cash_flows.columns
    rule = (
        (F.col("vs_tide_pts") > 0)
        & (F.col("direction") > 0)
        & (F.col("streak") >= min_streak)
        & (F.col("net_flow") > 0)
        & (F.col("free_cash_flow") > 0)
        & (F.col("prior_free_cash_flow") > 0)
        & (F.col("fiscal_end") > _oldest_year(p))
        & _comparable()
        & _shares_agree(p)
    )
    market_value = F.col("median_price") * F.col("diluted_shares")
    chosen = (
        _compared(stock_periods, stocks, min_funds)
        .join(cash_flows, _keys(cash_flows))
        .where(rule)
        .withColumn("market_value", market_value)
        .withColumn("fcf_yield", F.col("lower_free_cash_flow") / F.col("market_value"))
        .where(F.col("fcf_yield") >= min_yield)
    )
    # A past list is measured to today's close, long after it came out: no verdict.
    verdict = F.lit(None).cast("string") if past else priced_in(F.col("vs_market_pts"), F.col("stale"), p.price_lag_pts)
    return with_prices(chosen, stock_prices).select(
        "period", "cusip", "name_filed", "name_mixed", "title_of_class", "ticker", "ticker_source", "ticker_as_of",
        "since_start_pct", "quarter_pct", "latest_close", "latest_day", "vs_market_pts", "market_since_start_pct",
        "price_source",
        F.try_divide("net_flow", "dollar_volume").alias("flow_share"),
        F.coalesce("stale", F.lit(False)).alias("stale"),
        F.col("funds_holding").alias("funds"),
        "funds_prev", "funds_pct", "filers_pct", "vs_tide_pts", "streak", "direction", "net_flow", "price_pct",
        "median_price", "free_cash_flow", "prior_free_cash_flow", "lower_free_cash_flow", "fiscal_end",
        "prior_fiscal_end", "entity_name", "market_value", "fcf_yield", verdict.alias("priced"),
    )


def ranking(by: str) -> Column:
    """yield, tide or price; a stale price says nothing of today's market and goes last."""
    orders = {
        "yield": F.col("fcf_yield").desc(),
        "tide": F.col("vs_tide_pts").desc(),
        "price": F.when(~F.col("stale"), F.col("vs_market_pts")).asc_nulls_last(),
    }
    return orders[by]


def top_picks(picks: DataFrame, by: str = "yield", limit: int = 50) -> DataFrame:
    return picks.orderBy(ranking(by), "cusip").limit(limit)


def known_cash_flows(stock_periods: DataFrame, lists: DataFrame, history: DataFrame, covers: DataFrame) -> DataFrame:
    """The financials each list could have read, for every stock in it: one as-of pass for all lists."""
    asked = stock_periods.select("cusip", "period").join(
        F.broadcast(lists.select("period", F.col("list_date").alias("known_by"))), "period"
    )
    return asof_known_by(asked, history, covers).drop("known_by")


def accumulate_coverage(
    stock_periods: DataFrame, stocks: DataFrame, cash_flows: DataFrame, p: Params = Params()
) -> DataFrame:
    """Per period: stocks compared, with comparable cash flow, financial, failing the share checks."""
    compared = _compared(stock_periods, stocks, p.min_funds)
    with_flows = compared.join(
        cash_flows.withColumn("_has", F.lit(True)), _keys(cash_flows), "left"
    )
    recent = is_true(F.col("_has") & (F.col("fiscal_end") > _oldest_year(p)))
    comparable = recent & is_true(_comparable())
    return with_flows.groupBy("period").agg(
        F.count_if(F.col("stock_kind") == "stock").alias("compared"),
        F.count_if(comparable).alias("with_cash_flow"),
        F.count_if(recent & F.col("financial")).alias("financial"),
        F.count_if(comparable & ~_shares_agree(p)).alias("shares_differ"),
    )


def accumulate_gaps(
    stock_periods: DataFrame,
    stocks: DataFrame,
    cash_flows: DataFrame,
    raw_sec_tickers: DataFrame | None,
    p: Params = Params(),
) -> DataFrame:
    """Per period, compared stocks without comparable figures by the first reason that applies."""
    compared = _compared(stock_periods, stocks, p.min_funds).where(F.col("stock_kind") == "stock")
    rows = compared.withColumn("key", compact_key(F.col("ticker"))).join(
        cash_flows.withColumn("_has", F.lit(True)), _keys(cash_flows), "left"
    )
    if raw_sec_tickers is not None:
        listed = raw_sec_tickers.select(compact_key(F.col("ticker")).alias("key"), F.lit(True).alias("_listed"))
        rows = rows.join(listed.distinct(), "key", "left")
    else:
        rows = rows.withColumn("_listed", F.lit(True))
    has = F.col("_has").isNotNull()
    reason = (
        F.when(has & (F.col("fiscal_end") <= _oldest_year(p)), "stale")
        .when(has & F.col("prior_free_cash_flow").isNull() & ~F.col("financial"), "one_year")
        .when(has, None)
        .when(F.col("ticker").isNull(), "no_ticker")
        .when(F.coalesce("ticker_source", F.lit("")) == "issuer-name", "unverified_ticker")
        .when(F.col("_listed").isNull(), "not_in_sec_list")
        .otherwise("no_full_year")
    )
    # One counter per reason keeps the zeros without a join against the reason list.
    counted = rows.withColumn("reason", reason).groupBy("period").agg(
        F.array(
            *(
                F.struct(F.lit(r).alias("reason"), F.count_if(F.col("reason") == r).alias("stocks"))
                for r in GAP_REASONS
            )
        ).alias("gaps")
    )
    return counted.select("period", F.inline("gaps"))


def financials_through(cash_flows: DataFrame) -> DataFrame:
    """The end of the latest fiscal year the list reads (one row)."""
    return cash_flows.agg(F.max("fiscal_end").alias("through"))


RUN_COLUMNS = (
    "run_at", "period", "rank", "cusip", "ticker", "name_filed", "name_mixed", "fcf_yield", "funds", "vs_tide_pts",
    "streak", "vs_market_pts", "rules",
)


def run_rows(picks: DataFrame, runs: DataFrame, p: Params = Params()) -> DataFrame:
    """Rows to append to the run history. `runs` has (run_at, period); a run whose list is empty
    leaves one marker row of rank 0."""
    rules = F.to_json(
        F.struct(
            F.lit(p.min_funds).alias("min_funds"),
            F.lit(p.min_yield).alias("min_yield"),
            F.lit(p.min_streak).alias("min_streak"),
        )
    )
    best_first = Window.partitionBy("period").orderBy(F.col("fcf_yield").desc(), "cusip")
    ranked = picks.select(
        "period", F.row_number().over(best_first).alias("rank"),
        *(c for c in RUN_COLUMNS if c not in ("run_at", "period", "rank", "rules")),
    )
    joined = runs.select("run_at", "period").join(ranked, "period", "left")
    return joined.withColumns(
        {
            "rank": F.coalesce("rank", F.lit(0)),
            "cusip": F.coalesce("cusip", F.lit("")),
            "rules": rules,
        }
    ).select(*RUN_COLUMNS)


def saved_runs(runs: DataFrame) -> DataFrame:
    """Each saved run and how many picks it holds."""
    return runs.groupBy("run_at").agg(F.count_if(F.col("rank") > 0).alias("picks"))


def run_diff(runs: DataFrame) -> DataFrame:
    """Entered, left and stayed between the two latest runs; nothing with fewer than two."""
    last_two = (
        runs.groupBy("run_at")
        .agg(F.min("period").alias("run_period"), F.min("rules").alias("run_rules"))
        .orderBy(F.col("run_at").desc())
        .limit(2)
    )
    facts = F.struct("run_at", "run_period", "run_rules")
    pair = last_two.agg(
        F.max(facts).alias("latest"), F.min(facts).alias("before"), F.count(F.lit(1)).alias("runs")
    ).where(F.col("runs") == 2)
    # Two rows, one per run.
    both_runs = pair.select(
        "latest", "before", F.explode(F.array("latest.run_at", "before.run_at")).alias("run_at")
    )
    rows = runs.where(F.col("rank") > 0).join(F.broadcast(both_runs), "run_at")
    is_latest = F.col("run_at") == F.col("latest.run_at")
    both = rows.groupBy(
        "cusip",
        (F.col("latest.run_period") != F.col("before.run_period")).alias("new_period"),
        (F.col("latest.run_rules") != F.col("before.run_rules")).alias("rules_changed"),
    ).agg(
        F.max(F.when(is_latest, F.col("rank"))).alias("rank_now"),
        F.max(F.when(~is_latest, F.col("rank"))).alias("rank_before"),
    )
    change = (
        F.when(F.col("rank_before").isNull(), "entered").when(F.col("rank_now").isNull(), "left").otherwise("stayed")
    )
    return both.withColumn("change", change)


def wanted_symbols(
    market: DataFrame, past_picks: DataFrame, candidates: DataFrame, watched: DataFrame
) -> DataFrame:
    """Symbols to keep prices for: the market, past and current picks, the watchlist's stocks."""

    def verified(table: DataFrame) -> DataFrame:
        ok = F.col("ticker").isNotNull() & (F.col("ticker_source") != "issuer-name")
        return table.where(ok).select(symbol_key(F.col("ticker")).alias("symbol"))

    named = verified(past_picks).union(verified(candidates)).union(verified(watched))
    return market.select("symbol").union(named).where(F.col("symbol") != "").distinct()
