"""The screen, its run history and its backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.context import CheckModel
from checks.oracle import cut, rounded
from checks.registry import check
from checks.settings import PARAMS as P
from tidegauge.operators import backtest, calendar, prices, screen

_FLOATS = (
    "since_start_pct quarter_pct latest_close vs_market_pts market_since_start_pct flow_share funds_pct filers_pct "
    "vs_tide_pts net_flow price_pct median_price free_cash_flow prior_free_cash_flow lower_free_cash_flow market_value "
    "fcf_yield"
)


def _lists(m: CheckModel) -> DataFrame:
    return calendar.list_dates(m.table("periods"), P.publish_lag_days)


def _inputs(m: CheckModel) -> tuple[DataFrame, ...]:
    return m.table("stock_periods"), m.table("stocks")


def _latest(m: CheckModel) -> DataFrame:
    """The default period's stock-quarters."""
    one = F.broadcast(calendar.default_period(m.table("periods")))
    return m.table("stock_periods").join(one, "period", "left_semi")


def _known(m: CheckModel) -> DataFrame:
    return screen.known_cash_flows(
        m.table("stock_periods"), _lists(m), m.table("stock_cash_flows_history"), m.table("cover_history")
    )


def _past(m: CheckModel) -> DataFrame:
    return screen.accumulate(*_inputs(m), _known(m), m.table("stock_prices"), P)


def _now(m: CheckModel) -> DataFrame:
    return screen.accumulate(_latest(m), m.table("stocks"), m.table("stock_cash_flows"), m.table("stock_prices"), P)


check("default_period", "SELECT period FROM default_period")(lambda m: calendar.default_period(m.table("periods")))
check("list_date", "SELECT * FROM list_dates")(_lists)
check(
    "asof_known_by",
    rounded(
        "known_cash_flows",
        "operating_cash_flow capex free_cash_flow diluted_shares prior_free_cash_flow lower_free_cash_flow shares_outstanding",
    ),
)(_known)
check("accumulate_all_periods", rounded("picks_now", _FLOATS))(
    lambda m: screen.accumulate(*_inputs(m), m.table("stock_cash_flows"), m.table("stock_prices"), P)
)
check("accumulate_past_lists", rounded("picks_past", _FLOATS))(_past)
_ORDERS = {
    "yield": "fcf_yield DESC",
    "tide": "vs_tide_pts DESC",
    "price": "CASE WHEN NOT stale THEN vs_market_pts END ASC NULLS LAST",
}
for _by, _order in _ORDERS.items():
    _top = f"(SELECT * FROM picks_now WHERE period = (SELECT period FROM default_period) ORDER BY {_order}, cusip LIMIT 5)"
    check("accumulate" if _by == "yield" else f"accumulate_by_{_by}", rounded(_top, _FLOATS))(
        lambda m, by=_by: screen.top_picks(_now(m), by, 5)
    )
check("accumulate_coverage", "SELECT * FROM accumulate_coverage")(
    lambda m: screen.accumulate_coverage(*_inputs(m), m.table("stock_cash_flows"), P)
)
check("accumulate_gaps", "SELECT * FROM accumulate_gaps")(
    lambda m: screen.accumulate_gaps(*_inputs(m), m.table("stock_cash_flows"), m.table("raw_sec_tickers"), P)
)
check("financials_through", "SELECT max(fiscal_end) AS through FROM stock_cash_flows")(
    lambda m: screen.financials_through(m.table("stock_cash_flows"))
)


def _runs(m: CheckModel) -> DataFrame:
    made = _lists(m).select(F.col("list_date").cast("timestamp_ntz").alias("run_at"), "period")
    return screen.run_rows(_past(m), made, P)


check("append_run_history", rounded("saved_runs", "fcf_yield vs_tide_pts vs_market_pts"))(_runs)
check("saved_runs", "SELECT run_at, count(*) FILTER (rank > 0) AS picks FROM saved_runs GROUP BY run_at")(
    lambda m: screen.saved_runs(_runs(m))
)
check("run_diff", "SELECT * FROM run_diff")(lambda m: screen.run_diff(_runs(m)))


def _wanted(m: CheckModel) -> DataFrame:
    market = m.table("raw_prices").where(F.col("symbol") == P.market_symbol).select("symbol")
    candidates = screen.accumulate(_latest(m), m.table("stocks"), m.table("stock_cash_flows"), None, P, None, 0.0, 1)
    watched = m.table("stocks").join(m.table("watchlist").select("cusip"), "cusip", "left_semi")
    return screen.wanted_symbols(market, _past(m), candidates, watched)


check(
    "wanted_symbols",
    """
SELECT 'SPY' AS symbol UNION
SELECT y.symbol FROM stock_symbols y WHERE y.symbol <> '' AND (
    y.cusip IN (SELECT cusip FROM picks_past)
    OR y.cusip IN (SELECT cusip FROM candidates_now WHERE period = (SELECT period FROM default_period))
    OR y.cusip IN (SELECT cusip FROM watchlist))
""",
)(_wanted)


# The lists, their picks and the results are written as they are drawn, each step reading the last.


def _open_lists(m: CheckModel) -> DataFrame:
    return backtest.backtest_lists(_lists(m), m.table("raw_prices"), P)


def _kept_lists(m: CheckModel) -> DataFrame:
    return m.derived("backtest_lists", lambda: _open_lists(m))


def _results(m: CheckModel) -> DataFrame:
    picks = m.derived("past_picks", lambda: _past(m))
    return backtest.backtest_picks(_kept_lists(m), picks, m.table("raw_prices"), P)


def _quarters(m: CheckModel) -> DataFrame:
    return backtest.backtest_quarters(_kept_lists(m), m.derived("backtest_picks", lambda: _results(m)), P)


check("backtest_lists", rounded("backtest_lists", "market_ret"))(_open_lists)
check("backtest_picks", rounded("backtest_picks", "fcf_yield ret"))(_results)
check("backtest_quarters", rounded("backtest_quarters", "ret market_ret excess"))(_quarters)
check("backtest_totals", rounded("backtest_totals", "list_return market_return"))(
    lambda m: backtest.backtest_totals(_quarters(m))
)


def _stock_days(m: CheckModel) -> DataFrame:
    """Every list date of every symbol with prices."""
    symbols = m.table("raw_prices").select("symbol").distinct()
    days = _lists(m).agg(F.collect_list("list_date").alias("days"))  # four list dates a year
    return symbols.select("symbol", F.explode(days.scalar()).alias("asked"))


for _name, _way, _edge in (
    ("first_close_on_or_after", ">=", "min"),
    ("last_close_on_or_before", "<=", "max"),
):
    check(
        _name,
        f"""
SELECT s.symbol, d.list_date AS asked, x.day, {cut("x.close", "close")}
FROM (SELECT DISTINCT symbol FROM raw_prices) s, list_dates d
LEFT JOIN good_prices x ON x.symbol = s.symbol AND x.day =
    (SELECT {_edge}(g.day) FROM good_prices g WHERE g.symbol = s.symbol AND g.day {_way} d.list_date)
""",
    )(
        lambda m, way=getattr(prices, _name): way(_stock_days(m), m.table("raw_prices"), "asked", "f").select(
            "symbol", "asked", "f.day", "f.close"
        )
    )
check("asof_close_at_period", rounded("close_at_period", "close"))(
    lambda m: prices.close_at_period(m.table("quarter_prices"), m.table("periods"))
)
check("traded_in_quarter", rounded("traded_in_quarter", "dollar_volume"))(
    lambda m: prices.traded_in_quarter(m.table("quarter_prices"), m.table("periods"))
)
check("market_on_own_latest", rounded("market_on_own_latest", "market_close"))(
    lambda m: prices.market_on_own_latest(
        prices.latest_prices(m.table("quarter_prices")), m.table("market_days"), P
    )
)
check(
    "stock_price_lookup",
    f"""
SELECT * REPLACE ({", ".join(cut(c, c) for c in "start_close end_close latest_close since_start_pct quarter_pct dollar_volume market_since_start_pct vs_market_pts".split())})
FROM (SELECT s.*, d.prev_period AS quarter_start,
        CASE WHEN vs_market_pts IS NULL THEN NULL WHEN stale THEN 'stale' WHEN vs_market_pts <= -{P.price_lag_pts} THEN 'lagging'
             WHEN vs_market_pts < {P.price_lag_pts} THEN 'in line' ELSE 'ahead' END AS priced
      FROM stock_prices s JOIN periods d ON d.period = s.period WHERE since_start_pct IS NOT NULL)
""",
)(lambda m: prices.stock_price_lookup(m.table("stock_prices"), m.table("periods"), P))
check(
    "prices_status",
    "SELECT max(latest_day) AS through, list(DISTINCT price_source ORDER BY price_source) AS sources FROM stock_prices "
    "WHERE price_source IS NOT NULL",
)(lambda m: prices.prices_status(m.table("stock_prices")))
check(
    "priced_in",
    f"""
SELECT period, priced, count(*) AS stocks FROM (
    SELECT period, CASE WHEN vs_market_pts IS NULL THEN NULL WHEN stale THEN 'stale'
        WHEN vs_market_pts >= {P.price_lag_pts} THEN 'ahead' WHEN vs_market_pts <= -{P.price_lag_pts} THEN 'lagging'
        ELSE 'in line' END AS priced FROM stock_prices)
GROUP BY period, priced
""",
)(
    lambda m: prices.stock_price_lookup(m.table("stock_prices"), m.table("periods"), P)
    .groupBy("period", "priced")
    .agg(F.count(F.lit(1)).alias("stocks"))
)
