"""Every model table, planned over its written inputs."""

from __future__ import annotations

from checks.oracle import rounded
from checks.registry import check

_POSITION_FLOATS = "implied_price median_price price_ratio"
_STOCK_FLOATS = (
    "filers_pct median_price median_price_prev bought_shares sold_shares bought_value sold_value net_flow funds_pct "
    "share_of_filers shares_pct value_pct market_median_pct vs_tide_pts vs_median_pts price_pct shares_vs_value_pts"
)
_YEAR_FLOATS = (
    "operating_cash_flow capex free_cash_flow diluted_shares prior_free_cash_flow lower_free_cash_flow shares_outstanding"
)
_PRICE_FLOATS = (
    "start_close end_close latest_close since_start_pct quarter_pct dollar_volume market_since_start_pct vs_market_pts"
)

MODEL_FLOATS = {
    "submissions": "",
    "periods": "",
    "filing_parts": "",
    "filings": "",
    "managers": "",
    "position_sums": "",
    "positions": _POSITION_FLOATS,
    "price_check": _POSITION_FLOATS,
    "cusip_holders": "",
    "cusip_changes": "exchange_ratio same_ratio value_ratio",
    "stock_keys": "ratio",
    "securities": "",
    "stocks": "",
    "holders": "median_price",
    "filers_total": "",
    "manager_totals": "",
    "changes": "bought_shares sold_shares",
    "stock_periods": _STOCK_FLOATS,
    "fundamentals_history": _YEAR_FLOATS,
    "fundamentals": _YEAR_FLOATS,
    "cover_history": "shares_outstanding",
    "stock_cash_flows_history": _YEAR_FLOATS,
    "stock_cash_flows": _YEAR_FLOATS,
    "stock_prices": _PRICE_FLOATS,
}
for _name, _floats in MODEL_FLOATS.items():
    check(_name, rounded(_name, _floats))(lambda m, name=_name: m.plan(name))
