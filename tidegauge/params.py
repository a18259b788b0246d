"""Thresholds of the model, the screen and the backtest, with their published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Implied-price check: value / shares this many times off the market-wide median.
    price_factor: float = 3.0
    value_thousands: int = 1000
    # Share totals that move this many points beyond their value "outran" it.
    shares_vs_value_pts: float = 25.0
    # A stock counts for the typical change of its kind when held by this many on both dates.
    median_min_funds: int = 100
    # Identifier changes.
    change_min_funds: int = 20
    change_min_moved: int = 20
    change_same_ratio: float = 0.2
    change_partial_moved: int = 50
    change_partial_same: float = 0.5
    change_value_low: float = 0.1
    change_value_high: float = 10.0
    # Company financials.
    lender_share: float = 0.25
    ten_k_days: int = 90
    fiscal_gap_days: tuple[int, int] = (350, 380)
    fiscal_max_age_months: int = 18
    # Daily prices.
    market_symbol: str = "SPY"
    price_lookback_days: int = 7
    price_stale_days: int = 7
    # Screen.
    min_funds: int = 100
    min_yield: float = 0.05
    min_streak: int = 2
    shares_agree: float = 1.5
    price_lag_pts: float = 5.0
    publish_lag_days: int = 14
    # Backtest.
    min_priced_share: float = 0.9
    # Reads.
    min_positions: int = 10
    top_holders: int = 10
