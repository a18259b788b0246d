"""Thresholds for the checks: the driver's tables hold tens of managers where the defaults expect
thousands. Both the Spark queries and their SQL read them from here."""

from tidegauge.params import Params

PARAMS = Params(
    change_min_funds=10,
    change_min_moved=10,
    change_partial_moved=25,
    median_min_funds=10,
    min_funds=10,
    min_positions=3,
    min_yield=0.01,
    min_streak=1,
    shares_agree=3.0,
)

# Floating columns in dollars or shares, compared to the hundredth; others to the millionth.
LARGE = {
    "bought_value", "sold_value", "net_flow", "flow", "bought", "sold", "dollar_volume", "net_buying", "market_value",
    "bought_shares", "sold_shares", "operating_cash_flow", "capex", "free_cash_flow", "prior_free_cash_flow",
    "lower_free_cash_flow", "diluted_shares", "shares_outstanding", "val", "volume", "shares_prev", "shares_now",
}


def digits_of(column: str) -> int:
    return 2 if column in LARGE else 6
