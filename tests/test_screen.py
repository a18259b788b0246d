import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.verdicts import priced_in
from tidegauge.operators import backtest, fundamentals, prices, screen
from tidegauge.params import Params

P = Params()
Q2 = datetime.date(2026, 6, 30)
DAY = datetime.date.fromisoformat
STOCKS = (
    "cusip string, name_filed string, name_mixed string, title_of_class string, ticker string, ticker_source string, "
    "ticker_as_of date, kind string"
)
PERIODS = (
    "cusip string, period date, funds_holding bigint, funds_prev bigint, funds_pct double, filers_pct double, "
    "vs_tide_pts double, streak int, direction int, net_flow double, price_pct double, median_price double, value bigint, kind string"
)
CASH = (
    "cusip string, free_cash_flow double, prior_free_cash_flow double, lower_free_cash_flow double, fiscal_end date, "
    "prior_fiscal_end date, entity_name string, diluted_shares double, shares_outstanding double, financial boolean"
)
# One rule broken at a time: what differs from the row that complies.
BROKEN = {
    "ok": {}, "streak": {"streak": 1}, "tide": {"vs_tide_pts": -1.0}, "flow": {"net_flow": -5.0},
    "prior": {"prior_free_cash_flow": -1.0}, "yield": {"lower_free_cash_flow": 4e9}, "bank": {"financial": True},
    "cover": {"shares_outstanding": 2e9}, "worth": {"value": 160_000_000_000}, "old": {"fiscal_end": DAY("2024-12-30")},
    "few": {"funds_prev": 99}, "year": {"prior_free_cash_flow": None},
}


def tables(spark, cases=BROKEN):
    stocks, periods, cash = [], [], []
    for name, off in cases.items():
        g = lambda k, v, off=off: off.get(k, v)
        stocks.append((name, name.upper(), None, "COM", name.upper(), "openfigi", None, "stock"))
        periods.append(
            (name, Q2, 150, g("funds_prev", 120), 0.25, 0.05, g("vs_tide_pts", 20.0), g("streak", 2), 1,
             g("net_flow", 1e9), 0.1, 100.0, g("value", 50_000_000_000), "stock")
        )
        cash.append(
            (name, 7e9, g("prior_free_cash_flow", 6e9), g("lower_free_cash_flow", 6e9), g("fiscal_end", DAY("2025-12-31")),
             DAY("2024-12-31"), name, 1e9, g("shares_outstanding", 1e9), g("financial", False))
        )
    return (
        spark.createDataFrame(periods, PERIODS), spark.createDataFrame(stocks, STOCKS), spark.createDataFrame(cash, CASH)
    )


def test_only_the_stock_that_keeps_every_rule_is_picked(spark):
    rows = screen.accumulate(*tables(spark), None, P).collect()
    assert [r["cusip"] for r in rows] == ["ok"]
    assert rows[0]["fcf_yield"] == pytest.approx(0.06) and rows[0]["market_value"] == 1e11
    assert rows[0]["vs_market_pts"] is None and rows[0]["priced"] is None


def test_coverage_and_gaps_count_what_is_left_out(spark):
    periods, stocks, cash = tables(spark)
    row = screen.accumulate_coverage(periods, stocks, cash, P).first()
    assert (row["compared"], row["with_cash_flow"], row["financial"], row["shares_differ"]) == (11, 8, 1, 2)
    gaps = {r["reason"]: r["stocks"] for r in screen.accumulate_gaps(periods, stocks, cash.where("cusip <> 'ok'"), None, P).collect()}
    assert gaps == {
        "no_ticker": 0, "unverified_ticker": 0, "not_in_sec_list": 0, "no_full_year": 1, "stale": 1, "one_year": 1,
    }


def test_a_stale_price_ranks_last(spark):
    rows = spark.createDataFrame(
        [("a", -9.0, True), ("b", 3.0, False), ("c", -4.0, False), ("d", None, False)], "cusip string, vs_market_pts double, stale boolean"
    )
    assert [r["cusip"] for r in screen.top_picks(rows, "price", 9).collect()] == ["c", "b", "a", "d"]


@pytest.mark.parametrize(
    "pts, stale, verdict",
    [(None, False, None), (-9.0, True, "stale"), (-5.0, False, "lagging"), (5.0, False, "ahead"), (4.9, None, "in line")],
)
def test_priced_in(spark, pts, stale, verdict):
    row = spark.createDataFrame([(pts, stale)], "a double, b boolean")
    assert row.select(priced_in(F.col("a"), F.col("b"), 5.0).alias("v")).first()["v"] == verdict


def test_past_lists_read_only_what_was_known(spark):
    history = spark.createDataFrame(
        [("s", 1, DAY("2023-12-31"), 1.0, 5.0, DAY("2024-03-30"), 2), ("s", 1, DAY("2024-12-31"), 2.0, 5.0, DAY("2025-03-31"), 1)],
        "cusip string, cik bigint, fiscal_end date, free_cash_flow double, shares_outstanding double, known_from date, n int",
    ).withColumn("shares_as_of", F.lit(None).cast("date"))
    covers = spark.createDataFrame([(1, DAY("2024-06-30"), 7.0)], "cik bigint, shares_as_of date, shares_outstanding double")
    asked = spark.createDataFrame(
        [("s", DAY(d)) for d in ("2024-03-29", "2024-03-30", "2025-03-30", "2025-03-31")], "cusip string, known_by date"
    )
    rows = fundamentals.asof_known_by(asked, history, covers).orderBy("known_by").collect()
    assert [(str(r["known_by"]), r["free_cash_flow"], r["shares_outstanding"]) for r in rows] == [
        ("2024-03-30", 1.0, None), ("2025-03-30", 1.0, 7.0), ("2025-03-31", 2.0, 7.0),
    ]


FACT = "cik bigint, tag string, unit string, period_end date, val double, taxonomy string, entity_name string, accn string"


def facts(spark, rows):
    unit = lambda tag: "shares" if "Shares" in tag else "USD"
    full = [
        (1, tag, unit(tag), DAY(end), float(val), "dei" if tag.startswith("Entity") else "us-gaap", "Co", "acc")
        for tag, end, val in rows
    ]
    return spark.createDataFrame(full, FACT)


CFO, CAPEX = "NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment"
DILUTED = "WeightedAverageNumberOfDilutedSharesOutstanding"


def year(end, cash, capex=10):
    return [(CFO, end, cash), (CAPEX, end, capex), (DILUTED, end, 5)]


@pytest.mark.parametrize(
    "rows, lower, financial",
    [
        (year("2025-12-31", 100) + year("2024-12-31", 60), 50.0, False),
        (year("2025-12-31", 100), None, False),
        (year("2025-12-31", 100) + year("2023-12-31", 60), None, False),
        (year("2025-12-31", 100) + year("2024-12-31", 60) + [("Deposits", "2020-03-31", 1)], 50.0, True),
        (year("2025-12-31", 100) + year("2024-12-31", 60)
         + [("InterestAndFeeIncomeLoansConsumer", "2024-12-31", 25), ("Revenues", "2024-12-31", 100)], 50.0, True),
        (year("2025-12-31", 100) + year("2024-12-31", 60)
         + [("InterestAndFeeIncomeLoansConsumer", "2024-12-31", 24), ("Revenues", "2024-12-31", 100)], 50.0, False),
        (year("2025-12-31", 100) + [("InterestAndFeeIncomeLoansConsumer", "2025-12-31", 1)], None, True),
        (year("2025-12-31", 100) + [("NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "2025-12-31", 999)], None, False),
    ],
)
def test_fiscal_years(spark, rows, lower, financial):
    latest = fundamentals.fundamentals_history(facts(spark, rows), P).where("n = 1").first()
    assert latest["free_cash_flow"] == 90.0
    assert (latest["lower_free_cash_flow"], latest["financial"]) == (lower, financial)
    assert str(latest["known_from"]) == "2026-03-31"


def days(symbol, *closes):
    return [(symbol, DAY(d), float(c)) for d, c in closes]


def test_trades_at_their_edges(spark):
    prices = spark.createDataFrame(
        days("A", ("2026-01-05", 100), ("2026-03-30", 150), ("2026-04-02", 999))  # an ordinary holding
        + days("B", ("2026-01-09", 100), ("2026-03-30", 150))  # the first close comes too late
        + days("C", ("2026-01-02", 100), ("2026-02-10", 40))  # prices end early: held as cash
        + days("D", ("2026-01-02", 100))  # nothing to sell at
        + days("E", ("2026-01-01", 0), ("2026-01-02", 10), ("2026-03-31", 20)),
        "symbol string, day date, close double",
    )
    trades = spark.createDataFrame(
        [(s, DAY("2026-01-01"), DAY("2026-04-01")) for s in "ABCDEF"], "symbol string, list_date date, exit_date date"
    )
    rows = {r["symbol"]: r for r in backtest.held_returns(trades, prices, P).collect()}
    returns = {s: None if r["ret"] is None else round(r["ret"], 6) for s, r in rows.items()}
    assert returns == {"A": 0.5, "B": None, "C": -0.6, "D": None, "E": 1.0, "F": None}
    assert [s for s, r in rows.items() if r["ended"]] == ["C"]


def test_quarters_and_totals(spark):
    lists = spark.createDataFrame(
        [(DAY("2025-03-31"), "Q1", DAY("2025-06-14"), DAY("2025-09-14"), False, 0.1),
         (DAY("2025-06-30"), "Q2", DAY("2025-09-14"), DAY("2025-12-14"), False, 0.0),
         (DAY("2025-09-30"), "Q3", DAY("2025-12-14"), DAY("2026-03-14"), False, None),
         (DAY("2025-12-31"), "Q4", DAY("2026-03-14"), DAY("2026-05-01"), True, 0.2)],
        "period date, label string, list_date date, exit_date date, open boolean, market_ret double",
    )
    picks = spark.createDataFrame(
        [(DAY("2025-03-31"), 0.3, False), (DAY("2025-03-31"), 0.1, True), (DAY("2025-06-30"), 0.5, False),
         (DAY("2025-06-30"), None, False), (DAY("2025-09-30"), 0.2, False)],
        "period date, ret double, ended boolean",
    )
    quarters = backtest.backtest_quarters(lists, picks, P)
    rows = {r["label"]: r for r in quarters.collect()}
    assert (rows["Q1"]["ret"], rows["Q1"]["beat"], rows["Q1"]["ended"], rows["Q1"]["complete"]) == (0.2, 1, 1, True)
    assert rows["Q2"]["complete"] is False and rows["Q3"]["beat"] is None and rows["Q4"]["complete"] is True
    totals = backtest.backtest_totals(quarters).first()
    assert (totals["closed_quarters"], totals["too_few_prices"]) == (1, 1)
    assert totals["list_return"] == pytest.approx(0.2) and totals["market_return"] == pytest.approx(0.1)


def test_closes_near_a_day_equal_brute_force(spark):
    """Days in months with and without closes, before the first and after the last, on a close itself, twice over, and
    missing; the scan is cut to the days."""
    draw = random.Random(6)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    closes = [(s, day(n), float(n + len(s))) for s in ("x", "yy", "z") for n in draw.sample(range(0, 700), 40)]
    closes = list({(s, d): (s, d, c) for s, d, c in closes}.values())
    asked = [(i, draw.choice(("x", "yy", "none", None)), draw.choice((day(draw.randint(-40, 760)), closes[i % len(closes)][1]))) for i in range(200)]
    asked += [(300, "x", None), *((400 + i, *asked[0][1:]) for i in range(3))]
    raw = spark.createDataFrame([(s, d, c, 1.0, "a") for s, d, c in closes] + [("x", None, 1.0, 1.0, "a"), ("x", day(5), -1.0, 1.0, "a")], "symbol string, day date, close double, volume double, source string")
    dates = spark.createDataFrame(asked, "id int, symbol string, at date")
    for look, side, best in (
        (prices.first_close_on_or_after, lambda d, at: d >= at, min), (prices.last_close_on_or_before, lambda d, at: d <= at, max),
    ):
        found = look(dates, raw, "at", "f")
        got = {r["id"]: r["f"] and (r["f"]["day"], r["f"]["close"]) for r in found.collect()}
        want = {i: best(((d, c) for s, d, c in closes if s == symbol and at and side(d, at)), default=None) for i, symbol, at in asked}
        assert got == want and found.columns == ["id", "symbol", "at", "f"]
        assert look(dates.where("at is null"), raw, "at", "f").where("f is not null").count() == 0


def test_runs_are_compared(spark):
    at = lambda d: datetime.datetime(2026, 1, d)
    schema = "run_at timestamp_ntz, period date, rank int, cusip string, rules string"
    rows = [(at(1), Q2, 1, "z", "r"), (at(2), Q2, 1, "a", "r"), (at(2), Q2, 2, "b", "r"), (at(3), Q2, 1, "b", "s"), (at(3), Q2, 2, "c", "s")]
    diff = {r["cusip"]: r for r in screen.run_diff(spark.createDataFrame(rows, schema)).collect()}
    assert {c: r["change"] for c, r in diff.items()} == {"a": "left", "b": "stayed", "c": "entered"}
    assert diff["b"]["rules_changed"] and not diff["b"]["new_period"]
    assert screen.run_diff(spark.createDataFrame(rows[:1], schema)).count() == 0


def test_an_empty_list_leaves_a_marker(spark):
    picks = screen.accumulate(*tables(spark, {"streak": BROKEN["streak"]}), None, P)
    runs = spark.createDataFrame([(datetime.datetime(2026, 8, 1), Q2)], "run_at timestamp_ntz, period date")
    row = screen.run_rows(picks, runs, P).first()
    assert (row["rank"], row["cusip"], row["rules"]) == (0, "", '{"min_funds":100,"min_yield":0.05,"min_streak":2}')
