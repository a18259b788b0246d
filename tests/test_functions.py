import datetime
import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.functions import dates, stats, text, verdicts
from tidegauge.functions.asof import asof
from tidegauge.functions.stats import _bucket, exact_median, first_per_group, middle_buckets
from tidegauge.operators.calendar import federal_holidays


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in _types(values).items()))
    return row.select(column.alias("v")).first()["v"]


def _types(values):
    return {k: "date" if isinstance(v, datetime.date) else "string" for k, v in values.items()}


NAMES = {
    "Apple Inc.": "APPLE",
    "APPLE INC": "APPLE",
    "U.S. Bancorp": "USBANCORP",
    "US BANCORP DEL": "USBANCORP",
    "BANK OF AMERICA CORP /DE/": "BANKOFAMERICA",
    "BERKSHIRE HATHAWAY INC DEL CL B": "BERKSHIREHATHAWAY",
    "The Kroger Co.": "KROGER",
    "UNILEVER N V": "UNILEVER",
    "SHELL P L C": "SHELL",
    "AT&T INC": "ATANDT",
    "MCDONALD'S CORP": "MCDONALDS",
    "N V": "NV",
    "INC": "",
    "SER A G": "SER",
    "LIBERTY MEDIA CORP SER A": "LIBERTYMEDIA",
    "FORD MTR CO CAP STK": "FORDMTR",
    "Telefonica S.A. SPONSORED ADR": "TELEFONICA",
}


def test_issuer_names_reduce_to_one_key(spark):
    rows = spark.createDataFrame(list(NAMES.items()), "name string, key string")
    found = rows.select("name", "key", text.issuer_name_key(F.col("name")).alias("mine")).collect()
    assert [(r["name"], r["mine"]) for r in found] == [(r["name"], r["key"]) for r in found]


@pytest.mark.parametrize(
    "code, valid",
    [("037833100", True), ("037833101", False), ("67066G104", True), ("G2004J103", True), ("000000001", False),
     ("03783310", False), ("0378331Aa", False), ("03783310X", False), ("", False)],
)
def test_check_digits(spark, code, valid):
    assert one(spark, text.valid_cusip(F.col("code")), code=code) is valid


@pytest.mark.parametrize(
    "ticker, symbol, compact", [("BRK/B", "BRK-B", "BRKB"), (" brk.b ", "BRK-B", "BRKB"), ("/A/", "A", "A")]
)
def test_ticker_keys(spark, ticker, symbol, compact):
    assert one(spark, text.symbol_key(F.col("t")), t=ticker) == symbol
    assert one(spark, text.compact_key(F.col("t")), t=ticker) == compact


@pytest.mark.parametrize(
    "filed, mixed, shown",
    [("NVIDIA CORPORATION", "NVIDIA Corporation", "NVIDIA Corporation"), ("APPLE INC", "", "Apple Inc"),
     ("SPDR S&P 500 ETF TR", "", "SPDR S&P 500 ETF Tr"), ("3M CO", "", "3M Co"), ("", "", "")],
)
def test_display_names(spark, filed, mixed, shown):
    assert one(spark, text.display_name(F.col("a"), F.col("b")), a=filed, b=mixed) == shown


def test_search_names_leave_suffixes_out(spark):
    assert one(spark, text.name_search_key(F.col("n")), n="The Apple Inc.") == "APPLE"


@pytest.mark.parametrize(
    "period, deadline",
    [("2024-06-30", "2024-08-14"), ("2024-12-31", "2025-02-14"), ("2025-12-31", "2026-02-17"), ("2020-09-30", "2020-11-16")],
)
def test_deadlines_skip_weekends_and_holidays(spark, period, deadline):
    day = datetime.date.fromisoformat(period)
    assert one(spark, dates.filing_deadline(F.col("p")), p=day) == datetime.date.fromisoformat(deadline)


def test_holidays_of_a_year(spark):
    rows = federal_holidays(spark.range(2026, 2027).select(F.col("id").cast("int").alias("year"))).collect()
    days = {str(r["holiday"]) for r in rows}
    assert days == {
        "2026-01-01", "2026-01-19", "2026-02-16", "2026-05-25", "2026-06-19", "2026-07-03", "2026-09-07", "2026-10-12",
        "2026-11-11", "2026-11-26", "2026-12-25",
    }


def test_list_date_follows_the_deadlines_month(spark):
    assert one(spark, dates.list_date(F.col("d")), d=datetime.date(2024, 8, 14)) == datetime.date(2024, 9, 14)


@pytest.mark.parametrize(
    "prev, now, filed, flagged, converted, action",
    [(None, 5.0, False, False, False, "first"), (5.0, 5.0, False, True, False, "first"), (5.0, 9.0, True, True, False, "check"),
     (None, 5.0, True, False, False, "new"), (5.0, None, True, False, False, "exit"), (5.0, 5.0, True, False, False, "hold"),
     (100.0, 100.9, True, False, True, "hold"), (100.0, 100.9, True, False, False, "add"), (100.0, 90.0, True, False, True, "trim")],
)
def test_manager_actions(spark, prev, now, filed, flagged, converted, action):
    row = spark.createDataFrame(
        [(prev, now, filed, flagged, converted)], "a double, b double, f boolean, c boolean, v boolean"
    )
    columns = map(F.col, ("a", "b", "f", "c", "v"))
    assert row.select(verdicts.manager_action(*columns).alias("x")).first()["x"] == action


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.one_of(st.none(), st.floats(-1e6, 1e6), st.integers(-3, 3).map(float))), max_size=40))
def test_median_equals_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r["k"]: (r["m"], r["n"]) for r in exact_median(df, ["k"], "v", "m", "n").collect()}
    for key in "ab":
        values = [v for k, v in rows if k == key and v is not None]
        if not values:
            assert key not in found
        else:
            assert found[key][0] == pytest.approx(statistics.median(values), rel=1e-12, abs=1e-12)
            assert found[key][1] == len(values)


def test_values_close_together_do_not_meet_in_one_task(spark):
    """A million values within 0.1 %, a third of them equal: at most a few hundred are ranked together."""
    n = 1_000_000
    tight = F.when(F.col("id") % 3 == 0, 50.0).otherwise(50.0 + F.pmod(F.xxhash64("id"), F.lit(n)) * (0.05 / n))
    df = spark.range(n).select(F.lit("k").alias("k"), tight.alias("v"))
    found = exact_median(df, ["k"], "v", "m", "n").first()
    assert found["n"] == n and found["m"] == df.agg(F.median("v")).first()[0]
    counted = df.groupBy("k", F.col("v").alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _bucket(F.col("_v")))
    parts = middle_buckets(counted, ["k"]).groupBy("k", "_b", "_s").count()
    assert parts.agg(F.max("count")).first()[0] < 1000


def test_a_dense_cluster_is_selected_in_rounds(spark, monkeypatch):
    """A million different values within 1e-7 of each other, an outlier far off, small keys and a null key beside
    them: what is left to rank in one task is bounded, and no key's median changes."""
    n, left = 1_000_000, []
    ranked = stats._between

    def watched(rows, keys, out, count):
        left.append(rows.groupBy(*keys, *(["_side"] if "_side" in rows.columns else [])).count().agg(F.max("count")).first()[0])
        return ranked(rows, keys, out, count)

    monkeypatch.setattr(stats, "_between", watched)
    dense = spark.range(n).select(F.lit("k").alias("k"), (F.lit(3.0) + F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * (3e-7 / (1 << 30))).alias("v"))
    few = spark.range(1001).select(F.when(F.col("id") % 2 == 0, F.lit("s")).alias("k"), F.col("id").cast("double").alias("v"))
    df = dense.union(few).union(spark.createDataFrame([("k", 1e300), ("k", -5.0)], "k string, v double")).repartition(8)
    found = {r["k"]: r["m"] for r in exact_median(df, ["k"], "v", "m").collect()}
    low, high = df.where("k = 'k'").selectExpr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v) AS a", "percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS b").first()
    assert found == {"k": low * 0.5 + high * 0.5, "s": 500.0, None: 500.0}
    assert max(left) <= stats._BOUND


def test_rounds_part_the_two_middles(spark, monkeypatch):
    """With room for two values, both halves of an even count are followed to values far apart."""
    monkeypatch.setattr(stats, "_BOUND", 2)
    values = [-1e6, -3.0, -2.999999, 0.0, 0.0, 1e-9, 7.0, 7.0000001, 7.0000002, 1e12]
    df = spark.createDataFrame([("e", v) for v in values] + [("o", v) for v in values[:9]] + [("p", v) for v in (1.0, 2.0, 3e5, 4e5)], "k string, v double")
    found = {r["k"]: (r["m"], r["n"]) for r in exact_median(df, ["k"], "v", "m", "n").collect()}
    assert found == {"e": (0.0 * 0.5 + 1e-9 * 0.5, 10), "o": (0.0, 9), "p": (2.0 * 0.5 + 3e5 * 0.5, 4)}



def test_asof_looks_both_ways(spark):
    day = lambda d: datetime.date(2024, 1, d)
    left = spark.createDataFrame([("x", day(5), 1), ("x", day(1), 2), ("y", day(5), 3)], "k string, t date, id int")
    right = spark.createDataFrame([("x", day(3), 30), ("x", day(5), 50), ("x", day(9), 90)], "k string, d date, v int")
    back = asof(left, right, "k", "t", "d", F.struct("v"), "f").select("id", "f.v").collect()
    ahead = asof(left, right, "k", "t", "d", F.struct("v"), "f", forward=True).select("id", "f.v").collect()
    assert {r["id"]: r["v"] for r in back} == {1: 50, 2: None, 3: None}
    assert {r["id"]: r["v"] for r in ahead} == {1: 50, 2: 30, 3: None}


def test_first_per_group_orders_by_several_keys(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "z"), ("a", 2, "y"), ("b", 0, "q")], "k string, n int, s string")
    rows = first_per_group(df, ["k"], [-F.col("n"), F.col("s")]).collect()
    assert {(r["k"], r["n"], r["s"]) for r in rows} == {("a", 2, "y"), ("b", 0, "q")}
