"""Each past list, drawn as it could have been read then, held until the next one came out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.stats import product_minus_one
from tidegauge.functions.text import symbol_key
from tidegauge.operators.prices import market_days, usable_prices
from tidegauge.params import Params


def backtest_lists(list_dates: DataFrame, raw_prices: DataFrame, p: Params = Params()) -> DataFrame:
    """The lists prices reach: list date, exit date (the next list's, or the latest market day while
    open) and the market's return between them."""
    # Cut to the market first: the other symbols are neither read on nor shuffled.
    market_prices = raw_prices.where(F.col("symbol") == p.market_symbol)
    through = market_prices.agg(F.max("day")).scalar()
    # The calendar has four rows a year: one small window.
    in_order = Window.partitionBy(F.lit(1)).orderBy("period")
    lists = list_dates.withColumn("through", through).where(F.col("list_date") <= F.col("through"))
    lists = lists.withColumn("next_list", F.lead("list_date").over(in_order))
    lists = lists.select(
        "period", "label", "list_date",
        F.coalesce("next_list", "through").alias("exit_date"),
        F.col("next_list").isNull().alias("open"),
    )
    market = held_returns(lists.withColumn("symbol", F.lit(p.market_symbol)), market_prices, p)
    return lists.join(market.select("period", F.col("ret").alias("market_ret")), "period", "left")


def held_returns(trades: DataFrame, raw_prices: DataFrame, p: Params = Params()) -> DataFrame:
    """Bought at the first close on or after `list_date`, sold at the last on or before `exit_date`.
    No return when the first close is too late, or there is none after it to sell at."""
    # Both ends in one pass: the days held, joined on the symbol (a symbol's trades number at most the
    # lists drawn), and of each trade the first and the last of them, combined before their shuffle.
    held = ["symbol", "list_date", "exit_date"]
    asked = trades.select(*held).distinct()
    closes = usable_prices(raw_prices).select("symbol", "day", "close")
    close = F.struct("day", "close")
    ends = (
        closes.join(asked, "symbol")
        .where(F.col("day").between(F.col("list_date"), F.col("exit_date")))
        .groupBy(*held)
        .agg(F.min(close).alias("buy"), F.max(close).alias("sell"))
    )
    sold = trades.join(ends, held, "left")
    valid = (F.col("sell.day") > F.col("buy.day")) & (
        F.datediff("buy.day", "list_date") <= p.price_lookback_days
    )
    valid = F.coalesce(valid, F.lit(False))
    kept = lambda c: F.when(valid, c)
    return sold.select(
        *trades.columns,
        kept(F.col("buy.day")).alias("entry"),
        kept(F.col("sell.day")).alias("exit"),
        kept(F.col("sell.close") / F.col("buy.close") - 1).alias("ret"),
        # Prices that end early are held as cash from their last close.
        (valid & (F.datediff("exit_date", "sell.day") > p.price_lookback_days)).alias("ended"),
    )


def backtest_picks(lists: DataFrame, picks: DataFrame, raw_prices: DataFrame, p: Params = Params()) -> DataFrame:
    """Every pick of every list with its return; picks without a verified ticker have none."""
    verified = F.col("ticker").isNotNull() & (F.col("ticker_source") != "issuer-name")
    symbol = F.nullif(symbol_key(F.col("ticker")), F.lit(""))
    named = picks.select("period", "cusip", F.when(verified, symbol).alias("symbol"), "fcf_yield")
    trades = named.join(F.broadcast(lists.drop("market_ret")), "period")
    # Days before the first list or after the last exit are cut in the scan.
    span = [lists.agg(F.min("list_date")).scalar(), lists.agg(F.max("exit_date")).scalar()]
    within = raw_prices.where(F.col("day").between(*span))
    with_symbol = held_returns(trades.where(F.col("symbol").isNotNull()), within, p)
    without = trades.where(F.col("symbol").isNull()).select(
        "*",
        F.lit(None).cast("date").alias("entry"),
        F.lit(None).cast("date").alias("exit"),
        F.lit(None).cast("double").alias("ret"),
        F.lit(False).alias("ended"),
    )
    return with_symbol.unionByName(without)


def backtest_quarters(lists: DataFrame, results: DataFrame, p: Params = Params()) -> DataFrame:
    """Per list: the plain mean of its priced picks against the market."""
    market = F.broadcast(lists.select("period", "market_ret"))
    by_list = (
        results.join(market, "period")
        .groupBy("period")
        .agg(
            F.count(F.lit(1)).alias("picks"),
            F.count("ret").alias("priced"),
            F.avg("ret").alias("ret"),
            F.count_if(F.col("ret") > F.col("market_ret")).alias("_beat"),
            F.count_if("ended").alias("ended"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return lists.join(by_list, "period", "left").select(
        "period", "label", "list_date", "exit_date", "open",
        zero("picks").alias("picks"),
        zero("priced").alias("priced"),
        "ret", "market_ret",
        (F.col("ret") - F.col("market_ret")).alias("excess"),
        F.when(F.col("market_ret").isNotNull(), zero("_beat")).alias("beat"),
        zero("ended").alias("ended"),
        ((zero("picks") == 0) | (zero("priced") >= zero("picks") * p.min_priced_share)).alias("complete"),
    )


def backtest_totals(quarters: DataFrame) -> DataFrame:
    """The list's and the market's returns over the closed quarters, one after another (one row)."""
    closed = ~F.col("open") & F.col("complete") & F.col("ret").isNotNull() & F.col("market_ret").isNotNull()
    short = ~F.col("open") & (F.col("picks") > 0) & ~F.col("complete")
    # Four quarters a year: the collected array is bounded by the calendar.
    in_order = lambda c: F.transform(
        F.array_sort(F.collect_list(F.when(closed, F.struct("period", F.col(c).alias("r"))))), lambda x: x["r"]
    )
    totals = quarters.agg(
        F.count_if(closed).alias("closed_quarters"),
        F.count_if(short).alias("too_few_prices"),
        in_order("ret").alias("mine"),
        in_order("market_ret").alias("market"),
    )
    some = F.col("closed_quarters") > 0
    return totals.select(
        "closed_quarters", "too_few_prices",
        F.when(some, product_minus_one(F.col("mine"))).alias("list_return"),
        F.when(some, product_minus_one(F.col("market"))).alias("market_return"),
    )


def prices_through(raw_prices: DataFrame, p: Params = Params()) -> DataFrame:
    return market_days(raw_prices, p).agg(F.max("day").alias("through"))
