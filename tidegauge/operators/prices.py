"""Daily prices against quarters. Quarter ends lie far apart, so each day has one quarter it can
count for and the lookback and volume joins become one grouping on (symbol, quarter)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.asof import asof
from tidegauge.functions.dates import quarter_end
from tidegauge.functions.text import symbol_key
from tidegauge.functions.verdicts import priced_in
from tidegauge.operators.calendar import with_next
from tidegauge.params import Params


def usable_prices(raw_prices: DataFrame) -> DataFrame:
    return raw_prices.where((F.col("close") > 0) & F.col("day").isNotNull())


def quarter_prices(raw_prices: DataFrame, p: Params = Params()) -> DataFrame:
    """Per symbol and quarter: the close at its end (within the lookback), value traded, last day."""
    at_end = F.col("day") > F.date_sub(quarter_end(F.col("day")), p.price_lookback_days)
    return (
        usable_prices(raw_prices)
        .groupBy("symbol", quarter_end(F.col("day")).alias("period"))
        .agg(
            F.max_by(F.when(at_end, F.col("close")), F.when(at_end, F.col("day"))).alias("end_close"),
            F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
            F.count(F.lit(1)).alias("days_traded"),
            F.max(F.struct("day", "close", "source")).alias("last"),
        )
    )


def market_days(raw_prices: DataFrame, p: Params = Params()) -> DataFrame:
    """The market's close on each of its days: one row a trading day."""
    return usable_prices(raw_prices).where(F.col("symbol") == p.market_symbol).select("day", "close")


def close_at_period(by_quarter: DataFrame, periods: DataFrame) -> DataFrame:
    """Last close on or before each quarter end of the calendar, within the lookback (of `quarter_prices`)."""
    wanted = F.broadcast(
        periods.select("period").union(periods.select("prev_period")).where(F.col("period").isNotNull()).distinct()
    )
    return (
        by_quarter.where(F.col("end_close").isNotNull())
        .join(wanted, "period", "left_semi")
        .select("period", "symbol", F.col("end_close").alias("close"))
    )


def traded_in_quarter(by_quarter: DataFrame, periods: DataFrame) -> DataFrame:
    """Value traded and days traded over each quarter that has one before it."""
    dated = F.broadcast(periods.where(F.col("prev_period").isNotNull()).select("period"))
    return by_quarter.join(dated, "period", "left_semi").select("period", "symbol", "dollar_volume", "days_traded")


def latest_prices(by_quarter: DataFrame) -> DataFrame:
    """Each symbol's newest close, its day and the source that supplied it."""
    return (
        by_quarter.groupBy("symbol")
        .agg(F.max("last").alias("last"))
        .select(
            "symbol",
            F.col("last.close").alias("latest_close"),
            F.col("last.day").alias("latest_day"),
            F.col("last.source").alias("latest_source"),
        )
    )


def market_on_own_latest(latest: DataFrame, market: DataFrame, p: Params = Params()) -> DataFrame:
    """The market's close on or before each symbol's own latest day, within the lookback."""
    # One row per day and symbol: a join on the day of each lookback offset, no range join.
    back = F.sequence(F.date_sub(F.col("latest_day"), p.price_lookback_days - 1), F.col("latest_day"))
    return (
        latest.select("symbol", F.explode(back).alias("day"))
        .join(market, "day")
        .groupBy("symbol")
        .agg(F.max_by("close", "day").alias("market_close"))
    )


def stock_symbols(stocks: DataFrame) -> DataFrame:
    """The price symbol of each stock with a verified ticker."""
    verified = F.col("ticker").isNotNull() & (F.col("ticker_source") != "issuer-name")
    return stocks.where(verified).select("cusip", symbol_key(F.col("ticker")).alias("symbol"))


def stock_prices(
    stocks: DataFrame, by_quarter: DataFrame, market_days: DataFrame, periods: DataFrame, p: Params = Params()
) -> DataFrame:
    """Per stock and period: the price since funds were buying, against the market, and the volume. The
    daily prices come in as two written tables, `quarter_prices` and `market_days`, and are not read again."""
    latest = latest_prices(by_quarter)
    ahead = F.broadcast(with_next(periods.select("period")).where(F.col("next_period").isNotNull()))
    starts = (
        by_quarter.where(F.col("end_close").isNotNull())
        .join(ahead, "period")
        .select("symbol", F.col("next_period").alias("period"), F.col("end_close").alias("start_close"))
    )
    ends = by_quarter.select("symbol", "period", "end_close", "dollar_volume", "days_traded")
    by_symbol = (
        starts.join(latest, "symbol")
        .join(ends, ["symbol", "period"], "left")
        .withColumn("since_start_pct", F.col("latest_close") / F.col("start_close") - 1)
        .withColumn("quarter_pct", F.col("end_close") / F.col("start_close") - 1)
    )
    # The market has one row a period: bounded by the calendar.
    market = F.broadcast(
        by_symbol.where(F.col("symbol") == p.market_symbol).select(
            "period", F.col("start_close").alias("market_start"), F.col("latest_day").alias("market_day")
        )
    )
    compared = by_symbol.join(market, "period", "left").join(
        market_on_own_latest(latest, market_days, p), "symbol", "left"
    )
    market_pct = F.col("market_close") / F.col("market_start") - 1
    stale = F.col("latest_day") < F.date_sub(F.col("market_day"), p.price_stale_days)
    return stock_symbols(stocks).join(compared, "symbol").select(
        "cusip", "period", "start_close", "end_close", "latest_close", "latest_day", "since_start_pct",
        "quarter_pct", "dollar_volume", "days_traded",
        market_pct.alias("market_since_start_pct"),
        ((F.col("since_start_pct") - market_pct) * 100).alias("vs_market_pts"),
        F.col("latest_source").alias("price_source"),
        F.coalesce(stale, F.lit(False)).alias("stale"),
    )


def _close_near(dates: DataFrame, raw_prices: DataFrame, day: str, out: str, forward: bool) -> DataFrame:
    """Each row of `dates` with the close nearest to its day on one side, looked up on two levels: inside the day's
    own month (an equi-join of at most 31 days), else in the nearest other month that has closes, of which only the
    first or last counts. What is ordered by symbol is months, never days; the scan is cut to the days asked for
    on the side that is open, and to the symbols."""
    asked = dates.select("symbol", F.col(day).alias("asked")).where(F.col("symbol").isNotNull() & F.col("asked").isNotNull()).distinct()
    low, high = asked.agg(F.min("asked"), F.max("asked")).first()
    if low is None:
        return dates.withColumn(out, F.lit(None).cast("struct<day: date, close: double>"))
    reach = F.col("day") >= F.lit(low) if forward else F.col("day") <= F.lit(high)
    nearest = (F.min if forward else F.max)(F.struct("day", "close")).alias("near")
    closes = usable_prices(raw_prices).select("symbol", "day", "close").where(reach)
    closes = closes.join(asked.select("symbol").distinct(), "symbol", "left_semi").withColumn("month", F.trunc("day", "month").cast("date"))
    in_month = asked.withColumn("month", F.trunc("asked", "month").cast("date"))
    side = F.col("day") >= F.col("asked") if forward else F.col("day") <= F.col("asked")
    own = in_month.join(closes, ["symbol", "month"]).where(side).groupBy("symbol", "asked").agg(nearest)
    by_month = closes.groupBy("symbol", "month").agg(nearest)
    beyond = F.add_months("month", 1) if forward else F.date_sub("month", 1)
    others = asof(in_month.withColumn("beyond", beyond), by_month, "symbol", "beyond", "month", F.struct("near"), "other", forward)
    found = others.join(own, ["symbol", "asked"], "left").select("symbol", F.col("asked").alias(day), F.coalesce("near", "other.near").alias(out))
    return dates.join(found, ["symbol", day], "left").select(*dates.columns, out)


def first_close_on_or_after(dates: DataFrame, raw_prices: DataFrame, day: str, out: str) -> DataFrame:
    """Each (symbol, day) row with the first close on or after the day, as struct(day, close)."""
    return _close_near(dates, raw_prices, day, out, forward=True)


def last_close_on_or_before(dates: DataFrame, raw_prices: DataFrame, day: str, out: str) -> DataFrame:
    """Each (symbol, day) row with the last close on or before the day, as struct(day, close)."""
    return _close_near(dates, raw_prices, day, out, forward=False)


def stock_price_lookup(stock_prices: DataFrame, periods: DataFrame, p: Params = Params()) -> DataFrame:
    """Each stock-quarter's price row with the verdict on whether its flow is priced in."""
    starts = F.broadcast(periods.select("period", F.col("prev_period").alias("quarter_start")))
    return (
        stock_prices.where(F.col("since_start_pct").isNotNull())
        .join(starts, "period")
        .withColumn("priced", priced_in(F.col("vs_market_pts"), F.col("stale"), p.price_lag_pts))
    )


def prices_status(stock_prices: DataFrame) -> DataFrame:
    """The day prices run through and their sources (one row)."""
    return (
        stock_prices.where(F.col("price_source").isNotNull())
        .agg(F.max("latest_day").alias("through"), F.array_sort(F.collect_set("price_source")).alias("sources"))
        .where(F.col("through").isNotNull())
    )


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
