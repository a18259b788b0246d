"""Company financials: the cash flows, share counts and lender marks the screen reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.asof import asof
from tidegauge.functions.text import compact_key
from tidegauge.params import Params

# Measure, taxonomy, tag and unit of the lines read per fiscal year. Within a
# measure the first tag a company reports wins.
ANNUAL_CONCEPTS = (
    ("operating_cash_flow", "us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD"),
    ("operating_cash_flow", "us-gaap", "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "USD"),
    ("capex", "us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "USD"),
    ("capex", "us-gaap", "PaymentsToAcquireProductiveAssets", "USD"),
    ("diluted_shares", "us-gaap", "WeightedAverageNumberOfDilutedSharesOutstanding", "shares"),
    ("diluted_shares", "us-gaap", "WeightedAverageNumberOfSharesOutstandingBasic", "shares"),
    ("financial", "us-gaap", "InterestAndDividendIncomeOperating", "USD"),
    ("financial", "us-gaap", "PremiumsEarnedNet", "USD"),
    ("loan_income", "us-gaap", "InterestAndFeeIncomeLoansAndLeases", "USD"),
    ("loan_income", "us-gaap", "InterestAndFeeIncomeLoansConsumer", "USD"),
    ("revenue", "us-gaap", "Revenues", "USD"),
    ("revenue", "us-gaap", "RevenueFromContractWithCustomerExcludingAssessedTax", "USD"),
)
# Lines read at quarter ends.
INSTANT_CONCEPTS = (
    ("shares_outstanding", "dei", "EntityCommonStockSharesOutstanding", "shares"),
    ("financial", "us-gaap", "Deposits", "USD"),
)
FIRST_FISCAL_YEAR = 2022
INSTANT_QUARTERS = 12


def concepts(spark: SparkSession) -> DataFrame:
    rows = (
        f"('{measure}', '{taxonomy}', '{tag}', '{unit}', {rank})"
        for rank, (measure, taxonomy, tag, unit) in enumerate((*ANNUAL_CONCEPTS, *INSTANT_CONCEPTS))
    )
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS c(measure, taxonomy, tag, unit, rank)")


def known_facts(raw_frames: DataFrame) -> DataFrame:
    """Reported facts of the known concepts (the concept list is a literal of 14 rows)."""
    named = F.broadcast(concepts(raw_frames.sparkSession))
    return raw_frames.join(named, ["taxonomy", "tag", "unit"]).select(
        "cik", "period_end", "entity_name", "accn", "val", "measure", "rank"
    )


def fundamentals_history(raw_frames: DataFrame, p: Params = Params()) -> DataFrame:
    """Every usable fiscal year of every company against the year before it."""
    facts = known_facts(raw_frames)
    is_a = lambda m: F.col("measure") == m
    cash = is_a("operating_cash_flow") | is_a("capex") | is_a("diluted_shares")

    def preferred(measure: str, column: str):
        order = F.when(is_a(measure), F.struct("rank", "accn", "val"))
        return F.min_by(F.when(is_a(measure), F.col(column)), order)

    # One pass per company and date picks each measure's first tag and the loan lines.
    dated = facts.groupBy("cik", F.col("period_end").alias("fiscal_end")).agg(
        F.min(F.when(cash, F.col("entity_name"))).alias("entity_name"),
        preferred("operating_cash_flow", "accn").alias("accn"),
        preferred("operating_cash_flow", "val").alias("operating_cash_flow"),
        preferred("capex", "val").alias("capex"),
        preferred("diluted_shares", "val").alias("diluted_shares"),
        F.max(F.when(is_a("loan_income"), F.col("val"))).alias("loan_income"),
        F.max(F.when(is_a("revenue"), F.col("val"))).alias("revenue"),
    )
    lends = (F.col("loan_income") > 0) & (F.col("loan_income") >= F.coalesce("revenue", F.lit(0.0)) * p.lender_share)
    newest_first = Window.partitionBy("cik").orderBy(F.col("fiscal_end").desc())
    usable = F.col("operating_cash_flow").isNotNull() & F.col("capex").isNotNull() & (F.col("diluted_shares") > 0)
    years = (
        dated.where(usable)
        .withColumn("free_cash_flow", F.col("operating_cash_flow") - F.col("capex"))
        .withColumn("lender", F.coalesce(lends, F.lit(False)))
        .withColumn("n", F.row_number().over(newest_first))
        .withColumn("before", F.lead(F.struct("fiscal_end", "free_cash_flow", "lender")).over(newest_first))
    )
    near, far = p.fiscal_gap_days
    follows = F.datediff("fiscal_end", "before.fiscal_end").between(near, far)
    prior = F.when(follows, F.col("before"))
    company = facts.groupBy("cik").agg(
        F.bool_or(is_a("financial") & (F.col("val") > 0)).alias("bank"),
        F.max(
            F.when(is_a("shares_outstanding") & (F.col("val") > 0), F.struct("period_end", "val"))
        ).alias("cover"),
    )
    return (
        years.withColumn("prior", prior)
        .join(company, "cik")
        .select(
            "cik",
            "entity_name",
            "accn",
            "fiscal_end",
            "operating_cash_flow",
            "capex",
            "free_cash_flow",
            "diluted_shares",
            F.col("prior.fiscal_end").alias("prior_fiscal_end"),
            F.col("prior.free_cash_flow").alias("prior_free_cash_flow"),
            # least() skips NULLs, which would pass one year off as two.
            F.when(
                F.col("prior").isNotNull(), F.least("free_cash_flow", "prior.free_cash_flow")
            ).alias("lower_free_cash_flow"),
            F.col("cover.val").alias("shares_outstanding"),
            F.col("cover.period_end").alias("shares_as_of"),
            (
                F.coalesce("bank", F.lit(False)) | F.col("lender") | F.coalesce("prior.lender", F.lit(False))
            ).alias("financial"),
            "n",
            F.date_add("fiscal_end", p.ten_k_days).alias("known_from"),
        )
    )


def fundamentals(history: DataFrame) -> DataFrame:
    """Each company's latest fiscal year."""
    return history.where(F.col("n") == 1).drop("n", "known_from")


def cover_history(raw_frames: DataFrame) -> DataFrame:
    """Every cover-page share count; the largest where a date has several."""
    shares = (F.col("taxonomy") == "dei") & (F.col("tag") == "EntityCommonStockSharesOutstanding")
    return (
        raw_frames.where(shares & (F.col("val") > 0))
        .groupBy("cik", F.col("period_end").alias("shares_as_of"))
        .agg(F.max("val").alias("shares_outstanding"))
    )


def stock_cash_flows_history(stocks: DataFrame, raw_sec_tickers: DataFrame, history: DataFrame) -> DataFrame:
    """Fiscal years of each stock's company, met through its ticker in letters and digits only."""
    key = compact_key(F.col("ticker")).alias("key")
    companies = raw_sec_tickers.select(key, "cik").groupBy("key").agg(F.min("cik").alias("cik"))
    verified = (F.col("kind") == "stock") & F.col("ticker").isNotNull() & (F.col("ticker_source") != "issuer-name")
    return stocks.where(verified).select("cusip", key).join(companies, "key").join(history, "cik").drop("key")


def stock_cash_flows(history: DataFrame) -> DataFrame:
    return history.where(F.col("n") == 1).drop("n", "known_from")


def asof_known_by(asked: DataFrame, history: DataFrame, cover_history: DataFrame | None = None) -> DataFrame:
    """The financials of each asked (cusip, known_by): the latest fiscal year known by that day,
    its share count from the latest cover page dated by then. Rows with nothing known drop out."""
    fields = [c for c in history.columns if c not in ("cusip", "n", "known_from")]
    found = asof(asked, history, "cusip", "known_by", "known_from", F.struct(*fields), "f").where(
        F.col("f").isNotNull()
    )
    rows = found.select(*asked.columns, "f.*")
    if cover_history is None:
        return rows
    covered = asof(
        rows.drop("shares_outstanding", "shares_as_of"), cover_history, "cik", "known_by", "shares_as_of",
        F.struct("shares_outstanding", "shares_as_of"), "c",
    )
    return covered.select(
        *asked.columns,
        *(F.col(f"c.{c}").alias(c) if c in ("shares_outstanding", "shares_as_of") else F.col(c) for c in fields),
    )


def frame_worklist(days: DataFrame, loaded: DataFrame | None = None) -> DataFrame:
    """The source frames expected by each `today`: annual lines per fiscal year, quarter-end lines
    for the last twelve quarters; those already loaded (taxonomy, tag, unit, frame) are left out."""
    spark = days.sparkSession
    struct = lambda c: F.struct(*(F.lit(x).alias(n) for x, n in zip(c[1:], ("taxonomy", "tag", "unit"))))
    years = F.when(F.year("today") >= FIRST_FISCAL_YEAR, F.sequence(F.lit(FIRST_FISCAL_YEAR), F.year("today")))
    quarters = F.transform(
        F.sequence(F.lit(0), F.lit(INSTANT_QUARTERS - 1)), lambda n: F.add_months(F.trunc("today", "quarter"), n * -3)
    )
    annual = days.select(
        F.explode(F.transform(years, lambda y: F.concat(F.lit("CY"), y.cast("string")))).alias("frame")
    ).select("frame", F.explode(F.array(*map(struct, ANNUAL_CONCEPTS))).alias("c"))
    instant = days.select(F.explode(quarters).alias("q")).select(
        F.concat(
            F.lit("CY"), F.year("q").cast("string"), F.lit("Q"), F.quarter("q").cast("string"), F.lit("I")
        ).alias("frame"),
        F.explode(F.array(*map(struct, INSTANT_CONCEPTS))).alias("c"),
    )
    wanted = annual.unionByName(instant).select("c.taxonomy", "c.tag", "c.unit", "frame").distinct()
    if loaded is None:
        return wanted
    return wanted.join(loaded.select(*wanted.columns).distinct(), wanted.columns, "left_anti")
