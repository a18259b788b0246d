"""The driver's tables as raw filing tables, in Spark.

An order is a filing, its lines are the holding lines, fifty customers are one manager, a brand is
a security. Dates move 25 years and 60 days on, so that filings fall on both sides of the day values changed
from thousands to dollars. Nothing is left out: every order and line becomes a raw row.
`checks/oracle.py` states the same mapping in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.dates import quarter_end
from tidegauge.functions.text import check_digit

SHIFT_MONTHS = 300
SHIFT_DAYS = 60  # so that the last quarter is a whole one
CUSTOMERS_PER_MANAGER = 50


def _shifted(column: str) -> Column:
    return F.date_add(F.add_months(F.col(column).cast("date"), SHIFT_MONTHS), SHIFT_DAYS)


def _text_date(day: Column) -> Column:
    return F.upper(F.date_format(day, "dd-MMM-yyyy"))


def _quarter_number(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def filed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a filing, typed: manager, period, date, type and amendment."""
    orders = _read(spark, folder, "orders")
    h = F.col("o_orderkey") % 97
    urgent = F.substring("o_orderpriority", 1, 1)
    rows = orders.select(
        "o_orderkey",
        "o_totalprice",
        F.floor(F.col("o_custkey") / CUSTOMERS_PER_MANAGER).alias("m"),
        quarter_end(_shifted("o_orderdate")).alias("period"),
        F.col("o_orderstatus").alias("s"),
        urgent.alias("k"),
        h.cast("int").alias("h"),
    ).withColumn("silent", (F.col("m") * 7 + _quarter_number(F.col("period")) * 5) % 11 == 0)
    kind = (
        F.when(F.col("silent"), "notice")
        .when((F.col("s") == "F") & F.col("k").isin("1", "2"), "original")
        .when((F.col("s") == "P") & (F.col("k") == "3"), "relabelled original")
        .when((F.col("s") == "P") & (F.col("k") == "1") & (F.col("o_orderkey") % 2 == 0), "restatement")
        .when((F.col("s") == "P") & (F.col("k") == "1"), "untyped amendment")
        .when((F.col("s") == "P") & (F.col("k") == "4"), "notice")
        .otherwise("new holdings")
    )
    rows = rows.withColumn("kind", kind)
    offset = (
        F.when(F.col("kind").isin("original", "relabelled original"), F.col("h") % 32 + 14 + F.when(F.col("h") % 19 == 0, 45).otherwise(0))
        .when(F.col("kind").isin("restatement", "untyped amendment"), F.col("h") % 40 + 20)
        .otherwise(F.col("h") % 70 + 30)
    )
    rows = rows.withColumn("filed", F.date_add("period", offset))
    start = F.add_months(F.trunc(F.add_months("filed", -2), "quarter"), 2)
    name = lambda d: F.lower(F.date_format(d, "ddMMMyyyy"))
    return rows.withColumn(
        "source_zip",
        F.concat(name(start), F.lit("-"), name(F.date_sub(F.add_months(start, 3), 1)), F.lit("_form13f.zip")),
    )


def _accession(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 12, "0")


def raw_submission(filed: DataFrame) -> DataFrame:
    cik = (F.col("m") + 1).cast("string")
    form = (
        F.when(F.col("kind") == "notice", "13F-NT")
        .when(F.col("kind").isin("original", "relabelled original"), "13F-HR")
        .otherwise("13F-HR/A")
    )
    return filed.select(
        _accession("o_orderkey").alias("ACCESSION_NUMBER"),
        _text_date(F.col("filed")).alias("FILING_DATE"),
        form.alias("SUBMISSIONTYPE"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lpad(cik, 10, "0")).otherwise(cik).alias("CIK"),
        _text_date(F.col("period")).alias("PERIODOFREPORT"),
        "source_zip",
    )


def raw_coverpage(filed: DataFrame) -> DataFrame:
    amends = ~F.col("kind").isin("original", "relabelled original", "notice")
    label = F.when(F.col("kind") == "new holdings", "NEW HOLDINGS").when(
        F.col("kind").isin("restatement", "relabelled original"), "RESTATEMENT"
    )
    suffix = F.when(F.col("h") % 3 == 0, " LLC").otherwise(" LP")
    return filed.select(
        _accession("o_orderkey").alias("ACCESSION_NUMBER"),
        F.when(amends, "Y").otherwise("N").alias("ISAMENDMENT"),
        F.when(amends, F.col("h").cast("string")).alias("AMENDMENTNO"),
        label.alias("AMENDMENTTYPE"),
        F.lit("13F HOLDINGS REPORT").alias("REPORTTYPE"),
        F.concat(F.lit("Manager "), F.col("m").cast("string"), suffix).alias("FILINGMANAGER_NAME"),
        "source_zip",
    )


def raw_summarypage(filed: DataFrame) -> DataFrame:
    declared = F.when(F.col("o_orderkey") % 13 == 0, "40").when(F.col("o_orderkey") % 7 != 0, "4")
    return filed.select(
        _accession("o_orderkey").alias("ACCESSION_NUMBER"),
        declared.alias("TABLEENTRYTOTAL"),
        F.floor("o_totalprice").cast("string").alias("TABLEVALUETOTAL"),
        "source_zip",
    )


# Brands whose code is replaced, from which quarter end, with how many old shares per new one.
REPLACED = ((3, "2023-06-30"), (7, "2023-06-30"), (11, "2022-03-31"), (11, "2024-06-30"))


def _version(brand: Column, day: Column) -> Column:
    """How often a brand's code was replaced by a day."""
    return sum((((brand == b) & (day >= F.to_date(F.lit(d)))).cast("int") for b, d in REPLACED), F.lit(0))


def brand_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Every brand's nine-character codes: the seventh character counts its replacements; every ninth
    brand's check digit is wrong."""
    rows = brands(spark, folder).select("b", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("version"))
    b, wrong = F.col("b"), F.when(F.col("b") % 9 == 0, 1).otherwise(0)
    base = F.concat(F.lpad((b * 7919 + 10007).cast("string"), 6, "0"), F.col("version").cast("string"), F.lit("0"))
    based = rows.select("b", "version", base.alias("base"))
    return based.select(
        "b", "version", F.concat("base", ((check_digit(F.col("base")) + wrong) % 10).cast("string")).alias("code")
    )


def with_code(rows: DataFrame, day: Column, codes: DataFrame) -> DataFrame:
    """Rows with the code their brand (b) had on a day."""
    return rows.withColumn("version", _version(F.col("b"), day)).join(codes, ["b", "version"]).drop("version")


def price_of(brand: Column, day: Column) -> Column:
    """Whole dollars, moving each quarter."""
    return brand * 14 + 40 + ((_quarter_number(day) * (brand % 5 + 1)) % 23) * 2


def held_lines(spark: SparkSession, folder: str, filed: DataFrame) -> DataFrame:
    """Every line with its filing and its security, before it is written as text."""
    part = _read(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("b"),
    )
    lines = _read(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    orders = filed.select(F.col("o_orderkey").alias("l_orderkey"), "m", "period", "filed", "source_zip")
    rows = lines.join(part, "l_partkey").join(orders, "l_orderkey")
    b, day = F.col("b"), F.col("period")
    before = sum((((b == x) & (day < F.to_date(F.lit(d)))).cast("int") for x, d in REPLACED), F.lit(0))
    fold = F.when(before == 0, 1).when(before == 1, 2).otherwise(4)  # old shares per new one
    today = F.when(b.isin(3, 7, 11), (F.col("m") * 31 + b * 17) % 97 + 1).otherwise(F.col("l_quantity").cast("bigint")) * 10000
    slip = F.when((F.col("l_tax") > 0.075) & (F.col("l_linenumber") == 3), 5).otherwise(1)
    thousands = (F.col("filed") < F.to_date(F.lit("2023-01-03"))) | ((F.col("l_tax") < 0.005) & (F.col("l_linenumber") == 2))
    staged = rows.withColumns(
        {
            "fold": fold,
            "today": today.cast("bigint"),
            "price": price_of(b, day),
            "percent": (F.round(F.col("l_discount") * 100).cast("bigint") + 100) * slip,
            "unit": F.when(thousands, 100_000.0).otherwise(100.0),
        }
    )
    return with_code(staged, day, brand_codes(spark, folder)).select(
        "l_orderkey", "l_linenumber", "b", "m", "period", "source_zip", "l_returnflag", "l_linestatus", "code",
        (F.col("today") * F.col("fold")).alias("shares"),
        F.floor(F.col("today") * F.col("price") * F.col("percent") / F.col("unit")).alias("value"),
    )


def raw_infotable(lines: DataFrame) -> DataFrame:
    b, n = F.col("b"), F.col("l_linenumber")
    tails = F.array(*map(F.lit, (" INC", " CORP CL A", " LTD /DE/", " PLC", " & CO NEW")))
    name = F.concat(F.lit("BRAND "), F.chr((b % 26 + 65).cast("bigint")), F.lit(" GROUP"), F.element_at(tails, b % 5 + 1))
    spelled = F.when(n % 3 == 0, F.initcap(name)).otherwise(name)
    title = F.when(b % 5 == 1, "UNIT SER 1").when(b % 6 == 0, "MSCI ETF").otherwise("COM")
    title = F.when(n == 4, F.concat(title, F.lit(" NEW"))).otherwise(title)
    code = F.when(n % 5 == 0, F.lower("code")).when(n % 7 == 0, F.concat(F.lit(" "), F.col("code"))).otherwise(F.col("code"))
    bond = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (n == 1)
    option = (F.col("l_returnflag") == "N") & (n == 2)
    return lines.select(
        _accession("l_orderkey").alias("ACCESSION_NUMBER"),
        n.cast("string").alias("INFOTABLE_SK"),
        spelled.alias("NAMEOFISSUER"),
        title.alias("TITLEOFCLASS"),
        code.alias("CUSIP"),
        F.when(n % 2 == 0, F.concat(F.lit("BBG"), F.lpad(b.cast("string"), 9, "0"))).otherwise("").alias("FIGI"),
        F.col("value").cast("string").alias("VALUE"),
        F.col("shares").cast("string").alias("SSHPRNAMT"),
        F.when(bond, "PRN").otherwise("SH").alias("SSHPRNAMTTYPE"),
        F.when(option, "Put").when(n == 6, " ").alias("PUTCALL"),
        "source_zip",
    )


def ticker_of(brand: Column) -> Column:
    return F.concat(
        F.lit("BR"), F.when(brand % 4 == 0, "/").otherwise(""), F.chr((brand % 26 + 65).cast("bigint"))
    )


def symbol_of(brand: Column) -> Column:
    return F.regexp_replace(ticker_of(brand), "/", "-")


def traded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line on its ship date, with its brand."""
    part = _read(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("b"),
    )
    lines = _read(spark, folder, "lineitem").select(
        "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_tax", "l_orderkey", "l_linenumber"
    )
    return lines.join(part, "l_partkey").withColumn("day", _shifted("l_shipdate"))


def raw_prices(traded: DataFrame) -> DataFrame:
    """A close per brand and day traded, and one for the market per day."""
    b, day = F.col("b"), F.col("day")
    stock = traded.groupBy("b", "day").agg(
        F.max("l_quantity").alias("high"), F.min("l_quantity").alias("low"), F.sum("l_quantity").alias("volume")
    )
    # Two brands' closes stop being usable before the end: one long before, one just before.
    gone = ((b == 5) & (day > F.to_date(F.lit("2025-06-30")))) | ((b == 8) & (day > F.to_date(F.lit("2026-05-31"))))
    close = F.when(gone, 0.0).otherwise((price_of(b, day) * 100 + F.col("high")) / 100)
    base = price_of(b, day).cast("double")
    source = F.element_at(F.array(*map(F.lit, ("stooq", "polygon", "tiingo"))), b % 3 + 1)
    columns = lambda symbol, open_, close_, src, file: [
        symbol.alias("symbol"), F.col("day"), open_.alias("open"), (close_ + 1).alias("high"),
        (open_ - 1).alias("low"), close_.alias("close"), (F.col("volume") * 10000).cast("double").alias("volume"),
        src.alias("source"), file.alias("source_file"),
    ]
    stocks = stock.select(*columns(symbol_of(b), base, close, source, F.concat(symbol_of(b), F.lit(".csv"))))
    market = traded.groupBy("day").agg(F.max("l_quantity").alias("high"), F.sum("l_quantity").alias("volume"))
    level = _quarter_number(day).cast("double") * 5 - 40000
    market = market.select(
        *columns(F.lit("SPY"), level, level + F.col("high") / 10, F.lit("stooq"), F.lit("SPY.csv"))
    )
    return stocks.unionByName(market)


def raw_xbrl_frames(traded: DataFrame) -> DataFrame:
    """Company facts per brand and calendar year, scaled to what was traded."""
    b = F.col("b")
    yearly = traded.groupBy("b", F.least(F.year("day"), F.lit(2026)).alias("y")).agg(F.sum("l_quantity").alias("q"))
    ends = F.when(b % 2 == 1, F.make_date("y", F.lit(9), F.lit(30))).otherwise(F.make_date("y", F.lit(12), F.lit(31)))
    rows = yearly.withColumn("fiscal_end", ends).withColumn("y", F.col("y").cast("bigint"))
    q, y = F.col("q"), F.col("y")
    cash = q * (21000 + (b * 613 + y * 211) % 16000)
    capex = q * (3000 + (b * 97 + y * 41) % 3000)
    diluted = q * (1200 + (b * 37) % 400)
    missing = F.lit(None).cast("double")
    value = lambda rule, v: F.when(rule, v.cast("double")).otherwise(missing)
    always = F.lit(True)
    gaap = "us-gaap"
    facts = (
        (gaap, "NetCashProvidedByUsedInOperatingActivities", "USD", value(b % 5 != 0, cash)),
        (gaap, "NetCashProvidedByUsedInOperatingActivitiesContinuingOperations", "USD", value(b % 5 <= 1, cash + 1)),
        (gaap, "PaymentsToAcquirePropertyPlantAndEquipment", "USD", value((b % 7 != 0) | (y % 2 == 0), capex)),
        (gaap, "PaymentsToAcquireProductiveAssets", "USD", value(b % 7 <= 1, capex + 5)),
        (gaap, "WeightedAverageNumberOfDilutedSharesOutstanding", "shares", value(b % 6 != 5, diluted)),
        (gaap, "WeightedAverageNumberOfSharesOutstandingBasic", "shares", value((b % 6 == 5) & (y != 2024), diluted)),
        (gaap, "InterestAndFeeIncomeLoansAndLeases", "USD", value(b % 12 == 5, cash * 2)),
        (gaap, "InterestAndFeeIncomeLoansConsumer", "USD", value((b % 12 == 7) & (y < 2023), cash)),
        (gaap, "Revenues", "USD", value(b % 12 != 5, cash * 3)),
        (gaap, "Deposits", "USD", value(b % 11 == 0, cash)),
        ("dei", "EntityCommonStockSharesOutstanding", "shares", value(always, diluted * F.when(b % 9 == 0, 2).otherwise(1))),
        ("dei", "EntityPublicFloat", "USD", value(always, cash)),
    )
    listed = F.array(
        *(
            F.struct(F.lit(t).alias("taxonomy"), F.lit(tag).alias("tag"), F.lit(u).alias("unit"), v.alias("val"))
            for t, tag, u, v in facts
        )
    )
    company = F.concat(F.lit("Brand "), F.chr((b % 26 + 65).cast("bigint")), F.lit(" Group"))
    return (
        rows.select("b", "y", "fiscal_end", company.alias("entity_name"), F.inline(listed))
        .where(F.col("val").isNotNull())
        .select(
            F.concat_ws("_", "taxonomy", "tag", "unit", F.concat(F.lit("CY"), F.col("y").cast("string"))).alias("source_file"),
            "taxonomy", "tag", "unit",
            F.concat(F.lit("CY"), F.col("y").cast("string")).alias("frame"),
            F.concat(F.lpad((b + 1000).cast("string"), 10, "0"), F.lit("-"), F.col("y").cast("string")).alias("accn"),
            (b + 1000).cast("bigint").alias("cik"),
            "entity_name",
            F.lit("US-NY").alias("loc"),
            F.add_months(F.date_add("fiscal_end", 1), -12).alias("period_start"),
            F.col("fiscal_end").alias("period_end"),
            "val",
        )
    )


def brands(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _read(spark, folder, "part")
        .select(F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("parts"))
    )


def raw_sec_tickers(brands: DataFrame) -> DataFrame:
    b = F.col("b")
    title = F.concat(F.lit("Brand "), F.chr((b % 26 + 65).cast("bigint")), F.lit(" Group, Inc."))
    return brands.where(b % 10 != 4).select(
        (b + 1000).cast("bigint").alias("cik"), symbol_of(b).alias("ticker"), title.alias("title")
    )


_NEWEST = "2026-09-30"


def _coded(brands: DataFrame, codes: DataFrame, day: str) -> DataFrame:
    return with_code(brands, F.to_date(F.lit(day)), codes).withColumnRenamed("code", "cusip")


def openfigi(brands: DataFrame, codes: DataFrame) -> DataFrame:
    """Answers of the lookup service for each brand's newest code, and for the replaced ones."""
    b = F.col("b")
    newest = _coded(brands, codes, _NEWEST)
    oldest = _coded(brands.where(b.isin(3, 7, 11)), codes, "2020-03-31")
    found = (b % 10 != 9) & (b != 7)
    old_found = F.col("b").isNotNull()

    def answers(rows: DataFrame, known: Column) -> DataFrame:
        kind = (
            F.when(b % 6 == 0, "ETP").when(b % 8 == 0, None).when(b % 13 == 0, "Closed-End Fund").otherwise("Common Stock")
        )
        return rows.select(
            "cusip",
            F.lit("ID_CUSIP").alias("id_type"),
            known.alias("found"),
            F.when(known, ticker_of(b)).alias("ticker"),
            F.when(known, F.concat(F.lit("BRAND "), F.chr((b % 26 + 65).cast("bigint")))).alias("name"),
            F.when(known, kind).alias("security_type"),
        )

    return answers(newest, found).unionByName(answers(oldest, old_found))


def ticker_fallbacks(brands: DataFrame, codes: DataFrame) -> DataFrame:
    b = F.col("b")
    return _coded(brands.where(b % 10 == 9), codes, _NEWEST).select(
        "cusip",
        ticker_of(b).alias("ticker"),
        F.when(b == 9, "issuer-name").otherwise("sec-ftd").alias("source"),
        F.when(b != 9, F.to_date(F.lit("2026-09-15"))).alias("as_of"),
    )


def raw_ftd(traded: DataFrame, codes: DataFrame) -> DataFrame:
    """Every line as a line of a fails-to-deliver file, some without a symbol or a readable date."""
    b, day = F.col("b"), F.col("day")
    half = F.when(F.dayofmonth(day) <= 15, "a").otherwise("b")
    return with_code(traded, day, codes).select(
        F.when(F.col("l_orderkey") % 61 == 0, "n/a").otherwise(F.date_format(day, "yyyyMMdd")).alias("settlement_date"),
        F.when(F.col("l_linenumber") == 2, F.lower("code")).otherwise(F.col("code")).alias("cusip"),
        F.when(F.col("l_orderkey") % 50 == 0, " ").otherwise(symbol_of(b)).alias("symbol"),
        F.col("l_quantity").cast("bigint").cast("string").alias("quantity"),
        F.concat(F.lit("BRAND "), b.cast("string")).alias("description"),
        F.lit(".").alias("price"),
        F.concat(F.lit("cnsfails"), F.date_format(day, "yyyyMM"), half, F.lit(".zip")).alias("source_file"),
    )


def lookup_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, an answer of the lookup service as its JSON text, in each of its shapes."""
    key = F.col("p_partkey").cast("string")
    listing = lambda exchange, ticker: F.concat(
        F.lit('{"ticker":"'), ticker, F.lit('","name":"'), F.upper("p_name"), F.lit('","exchCode":"'), F.lit(exchange),
        F.lit('","securityType":"Common Stock","figi":"BBG'), F.lpad(key, 9, "0"), F.lit('"}'),
    )
    shape = F.col("p_partkey") % 7
    text = (
        F.when(shape == 0, '{"warning":"No identifier found."}')
        .when(shape == 1, '{"error":"Invalid idValue format."}')
        .when(shape == 2, '{"error":"Too many requests."}')
        .when(shape == 3, '{"data":[]}')
        .when(shape == 4, F.concat(F.lit('{"data":['), listing("LN", F.concat(F.lit("L"), key)), F.lit("]}")))
        .otherwise(
            F.concat(
                F.lit('{"data":['), listing("LN", F.concat(F.lit("L"), key)), F.lit(","),
                listing("US", F.concat(F.lit("U"), key)), F.lit("]}"),
            )
        )
    )
    return _read(spark, folder, "part").select(
        F.lpad(key, 9, "0").alias("cusip"), F.lit("ID_CUSIP").alias("id_type"), F.lpad(key, 9, "0").alias("id_value"),
        text.alias("response"), F.to_timestamp(F.lit("2026-10-01 00:00:00")).alias("fetched_at"),
    )


def lookup_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, how far the lookup got: never asked, or one of the stages."""
    stages = F.array(
        *map(F.lit, ("ID_CUSIP", "INVALID_CUSIP", "ANY_EXCHANGE", "ID_BB_GLOBAL", "FILER_FIGI_AS_SHARE_CLASS",
                     "ID_BB_GLOBAL_SHARE_CLASS_LEVEL", "ID_CINS")),
    )
    n = F.col("p_partkey")
    return part_securities(spark, folder).where(n % 4 != 0).select(
        "cusip", F.element_at(stages, (n % 7 + 1).cast("int")).alias("id_type"), (n % 5 == 0).alias("found"), n
    )


def part_securities(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, an identifier (some with a wrong check digit, some foreign), a FIGI and a name. An identifier
    holds six digits of the part's number: beyond 999,999 parts several share one."""
    n = F.col("p_partkey")
    key = F.lpad(n.cast("string"), 6, "0")
    base = F.concat(F.when(n % 11 == 0, F.concat(F.lit("G"), F.substring(key, 2, 5))).otherwise(key), F.lit("10"))
    digit = (check_digit(F.col("base")) + F.when(n % 9 == 0, 1).otherwise(0)) % 10
    code = F.concat("base", digit.cast("string"))
    figi = F.when(n % 3 == 0, F.concat(F.lit("BBG"), F.lpad(n.cast("string"), 9, "0"))).when(n % 3 == 1, "n/a")
    rows = _read(spark, folder, "part").withColumn("base", base)
    return rows.select(
        "p_partkey", code.alias("cusip"), F.concat(F.lit("S"), F.floor(n / 2).cast("string")).alias("stock"),
        figi.alias("figi"), issuer_name(n, F.col("p_name")).alias("name_filed"),
        F.make_date(F.lit(2026), (n % 4 * 3 + 3).cast("int"), F.lit(28)).alias("latest_period"),
    )


# Endings filers add to a company's name.
NAME_ENDINGS = (
    " INC", " CORP CL A", " CORP /DE/", " & SONS LTD", " N V", " P L C", " CO NEW", " Holdings, Inc.", " COM",
    " CAP STK", " CLASS B COM STK", " SER 1", " GROUP LLC DEL", " S.A. SPONSORED ADR", " TRUST", " L P", " N.V.",
)


def issuer_name(key: Column, name: Column) -> Column:
    """A company name as filers write it: a number in words' place keeps most of them apart."""
    ending = F.element_at(F.array(*map(F.lit, NAME_ENDINGS)), (key % len(NAME_ENDINGS) + 1).cast("int"))
    front = F.when(key % 5 == 0, "The ").when(key % 7 == 0, "U.S. ").when(key % 11 == 0, "O'Neil ").otherwise("")
    return F.concat(front, F.upper(name), F.lit(" "), F.floor(key / 3).cast("string"), ending)


def part_companies(spark: SparkSession, folder: str) -> DataFrame:
    """Per part, a listed company whose title spells the same name its own way."""
    n = F.col("p_partkey")
    front = F.when(n % 7 == 0, "US ").when(n % 11 == 0, "ONeil ").otherwise("")
    return _read(spark, folder, "part").where(n % 3 == 0).select(
        n.alias("cik"),
        F.concat(F.lit("T"), n.cast("string")).alias("ticker"),
        F.concat(front, F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000), F.lit(" "), F.floor(n / 3).cast("string"), F.lit(" Corp.")).alias("title"),
    )


def request_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a request to one of the sources."""
    names = F.array(*map(F.lit, ("sec", "sec-xbrl", "openfigi", "sec-ftd", "stooq", "polygon", "tiingo")))
    kind = F.col("event_type")
    # One source answers badly, so that it shows as unreliable.
    source = F.element_at(names, (F.col("user_id") % 7 + 1).cast("int"))
    outcome = (
        F.when((F.col("user_id") % 7).isin(1, 2, 3) & (kind != "click"), "failed")
        .when(kind == "error", "failed")
        .when(kind == "signup", "throttled")
        .otherwise("ok")
    )
    return _read(spark, folder, "events").select(
        "event_id", source.alias("source"), F.col("ts").alias("at"), outcome.alias("outcome"),
        F.when(outcome != "ok", F.concat(F.lit("HTTP "), F.col("props"))).alias("error"),
    )


def watchlist(brands: DataFrame, codes: DataFrame) -> DataFrame:
    """Watched codes: newest and replaced ones, and one per tenth brand that nobody reports."""
    b = F.col("b")
    rows = _coded(brands.where(b % 3 == 0), codes, _NEWEST).select("cusip", b.alias("line_no"))
    old = _coded(brands.where(b.isin(3, 7, 11)), codes, "2020-03-31").select("cusip", (b + 100).alias("line_no"))
    unknown = brands.where(b % 10 == 0).select(
        F.concat(F.lit("NONE"), F.lpad(b.cast("string"), 5, "0")).alias("cusip"), (b + 200).alias("line_no")
    )
    every = rows.unionByName(old).unionByName(unknown)
    return every.select("cusip", F.lit("").alias("ticker"), F.lit("").alias("name"), "line_no")


def raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    filed = filed_orders(spark, folder)
    traded = traded_lines(spark, folder)
    kinds = brands(spark, folder)
    codes = brand_codes(spark, folder)
    return {
        "raw_submission": raw_submission(filed),
        "raw_coverpage": raw_coverpage(filed),
        "raw_summarypage": raw_summarypage(filed),
        "raw_infotable": raw_infotable(held_lines(spark, folder, filed)),
        "raw_prices": raw_prices(traded),
        "raw_xbrl_frames": raw_xbrl_frames(traded),
        "raw_sec_tickers": raw_sec_tickers(kinds),
        "openfigi": openfigi(kinds, codes),
        "ticker_fallbacks": ticker_fallbacks(kinds, codes),
        "raw_ftd": raw_ftd(traded, codes),
        "watchlist": watchlist(kinds, codes),
        "part_securities": part_securities(spark, folder),
    }
