"""From filings as received to one current report per manager and quarter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.dates import filed_date

# VALUE was in thousands of dollars in reports filed before this day.
WHOLE_DOLLARS_FROM = "2023-01-03"


def submissions(raw_submission: DataFrame, raw_coverpage: DataFrame, raw_summarypage: DataFrame) -> DataFrame:
    """Every filing, parsed; one row per accession, from the latest source that has it."""
    # Moved once, by accession: a join on accession and source would move all three tables, and its rows again
    # for the latest of each accession. Covers and totals count only beside a submission of their own source.
    acc, zipped = "ACCESSION_NUMBER", "source_zip"
    parts = {
        "s": raw_submission.select(acc, zipped, "FILING_DATE", "SUBMISSIONTYPE", "CIK", "PERIODOFREPORT"),
        "c": raw_coverpage.select(acc, zipped, "AMENDMENTTYPE", "AMENDMENTNO", "REPORTTYPE", "FILINGMANAGER_NAME"),
        "t": raw_summarypage.select(acc, zipped, "TABLEENTRYTOTAL", "TABLEVALUETOTAL"),
    }
    one = lambda rows, name: rows.select(acc, zipped, F.struct(*rows.columns[2:]).alias(name))
    sent, *others = (one(rows, name) for name, rows in parts.items())
    rows = sent
    for other in others:
        rows = rows.unionByName(other.where(F.col(acc).isNotNull() & F.col(zipped).isNotNull()), allowMissingColumns=True)
    latest = F.max(F.when(F.col("s").isNotNull(), F.col(zipped))).over(Window.partitionBy(acc))
    joined = (
        rows.withColumn("latest", latest)
        .where(F.col(zipped).eqNullSafe(F.col("latest")))
        .groupBy(acc)
        .agg(*(F.max(name).alias(name) for name in parts), F.max(zipped).alias(zipped))
        .select(acc, zipped, *(f"{name}.*" for name in parts))
    )
    filed = filed_date(F.col("FILING_DATE"))
    amends = F.col("SUBMISSIONTYPE") == "13F-HR/A"
    role = (
        F.when(F.col("SUBMISSIONTYPE") == "13F-HR", "original")  # whatever its cover says
        .when(amends & (F.col("AMENDMENTTYPE") == "NEW HOLDINGS"), "new holdings")
        .when(amends, "restatement")  # an amendment without a type replaces the report
        .otherwise("notice")
    )
    return joined.select(
        F.col("ACCESSION_NUMBER").alias("accession"),
        F.col("CIK").cast("bigint").alias("cik"),
        filed_date(F.col("PERIODOFREPORT")).alias("period"),
        filed.alias("filing_date"),
        F.col("SUBMISSIONTYPE").alias("submission_type"),
        F.col("AMENDMENTTYPE").alias("amendment_type"),
        F.col("AMENDMENTNO").try_cast("int").alias("amendment_no"),
        F.col("REPORTTYPE").alias("report_type"),
        F.col("FILINGMANAGER_NAME").alias("manager_name"),
        F.col("TABLEENTRYTOTAL").try_cast("bigint").alias("table_entry_total"),
        F.col("TABLEVALUETOTAL").try_cast("bigint").alias("table_value_total"),
        role.alias("role"),
        F.when(filed < F.to_date(F.lit(WHOLE_DOLLARS_FROM)), 1000).otherwise(1).alias("value_multiplier"),
        "source_zip",
    )


def filing_parts(submissions: DataFrame, periods: DataFrame) -> DataFrame:
    """The accessions in use: the latest restatement, else the latest original, and the new
    holdings filed after it (or alone where there is no such report)."""
    held = (
        submissions.where(F.col("role") != "notice")
        .join(F.broadcast(periods.select("period")), "period", "left_semi")
        .select("cik", "period", "accession", "role", "filing_date", "value_multiplier")
    )
    whole = held.where(F.col("role").isin("restatement", "original"))
    base = whole.groupBy("cik", "period").agg(
        F.max_by(
            F.struct("filing_date", "accession"),
            F.struct(F.col("role") == "restatement", "filing_date", "accession"),
        ).alias("base")
    )
    later = F.col("base").isNull() | (F.struct("filing_date", "accession") > F.col("base"))
    in_use = (F.col("accession") == F.col("base.accession")) | ((F.col("role") == "new holdings") & later)
    return held.join(base, ["cik", "period"], "left").where(in_use).select(*held.columns)


def filings(filing_parts: DataFrame, submissions: DataFrame, raw_infotable: DataFrame) -> DataFrame:
    """One current report per manager and period, and whether the data hold enough of it."""
    lines = (
        raw_infotable.select(F.col("ACCESSION_NUMBER").alias("accession"))
        .join(filing_parts.select("accession"), "accession", "left_semi")
        .groupBy("accession")
        .agg(F.count(F.lit(1)).alias("part_lines"))
    )
    facts = submissions.select("accession", "manager_name", "table_entry_total")
    parts = filing_parts.join(facts, "accession").join(lines, "accession", "left")
    # Among new holdings alone, the latest stands in for the base report.
    base = F.max_by(
        F.struct("accession", F.coalesce("part_lines", F.lit(0)).alias("lines"), "table_entry_total"),
        F.struct(F.col("role") != "new holdings", "filing_date", "accession"),
    )
    reports = parts.groupBy("cik", "period").agg(
        base.alias("base"),
        (F.count(F.lit(1)) - 1).alias("new_holdings_amendments"),
        F.bool_or(F.col("role") == "restatement").alias("restated"),
        F.max("filing_date").alias("filing_date"),
        F.min("filing_date").alias("first_filing_date"),
        F.coalesce(F.sum("part_lines"), F.lit(0)).cast("bigint").alias("lines"),
        F.max_by("manager_name", F.struct("filing_date", "accession")).alias("manager_name"),
    )
    declared = F.coalesce("base.table_entry_total", F.lit(0))
    return reports.select(
        "cik",
        "period",
        F.col("base.accession").alias("base_accession"),
        "new_holdings_amendments",
        "restated",
        "filing_date",
        "first_filing_date",
        "lines",
        "manager_name",
        F.col("base.lines").alias("base_lines"),
        declared.alias("base_declared"),
        ((declared == 0) | (F.col("base.lines") >= declared * 0.5)).alias("complete"),
    )


def managers(submissions: DataFrame) -> DataFrame:
    """Each manager's latest name."""
    return submissions.groupBy("cik").agg(
        F.max_by("manager_name", F.struct("filing_date", "accession")).alias("name")
    )


def filers_total(periods: DataFrame, filings: DataFrame) -> DataFrame:
    """Per period: reports, and reports that list holdings (the tide)."""
    counted = filings.groupBy("period").agg(
        F.count_if(F.col("lines") > 0).alias("filers"), F.count(F.lit(1)).alias("filings")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return periods.select("period").join(counted, "period", "left").select("period", zero("filers"), zero("filings"))


def manager_totals(filings: DataFrame, positions: DataFrame) -> DataFrame:
    """Each manager's reported portfolio: value and positions, flagged reports' value left out."""
    books = (
        positions.where(F.col("shares") > 0)
        .groupBy("cik", "period")
        .agg(
            F.sum(F.when(~F.col("price_flag"), F.col("value_checked"))).alias("value"),
            F.count(F.lit(1)).alias("positions"),
        )
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return filings.join(books, ["cik", "period"], "left").select(
        "cik", "period", zero("value"), zero("positions"), "manager_name", "filing_date",
        F.col("base_accession").alias("accession"),
    )
