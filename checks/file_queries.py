"""Source scans over files Spark writes from the driver's tables."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import adapter
from checks.context import CheckModel
from checks.oracle import TABLES, cut, statement, table
from checks.registry import ORACLES, check
from checks.settings import PARAMS as P
from checks.source_queries import _COLUMNS
from tidegauge.operators import reads
from tidegauge.plans.model import Model
from tidegauge.sources import fails, filings, lists, prices, sinks
from tidegauge.sources.archives import open_file
from tidegauge.sources.facts import scan_keyed_json
from tidegauge.sources.zip_pieces import PIECES, WRITTEN, archives_of, pieces_of

# --- archives -----------------------------------------------------------------------------------------


_MEMBERS = {table: member for member, table in filings.MEMBERS.items()}


def _zip_folder(m: CheckModel) -> str:
    """The raw tables packed into the archives they came in, as files named after them, each with the four members."""

    def export(path: str) -> None:
        pieces, members = None, []
        for place, (name, member) in enumerate(_MEMBERS.items()):
            columns = [c for c in m.table(name).columns if c != "source_zip"]
            members.append((f"data/{member.lower()}.tsv", "\t".join(columns).encode()))
            fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
            lines = m.table(name).select("source_zip", F.concat_ws("\t", *fields).cast("binary").alias("line"))
            part = lines.mapInArrow(lambda batches, place=place: pieces_of(batches, place), PIECES)
            pieces = part if pieces is None else pieces.unionByName(part)
        ordered = pieces.repartition("source_zip").sortWithinPartitions("source_zip", "place", "crc")
        ordered.mapInArrow(lambda batches: archives_of(batches, path, members), WRITTEN).collect()

    return m.exported("zips", export)


check("scan_zip_members", "SELECT * REPLACE (nullif(FIGI, '') AS FIGI) FROM raw_infotable")(
    lambda m: filings.scan_zip_members(m.spark, _zip_folder(m), "INFOTABLE", list(_COLUMNS["raw_infotable"]), "*.zip")
)


def _loaded(m: CheckModel) -> str:
    """The tables that a load of the archives wrote, after a second load that finds nothing new."""

    def export(path: str) -> None:
        for _ in range(2):
            filings.load_archives(m.spark, _zip_folder(m), path, F.lit("2026-10-01 00:00:00"), "*.zip")

    return m.exported("loaded-archives", export)


check("load_archives", "SELECT * REPLACE (nullif(FIGI, '') AS FIGI) FROM raw_infotable")(
    lambda m: filings.read_by_source(m.spark, f"{_loaded(m)}/raw_infotable", list(_COLUMNS["raw_infotable"]))
)


def _loaded_log(m: CheckModel) -> DataFrame:
    """What the log of the load tells, next to the bytes of each file and whether its hash is that of its bytes."""
    files = m.spark.read.format("binaryFile").load(_zip_folder(m)).select("path", F.col("length").alias("bytes"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                with open_file(path) as file:
                    digest = hashlib.file_digest(file, "sha256").hexdigest()
                yield pa.RecordBatch.from_pylist([{"path": path, "hash": digest}])

    # No archive is held as one value.
    hashes = files.select("path").mapInArrow(hashed, "path string, hash string")
    held = files.join(hashes, "path").withColumn("source_zip", filings.file_name(F.col("path")))
    log = m.spark.read.parquet(f"{_loaded(m)}/load_log").join(held, "source_zip")
    return log.select(
        "source_zip", "table_name", "row_count", "loaded_at",
        ((F.col("zip_bytes") == F.col("bytes")) & (F.col("zip_sha256") == F.col("hash"))).alias("as_filed"),
    )


check("load_archives_log", "SELECT source_zip, table_name, row_count, loaded_at, true AS as_filed FROM load_log")(_loaded_log)

# --- price files ----------------------------------------------------------------------------------------


def _price_files(m: CheckModel, kind: str) -> str:
    rows = m.table("raw_prices")
    names = ("open", "high", "low", "close", "volume")
    if kind == "csv":
        shaped = rows.select("symbol", F.col("day").alias("Date"), *(F.col(c).alias(c.title()) for c in names))
    elif kind == "bars":
        stamp = (F.unix_date("day").cast("bigint") * 86_400_000).alias("t")
        bar = F.struct(stamp, *(F.col(c).alias(c[0]) for c in names))
        # A document holds the bars of one month.
        monthly = rows.groupBy("symbol", F.trunc("day", "month").alias("month")).agg(F.collect_list(bar).alias("results"))
        shaped = monthly.select("symbol", "results")
    else:
        at = F.concat(F.col("day").cast("string"), F.lit("T00:00:00.000Z")).alias("date")
        shaped = rows.select("symbol", at, *(F.col(c).alias(f"adj{c.title()}") for c in names))

    def export(path: str) -> None:
        writer = shaped.hint("rebalance", "symbol").write.mode("overwrite").partitionBy("symbol")
        writer.csv(path, header=True) if kind == "csv" else writer.json(path)

    return m.exported(f"prices-{kind}", export)


_PRICES = f"SELECT symbol, day, {', '.join(cut(c, c) for c in ('open', 'high', 'low', 'close', 'volume'))} FROM raw_prices"
_SHOWN = ("symbol", "day", "open", "high", "low", "close", "volume")
check("scan_prices_csv", _PRICES)(
    lambda m: prices.scan_prices_csv(m.spark, _price_files(m, "csv")).select(*_SHOWN)
)
check("scan_prices_bars_json", _PRICES)(
    lambda m: prices.scan_prices_bars_json(m.spark, _price_files(m, "bars"), multi_line=False).select(*_SHOWN)
)
check("scan_prices_adj_json", _PRICES)(
    lambda m: prices.scan_prices_adj_json(m.spark, _price_files(m, "adj"), multi_line=False).select(*_SHOWN)
)

# --- lists ------------------------------------------------------------------------------------------------


def _company_documents(m: CheckModel) -> str:
    def export(path: str) -> None:
        entry = F.struct(
            F.col("cik").cast("string").alias("key"),
            F.struct(F.col("cik").alias("cik_str"), "ticker", "title").alias("value"),
        )
        # A document lists at most a thousand companies.
        rows = adapter.part_companies(m.spark, m.folder).groupBy(F.floor(F.col("cik") / 1000).alias("k"))
        rows.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value").write.mode(
            "overwrite"
        ).text(path)

    return m.exported("companies-json", export)


check("scan_keyed_json", "SELECT CAST(cik AS BIGINT) AS cik, ticker, title FROM part_companies")(
    lambda m: scan_keyed_json(m.spark, _company_documents(m), whole_files=False)
)


def _watchlist_file(m: CheckModel) -> str:
    """Every part's identifier as a watchlist, some twice, some blank, in any case."""

    def export(path: str) -> None:
        n = F.col("p_partkey")
        code = F.when(n % 10 == 3, " ").otherwise(F.concat(F.lit(" c"), F.lpad(F.floor(n / 2).cast("string"), 8, "0")))
        rows = m.part.select(F.concat(F.lit("t"), F.floor(n / 2).cast("string")).alias("ticker"), code.alias("cusip"), F.col("p_name").alias("name"))
        rows.write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)

    return m.exported("watchlist-csv", export)


check(
    "scan_watchlist",
    """
SELECT DISTINCT 'C' || lpad(CAST(p_partkey // 2 AS VARCHAR), 8, '0') AS cusip, 'T' || CAST(p_partkey // 2 AS VARCHAR) AS ticker
FROM part WHERE p_partkey % 10 <> 3
""",
)(lambda m: lists.scan_watchlist(m.spark, _watchlist_file(m)).select("cusip", "ticker"))


def _reference_file(m: CheckModel) -> str:
    def export(path: str) -> None:
        quarter = F.concat(F.year("period").cast("string"), F.lit("Q"), F.quarter("period").cast("string"))
        rows = m.table("holders").select(
            F.lit("T").alias("ticker"), "cusip", quarter.alias("period"), F.col("funds_holding").alias("filings"),
            F.col("shares").alias("shares_excl_options"), F.col("value").alias("value_excl_options_usd"),
        )
        rows.write.mode("overwrite").csv(path, header=True)

    return m.exported("reference-csv", export)


check(
    "scan_reference_holdings",
    "SELECT 'T' AS ticker, cusip, period, funds_holding AS filings, shares, value FROM holders",
)(lambda m: lists.scan_reference_holdings(m.spark, _reference_file(m)))

# --- fails-to-deliver files ---------------------------------------------------------------------------------

table(
    "ftd_files",
    """
SELECT 'cnsfails' || lpad(CAST(l_orderkey // 1000 AS VARCHAR), 9, '0') AS source_file, l_orderkey // 1000 AS bucket, count(*) AS n
FROM lineitem GROUP BY ALL
""",
)


def _ftd_files(m: CheckModel) -> str:
    """Files of a thousand orders' lines each, with header and trailer; every third miscounts, every
    fifth has another header."""

    def export(path: str) -> None:
        bucket = F.floor(F.col("l_orderkey") / 1000).alias("bucket")
        line = F.concat_ws(
            "|", F.lit("20260901"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lit("SYM"),
            F.col("l_quantity").cast("bigint").cast("string"), F.lit("ISSUER"), F.lit("."),
        )
        rows = m.source("lineitem").groupBy(bucket).agg(F.collect_list(line).alias("lines"))
        header = F.when(F.col("bucket") % 5 == 4, "DATE|CUSIP").otherwise(fails.HEADER)
        count = F.size("lines") + F.when(F.col("bucket") % 3 == 1, 1).otherwise(0)
        text = F.concat(
            header, F.lit("\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\nTrailer record count "), count.cast("string"),
            F.lit("\r\nTrailer total quantity of shares 1\r"),
        )
        name = F.concat(F.lit("cnsfails"), F.lpad(F.col("bucket").cast("string"), 9, "0")).alias("source_file")
        rows.select(name, text.alias("value")).write.mode("overwrite").partitionBy("source_file").text(path)

    return m.exported("ftd-files", export)


check(
    "ftd_file_audit",
    """
SELECT source_file, n AS data_rows, n + if(bucket % 3 = 1, 1, 0) AS counted,
       CASE WHEN bucket % 5 = 4 THEN 'unexpected header' WHEN bucket % 3 = 1 THEN 'rows differ from the trailer''s count' END AS reason,
       bucket % 5 <> 4 AND bucket % 3 <> 1 AS accepted
FROM ftd_files
""",
)(lambda m: fails.ftd_file_audit(m.spark, _ftd_files(m)))


def _new_files(m: CheckModel) -> DataFrame:
    """Rows per accepted file that is not among those loaded before (every fourth)."""
    bucket = F.floor(F.col("l_orderkey") / 1000)
    before = m.source("lineitem").where(bucket % 4 == 0).select(
        F.concat(F.lit("cnsfails"), F.lpad(bucket.cast("string"), 9, "0")).alias("source_file")
    )
    rows, rejected = fails.load_new_files(m.spark, _ftd_files(m), before)
    counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected.withColumn("rows", F.lit(0).cast("bigint"))
    )


check(
    "load_new_files",
    """
SELECT source_file, if(bucket % 5 = 4 OR bucket % 3 = 1, 0, n + 2) AS rows,
       CASE WHEN bucket % 5 = 4 THEN 'unexpected header' WHEN bucket % 3 = 1 THEN 'rows differ from the trailer''s count' END AS reason
FROM ftd_files WHERE bucket % 4 <> 0
""",
)(_new_files)



def _ftd_zips(m: CheckModel) -> str:
    """The same files as delivered: each zipped under its own name (every seventh under another)."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["source_file"].iloc[0]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("notes.txt" if int(source[8:]) % 7 == 6 else f"{source}.txt", rows["value"].iloc[0] + "\n")
        return pd.DataFrame({"source_file": [f"{source}.zip"], "content": [out.getvalue()]})

    def export(path: str) -> None:
        whole = m.spark.read.text(_ftd_files(m), wholetext=True)
        # The sink ends a file with a line feed, which readers of zips pass over.
        packed = whole.groupBy("source_file").applyInPandas(pack, "source_file string, content binary")
        packed.select("source_file", F.col("content").cast("string")).write.mode("overwrite").partitionBy("source_file").text(path)

    return m.exported("ftd-zips", export)


def _new_zips(m: CheckModel) -> DataFrame:
    """Rows per accepted zip, their shares and days, and what was rejected."""
    rows, rejected = fails.load_new_zips(m.spark, _ftd_zips(m), pattern="part-*")
    counts = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("quantity").cast("bigint")).alias("shares"), F.max("settlement_date").alias("latest")
    )
    none = {"rows": F.lit(0).cast("bigint"), "shares": F.lit(None).cast("bigint"), "latest": F.lit(None).cast("string")}
    return counts.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected.withColumns(none))


check(
    "load_new_zips",
    """
SELECT source_file || '.zip' AS source_file, if(r IS NULL, n + 2, 0) AS rows, if(r IS NULL, shares, NULL) AS shares,
       if(r IS NULL, 'Trailer total quantity of shares 1', NULL) AS latest, r AS reason
FROM (SELECT 'cnsfails' || lpad(CAST(l_orderkey // 1000 AS VARCHAR), 9, '0') AS source_file, count(*) AS n,
             CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS shares,
             CASE WHEN l_orderkey // 1000 % 7 = 6 THEN 'not one file of its own name inside'
                  WHEN l_orderkey // 1000 % 5 = 4 THEN 'unexpected header'
                  WHEN l_orderkey // 1000 % 3 = 1 THEN 'rows differ from the trailer''s count' END AS r
      FROM lineitem GROUP BY l_orderkey // 1000)
""",
)(_new_zips)

# --- sinks and rebuilds ---------------------------------------------------------------------------------------


def _history(m: CheckModel) -> DataFrame:
    """Two runs appended to one history."""

    def export(path: str) -> None:
        from checks.screen_queries import _runs

        rows = _runs(m)
        sinks.append_run_history(rows.where(F.month("period") <= 6), path)
        sinks.append_run_history(rows.where(F.month("period") > 6), path)

    return m.spark.read.parquet(m.exported("run-history", export))


check("run_history_table", "SELECT run_at, period, rank, cusip, rules FROM saved_runs")(
    lambda m: _history(m).select("run_at", "period", "rank", "cusip", "rules")
)


def _rebuilt(m: CheckModel) -> DataFrame:
    """Typical changes after the lookup lost every security type: kinds come from the words alone."""
    if "rebuilt" not in m.__dict__:
        for name in ("openfigi", "ticker_fallbacks", "stock_periods"):
            m.table(name)
        again = Model(m.spark, dict(m.raw), f"{m.path}/rebuilt", P, tables=dict(m.tables))
        for name in ("raw_xbrl_frames", "raw_sec_tickers", "raw_prices"):
            again.raw[name] = m.table(name)
        untyped = m.table("openfigi").withColumn("security_type", F.lit(None).cast("string"))
        again.rebuild_after_tickers(untyped, m.table("ticker_fallbacks"))
        m.__dict__["rebuilt"] = again
    again = m.__dict__["rebuilt"]
    return reads.kind_counts(again.table("stock_periods"), again.table("stocks"), P.min_funds)


check("refresh_after_dimension")(_rebuilt)
_KINDS = """
SELECT period, kind, count(*) AS stocks FROM compared_stocks GROUP BY period, kind
UNION ALL SELECT period, 'all', count(*) FROM compared_stocks GROUP BY period
"""
ORACLES["refresh_after_dimension"] = statement(_KINDS).replace(
    TABLES["openfigi"], f"SELECT * REPLACE (CAST(NULL AS VARCHAR) AS security_type) FROM ({TABLES['openfigi']})"
)
