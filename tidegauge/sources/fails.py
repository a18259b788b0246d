"""Fails-to-deliver files: pipe-delimited, with trailer lines that count the records."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from io import BufferedReader

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import shared_folder
from tidegauge.sources.filings import file_name
from tidegauge.sources.tables import write_table

# The documented header, the file names, the trailer.
HEADER = "SETTLEMENT DATE|CUSIP|SYMBOL|QUANTITY (FAILS)|DESCRIPTION|PRICE"
FILE_NAME = r"(?i)^cnsfails(\d{4})(\d{2})([ab])"
TRAILER = "Trailer"
SCHEMA = "settlement_date string, cusip string, symbol string, quantity string, description string, price string"
MONTHS = 13


def scan_ftd_pipe(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Every line after the header as text; short trailer lines are kept, padded with NULL."""
    rows = (
        spark.read.schema(SCHEMA)
        .option("sep", "|").option("header", True).option("enforceSchema", True)
        .option("quote", "").option("escape", "").option("encoding", "ISO-8859-1").option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .csv(paths)
    )
    return rows.select("*", file_name().alias("source_file"))


def _is_trailer():
    return F.coalesce(F.startswith("settlement_date", F.lit(TRAILER)), F.lit(False))


def ftd_zip_lines(spark: SparkSession, folder: str, pattern: str = "*.zip") -> DataFrame:
    """Every line of delivered zips: source_file (the zip), number (0 for the header) and line. A zip holds
    one file of its own name, with .txt or nothing after it; one with none or several has a single row
    without a number, whose line is NULL. A zip opens once, in one task, and streams out in batches."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, content in zip(batch["source_file"].to_pylist(), batch["content"], strict=True):
                own = source.casefold().removesuffix(".zip")
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as archive:
                    data = [n for n in archive.namelist() if n.rsplit("/", 1)[-1].casefold() in (own, f"{own}.txt")]
                    if len(data) != 1:
                        yield _numbered(source, None, [None])
                        continue
                    with archive.open(data[0]) as opened:
                        stream, number = BufferedReader(opened, 1 << 20), 0
                        while lines := stream.readlines(4 << 20):
                            yield _numbered(source, number, [x.rstrip(b"\r\n").decode("latin-1") for x in lines])
                            number += len(lines)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(file_name(F.col("path")).alias("source_file"), "content").mapInArrow(unpack, "source_file string, number bigint, line string")


def _numbered(source: str, first: int | None, lines: list[str | None]) -> pa.RecordBatch:
    numbers = [None] if first is None else range(first, first + len(lines))
    return pa.RecordBatch.from_arrays(
        [pa.array([source] * len(lines), pa.string()), pa.array(numbers, pa.int64()), pa.array(lines, pa.string())],
        ["source_file", "number", "line"],
    )


def ftd_zip_rows(lines: DataFrame) -> DataFrame:
    """The rows of `ftd_zip_lines`, as `scan_ftd_pipe` gives them: lines after the header, blank ones left
    out, short ones padded with NULL."""
    fields = F.split("line", r"\|", -1)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = (F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(names))
    return lines.where((F.col("number") > 0) & (F.length(F.trim("line")) > 0)).select(*columns, "source_file")


def load_new_zips(
    spark: SparkSession, folder: str, loaded: DataFrame | None = None, pattern: str = "*.zip"
) -> tuple[DataFrame, DataFrame]:
    """`load_new_files` for delivered zips."""
    lines = ftd_zip_lines(spark, folder, pattern)
    if loaded is not None:
        lines = lines.join(loaded.select("source_file").distinct(), "source_file", "left_anti")
    lines = write_table(lines, f"{shared_folder(spark)}/fails-{uuid.uuid4().hex}")
    audit = _audit(lines.select("source_file", F.rtrim("line").alias("line")), ftd_zip_rows(lines))
    accepted = audit.where("accepted").select("source_file")
    rows = ftd_zip_rows(lines.join(accepted, "source_file", "left_semi"))
    return rows, audit.where(~F.col("accepted")).select("source_file", "reason")


def ftd_file_audit(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Per file: accepted, or why not. The header must be the documented one, every line must have
    been read, and the data rows must be as many as the trailer counts."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("recursiveFileLookup", True).text(paths).select(
        file_name().alias("source_file"), F.rtrim(F.regexp_replace("value", "\r$", "")).alias("line")
    )
    return _audit(lines, scan_ftd_pipe(spark, paths))


def _audit(lines: DataFrame, loaded: DataFrame) -> DataFrame:
    """The verdict on each file from its lines (source_file, line; no line but a NULL where a zip held no
    one data file) and the rows read from them."""
    counted = F.regexp_extract("line", r"(?i)^Trailer record count\s+(\d+)$", 1)
    texts = lines.groupBy("source_file").agg(
        F.count_if(F.col("line").isNull()).alias("unclear"),
        F.count_if(F.col("line") == HEADER).alias("headers"),
        F.count_if(F.length(F.trim("line")) > 0).alias("lines"),
        F.max(F.when(counted != "", counted.cast("bigint"))).alias("counted"),
        F.count_if(
            (F.col("line") != HEADER) & ~F.startswith("line", F.lit(TRAILER)) & (F.length(F.trim("line")) > 0)
            & (F.size(F.split("line", r"\|")) != 6)
        ).alias("ragged"),
    )
    rows = loaded.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("loaded"), F.count_if(~_is_trailer()).alias("data_rows")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    reason = (
        F.when(F.col("unclear") > 0, "not one file of its own name inside")
        .when(F.col("headers") == 0, "unexpected header")
        .when(zero("loaded") != F.col("lines") - 1, "lines not read")
        .when(F.col("ragged") > 0, "a line without six fields")
        .when(F.col("counted") != zero("data_rows"), "rows differ from the trailer's count")
    )
    return texts.join(rows, "source_file", "left").select(
        "source_file", zero("data_rows").alias("data_rows"), "counted", reason.alias("reason"),
        reason.isNull().alias("accepted"),
    )


def load_new_files(
    spark: SparkSession, paths: list[str] | str, loaded: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of the acceptable files not loaded yet, and the rejected files with the reason."""
    audit = ftd_file_audit(spark, paths)
    if loaded is not None:
        audit = audit.join(loaded.select("source_file").distinct(), "source_file", "left_anti")
    # One row per file: the file list is what the folder holds, not what the files hold.
    accepted = audit.where("accepted").select("source_file")
    rows = scan_ftd_pipe(spark, paths).join(accepted, "source_file", "left_semi")
    return rows, audit.where(~F.col("accepted")).select("source_file", "reason")


def newest_months(names: DataFrame, months: int = MONTHS) -> DataFrame:
    """Files of the last calendar months up to the newest, ordered by the date in their names. The
    last of several links to one name counts (column `line_no`)."""
    part = lambda n: F.regexp_extract("name", FILE_NAME, n)
    dated = (
        names.where(F.col("name").rlike(FILE_NAME))
        .groupBy(F.lower("name").alias("name"))
        .agg(F.max_by("link", "line_no").alias("link"))
        .withColumn("month_no", part(1).cast("int") * 12 + part(2).cast("int"))
        .withColumn("half", F.lower(part(3)))
    )
    newest = dated.agg(F.max("month_no")).scalar()
    return (
        dated.where(F.col("month_no") > newest - months)
        .select("name", "link", F.concat(part(1), part(2)).alias("month"), "half")
        .orderBy("month", "half")
    )

