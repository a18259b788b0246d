"""Company facts and company lists as published: one JSON document per frame, one per list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.filings import file_name

# Fixed value: the fields of a frame document.
FRAME_SCHEMA = (
    "taxonomy string, tag string, ccp string, uom string, "
    "data array<struct<accn: string, cik: bigint, entityName: string, loc: string, start: string, `end`: string, val: double>>"
)


def scan_xbrl_frames(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Fact rows of every frame document in a folder: one a file as published, or one a line."""
    documents = spark.read.schema(FRAME_SCHEMA).option("multiLine", multi_line).json(path)
    rows = documents.select(file_name().alias("source_file"), "taxonomy", "tag", "uom", "ccp", F.inline("data"))
    return rows.select(
        "source_file", "taxonomy", "tag", F.col("uom").alias("unit"), F.col("ccp").alias("frame"), "accn", "cik",
        F.col("entityName").alias("entity_name"), "loc",
        F.try_to_date("start", "yyyy-MM-dd").alias("period_start"),
        F.to_date("end", "yyyy-MM-dd").alias("period_end"),
        "val",
    )


def replace_frames(existing: DataFrame, new: DataFrame) -> DataFrame:
    """A frame read again replaces its rows."""
    return existing.join(new.select("source_file").distinct(), "source_file", "left_anti").unionByName(new)


def scan_keyed_json(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Companies of list documents whose keys carry no meaning: one a file as published, or one a line."""
    entries = F.from_json("value", "map<string, struct<cik_str: bigint, ticker: string, title: string>>")
    return (
        spark.read.text(path, wholetext=whole_files)
        .select(F.explode(F.map_values(entries)).alias("c"))
        .select(F.col("c.cik_str").alias("cik"), "c.ticker", "c.title")
    )
