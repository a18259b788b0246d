"""Writing model tables and reading them back, which cuts lineage and survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegauge.session import shared_folder


def write_table(df: DataFrame, path: str, partition_by: str | None = None, rebalance: bool = True) -> DataFrame:
    """Write a table as Parquet (whole, replacing what was there) and read it back.

    Rebalancing lets AQE split a large period over several tasks and merge small ones, so each
    period ends up in files of a sensible size. Without it a table is written as its plan leaves it, which
    saves moving every row once more."""
    shaped = df.hint("rebalance", *([partition_by] if partition_by else [])) if rebalance else df
    writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return read_table(df.sparkSession, path, df)


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to a new folder that all executors share, and read back."""
    return write_table(df, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
