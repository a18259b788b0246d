"""Incremental loading without loss: parts of a delivery add up, a newer delivery replaces an older one whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from tidegauge.session import shared_folder
from tidegauge.sources.filings import replace_by_source
from tidegauge.sources.tables import write_table

#: Columns that the landed rows have besides their own; rows to load must not use these names.
DELIVERY, BATCH = "load_delivery", "load_batch"


def delivery_folder() -> Column:
    """The delivery a row's file belongs to: the folder it lies in."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def ledger_folder(table: str) -> str:
    """The rows that each batch brought of each source's deliveries: source, load_delivery, load_rows, load_batch."""
    return f"{table.rstrip('/')}-ledger"


def held_folder(table: str) -> str:
    """Which delivery of a source each batch put into the table: source, load_delivery, load_batch."""
    return f"{table.rstrip('/')}-held"


def landing_folder(table: str) -> str:
    """Where the deliveries of a table land, each part kept."""
    return f"{table.rstrip('/')}-deliveries"


def stream_ingest(
    spark: SparkSession,
    schema: T.StructType,
    incoming: str,
    table: str,
    checkpoint: str,
    source: str = "source_zip",
    file_format: str = "parquet",
    expected: Callable[[SparkSession], DataFrame] | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Load what has arrived below `incoming` since the last run and stop.

    A delivery is a folder of files, of one or more sources; deliveries of a source follow each other in
    the order of their folders' names. Parts that arrive in later batches or runs add to their delivery.
    `table` holds, for every source, the rows of its newest complete delivery, and no others. With
    `expected` (source, load_delivery, expected: the rows that were declared, read anew in every batch) a
    delivery is complete once its rows agree; until then the one before stays. Without it, every delivery
    counts as complete.

    A batch lands in partitions of its own number and adds its counts to a ledger. Which deliveries are complete and
    which is the newest comes from the ledger; of what landed before, only the rows of a delivery that a source now
    gets are read. All that a batch writes goes by its number, and the table is compared with what earlier batches put
    into it, so a batch run again after a failure leaves the same table. `max_files` bounds a batch."""
    reader = spark.readStream.schema(schema).format(file_format).option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arriving = reader.load(incoming).withColumn(DELIVERY, delivery_folder())
    landing = landing_folder(table)
    placed = T.StructType([T.StructField(DELIVERY, T.StringType()), T.StructField(BATCH, T.LongType())])
    landed_schema = T.StructType([*schema.fields, *placed.fields])

    counted = f"`{source}` string, {DELIVERY} string, load_rows long, {BATCH} long"
    put = f"`{source}` string, {DELIVERY} string, {BATCH} long"

    def load(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        by_batch = batch.withColumn(BATCH, F.lit(number).cast("long")).hint("rebalance", source, DELIVERY)
        _overwrite(by_batch, landing, source, DELIVERY, BATCH)
        landed = _read(session, landing, landed_schema)
        brought = landed.where(F.col(BATCH) == number).groupBy(source, DELIVERY).agg(F.count(F.lit(1)).alias("load_rows"))
        _overwrite(brought.withColumn(BATCH, F.lit(number).cast("long")).coalesce(1), ledger_folder(table), BATCH)
        due = due_deliveries(
            _read(session, ledger_folder(table), counted), _read(session, held_folder(table), put), number, source,
            expected and expected(session),
        )
        due = write_table(due, f"{shared_folder(session)}/due-{uuid.uuid4().hex}")
        names = due.collect()  # one row a source whose rows change
        if not names:
            return
        # The folders to read are known when the scan is planned: no earlier delivery of these sources is opened.
        wanted = landed.where(F.col(source).isin([r[source] for r in names]) & F.col(DELIVERY).isin(list({r[DELIVERY] for r in names})))
        rows = wanted.join(F.broadcast(due), [source, DELIVERY], "left_semi")
        replace_by_source(rows.select(*schema.names), table, source)
        _overwrite(due.withColumn(BATCH, F.lit(number).cast("long")).coalesce(1), held_folder(table), BATCH)

    return (
        arriving.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _overwrite(rows: DataFrame, path: str, *partitions: str) -> None:
    """Write rows so that they replace the partitions they belong to, and no others."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table, or none of its rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def due_deliveries(ledger: DataFrame, held: DataFrame, number: int, source: str = "source_zip", expected: DataFrame | None = None) -> DataFrame:
    """Sources and the delivery each is to get in batch `number`: the newest complete one, where the batch brought
    rows of it or the table holds another. Only counts are read."""
    totals = ledger.where(F.col(BATCH) <= number).groupBy(source, DELIVERY).agg(F.sum("load_rows").alias("load_rows"), F.max(BATCH).alias("last"))
    if expected is not None:
        totals = totals.join(expected, [source, DELIVERY]).where(F.col("load_rows") == F.col("expected"))
    newest = totals.groupBy(source).agg(F.max(F.struct(DELIVERY, "last")).alias("newest")).select(source, "newest.*")
    before = held.where(F.col(BATCH) < number).groupBy(source).agg(F.max_by(DELIVERY, BATCH).alias("held"))
    changed = F.col("held").isNull() | (F.col("held") != F.col(DELIVERY)) | (F.col("last") == number)
    return newest.join(before, source, "left").where(changed).select(source, DELIVERY)


def complete(rows: DataFrame, keys: list[str], expected: DataFrame | None) -> DataFrame:
    """The keys whose rows number what `expected` (the keys, expected) declares; all, if nothing does."""
    if expected is None:
        return rows.select(*keys).distinct()
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("load_rows"))
    return counts.join(expected, keys).where(F.col("load_rows") == F.col("expected")).select(*keys)


def audited_batch(batch: DataFrame, expected: DataFrame, source: str = "source_zip") -> DataFrame:
    """Rows of the sources whose counts agree with what their files declare."""
    return batch.join(complete(batch, [source], expected), source, "left_semi")
