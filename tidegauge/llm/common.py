"""What the operators of this folder share: the fold of the labels, bounded samples, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import shared_folder

#: Whether a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers that may go to every task, so that texts need not move to meet them (some tens of MB).
FEW = 1_000_000


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and in bytes, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows no label is learnt from; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def bounded_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most `rows` ids that are not held out, one label (the larger) each, in an order that depends
    on the id alone."""
    known = labels.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return (
        known.groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id")
        .limit(rows)
    )


def one_per_id(rows: DataFrame) -> DataFrame:
    """One row for each doc_id: of several the least by its other columns. Combined before the shuffle,
    so that an id repeated in many rows costs no task more than its partitions."""
    others = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("least")).select("doc_id", "least.*")


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = staging_folder(spark, name)
    # Nobody runs this plan again, so its shuffle files need not wait for the driver's garbage collector.
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def where_few(written: DataFrame, most: int = FEW) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast while it has at most `most` rows; a larger one is
    joined as Spark sees fit."""
    return F.broadcast(written) if written.count() <= most else written


def per_batch(start: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Callable[[Column], Column]:
    """A column function computed batch by batch; only its argument goes to Python. `start` runs once a
    task and gives the function of a batch."""

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = start()
        for batch in batches:
            yield work(batch)

    return F.arrow_udf(over, kind)
