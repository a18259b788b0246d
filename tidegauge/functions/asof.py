"""As-of lookups as a union and one window: no range join, one shuffle on the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    value: Column,
    out: str,
    forward: bool = False,
) -> DataFrame:
    """Each left row with the right side's `value` at its last time on or before the left time
    (forward: its first time on or after it); NULL when there is none. `value` is a struct."""
    names = left.columns
    asked = left.select(F.struct(*names).alias("_left"), F.col(key).alias("_key"), F.col(left_time).alias("_at"))
    known = right.where(F.col(right_time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_time).alias("_at"), value.alias("_value")
    )
    both = asked.withColumn("_value", F.lit(None).cast(known.schema["_value"].dataType)).unionByName(
        known.withColumn("_left", F.lit(None).cast(asked.schema["_left"].dataType))
    )
    when = F.col("_at").desc() if forward else F.col("_at").asc()
    # On equal times the known rows come first, so that "on" the date counts.
    order = Window.partitionBy("_key").orderBy(when, F.col("_left").isNotNull().asc())
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_found", F.last("_value", ignorenulls=True).over(so_far))
        .where(F.col("_left").isNotNull())
        .select("_left.*", F.col("_found").alias(out))
    )
