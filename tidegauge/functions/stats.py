"""Aggregation helpers that stay exact and keep hot groups spread over tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.sources.tables import staged

# Buckets per e-fold in the median's histogram: neighbouring buckets differ by under 1%.
_BUCKETS_PER_E = 128
# Parts of a range in each later histogram, and shares a bucket's values are dealt into unless their number is known.
_PARTS, _SHARES = 4096, 16
# Different values of one key that may be ranked in one task.
_BOUND = 1 << 16


def _bucket(value: Column) -> Column:
    """A bucket number that never decreases as the value grows. Never NULL, so that no null filter
    keeps Spark from reusing one shuffle for both passes over the counted values."""
    size = F.floor(F.log(F.abs(value)) * _BUCKETS_PER_E) + F.lit(1_000_000)
    return F.coalesce(F.when(value > 0, size).when(value < 0, -size), F.lit(0)).cast("long")


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, count: str | None = None) -> DataFrame:
    """One row per key with the exact median of a numeric column (NULLs left out), and how many
    values it has where `count` names a column for it.

    The built-in median keeps every distinct value of a group in one task's memory. Here equal values are
    counted first (partial aggregation, shuffled on key and value) and written. Keys with at most 65,536
    different values, known from the counts, are ranked at once. For larger ones the middle is selected in
    rounds: a histogram, of which the part with the middle is kept, until so many values are left; each round
    leaves about 1/4096 of the range, so four to six end it. Both ways rank the same values."""
    v = F.col(value)
    counted = df.where(v.isNotNull()).groupBy(*keys, v.cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = staged(counted, "median")
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_distinct"))
    most = sizes.agg(F.max("_distinct")).first()[0] or 0
    if most <= _BOUND:
        return _at_once(counted, keys, out, count)
    shares = -(-most // _BOUND)
    large = sizes.where(F.col("_distinct") > _BOUND).select(*keys, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"))
    dealt = counted.withColumn("_share", _share_of(shares))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"l.{k}")) for k in (*keys, "_share")]
    some = lambda how: dealt.alias("c").join(large.alias("l"), reduce(Column.__and__, same), how).drop("_share")
    found = _in_rounds(staged(some("left_semi"), "median-large"), keys, shares, out, count)
    return _at_once(some("left_anti"), keys, out, count).unionByName(found)


def _share_of(shares: int) -> Column:
    return F.pmod(F.xxhash64("_v"), F.lit(shares)).cast("int")


def _between(ranked: DataFrame, keys: list[str], out: str, count: str | None) -> DataFrame:
    """The median from values with the rank (_rank) that the last of them has."""
    at = lambda position: F.min(F.when(F.col("_rank") >= F.col(position), F.col("_v")))
    found = [(at("_low") * 0.5 + at("_high") * 0.5).alias(out)]
    if count is not None:
        found.append(F.max("_all").alias(count))
    return ranked.groupBy(*keys).agg(*found)


def _at_once(counted: DataFrame, keys: list[str], out: str, count: str | None) -> DataFrame:
    by_key = Window.partitionBy(*keys).orderBy("_v")
    ranked = counted.withColumn("_rank", F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    everything = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_all", F.max("_rank").over(everything))
    middle = ranked.withColumns({"_low": F.floor((F.col("_all") + 1) / 2), "_high": F.floor(F.col("_all") / 2) + 1})
    return _between(middle, keys, out, count)


def _in_rounds(counted: DataFrame, keys: list[str], shares: int, out: str, count: str | None) -> DataFrame:
    """The median of keys that have too many values for one task. The lower and the upper middle may part; from
    then on _side tells the group of each."""
    pool, group = middle_buckets(counted.withColumn("_b", _bucket(F.col("_v"))), keys, shares), [*keys, "_b"]
    while True:
        so_far = Window.partitionBy(*group).orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
        parts = (
            pool.groupBy(*group, "_s", "_before", "_low", "_high")
            .agg(F.sum("_n").alias("_in"), F.count(F.lit(1)).alias("_distinct"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            .withColumn("_upto", F.col("_before") + F.sum("_in").over(so_far))
            .withColumn("_start", F.col("_upto") - F.col("_in"))
            .where((F.col("_start") < F.col("_high")) & (F.col("_upto") >= F.col("_low")))
            .withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
            .select(*group, "_s", "_share", "_start", "_distinct", "_least", "_most")
        )
        same = [F.col(f"p.{k}").eqNullSafe(F.col(f"q.{k}")) for k in (*group, "_s", "_share")]
        kept = pool.withColumn("_share", _share_of(shares)).alias("p").join(parts.alias("q"), reduce(Column.__and__, same))
        kept = kept.select(
            *(f"p.{k}" for k in keys), "_v", "_n", "_low", "_high", "_all", F.col("_start").alias("_before"), "_distinct", "_least", "_most",
            (F.col("_start") < F.col("_low")).alias("_side"),
        )
        kept, group = staged(kept, "median-middle"), [*keys, "_side"]
        if kept.agg(F.max("_distinct")).first()[0] <= _BOUND:
            in_group = Window.partitionBy(*group).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
            return _between(kept.withColumn("_rank", F.col("_before") + F.sum("_n").over(in_group)), keys, out, count)
        pool = kept.withColumn("_s", _part_of_range()).drop("_distinct", "_least", "_most")


def _part_of_range() -> Column:
    """The part of its group's range (from _least to _most) that a value falls in; both ends are parts of their own."""
    width = F.col("_most") - F.col("_least")
    part = F.floor((F.col("_v") - F.col("_least")) / width * (_PARTS - 1))
    return F.when(width > 0, part).otherwise(0)


def middle_buckets(counted: DataFrame, keys: list[str], shares: int = _SHARES) -> DataFrame:
    """The counted values (_v, _n) of the bucket _b, or the two, in which a key's middle lies, with the part
    _s of the bucket's range each falls in. A bucket may hold most of a key's values, so they are dealt by
    value over tasks, and the few rows about buckets are repeated for each share."""
    by_key = Window.partitionBy(*keys)
    buckets = (
        counted.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        .withColumn("_upto", F.sum("_in").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_all", F.sum("_in").over(by_key))
        .withColumn("_low", F.floor((F.col("_all") + 1) / 2))
        .withColumn("_high", F.floor(F.col("_all") / 2) + 1)
        .withColumn("_before", F.col("_upto") - F.col("_in"))
        .where((F.col("_before") < F.col("_high")) & (F.col("_upto") >= F.col("_low")))
        .select(*keys, "_b", "_before", "_low", "_high", "_all", "_least", "_most")
        .withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    )
    dealt = counted.withColumn("_share", _share_of(shares))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in (*keys, "_b", "_share")]
    joined = dealt.alias("c").join(buckets.alias("m"), reduce(Column.__and__, same))
    found = joined.select("c.*", *(f"m.{c}" for c in ("_before", "_low", "_high", "_all", "_least", "_most")))
    return found.withColumn("_s", _part_of_range()).drop("_share", "_least", "_most")


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each group with the smallest ordering, chosen by a partial aggregate.

    Descending numbers and dates are passed negated (see `desc_date`)."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def desc_date(day: Column) -> Column:
    """A sort key that puts later dates first and missing ones last."""
    return F.coalesce(-F.unix_date(day), F.lit(2_147_483_647))


def ratio_change(now: Column, before: Column) -> Column:
    """now / before - 1, NULL unless the earlier figure is positive."""
    return F.when(before > 0, now.cast("double") / before - 1)


def is_true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def optional(df: DataFrame | None, column: str, type_name: str) -> Column:
    """A column when the table has it, else a typed NULL (older or missing tables)."""
    if df is not None and column in df.columns:
        return F.col(column)
    return F.lit(None).cast(type_name).alias(column)


def product_minus_one(values: Column) -> Column:
    """Compounded return of a short array of returns."""
    return F.aggregate(values, F.lit(1.0), lambda acc, r: acc * (r + 1)) - 1
