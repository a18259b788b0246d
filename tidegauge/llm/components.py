"""Connected components of a link table by large and small stars, each round written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import staged


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours now hang on its smallest one."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    hung = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
    return hung.where("a != b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours now hang on the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return hung.union(least.select("a", F.col("least").alias("b"))).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) of a long or string type: node, root (the smallest node that it reaches), for
    every node of a link between two different nodes. Null ends are no links. Each round at least
    halves long chains, so rounds grow with the logarithm of the longest; nothing but three numbers a
    round reaches the driver."""
    a, b = links.columns
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a != b").distinct()
    links = staged(links, "links")
    state = _state(links)
    while True:
        links = staged(_small_star(_large_star(links)), "links")
        now = _state(links)
        if now == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
