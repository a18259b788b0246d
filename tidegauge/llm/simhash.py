"""Near copies by SimHash: fingerprints that share pigeonhole blocks are joined, then verified.

A fingerprint of 64 bits is four blocks of 16. Two fingerprints that differ in at most two bits agree
in at least two whole blocks, so they meet under one of six keys of 32 bits. A key that more than
`crowd` fingerprints share (a large group of near copies) makes no pairs. Its fingerprints are dealt
again by neighbourhood: two of them differ in at most two bits exactly when some value is at most one
bit from both, so each goes to 65 such values, and whoever meets there is linked.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import free_name, per_batch, staged, where_few
from tidegauge.llm.components import components
from tidegauge.llm.shingles import links_alike, with_keys

BITS, BLOCKS, REACH = 64, 4, 2
SHINGLE, SEED = 3, 42
#: Fingerprints that may share a key before they are dealt by neighbourhood.
CROWD = 32


def fingerprint_of(text: bytes | None) -> int:
    """The fingerprint of a UTF-8 text as a signed long: bit i is set where over half the shingles'
    hashes set it. Capitals A to Z count as small letters; no words (or null) give zero."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - SHINGLE + 1, 1)
    hash64 = xxhash.xxh64_intdigest
    spans = zip(starts[:last].tolist(), ends[-last:].tolist(), strict=True)
    hashes = np.fromiter((hash64(joined[i:j], SEED) for i, j in spans), np.uint64, last)
    total = np.zeros(BITS, np.int64)
    for i in range(0, last, 4096):
        bits = np.unpackbits(hashes[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > last, bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, column: str = "simhash") -> DataFrame:
    """`docs` with the fingerprint of each whole text in `column` (replaced, if there is one)."""

    def marked(batch: pa.Array) -> pa.Array:
        return pa.array(map(fingerprint_of, batch.cast(pa.binary()).to_pylist()), pa.int64())

    return docs.withColumn(column, per_batch(lambda: marked, "long")("text"))


def _keys(value):
    """The six keys of a fingerprint: which two blocks, and their bits."""
    width = BITS // BLOCKS

    def block(i: int):
        return F.shiftrightunsigned(value, width * i).bitwiseAND((1 << width) - 1)

    return F.array(
        *(
            F.struct(F.lit(n).alias("pair"), F.shiftleft(block(i), width).bitwiseOR(block(j)).alias("bits"))
            for n, (i, j) in enumerate(combinations(range(BLOCKS), REACH))
        )
    )


def _apart(a, b):
    return F.bit_count(a.bitwiseXOR(b))


def links_between(values: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) between different fingerprints of `values` (one distinct long column, `value`) that
    connect exactly those that are connected at two or fewer differing bits."""
    keyed = staged(values.select("value", F.explode(_keys(F.col("value"))).alias("key")).select("value", "key.*"), "keys")
    sizes = keyed.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = keyed.join(sizes, ["pair", "bits"])
    few = shared.where(F.col("members") <= crowd).select("pair", "bits", "value")
    # A bounded join on blocks; only verified links leave it.
    near = (
        few.groupBy("pair", "bits")
        .agg(F.array_sort(F.collect_list("value")).alias("near"))
        .select(F.explode("near").alias("a"), "near")
        .select("a", F.explode(F.filter("near", lambda b: (b > F.col("a")) & (_apart(F.col("a"), b) <= REACH))).alias("b"))
    )
    crowded = shared.where(F.col("members") > crowd).select("value").distinct()
    flips = F.concat(
        F.array(F.col("value")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    )
    # At most 65 values are one bit or less from a centre, so these lists are bounded.
    met = crowded.select("value", F.explode(flips).alias("centre")).groupBy("centre").agg(F.collect_list("value").alias("near"))
    star = (
        met.where(F.size("near") > 1)
        .select(F.explode("near").alias("a"), F.array_min("near").alias("b"))
        .where("a != b")
        .where(_apart(F.col("a"), F.col("b")) <= REACH)
    )
    return near.unionByName(star).distinct()


def near_copies(marked: DataFrame, column: str = "simhash", linked: Callable[[DataFrame], DataFrame] = links_between) -> DataFrame:
    """For rows with doc_id and a fingerprint in `column`: one row per distinct fingerprint (of which
    `linked` makes the links) with component_id, the smallest doc_id of all rows reachable over links (null ids count only where there
    is no other), and stays, the fingerprint of the row that stands for the component (of the smallest
    fingerprint, if several rows have that id)."""
    value = F.col(column)
    own = staged(marked.groupBy(value.alias("value")).agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(linked(own.select("value")))
    rooted = own.join(roots.withColumnRenamed("node", "value"), "value", "left").select(
        "value", "least", F.coalesce("root", "value").alias("root")
    )
    first = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"),
        F.min(F.struct(F.col("least").isNull(), "least", "value")).getField("value").alias("stays"),
    )
    return staged(rooted.join(first, "root").select(F.col("value").alias(column), "component_id", "stays"), "components")


def deduplicate(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component of near copies (shingles.py: five words, a similarity of 4/5
    or more): that with the smallest doc_id, and of repeated rows with that id one. Texts of the same
    words are copies, and so are null and empty texts. An empty table stays empty."""
    value, keys, place = free_name(docs, "whole"), free_name(docs, "keys"), free_name(docs, "place")
    marked = staged(with_keys(docs, value, keys), "marked")
    groups = near_copies(marked.select("doc_id", value), value, lambda _: links_alike(marked, value, keys))
    rows = marked.select("doc_id", value).join(groups, value)
    stays = (F.col(value) == F.col("stays")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    # The rows that go hold no text and are often few: then the texts need not move to meet them.
    gone = staged(rows.where(~stays).select(F.col(value).alias("whole_gone"), F.col("doc_id").alias("id_gone")).distinct(), "gone")
    kept = marked.join(where_few(gone), (marked[value] == gone["whole_gone"]) & marked["doc_id"].eqNullSafe(gone["id_gone"]), "left_anti")
    # Only repeated rows are ranked, so that other texts stay where they are.
    times = staged(rows.where(stays).groupBy(value).agg(F.count(F.lit(1)).alias(place)).where(F.col(place) > 1).select(value), "repeated")
    times = where_few(times)
    first = Window.partitionBy(value).orderBy(F.xxhash64("text"), "text")
    several = kept.join(times, value, "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return kept.join(times, value, "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))
