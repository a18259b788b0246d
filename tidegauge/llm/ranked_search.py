"""Ranked lexical search by bag deduplication.

Documents are restricted to the terms that items use. Those with the same terms, the same counts and the same
length figure m score alike for every item, so they are one class: found by a hash, told apart by what was
hashed. Each class is scored once, and its members follow by ascending doc_id. Only 20 members of a class can be
among an item's 20 best, so no class grows with its copies.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import staged

TOP = 20
#: Items of a block, and cells (terms times items) of its table: what a task holds of the items.
BLOCK_ITEMS, BLOCK_CELLS = 256, 16_000_000
#: Shares that a class is dealt into while it is cut to its first members.
DEALT = 32
# Everything but ASCII letters and digits parts terms; only A to Z become small.
_PARTS = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in _PARTS)


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a whole UTF-8 text; bytes from 128 on belong to no ASCII character."""
    return (text or b"").translate(_FOLD).split()


def weight(df: int, n: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def bags(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), and the ids and counts of those in the vocabulary, by id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, ids, tfs = [], [], []
            for text in batch["text"].cast(pa.binary()).to_pylist():
                terms = terms_of(text)
                known = sorted((vocabulary[t], c) for t, c in Counter(terms).items() if t in vocabulary)
                ns.append(len(terms))
                ids.append([i for i, _ in known])
                tfs.append([c for _, c in known])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(ns, pa.int64()), pa.array(ids, ints), pa.array(tfs, ints)], names=["doc_id", "n", "ids", "tfs"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(counted, "doc_id long, n long, ids array<int>, tfs array<int>")


def _first_members(rows: DataFrame, keys: list[str | Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("place", place).where(F.col("place") <= TOP).drop("place")


def classes(bagged: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """m, ids, tfs of every class, and its first members by ascending doc_id. A class may hold a third of all
    rows: each task cuts its part, dealt into shares, before it moves, and the shares are cut again."""
    # 25 * n * N and L are whole numbers, div rounds down.
    m = F.expr(f"100 - 25 + (25 * n * {n_docs}L) div {n_terms}L").alias("m")
    rows = bagged.where(F.size("ids") > 0).select("doc_id", m, "ids", "tfs").withColumn("hash", F.xxhash64("m", "ids", "tfs"))
    key = ["hash", "m", "ids", "tfs"]
    first = _first_members(rows, [*key, F.pmod(F.xxhash64("doc_id"), F.lit(DEALT))])
    members = F.sort_array(F.collect_list(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")))
    return _first_members(first, key).groupBy(*key).agg(members["doc_id"].alias("members")).drop("hash")


class _Best:
    """The best members so far of each item: (-score, null id, doc_id) by item."""

    def __init__(self, weights: np.ndarray, counts: np.ndarray):
        self.weights, self.counts = weights, counts
        self.least = np.ones(counts.shape[1], np.int64)
        self.kept: list[list[tuple]] = [[] for _ in self.least]

    def add(self, batch: pa.RecordBatch) -> None:
        ends = batch["ids"].offsets.to_numpy()
        ids, tfs = (batch[c].flatten().to_numpy().astype(np.int64) for c in ("ids", "tfs"))
        ends = ends - ends[0]
        m = np.repeat(batch["m"].to_numpy(), np.diff(ends))
        worth = self.weights[ids] * ((1_000_000_000 * tfs) // (1000 * tfs + 12 * m))
        scores = np.empty((len(batch), len(self.least)), np.int64)
        for row, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            scores[row] = worth[i:j] @ self.counts[ids[i:j]]
        # Of this batch, only what reaches its own 20th score and the least score kept so far.
        if len(batch) > TOP:
            bound = np.maximum(np.partition(scores, len(batch) - TOP, axis=0)[len(batch) - TOP], self.least)
        else:
            bound = self.least
        rows, items = np.nonzero(scores >= bound)
        members = batch["members"].to_pylist()
        touched = set(items.tolist())
        for row, item in zip(rows.tolist(), items.tolist(), strict=True):
            score = -int(scores[row, item])
            self.kept[item].extend((score, d is None, d or 0) for d in members[row])
        for item in touched:
            self.kept[item] = sorted(self.kept[item])[:TOP]
            if len(self.kept[item]) == TOP:
                self.least[item] = -self.kept[item][-1][0]


def _best_of_block(found: DataFrame, weights: np.ndarray, counts: np.ndarray) -> DataFrame:
    """item (its place in the block), doc_id, score: every task's 20 best members of each item."""
    sent = found.sparkSession.sparkContext.broadcast((weights, counts))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*sent.value)
        for batch in batches:
            if len(batch):
                best.add(batch)
        for i, kept in enumerate(best.kept):
            if kept:
                ids = pa.array([None if null else d for _, null, d in kept], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(kept), pa.int32()), ids, pa.array([-s for s, *_ in kept], pa.int64())], names=["item", "doc_id", "score"])

    return found.mapInArrow(scored, "item int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items (one row an item_id) with their terms, in blocks bounded in items and in cells."""
    block, seen = [], set()
    for row in items.toLocalIterator():
        terms = terms_of(row.text.encode() if row.text is not None else None)
        more = seen.union(terms)
        if block and (len(block) == BLOCK_ITEMS or (len(block) + 1) * len(more) > BLOCK_CELLS):
            yield block
            block, more = [], set(terms)
        block.append((row.item_id, terms))
        seen = more
    if block:
        yield block


def search(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 highest-scoring documents of each item, with a score above 0.

    Null texts have no terms; a repeated row of `docs` (doc_id long, text) is a document of its own, and null
    ids come after all others of their score. Rows that repeat an item_id are one item, with the smallest
    of their texts. No documents or no items give no rows. Other columns are not read. Items are a query
    set: they go to the tasks in blocks of bounded size, each against all documents."""
    single = items.groupBy("item_id").agg(F.min("text").alias("text")).orderBy("item_id")
    kind = items.schema["item_id"].dataType
    found = []
    for block in _blocks(single):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        if not vocabulary:
            continue
        bagged = staged(bags(docs, vocabulary), "bags")
        n_docs, n_terms = bagged.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        held = bagged.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df"))
        df = dict(held.collect())  # bounded by the terms of a block
        weights = np.array([weight(df.get(i, 0), n_docs) for i in range(len(vocabulary))], np.int64)
        counts = np.zeros((len(vocabulary), len(block)), np.int32)
        for i, (_, terms) in enumerate(block):
            for term, times in Counter(terms).items():
                counts[vocabulary[term], i] = times
        best = _best_of_block(classes(bagged, n_docs, n_terms), weights, counts)
        in_order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= TOP)
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        found.append(staged(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("item_id", kind)])).selectExpr("item_id", "1 AS rank", "1L AS doc_id", "1L AS score")
    out = found[0]
    for block in found[1:]:
        out = out.unionByName(block)
    return out
