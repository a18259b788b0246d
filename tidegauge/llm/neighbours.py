"""Nearest neighbours by inner product from a forest of hash-prefix trees.

Rows are dealt into shards of a bounded size, and blocks of queries meet every shard. In a shard a tree
is a sorted array of long hash strings: the signs of one set of random directions, one bit each, after a
vector has been given one more component that makes all lengths equal, so that angles order as inner
products. A query descends every tree to its longest matching prefix, then ascends in all of them at
once, a bit at a time, until the ranges of rows that share the prefix hold enough different candidates.
These are scored exactly; the best of all shards are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import staged


@dataclass(frozen=True)
class ForestParams:
    """`candidates` is the least share of a shard's different vectors, and `least` their least number,
    that a query scores before it stops to ascend; a shard of no more vectors is scored whole, so exactly.
    Vectors without structure (random directions) need large ones: their nearest are hardly nearer than
    the rest, and the share alone misses more of them the smaller the shard."""

    trees: int = 48
    bits: int = 32
    candidates: float = 0.4
    least: int = 2_048
    shard_rows: int = 16_384
    block_rows: int = 4_096
    seed: int = 11


class PrefixForest:
    """The trees of one shard over vectors without copies."""

    def __init__(self, vectors: np.ndarray, params: ForestParams):
        self.vectors, self.params = vectors, params
        square = (vectors**2).sum(axis=1)
        self.reach = float(square.max()) if len(square) else 1.0
        rng = np.random.default_rng(params.seed)
        width = vectors.shape[1]
        self.planes = rng.normal(size=(params.trees, width + 1, params.bits))
        lifted = np.concatenate([vectors, np.sqrt(np.maximum(self.reach - square, 0))[:, None]], axis=1)
        self.trees = []
        for planes in self.planes:
            codes = self._codes(lifted, planes)
            order = np.argsort(codes, kind="stable")
            self.trees.append((codes[order], order))

    def _codes(self, lifted: np.ndarray, planes: np.ndarray) -> np.ndarray:
        return ((lifted @ planes) > 0).astype(np.int64) @ (1 << np.arange(self.params.bits - 1, -1, -1, dtype=np.int64))

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """Places of the candidates of each query."""
        share = int(np.ceil(self.params.candidates * len(self.vectors)))
        enough = min(len(self.vectors), max(self.params.least, share))
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        codes = [self._codes(lifted, planes) for planes in self.planes]
        bits = self.params.bits
        waiting = np.arange(len(queries))
        found: list[np.ndarray | None] = [None] * len(queries)
        # Ascend: `kept` leading bits must match, one fewer a step, in every tree at once.
        for kept in range(bits, -1, -1):
            if not len(waiting):
                break
            shift = bits - kept
            ranges = []
            for (tree, _), own in zip(self.trees, codes, strict=True):
                low = own[waiting] >> shift << shift
                ranges.append((np.searchsorted(tree, low), np.searchsorted(tree, low + (1 << shift))))
            spans = np.sum([high - low for low, high in ranges], axis=0)
            still = []
            for i, q in enumerate(waiting):
                if kept and spans[i] < enough:
                    still.append(q)
                    continue
                hit = np.zeros(len(self.vectors), bool)
                for (_, order), (low, high) in zip(self.trees, ranges, strict=True):
                    hit[order[low[i] : high[i]]] = True
                places = np.flatnonzero(hit)
                if kept and len(places) < enough:
                    still.append(q)
                else:
                    found[q] = places
            waiting = np.array(still, np.int64)
        yield from found


def nearest_in_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, params: ForestParams):
    """(query, id, score) rows: the k nearest candidates of each query, ties to the smaller id, the
    query's own row (its id with its vector) left out. Copies of a vector are one entry of the forest with their smallest k + 1
    ids, which is all that can be among the nearest."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    _, first, member = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by_class = np.argsort(member, kind="stable")
    starts = np.searchsorted(member[by_class], np.arange(len(first) + 1))
    forest = PrefixForest(vectors[first], params)
    out_query, out_id, out_score = [], [], []
    for own, query, places in zip(query_ids, queries, forest.candidates(queries), strict=True):
        near = forest.vectors[places]
        rough = near @ query
        # Exact scores in one order of additions, so that equal vectors score alike wherever they lie.
        if len(rough) > 2 * k + 2:
            cut = np.partition(rough, len(rough) - 2 * k - 2)[len(rough) - 2 * k - 2]
            keep = rough >= cut - 1e-9 * max(1.0, abs(cut))
            places, near = places[keep], near[keep]
        scores = (near * query).sum(axis=1)
        sizes = np.minimum(starts[places + 1] - starts[places], k + 1)
        members = by_class[np.repeat(starts[places], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        some, score = ids[members], np.repeat(scores, sizes)
        others = (some != own) | ~np.repeat((near == query).all(axis=1), sizes)
        some, score = some[others], score[others]
        best = np.lexsort((some, -score))[:k]
        out_query.append(np.full(len(best), own))
        out_id.append(some[best])
        out_score.append(score[best])
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return join(out_query, np.int64), join(out_id, np.int64), join(out_score, float)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that can take part: an id, and a vector that is neither
    null, empty nor zero and has no null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null")
    return rows.where(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, params: ForestParams = ForestParams()) -> DataFrame:
    """For each distinct vec_id of `queries` its k nearest of `vectors` (both vec_id, embedding), all but
    itself: query_id, rank, vec_id, score. Vectors of another number of components than a query have no
    inner product with it and are no candidates. Repeated rows of one id and vector count once. Of an id
    with several vectors the least (component by component) is searched for; the others stay candidates,
    its own too. Null,
    zero and non-finite vectors take no part, on either side.

    A task holds one shard and one block, both bounded; answers of k rows a shard meet in one window."""
    base = staged(usable(vectors).distinct().withColumn("width", F.size("embedding")), "vectors")
    asked = staged(usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding")), "asked")
    shards = {r["width"]: max(1, -(-r["n"] // params.shard_rows)) for r in base.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {r["width"]: max(1, -(-r["n"] // params.block_rows)) for r in asked.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect()}
    widths = sorted(set(shards) & set(blocks))
    out = "query_id long, vec_id long, score double"
    if not widths:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = lambda counts: F.element_at(F.create_map(*(F.lit(x) for w in widths for x in (w, counts[w]))), F.col("width"))
    dealt = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), "vec_id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    base, asked = (x.where(F.col("width").isin(*widths)).withColumns({"n_shards": of(shards), "n_blocks": of(blocks)}) for x in (base, asked))
    left = base.select("width", dealt(F.col("n_shards"), "shard").alias("shard"), every(F.col("n_blocks")).alias("block"), "vec_id", "embedding")
    right = asked.select("width", every(F.col("n_shards")).alias("shard"), dealt(F.col("n_blocks"), "block").alias("block"), "vec_id", "embedding")

    def search(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = nearest_in_shard(
            one.vec_id.to_numpy(), np.stack(one.embedding.to_numpy()), two.vec_id.to_numpy(), np.stack(two.embedding.to_numpy()), k, params
        )
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    keys = ["width", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
