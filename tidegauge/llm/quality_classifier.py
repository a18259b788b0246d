"""Quality: gradient-boosted trees over document statistics.

Statistics are taken from every whole text. Training sorts each statistic into quantile bins once and
grows trees of a fixed depth from histograms of gradients. A forest is five arrays, one row a tree in
heap order (children of node i are 2i+1 and 2i+2), so that scoring a batch is a few numpy gathers.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bounded_sample, one_per_id, per_batch

STATISTICS = (
    "words", "chars_per_word", "longest_word", "distinct_words", "top_word", "repeated_trigrams", "capital_words",
    "title_words", "stop_share", "lines", "chars_per_line",
    "short_lines", "repeated_lines", "ended_lines", "letters", "capitals", "digits", "spaces", "symbols", "marks",
    "bangs", "pipes", "high_bytes", "longest_run", "packed",
)
_CLASSES = {
    "letters": b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digits": b"0123456789", "spaces": b" \t\r\n\v\f", "symbols": b"#*$%&|<>{}[]=_~^\\@", "marks": b".,;:?!'\"()-",
    "bangs": b"!", "pipes": b"|",
}
_CLASS_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _i, _chars in enumerate(_CLASSES.values()):
    _CLASS_TABLE[list(_chars), _i] = 1
_CLASS_TABLE[128:, -1] = 1


@dataclass(frozen=True)
class QualityParams:
    """max_rows bounds the labelled rows that are learnt from."""

    trees: int = 80
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    leaf_weight: float = 2.0
    ridge: float = 1.0
    max_rows: int = 20_000


@dataclass(frozen=True)
class Forest:
    """feature and cut by inner node, value by leaf, of every tree; base is the score before the trees."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float


def statistics_of(text: str | None) -> list[float]:
    """The statistics of one text; all zero where it is null or empty. Shares are of words, lines or
    bytes, so a long text and a short one are on one scale."""
    if not text:
        return [0.0] * len(STATISTICS)
    words = text.split()
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    lowered = text.lower().split()
    counts = Counter(lowered)
    triples = set(zip(lowered, lowered[1:], lowered[2:]))  # noqa: B905
    raw = text.encode("utf-8", "replace")
    codes = np.frombuffer(raw, np.uint8)
    shares = np.bincount(codes, minlength=256) @ _CLASS_TABLE / len(codes)
    changes = np.flatnonzero(np.diff(codes))
    run = np.diff(np.concatenate([[-1], changes, [len(codes) - 1]])).max()
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        np.log1p(max(map(len, words), default=0)),
        len(counts) / n,
        max(counts.values(), default=0) / n,
        1 - len(triples) / max(len(lowered) - 2, 1) if triples else 0.0,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum([c for w, c in counts.items() if len(w) <= 3]) / n,
        np.log1p(len(lines)),
        np.log1p(len(text) / m),
        sum(len(x) < 30 for x in lines) / m,
        1 - len(set(lines)) / m if lines else 0.0,
        sum(x[-1] in ".!?\"'" for x in lines) / m,
        *shares,
        np.log1p(run),
        len(zlib.compress(raw, 1)) / len(raw),
    ]


def train(rows: np.ndarray, labels: np.ndarray, params: QualityParams) -> Forest:
    """Boost the log odds of label 1. Without rows of both labels every text scores their share (one
    half if there are no rows)."""
    inner, leaves = (1 << params.depth) - 1, 1 << params.depth
    share = float(labels.mean()) if len(labels) else 0.5
    base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    feature = np.zeros((params.trees, inner), np.int32)
    cut = np.full((params.trees, inner), np.inf)
    value = np.zeros((params.trees, leaves))
    if len(labels) == 0 or share in (0.0, 1.0):
        return Forest(feature, cut, value, base)
    wide = rows.shape[1]
    edges = [np.unique(np.quantile(rows[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(wide)]
    # Bin b holds what is over edge b-1 and at most edge b.
    binned = np.stack([np.searchsorted(edges[j], rows[:, j]) for j in range(wide)], axis=1)
    flat = binned + np.arange(wide) * params.bins
    score = np.full(len(labels), base)
    for t in range(params.trees):
        odds = 1 / (1 + np.exp(-score))
        slope, bend = odds - labels, odds * (1 - odds)
        node = np.zeros(len(labels), np.int64)
        for level in range(params.depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (wide * params.bins) + flat).ravel()
            total = width * wide * params.bins
            g = np.bincount(at, np.repeat(slope, wide), total).reshape(width, wide, params.bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(bend, wide), total).reshape(width, wide, params.bins).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + params.ridge) + (all_g - g) ** 2 / (all_h - h + params.ridge) - all_g**2 / (all_h + params.ridge)
            gain[(h < params.leaf_weight) | (all_h - h < params.leaf_weight)] = 0
            for j in range(wide):
                gain[:, j, len(edges[j]) :] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                j, b = divmod(int(best[k]), params.bins)
                if gain[k, j, b] > 1e-6:
                    feature[t, first + k], cut[t, first + k] = j, edges[j][b]
            chosen = feature[t, node]
            node = 2 * node + 1 + (rows[np.arange(len(labels)), chosen] > cut[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, leaves), np.bincount(leaf, bend, leaves)
        value[t] = -params.rate * g / (h + params.ridge)
        score += value[t][leaf]
    return Forest(feature, cut, value, base)


def predict(forest: Forest, rows: np.ndarray) -> np.ndarray:
    """Scores of a matrix of statistics: all rows walk all trees at once, one level a step."""
    trees, inner = forest.feature.shape
    which, line = np.arange(trees)[None, :], np.arange(len(rows))[:, None]
    node = np.zeros((len(rows), trees), np.int64)
    for _ in range((inner + 1).bit_length() - 1):
        node = 2 * node + 1 + (rows[line, forest.feature[which, node]] > forest.cut[which, node])
    total = forest.base + forest.value[which, node - inner].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit_quality(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Forest:
    """Learn from at most params.max_rows labelled rows (of `labels`: doc_id, quality), taken in an order
    that depends on doc_id alone; rows without a label or an id teach nothing. Of rows that repeat an id
    one is learnt from. Only their statistics, a few hundred bytes a row, come to the driver."""
    wanted = bounded_sample(labels.select("doc_id", F.col("quality").cast("int").alias("label")), params.max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(list(map(statistics_of, batch.column("text").to_pylist())), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), found], ["doc_id", "label", "found"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = one_per_id(rows.mapInArrow(measured, f"doc_id {kind}, label int, found array<double>"))
    got = sorted(found.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    matrix = np.array([r["found"] for r in got], dtype=float).reshape(-1, len(STATISTICS))
    return train(matrix, np.array([r["label"] for r in got], dtype=float), params)


def score_quality(docs: DataFrame, forest: Forest, column: str = "quality_score") -> DataFrame:
    """`docs` with a score from 0 to 1 in `column` (which it replaces, if there is one of that name).

    A null text scores like an empty one. Repeated rows score alike and all stay. No shuffle; a task
    keeps one batch."""
    known = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batch: pa.Array) -> pa.Array:
        rows = np.array(list(map(statistics_of, batch.to_pylist()))).reshape(-1, len(STATISTICS))
        return pa.array(predict(known.value, rows), pa.float64())

    return docs.withColumn(column, per_batch(lambda: scored, "double")("text"))
