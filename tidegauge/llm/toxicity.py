"""Toxicity: a bag of hashed subwords, averaged, under a linear softmax; both trained together in numpy.

A word is marked at its ends and cut into character n-grams, so a misspelling that was never seen
still shares most of its n-grams, hence its vectors, with the word it stands for. A document is the
mean over its words of the mean of each word's subword vectors. Scoring needs no matrix: with two classes the
softmax depends on one difference of weights, which is folded into one number per subword.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import bounded_sample, one_per_id, per_batch

WORD = re.compile(r"\w+")
SHORTEST, LONGEST = 3, 6
#: Distinct words a task remembers before it starts afresh.
REMEMBERED = 200_000
#: Words cut into subwords at once.
SLICE = 20_000


@dataclass(frozen=True)
class ToxicityParams:
    """max_rows bounds the labelled rows that are learnt from, max_words the distinct words of one of
    them that are sent to the driver (the most frequent; scoring always takes every word). Subwords whose
    rows don't differ between the labels by min_z standard errors keep a zero vector."""

    bits: int = 18
    dims: int = 4
    epochs: int = 20
    rate: float = 1.0
    min_z: float = 4.0
    max_rows: int = 4_000
    max_words: int = 20_000
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    """One number per subword bucket and a bias; an empty document scores by the bias alone."""

    weights: np.ndarray
    bias: float


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def subwords(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, each marked at its ends, and of their character n-grams, with the place of
    the word that each belongs to. A word of thousands of letters has four n-grams a letter, so this
    stays in proportion to the text."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(marked)), sizes)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(max(sizes, default=0) + 1, 0x01000193, np.uint32), dtype=np.uint32)
        whole = np.add.reduceat(codes * powers[np.arange(len(codes)) - starts[owner]], starts, dtype=np.uint32)
        found, owners = [whole * np.uint32(LONGEST + 1)], [np.arange(len(marked))]
        for n in range(SHORTEST, LONGEST + 1):
            last = len(codes) - n + 1
            if last <= 0:
                continue
            inside = np.flatnonzero(owner[:last] == owner[n - 1 :])
            value = np.full(len(inside), n, np.uint32)
            for j in range(n):
                value = value * np.uint32(0x01000193) + codes[inside + j]
            found.append(value)
            owners.append(owner[inside])
        value = np.concatenate(found)
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        value = (value ^ (value >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (value >> np.uint32(32 - bits)).astype(np.int64), np.concatenate(owners)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def train(rows: Iterable[tuple[dict[str, int], int]], params: ToxicityParams) -> ToxicityModel:
    """Subword vectors and softmax together, by one gradient step a row with a rate per coordinate;
    rows are words with their counts and a label. Without rows of both labels the score is the share
    of label 1 (one half if there are none)."""
    vocabulary: dict[str, int] = {}
    bags, labels = [], []
    for bag, label in rows:
        total = sum(bag.values())
        places = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in bag), np.int64, len(bag))
        bags.append((places, np.fromiter(bag.values(), np.float64, len(bag)) / max(total, 1)))
        labels.append(label)
    size = 1 << params.bits
    share = float(np.mean(labels)) if labels else 0.5
    if share in (0.0, 1.0) or not labels:
        return ToxicityModel(np.zeros(size, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    buckets, lengths = _subwords_of_all(list(vocabulary), params.bits)
    ends = np.cumsum(lengths)

    def of_row(bag: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The distinct buckets of a row and the share each has in its mean."""
        places, part = bag
        n = lengths[places]
        at = np.repeat(ends[places] - n, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        distinct, back = np.unique(buckets[at], return_inverse=True)
        return distinct.astype(np.int32), np.bincount(back, np.repeat(part / n, n)).astype(np.float32)

    labels = [y for b, y in zip(bags, labels, strict=True) if len(b[0])]
    bags = [b for b in bags if len(b[0])]
    # Rows are spelled out twice, one at a time: what all their subwords take together is far more than what is kept.
    kept = _telling((of_row(b)[0] for b in bags), labels, size, params)
    features = [(d[keep], s[keep]) for d, s in map(of_row, bags) for keep in [kept[d]]]

    rng = np.random.default_rng(params.seed)
    table = (rng.normal(size=(size, params.dims)) * 0.1).astype(np.float32)
    table[~kept] = 0
    weight = (rng.normal(size=(params.dims, 2)) * 0.5).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    past_table, past_weight, past_bias = np.full_like(table, 1e-10), np.full_like(weight, 1e-6), np.full_like(bias, 1e-2)
    # The rarer label counts for more, so that its rows are not drowned.
    importance = [1.0, min(4.0, 0.5 / share)]
    for epoch in range(params.epochs):
        rate = params.rate * (1 - epoch / params.epochs)
        for i in rng.permutation(len(features)):
            (distinct, part), label = features[i], labels[i]
            vectors = table[distinct]
            mean = part @ vectors
            odds = np.exp((logits := mean @ weight + bias) - logits.max())
            slope = (odds / odds.sum()).astype(np.float32)
            slope[label] -= 1
            slope *= importance[label]
            to_table = np.outer(part, weight @ slope)
            to_weight = np.outer(mean, slope)
            past_table[distinct] = past = past_table[distinct] + to_table**2
            table[distinct] = vectors - rate * to_table / np.sqrt(past)
            past_weight += to_weight**2
            weight -= rate * to_weight / np.sqrt(past_weight)
            past_bias += slope**2
            bias -= rate * slope / np.sqrt(past_bias)
    return ToxicityModel((table @ (weight[:, 1] - weight[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _subwords_of_all(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, those of one word together, and how many each word has; in slices of a bounded size."""
    found, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for i in range(0, len(words), SLICE):
        some = words[i : i + SLICE]
        buckets, owners = subwords(some, bits)
        found.append(buckets[np.argsort(owners, kind="stable")].astype(np.int32))
        lengths.append(np.bincount(owners, minlength=len(some)))
    return np.concatenate(found), np.concatenate(lengths)


def _telling(rows_of: Iterable[np.ndarray], labels: list[int], size: int, params: ToxicityParams) -> np.ndarray:
    """Buckets (of the distinct ones of each row) whose rows differ between the labels by min_z standard errors or more.
    All others would only be learnt by heart: there are far more subwords than labelled rows."""
    seen = np.zeros((2, size))
    for distinct, label in zip(rows_of, labels, strict=True):
        seen[label, distinct] += 1
    rows = np.bincount(labels, minlength=2)[:, None]
    share = seen.sum(axis=0) / rows.sum()
    error = np.sqrt(share * (1 - share) * (1 / np.maximum(rows, 1)).sum())
    apart = seen / np.maximum(rows, 1)
    return (np.abs(apart[1] - apart[0]) >= params.min_z * np.maximum(error, 1e-9)) & (seen.sum(axis=0) >= 2)


class Scorer:
    """Scores batches of texts; remembers each distinct word's number."""

    def __init__(self, model: ToxicityModel):
        self.model, self.known = model, {}
        self.bits = int(len(model.weights)).bit_length() - 1

    def learn(self, words: list[str]) -> None:
        """Numbers of words not met before, in slices of a bounded size."""
        for i in range(0, len(words), SLICE):
            some = words[i : i + SLICE]
            buckets, owners = subwords(some, self.bits)
            sums = np.bincount(owners, self.model.weights[buckets], len(some)) / np.bincount(owners, minlength=len(some))
            self.known.update(zip(some, sums.tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[float]:
        bags = [Counter(words_of(t)) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(list({w: 0 for bag in bags for w in bag if w not in self.known}))
        known = self.known
        sums = (sum(n * known[w] for w, n in bag.items()) / bag.total() if bag else 0.0 for bag in bags)
        return [_sigmoid(self.model.bias + x) for x in sums]


def fit_toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from at most params.max_rows labelled rows (of `labels`: doc_id, toxic), taken in an order
    that depends on doc_id alone; rows without a label, an id or a text teach nothing. Of rows that
    repeat an id one is learnt from, so no more than max_rows rows come to the driver."""
    wanted = bounded_sample(labels.select("doc_id", F.col("toxic").cast("int").alias("label")), params.max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(wanted), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words_of(t)).most_common(params.max_words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("label"),
                    pa.array([" ".join(w for w, _ in x) for x in found], pa.string()),
                    pa.array([[n for _, n in x] for x in found], pa.list_(pa.int32())),
                ],
                ["doc_id", "label", "words", "counts"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = one_per_id(rows.mapInArrow(bags, f"doc_id {kind}, label int, words string, counts array<int>"))
    got = sorted(found.toArrow().to_pylist(), key=lambda r: r["doc_id"])
    return train(((dict(zip(r["words"].split(" "), r["counts"], strict=True)), r["label"]) for r in got if r["counts"]), params)


def score_toxicity(docs: DataFrame, model: ToxicityModel, column: str = "toxic_score") -> DataFrame:
    """`docs` with a score from 0 to 1 in `column` (which it replaces, if there is one of that name).

    A null or empty text, or one without a letter or digit, scores by the bias. Repeated rows score
    alike and all stay. No shuffle; a task keeps one batch and a bounded memory of words."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        score = Scorer(known.value)
        return lambda batch: pa.array(score(batch.to_pylist()), pa.float64())

    return docs.withColumn(column, per_batch(start, "double")("text"))
