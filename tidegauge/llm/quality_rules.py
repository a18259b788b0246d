"""Quality rules whose cutoffs carry a guarantee.

Each rule rejects documents of which one measure is over a cutoff. Cutoffs are chosen from labelled
documents, by stratum (length of the text; neighbours with few labels are one): going through a fixed
order from loose to strict, a step is safe while the exact binomial test, at the level of `confidence`
shared out over strata and walks, shows that it rejects at most `risk` of the good documents; the
first that fails ends the walk (testing in a fixed order needs no further correction). Two walks test
all rules together, one each rule for its part of `risk`. Of the safe steps that which rejects most bad
documents is taken, the loosest of these. So with probability `confidence`, no group of strata loses
more than `risk` of its good documents. With too few labels in all there is no cutoff.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import held_out, per_batch, staged

#: Cutoffs of each rule, from the loosest to the strictest.
CUTOFFS: dict[str, tuple[float, ...]] = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_lines": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_words": (0.2, 0.17, 0.14, 0.11, 0.08, 0.05),
    "capital_words": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "top_word": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "chars_per_word": (40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0),
}
#: Words from which each stratum but the first begins.
STRATA = (60, 200, 600, 2000)
WINDOW = 5
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class RiskParams:
    risk: float = 0.03
    confidence: float = 0.95


def measures_of(raw: bytes | None) -> tuple[list[int], list[int]]:
    """The base counts of a UTF-8 text, and for each rule how many of its cutoffs the text is over."""
    raw = raw or b""
    text = raw.decode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    symbols = sum(map(text.count, SYMBOLS))
    chars = len(text) - sum(map(text.count, SPACES))
    seen: set[str] = set()
    filled = again = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            filled += 1
            again += line in seen
            seen.add(line)
    windows = list(zip(*(words[i:] for i in range(WINDOW))))  # noqa: B905
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, reached = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + WINDOW - max(i, reached)
                reached = i + WINDOW
    common = Counter(words)
    m = max(n, 1)
    values = (
        symbols / m,
        again / max(filled, 1),
        repeated / m,
        sum(map(bytes.isupper, words)) / m,
        max(common.values(), default=0) / m if n >= 10 else 0.0,
        chars / m,
    )
    over = [sum(v > c for c in cuts) for v, cuts in zip(values, CUTOFFS.values(), strict=True)]
    return [n, chars, symbols, again, repeated], over


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and over (by rule), of every row of `docs` (doc_id, text)."""

    def batch_of(batch: pa.Array) -> pa.Array:
        found = [measures_of(t) for t in batch.cast(pa.binary()).to_pylist()]
        columns = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(BASE))]
        over = pa.array([f[1] for f in found], pa.list_(pa.int32()))
        return pa.StructArray.from_arrays([*columns, over], [*BASE, "over"])

    kind = ", ".join(f"{c} long" for c in BASE) + ", over array<int>"
    return docs.select("doc_id", per_batch(lambda: batch_of, kind)("text").alias("m")).select("doc_id", "m.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum() -> Column:
    return sum(((F.col("n_words") >= start).cast("int") for start in STRATA), F.lit(0))


def chance_of_so_few(rejected: int, good: int, risk: float) -> float:
    """The probability that at most `rejected` of `good` documents are rejected, were `risk` the true
    rate: the exact binomial tail. Below the level, a rate over `risk` is ruled out."""
    if good == 0:
        return 1.0
    terms = (
        lgamma(good + 1) - lgamma(k + 1) - lgamma(good - k + 1) + k * log(risk) + (good - k) * log1p(-risk) for k in range(rejected + 1)
    )
    return min(1.0, sum(map(exp, terms)))


def choose_cutoffs(counts: dict[tuple[int, int, int, int], int], params: RiskParams) -> dict[tuple[int, int], int]:
    """From counts by (stratum, rule, cutoffs the row is over, label): for (stratum, rule) the number of
    cutoffs a rejected row must be over; rules without a safe and useful cutoff are left out."""
    chosen = {}
    level = (1 - params.confidence) / (len(CUTOFFS) * (len(STRATA) + 1))
    risk = params.risk / len(CUTOFFS)
    for s in range(len(STRATA) + 1):
        for r, cuts in enumerate(CUTOFFS.values()):
            over = lambda label, least: sum(counts.get((s, r, k, label), 0) for k in range(least, len(cuts) + 1))  # noqa: B023, E731
            good, best = over(1, 0), (0, 0)
            # Over the loosest cutoff is who is over all of them.
            for least in range(len(cuts), 0, -1):
                if chance_of_so_few(over(1, least), good, risk) > level:
                    break
                best = max(best, (over(0, least), least))
            if best[0]:
                chosen[s, r] = best[1]
    return chosen


def steps_together() -> list[tuple[int, ...]]:
    """All rules a cutoff stricter at every step; a rule at its strictest stays there."""
    sizes = [len(c) for c in CUTOFFS.values()]
    return [tuple(max(n - t, 1) for n in sizes) for t in range(max(sizes))]


def steps_in_turn() -> list[tuple[int, ...]]:
    """One rule after another, each from its loosest cutoff to its strictest, the ones before it kept."""
    sizes = [len(c) for c in CUTOFFS.values()]
    now, steps = [n + 1 for n in sizes], []
    for r, n in enumerate(sizes):
        for least in range(n, 0, -1):
            now[r] = least
            steps.append(tuple(now))
    return steps


def rejected_by(vector: tuple[int, ...], rows: dict[tuple[int, ...], int]) -> int:
    return sum(n for over, n in rows.items() if any(o >= v for o, v in zip(over, vector, strict=True)))


def walk(steps: list[tuple[int, ...]], good: dict[tuple[int, ...], int], bad: dict[tuple[int, ...], int], level: float, risk: float) -> tuple[int, tuple[int, ...] | None]:
    """Of the steps before the first that is not safe for all rules at once, the loosest that rejects
    most bad rows, and how many."""
    most, best, n = 0, None, sum(good.values())
    for vector in steps:
        if chance_of_so_few(rejected_by(vector, good), n, risk) > level:
            break
        if (gain := rejected_by(vector, bad)) > most:
            most, best = gain, vector
    return most, best


def groups_of_strata(good: list[int], least: int) -> list[int]:
    """For each stratum the first of its group: runs of strata with `least` good labels or more. What is
    left at the end joins the group before it. Only numbers of labels decide, not what is rejected."""
    firsts, starts, held = [], [0], 0
    for s, n in enumerate(good):
        if held >= least:
            starts.append(s)
            held = 0
        firsts.append(starts[-1])
        held += n
    if held < least and len(starts) > 1:
        firsts = [starts[-2] if f == starts[-1] else f for f in firsts]
    return firsts


def choose_jointly(counts: dict[tuple[int, int, tuple[int, ...]], int], params: RiskParams) -> dict[tuple[int, int], int]:
    """From counts by (stratum, label, over): cutoffs as choose_cutoffs() gives them. Three walks share
    the level of a group of strata: two test what all rules reject together against the full risk, the
    third tests each rule against its part. The one that rejects most bad rows counts."""
    level = (1 - params.confidence) / 3
    level_of_group = level / (len(STRATA) + 1)
    size = [sum(n for (s, label, _), n in counts.items() if s == i and label == 1) for i in range(len(STRATA) + 1)]
    firsts = groups_of_strata(size, ceil(log(level_of_group) / log1p(-params.risk)))
    rows: dict[tuple[int, int], Counter] = {}
    single: Counter = Counter()
    for (s, label, over), n in counts.items():
        rows.setdefault((firsts[s], label), Counter())[over] += n
        for r, k in enumerate(over):
            single[firsts[s], r, k, label] += n
    alone = choose_cutoffs(single, RiskParams(params.risk, 1 - level))
    chosen = {}
    for first in set(firsts):
        good, bad = (rows.get((first, label), Counter()) for label in (1, 0))
        found = [walk(steps, good, bad, level_of_group, params.risk) for steps in (steps_in_turn(), steps_together())]
        vector = tuple(alone.get((first, r), len(c) + 1) for r, c in enumerate(CUTOFFS.values()))
        most, best = max([*found, (rejected_by(vector, bad), vector)], key=lambda x: x[0])
        if most:
            for s in (s for s, f in enumerate(firsts) if f == first):
                chosen |= {(s, r): v for r, (v, c) in enumerate(zip(best, CUTOFFS.values(), strict=True)) if v <= len(c)}
    return chosen


def fit_rules(found: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> dict[tuple[int, int], int]:
    """Cutoffs from all labelled rows that are not held out and pass the base rules: `found` is
    measured(), `labels` has doc_id and quality (of two labels of an id the larger counts). The driver
    gets one count per stratum, label and combination of cutoffs a row is over."""
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    rows = found.where(~base_failed()).select("doc_id", stratum().alias("stratum"), "over").join(known, "doc_id")
    counted = rows.groupBy("stratum", "label", "over").agg(F.count(F.lit(1)).alias("n"))
    return choose_jointly({(r[0], r[1], tuple(r[2])): r[3] for r in counted.collect()}, params)


def judge(docs: DataFrame, labels: DataFrame, params: RiskParams = RiskParams()) -> DataFrame:
    """Every row of `docs` (doc_id, text): doc_id, the base counts, base_failed, kept. A null or empty
    text has no words, hence fails the base rules; repeated rows get the same verdict; without labels
    only the base rules reject."""
    found = staged(measured(docs), "measures")
    rejected = F.lit(False)
    for (s, r), least in sorted(fit_rules(found, labels, params).items()):
        rejected = rejected | ((stratum() == s) & (F.col("over")[r] >= least))
    return found.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
