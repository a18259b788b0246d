"""Spelling variants: words one insertion, deletion or replacement apart, found by pivotal grams.

All bigrams have one global order, the rarest first. A word's prefix is its three first bigrams in this order
(and all that tie with the third); of these, two disjoint ones of least total frequency are its pivots, chosen
by dynamic programming. One edit spares one of two disjoint bigrams. So of two words one edit apart, the one
whose prefix ends earlier has a pivot that lies in the other's prefix, at the same place from the left (the
edit is behind it) or from the right (the edit is before it). The index joins pivots with prefixes on this and
on what the edit, lying on one side of the bigram and in one half of that side, must leave equal. Every pair
that meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import per_batch, staged

#: Fixed values of the contract: letters of a run, one run in so many loses a letter, the shortest word, the fewest occurrences, and by how much a form outnumbers.
RUNS = r"[A-Za-zÀ-ÿ]+"
DAMAGED, SHORTEST, FEWEST, OUTNUMBERS = 199, 6, 5, 5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX, PIVOTS, GRAM = 3, 2, 2


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: the runs of letters of whole texts after one in 199 (document, run) lost a letter, of at least
    six code points and five occurrences. A null text has none; a null doc_id is written as nothing."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate("text", CAPITALS, SMALL), F.lit(RUNS), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= SHORTEST)
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(crc, F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(crc % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")
    counted = runs.select(word).where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= FEWEST)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Each bigram's place in the global order and its frequency. There are 90 letters, so at most 8,100."""
    starts = F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1))
    grams = words.select(F.explode(F.transform(starts, lambda i: F.substring("word", i, F.lit(GRAM)))).alias("gram"))
    rows = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).collect()
    ordered = sorted((r.df, r.gram) for r in rows)
    return {gram: (place, df) for place, (df, gram) in enumerate(ordered)}


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
    """The place in the global order at which the word's prefix ends, and the (position, frequency) of its bigrams."""
    grams = [(*order[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1)]
    last = sorted(grams)[PREFIX - 1][0]
    return last, sorted((i, df) for place, df, i in grams if place <= last)


def pivots_of(prefix: list[tuple[int, int]]) -> list[int]:
    """Positions of two disjoint bigrams of least total frequency: best[j] holds, over the bigrams so far, the
    least total of j disjoint ones. Three different positions always hold two that don't overlap."""
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] + [None] * PIVOTS]
    for k, (at, df) in enumerate(prefix):
        free = next((i for i in range(k, 0, -1) if prefix[i - 1][0] + GRAM <= at), 0)
        row = [(0, ())]
        for j in range(1, PIVOTS + 1):
            before = best[free][j - 1]
            taken = before and (before[0] + df, (*before[1], at))
            row.append(min((x for x in (best[k][j], taken) if x), default=None))
        best.append(row)
    return list(best[-1][PIVOTS][1])


def _meeting(word: str, at: int, longer: int) -> Iterator[int]:
    """What a word with a bigram at `at` shares with one that has a pivot there and is `longer` letters longer
    (0 for the pivot's own word): the edit lies behind the bigram or before it, in one half of that side."""
    n, other = len(word), len(word) + longer
    behind = other - at - GRAM
    if behind >= 0:
        half, rest = behind // 2, behind - behind // 2
        yield _hash(0, at, other, word[: at + GRAM + half], "")
        yield _hash(1, at, other, word[: at + GRAM], word[n - rest :])
    moved = at + longer
    if moved >= 0:
        half = moved // 2
        yield _hash(2, moved, other, "", word[n - (other - half) :] if other - half <= n else None)
        yield _hash(3, moved, other, word[:half], word[at:])


def _hash(*key) -> int:
    found = xxhash.xxh64_intdigest("\0".join(map(str, key)))
    return found - (1 << 64) if found >> 63 else found


def _keys(order: dict[str, tuple[int, int]], words: pa.Array) -> pa.Array:
    lasts, pivots, probes = [], [], []
    for word in words.to_pylist():
        last, prefix = prefix_of(word, order)
        lasts.append(last)
        pivots.append([k for at in pivots_of(prefix) for k in _meeting(word, at, 0)])
        probes.append(sorted({k for at, _ in prefix for longer in (-1, 0, 1) for k in _meeting(word, at, longer)}))
    longs = pa.list_(pa.int64())
    return pa.StructArray.from_arrays([pa.array(lasts, pa.int32()), pa.array(pivots, longs), pa.array(probes, longs)], ["last", "pivots", "probes"])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b (a < b) and their counts: every pair of `words` (word, n; a written table) one edit apart, once."""
    order = gram_order(words)
    kind = "last int, pivots array<long>, probes array<long>"
    keyed = staged(words.select("word", "n", per_batch(lambda: lambda b: _keys(order, b), kind)("word").alias("k")).select("word", "n", "k.*"), "grams")
    left = keyed.select(F.explode("pivots").alias("key"), F.col("word").alias("p"), F.col("n").alias("np"), F.col("last").alias("lp"))
    right = keyed.select(F.explode("probes").alias("key"), F.col("word").alias("r"), F.col("n").alias("nr"), F.col("last").alias("lr"))
    # Verified in the join itself, so that only near pairs leave it.
    verified = (F.col("lp") <= F.col("lr")) & (F.levenshtein("p", "r", 1) == 1)
    met = left.join(right, (left["key"] == right["key"]) & verified)
    lower = F.col("p") < F.col("r")
    pick = lambda one, two: F.when(lower, F.col(one)).otherwise(F.col(two))
    return met.select(pick("p", "r").alias("a"), pick("r", "p").alias("b"), pick("np", "nr").alias("na"), pick("nr", "np").alias("nb")).distinct()


def with_forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form (the near word of largest n, of equal ones the smallest, if it outnumbers the word
    five times) and form_n."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = F.min_by(F.struct("near", "m"), F.struct(-F.col("m"), F.col("near")))
    found = words.join(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best")), "word", "left")
    outnumbers: Column = F.col("best.m") >= OUTNUMBERS * F.col("n")
    return found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(outnumbers, F.col("best.near")).alias("form"), F.when(outnumbers, F.col("best.m")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """`formed` (a written table) with root, the last form reached. Counts grow five times with each step, so a
    chain has at most 27; each round doubles the steps, so five rounds end every chain."""
    ends = staged(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ends.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        ends = staged(ends.join(on, "root", "left").select("word", F.coalesce("onward", "root").alias("root"), F.col("onward").isNotNull().alias("went")), "roots")
        if not ends.where("went").limit(1).count():
            break
        ends = ends.select("word", "root")
    return formed.join(ends.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of `docs` (doc_id, text; other columns are not read).
    Repeated rows count each time; null and empty texts and an empty table give no word."""
    words = staged(words_of(docs.select("doc_id", "text")), "words")
    formed = staged(with_forms(words, near_pairs(words)), "formed")
    return with_roots(formed).select("word", "form", "root", "n", "n_near", "form_n")
