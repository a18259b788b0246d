"""How many pairs near copies are compared in, and what moves for them."""

import random
from itertools import combinations

import numpy as np

from tidegauge.llm import shingles
from tidegauge.llm.common import staged, where_few
from tidegauge.llm.components import components

COMMON = 200


def varied(draw, base, times):
    """`base` with `times` words, far from each other, replaced by words of its own."""
    words = list(base)
    for place in draw.sample(range(5, COMMON - 5, 10), times):
        words[place] = f"own{draw.getrandbits(40)}"
    return " ".join(words)


def test_texts_alike_to_seven_tenths_are_not_compared_in_all_pairs(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(COMMON)]
    texts = [varied(draw, base, 7) for _ in range(60)] + [varied(draw, base, 1) for _ in range(4)]
    texts += [varied(draw, texts[0].split(), 2), varied(draw, texts[1].split(), 2)]
    met, alike = [], shingles._alike
    monkeypatch.setattr(shingles, "_alike", lambda pairs, items: (met.append(pairs.count()), alike(pairs, items))[1])
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    marked = staged(shingles.with_keys(docs, "whole", "keys"), "marked")
    got = {r.node: r.root for r in components(shingles.links_alike(marked, "whole", "keys")).collect()}
    found = {w: set(f.tolist()) for w, f, _ in map(shingles.shingles_of, (t.encode() for t in texts))}
    near = lambda a, b: 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b])
    root = {w: w for w in found}
    for a, b in combinations(found, 2):
        if near(a, b):
            root = {w: min(root[a], root[b]) if r in (root[a], root[b]) else r for w, r in root.items()}
    assert {w: got.get(w, w) for w in found} == root and len(set(root.values())) > 20
    assert sum(met) <= 4 * len(texts)  # before: over a thousand


def test_few_rows_are_broadcast_and_many_are_not(spark):
    rows = spark.range(10)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(where_few(rows, 10)) and not hinted(where_few(rows, 9))


def test_maps_leave_out_no_pair_of_four_fifths_and_most_below(spark):
    draw = np.random.default_rng(7)
    hashes = lambda n: draw.integers(0, 2**64, n, np.uint64)
    rows, wanted = [], []
    for k in range(400):
        # 40 to 2,000 shared hashes (or a tenth, repeats besides); at 4/5 exactly, or at 7/10 of up to a few hundred.
        shared, four_fifths = int(draw.integers(1, 51 if k % 2 else 9)) * 40, bool(k % 2)
        own = shared // 8 if four_fifths else shared * 3 // 14
        base, sides = hashes(shared), (hashes(own), hashes(own))
        cut = shared // 10 if k % 4 == 1 else shared
        maps = [shingles.maps_of(np.concatenate([base[:cut], side]), base[cut:]).tolist() for side in sides]
        n, n2 = cut + own, shared + own
        rows.append((k, maps[0], n, n2, maps[1], n, n2))
        wanted.append(four_fifths)
    pairs = spark.createDataFrame(rows, "k int, maps array<long>, n int, n2 int, maps_b array<long>, n_b int, n2_b int")
    near = {r.k for r in pairs.where(shingles._near("", "_b")).collect()}
    assert all(k in near for k, w in enumerate(wanted) if w)
    assert sum(k in near for k, w in enumerate(wanted) if not w) < 40


def test_texts_alike_to_two_thirds_are_not_compared_in_full(spark, monkeypatch):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(COMMON)]
    texts = [varied(draw, base, 4) for _ in range(60)]
    met, alike = [], shingles._alike
    monkeypatch.setattr(shingles, "_alike", lambda pairs, items: (met.append(pairs.count()), alike(pairs, items))[1])
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string")
    marked = staged(shingles.with_keys(docs, "whole", "keys"), "marked")
    got = {r.node: r.root for r in components(shingles.links_alike(marked, "whole", "keys")).collect()}
    found = {w: set(f.tolist()) for w, f, _ in map(shingles.shingles_of, (t.encode() for t in texts))}
    root = {w: w for w in found}
    for a, b in combinations(found, 2):
        if 5 * len(found[a] & found[b]) >= 4 * len(found[a] | found[b]):
            root = {w: min(root[a], root[b]) if r in (root[a], root[b]) else r for w, r in root.items()}
    assert {w: got.get(w, w) for w in found} == root
    assert sum(met) <= 2 * len(texts), met
