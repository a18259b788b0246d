"""SimHash groups and neighbours against brute force."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash

from tidegauge.llm.components import components
from tidegauge.llm.neighbours import ForestParams, PrefixForest, nearest
from tidegauge.llm.simhash import deduplicate, fingerprint_of, links_between, near_copies, with_fingerprints


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, reach=2):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(values, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= reach:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_fingerprints_are_those_of_the_definition():
    for text in (None, "", "One", "one TWO", "a b c d e f", "É é A\x0bb\x0cc\x1fd", "w " * 9000, " ".join(map(str, range(9000)))):
        raw = None if text is None else text.encode()
        assert fingerprint_of(raw) & (2**64 - 1) == slow_fingerprint(text)


def signed(v):
    return v - 2**64 if v >= 2**63 else v


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(3)
    values = {0, 1, 7, 2**64 - 1}
    for _ in range(6):  # crowds around a centre, and chains that leave it
        centre = rng.getrandbits(64)
        for _ in range(90):
            v = centre
            for b in rng.sample(range(64), rng.choice((1, 1, 2, 4, 6))):
                v ^= 1 << b
            values.add(v)
    values = sorted(map(signed, values))
    df = spark.createDataFrame([(v,) for v in values], "value long")
    want = groups_of(values)
    for crowd in (2, 8, 1000):
        got = {r.node: r.root for r in components(links_between(df, crowd)).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 901: 900}


def test_copies_of_odd_documents(spark, documents):
    marked = with_fingerprints(documents)
    assert set(documents.columns) == set(marked.columns)  # a column of that name is replaced
    groups = {r.simhash: r.component_id for r in near_copies(marked).collect()}
    rows = {(r.doc_id, r.text): groups[r.simhash] for r in marked.select("doc_id", "text", "simhash").collect()}
    assert {rows[k] for k in rows if k[0] in (1, 2, 3, 4)} == {1}
    assert {rows[k] for k in rows if k[0] in (5, 6, 7)} == {5} and rows[None, None] == 5
    assert rows[None, "no id at all"] is None
    kept = deduplicate(documents)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 5, 8, 9, 10, 11, 12, 13]
    assert deduplicate(documents.limit(0)).count() == 0


def brute(ids, vectors, k):
    out = {}
    for q in sorted({i for i in ids if i % 20 == 0}):
        v = vectors[ids.index(q)]
        scored = sorted((-float((u * v).sum()), i) for i, u in zip(ids, vectors, strict=True) if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def test_neighbours_of_all_candidates_are_exact_and_of_few_nearly(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1200, 16)).astype(np.float32).astype(float)
    vectors[100:500] = vectors[99]  # a third are copies
    vectors[7] *= 40
    ids = list(range(1200))
    df = frame(spark, zip(ids, vectors.tolist(), strict=True))
    want = brute(ids, vectors, 20)
    for params, least in ((ForestParams(candidates=1.0, shard_rows=300, block_rows=16), 1.0), (ForestParams(shard_rows=700), 0.9)):
        got = {}
        for r in nearest(df, df.where("vec_id % 20 = 0"), 20, params).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert set(got) == set(want)
        assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= least
        if least == 1.0:
            assert got == want


def test_forest_on_shards_well_above_the_floor():
    rng = np.random.default_rng(8)
    for rows in (5_000, 9_000, 16_384):
        vectors = rng.normal(size=(rows, 64))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        queries = vectors[:: rows // 40]
        forest, found, scored = PrefixForest(vectors, ForestParams()), [], []
        for query, places in zip(queries, forest.candidates(queries), strict=True):
            near = np.argsort(-(vectors @ query))[:21]
            found.append(np.isin(near, places).mean())
            scored.append(len(places) / rows)
        assert np.mean(found) >= 0.92 and np.mean(scored) <= 0.7


def test_ids_with_several_vectors(spark):
    df = frame(spark, [(20, [2, 1]), (20, [1, 3]), (20, [1, 3]), (1, [1, 0]), (2, [1, 0]), (1, [0, 1])])
    got = [(r["rank"], r.vec_id, r.score) for r in nearest(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(1, 20, 5.0), (2, 1, 3.0), (3, 1, 1.0), (4, 2, 1.0)]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1, 0]), (1, [0.5, 1]), (2, None), (3, [0, 0]), (4, [None, 1]), (5, [float("nan"), 1]), (6, [float("inf"), 1])]
    rows += [(20, None), (40, [0, 0]), (7, [1, 2, 3]), (None, [1, 1]), (1, [0.5, 1]), (8, [])]
    df = frame(spark, rows)
    got = nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 0.5)]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def alike(one, two):
    """Similarity of five-word shingles, of the different ones or with repeats, whichever is more."""
    bags = [Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) for w in (one.lower().split(), two.lower().split())]
    sets = [set(b) for b in bags]
    return max(len(sets[0] & sets[1]) / len(sets[0] | sets[1]), (bags[0] & bags[1]).total() / (bags[0] | bags[1]).total())


def test_planted_near_copies_go_and_the_rest_stays(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for size, changes in ((120, 1), (120, 2), (120, 3), (400, 4), (400, 7), (400, 12), (400, 30)):
        for _ in range(8):
            words = [word() for _ in range(size)]
            texts.append(" ".join(words))
            for at in rng.sample(range(size), changes):
                words[at] = word()
            texts.append(" ".join(words))
    crowd = [word() for _ in range(300)]
    for _ in range(150):  # a crowd of near copies, of which many pairs are less alike
        words = list(crowd)
        for at in rng.sample(range(300), rng.randint(1, 9)):
            words[at] = word()
        texts.append(" ".join(words))
    texts += ["", "only three words", "Only  three WORDS", "a b"]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if texts[i] and texts[j] and alike(texts[i], texts[j]) >= 0.8:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    want = {find(i) for i in range(len(texts))}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.doc_id for r in deduplicate(df).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(texts) - 120


def test_recall_of_the_query_on_the_given_embeddings(spark, folder):
    from tidegauge.llm.queries import QUERIES

    for scale in ("sf0.001", "sf0.1"):
        at = folder.replace("sf0.001", scale)
        rows = [r for r in spark.read.parquet(f"{at}/embeddings.parquet").select("vec_id", "embedding").collect() if r.embedding]
        ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
        got = {}
        for r in QUERIES["op9_neighbours"](spark, at).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        found = []
        for q in got:
            near = [i for i in ids[np.argsort(-(vectors @ vectors[ids == q][0]), kind="stable")] if i != q][:20]
            found.append(len(got[q] & set(near)) / 20)
        assert len(got) == sum(ids % 20 == 0) and np.mean(found) >= 0.98
