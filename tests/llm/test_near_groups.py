"""near_groups against brute force over shingle sets."""

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from kindred.llm import near_groups
from kindred.llm.components import components


def _set(t, words=5):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _expected(rows, similarity=0.8):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if _similarity(sets[i], sets[j]) >= similarity:
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return {k: least[top(i)] for i, (k, _) in enumerate(rows)}


def _pair(rng, similarity, n=120):
    """Two texts whose n shingles (each) have about this similarity: the tail of one is replaced."""
    w = [f"t{rng.randint(0, 10**9)}" for _ in range(n + 4)]
    cut = round(n * (1 - similarity) / (1 + similarity))
    return " ".join(w), " ".join(w[: n + 4 - cut] + [f"u{rng.randint(0, 10**9)}" for _ in range(cut)])


def _rows(similarity, pairs=300, seed=3, n=120):
    rng = random.Random(seed)
    return [(2 * g + k, t) for g in range(pairs) for k, t in enumerate(_pair(rng, similarity, n))]


def _kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, df, "").collect())


def test_dissimilar_texts_are_not_merged(spark):
    rng = random.Random(8)
    rows = _rows(0.72)
    for g in range(40):  # 4 shingles, 3 of them shared: 0.6
        w = [f"s{rng.randint(0, 10**9)}" for _ in range(9)]
        rows += [(5000 + 2 * g, " ".join(w[:8])), (5001 + 2 * g, " ".join(w[1:]))]
    assert set(_expected(rows)) == set(_expected(rows).values())
    assert _kept(spark, rows) == sorted(k for k, _ in rows)


def test_true_groups():
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 1 << 40, 60).astype(np.uint64)) for _ in range(6)]
    sets = [np.unique(np.concatenate((b[rng.random(len(b)) < 0.95], rng.integers(0, 1 << 40, rng.integers(0, 8)).astype(np.uint64)))) for b in base for _ in range(25)]
    got = near_groups.true_groups(sets, 0.8)
    root = np.arange(len(sets))
    for _ in sets:
        for i in range(len(sets)):
            for j in range(i):
                if root[i] != root[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])):
                    root[root == root[i]] = root[j]
        break
    assert (got[:, None] == got[None, :]).tolist() == (root[:, None] == root[None, :]).tolist()


def test_pairs_at_the_limit_are_found(spark):
    rows = _rows(0.8, n=90)
    rows += [(k + 10_000, t) for k, t in _rows(0.8, n=9, seed=4)] + [(k + 20_000, t) for k, t in _rows(0.85, n=160, seed=5)]
    want = _expected(rows)
    assert len(set(want.values())) == 900  # each pair is at 0.8 or more
    assert _kept(spark, rows) == sorted(set(want.values()))


def test_empty_null_and_repeated(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "One  TWO"), (6, "one"), (7, "a b c d e f"), (7, "a b c d e f")]
    assert _kept(spark, rows) == [1, 4, 6, 7]
    none = near_groups.near_groups(spark.createDataFrame([], "doc_id long, text string"), 5, 0.8)
    assert none.collect() == []
    found = near_groups.near_groups(spark.createDataFrame([(None, "x y"), (3, "x y")], "doc_id long, text string"), 5, 0.8)
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found.collect()) == [(0, 0), (3, 3)]


def test_one_id_with_two_texts(spark):
    """A row goes for its own text only, and a group keeps its representative."""
    a, b = _pair(random.Random(1), 0.9)
    c, d = _pair(random.Random(2), 0.9)
    rows = [(1, a, "x"), (5, b, "x"), (5, c, "y"), (6, d, "y"), (7, "one two", "z"), (7, "three four", "z"), (7, "one two", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, a, "x"), (5, c, "y"), (7, "one two", "w"), (7, "three four", "z")]
    for parts in (1, 3):
        assert sorted(tuple(r) for r in corpus_pipeline.near_dedup_stage(spark, df.repartition(parts), "").collect()) == want


def test_candidates_come_from_the_tries_too(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (40, near_groups.LANES), dtype=np.uint64)
    close = base.copy()
    close[:, 0] ^= np.uint64(1 << 7)  # one bit apart, and no key of minimum hashes in common
    keys = rng.integers(0, 1 << 63, (80, near_groups.BANDS), dtype=np.uint64)
    rows = [(i, bytearray(fp.astype(">u8").tobytes()), bytearray(k.tobytes()), 10) for i, (fp, k) in enumerate(zip(np.concatenate((base, close)), keys, strict=True))]
    classes = spark.createDataFrame(rows, "node long, fp binary, bands binary, n long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in near_groups.candidate_links(classes, 0.8).collect()}
    assert {(i, i + 40) for i in range(40)} <= got


def test_dense_groups_have_few_links(spark):
    """Each of 28 tries and keys connects a group of near copies; their links name one node for it."""
    rng = random.Random(5)
    base = [f"t{rng.randint(0, 10**9)}" for _ in range(124)]
    texts = []
    for i in range(400):
        texts.append(" ".join(base[: (at := rng.randrange(124))] + [f"u{i}"] + base[at + 1 :]))
    sets = list(near_groups.shingle_sets(pa.array(texts), 5))
    prints = near_groups.fingerprints(pa.array(texts), 5, near_groups.LANES).astype(">u8")
    nodes = random.Random(6).sample(range(1 << 62), 400)
    rows = [(k, bytearray(f.tobytes()), bytearray(b.tobytes()), len(s)) for k, f, b, s in zip(nodes, prints, near_groups.band_keys(sets), sets, strict=True)]
    links = near_groups.candidate_links(spark.createDataFrame(rows, "node long, fp binary, bands binary, n long"), 0.8).distinct()
    assert links.count() < 8 * 400  # 27 a node when each task named a node of its own
    assert components(links).select("component").distinct().count() == 1
