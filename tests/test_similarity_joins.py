"""Similarity joins against all pairs in numpy: unclustered vectors, new against old, hot keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import graph, search


def frame(spark, m, prefix="c"):
    return spark.createDataFrame([(f"{prefix}{i:05d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, embedding array<float>")


def unit(m):
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.fixture(scope="module")
def vectors():
    """Unclustered vectors, each fifth with a neighbour at a cosine of 0.7 to 1."""
    rng = np.random.default_rng(1)
    m = unit(rng.standard_normal((1500, 48)))
    for i in range(0, 1500, 5):
        m[i] = m[i + 1] + rng.uniform(0, 0.9) * unit(rng.standard_normal((1, 48)))[0]
    return unit(m)


def test_hashed_pairs_find_most_and_look_at_few(spark, vectors):
    cards, m = frame(spark, vectors), vectors.astype(np.float64)
    want = {(f"c{i:05d}", f"c{j:05d}") for i, j in np.argwhere(np.triu(m @ m.T > 0.75, 1))}
    got = search.similar_pairs(cards, 0.75, recall=0.9).collect()
    assert {(r.a, r.b) for r in got} <= want and len({(r.a, r.b) for r in got}) >= 0.9 * len(want) and len(want) > 150
    assert all(abs(r.cos - m[int(r.a[1:])] @ m[int(r.b[1:])]) < 1e-6 for r in got)
    bits, tables, share = search.hash_shape(0.75, 0.9, 1_000_000)
    assert share < 0.1
    # measured: pairs of unrelated vectors that share a key
    signs = (m @ np.random.default_rng(7).standard_normal((48, tables * bits)) > 0).reshape(len(m), tables, bits)
    keys = signs @ (1 << np.arange(bits))
    met = np.zeros((len(m), len(m)), bool)
    for t in range(tables):
        met |= keys[:, t][:, None] == keys[:, t][None, :]
    assert np.triu(met, 1).sum() < 0.1 * len(m) * (len(m) - 1) / 2


def test_hashed_pairs_of_equal_vectors(spark):
    m = np.zeros((300, 8), np.float32)
    m[:, 0] = 1  # all share every key: dealt in blocks
    assert search.hashed_pairs(frame(spark, m), 0.9, block_rows=40).count() == 300 * 299 // 2
    assert search.hashed_pairs(frame(spark, m).limit(0), 0.9).count() == 0


@pytest.mark.parametrize("small", [4096, 0])
def test_new_against_old(spark, vectors, small):
    new, old = vectors[:200], vectors[100:900]
    a = frame(spark, new)
    b = spark.createDataFrame([(f"c{i + 100:05d}", [float(x) * (1 + i % 3) for x in v]) for i, v in enumerate(old)] + [("zero", [0.0] * 48), ("none", None), ("empty", [])], "id string, embedding array<float>")
    m, k = new.astype(np.float64), old.astype(np.float64)
    for threshold in (0.3, 0.75):
        want = {(f"c{i:05d}", f"c{j + 100:05d}") for i, j in np.argwhere(m @ k.T > threshold) if i != j + 100}
        got = search.similar_between(a, b, threshold, block_rows=60, small=small).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_links_of_new_cards(spark, vectors):
    rng = np.random.default_rng(3)
    rows = [(f"c{i:05d}", [float(x) for x in v] if i % 7 else None, [f"t{t}" for t in rng.integers(0, 9, rng.integers(0, 4))] or None) for i, v in enumerate(vectors[:400])]
    cards = spark.createDataFrame(rows, "id string, embedding array<float>, tags array<string>")
    new = cards.where("id < 'c00040'")
    links = graph.auto_link(new, cards, 0.6)
    assert "BroadcastNestedLoopJoin" not in links._jdf.queryExecution().executedPlan().toString()
    got = {(r.source_id, r.target_id): (r.relation_type, round(r.weight, 6)) for r in links.collect()}
    want = {}
    for i, e0, t0 in rows[:40]:
        for j, e1, t1 in rows:
            if i == j:
                continue
            cos = float(np.dot(e0, e1) / np.linalg.norm(e0) / np.linalg.norm(e1)) if e0 and e1 else 0.0
            s, t = set(t0 or []), set(t1 or [])
            if cos > 0.6:
                want[i, j] = ("semantic", round(min(1.0, cos), 6))
            elif s & t:
                want[i, j] = ("shared_tag", round(len(s & t) / len(s | t), 6))
    assert got == want and len({k for k, _ in got.values()}) == 2
    assert {(r.source_id, r.target_id, round(r.weight, 6)) for r in graph.tag_links(new, cards, small=0).collect()} == {(r.source_id, r.target_id, round(r.weight, 6)) for r in graph.tag_links(new, cards).collect()}


def test_pruning_by_cells_is_exact(spark):
    """Clustered vectors in many cells: few blocks meet, and nothing is lost."""
    rng = np.random.default_rng(5)
    centres = unit(rng.standard_normal((4, 32)))
    m = unit(np.repeat(centres, 200, axis=0) + 0.05 * rng.standard_normal((800, 32)))
    cards, k = frame(spark, m), m.astype(np.float64)
    want = {(f"c{i:05d}", f"c{j:05d}") for i, j in np.argwhere(np.triu(k @ k.T > 0.8, 1))}
    assert {(r.a, r.b) for r in search.similar_pairs(cards, 0.8, block_rows=40).collect()} == want and len(want) > 5000
    pivots, celled = search._cells(cards, 20)
    found = sorted(((r["cell"], r["angle"], r["norm"]) for r in celled.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()))
    meet = search.may_meet(pivots[[c for c, _, _ in found]], np.array([a for _, a, _ in found]), np.array([n for _, _, n in found]), 0.8)
    assert meet.mean() < 0.5
