"""What a graph comes to without its edges: sums and links of cards, hops, totals of shared tags; against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardloom.operators import graph, search


def frame(spark, m, ids=None):
    return spark.createDataFrame([(ids[i] if ids else f"c{i:05d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    """Groups of near vectors, some longer than 1, a zero, and lone ones."""
    rng = np.random.default_rng(11)
    m = np.concatenate([np.repeat(rng.standard_normal((30, 24)), 6, axis=0) + 0.3 * rng.standard_normal((180, 24)), rng.standard_normal((60, 24)), np.zeros((1, 24))])
    return (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9) * rng.choice([1.0, 1.2], (len(m), 1))).astype(np.float32)


@pytest.mark.parametrize("block", [20, 2000])
def test_sums_and_links(spark, vectors, block):
    cards, m = frame(spark, vectors), vectors.astype(np.float64)
    edges = graph.semantic_edges(cards, 0.5)
    x, y = np.nonzero(np.triu(m @ m.T > 0.5, 1))
    assert {(r.source_id, r.target_id) for r in edges.collect()} == {(f"c{i:05d}", f"c{j:05d}") for i, j in zip(x, y, strict=True)} and len(x) > 200
    nodes = search.similar_nodes(cards, 0.5, block_rows=block, most_rows=block)
    plain = lambda t: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in t.collect())
    assert plain(graph.node_stats(nodes)) == plain(graph.graph_stats(edges).select("edges", "avg_weight", "max_weight", "min_weight", "nodes"))
    assert plain(graph.node_density(cards, nodes)) == plain(graph.density(cards, edges))
    assert plain(graph.node_weights(nodes)) == plain(graph.compound_weight(edges))
    assert plain(graph.clusters(graph.node_links(nodes), 3, 0.0)) == plain(graph.clusters(edges, 3, 0.0))
    for small in (4096, 0):
        got = graph.near_hops(cards, ["c00000", "c00200"], 3, 0.5, small=small)
        assert plain(got) == plain(graph.multi_hop(edges, ["c00000", "c00200"], 3))
    assert plain(graph.node_stats(nodes.limit(0))) == plain(graph.graph_stats(edges.limit(0)).select("edges", "avg_weight", "max_weight", "min_weight", "nodes"))


def test_copies_make_no_pairs(spark):
    """600 equal vectors: 179,700 pairs, of which a row for a card and pair of blocks leaves its group."""
    nodes = search.similar_nodes(frame(spark, np.ones((600, 8))), 0.5, block_rows=100, most_rows=100).collect()
    assert len(nodes) <= 600 * 6 and sum(r.n for r in nodes) == 600 * 599 // 2


def test_an_empty_block_makes_nothing_twice(spark):
    cards = frame(spark, np.ones((5, 4)))
    assert search.similar_pairs(cards, 0.5, block_rows=1).count() == 10
    assert graph.node_stats(search.similar_nodes(cards, 0.5, block_rows=1, most_rows=1)).first()["edges"] == 10


def test_close_to_the_threshold(spark):
    """Products that single precision puts on the wrong side."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((200, 64)).astype(np.float32)
    m[::50] *= 1000
    k = m.astype(np.float64)
    products = np.sort((k @ k.T)[np.triu_indices(200, 1)])
    for at in (15000, 19000, 19890):
        t = (products[at] + products[at + 1]) / 2
        assert search.similar_pairs(frame(spark, m), float(t), block_rows=64).count() == len(products) - at - 1


def test_totals_of_shared_tags(spark):
    rng = random.Random(2)
    rows = [(f"c{i:03d}", [rng.choice([*"abcdefgh", None]) for _ in range(rng.randrange(5))]) for i in range(70)] + [("c001", ["a", "b"]), ("c001", ["a", "b"]), ("c002", ["a"])]
    cards = spark.createDataFrame(rows, "id string, tags array<string>")
    want = graph.shared_tag_edges(cards).agg(F.count("*"), F.sum("weight")).first()
    for block in (2, 2000):
        got = graph.shared_tag_totals(cards, block).first()
        assert got["n"] == want[0] and abs(got["weight"] - want[1]) < 1e-9
    assert tuple(graph.shared_tag_totals(cards.limit(0)).first()) == (0, 0.0)


def test_a_rebuilt_graph_in_sums(spark):
    """50,000 cards of one tag: 1,249,975,000 edges, none of them formed."""
    cards = spark.range(50_000).selectExpr("cast(id as string) as id", "array('all') as tags", "cast(null as array<float>) as embedding", "cast(null as string) as superseded_by", "0D as archived")
    assert [tuple(r) for r in graph.rebuild_totals(cards, 0.5).orderBy("relation_type").collect()] == [("semantic", 0, 0.0), ("shared_tag", 1_249_975_000, 1_249_975_000.0)]
