"""Edges by shared tags: brute force, and a frequent tag that is dealt out."""

import random

from pyspark.sql import functions as F

from cardloom.operators import graph

SCHEMA = "id string, tags array<string>"


def test_edges_by_brute_force(spark):
    rng = random.Random(2)
    tags = {f"c{i:03d}": [rng.choice([*"abcdefgh", None]) for _ in range(rng.randrange(5))] for i in range(70)}
    want = {}
    for x, s in tags.items():
        for y, t in tags.items():
            if x < y and (both := (set(s) & set(t)) - {None}):
                want[x, y] = round(len(both) / (len(set(s)) + len(set(t)) - len(both)), 9)
    for block in (2, 2000):
        got = graph.shared_tag_edges(spark.createDataFrame(list(tags.items()), SCHEMA), block_rows=block).collect()
        assert len(got) == len(want) and {(r.source_id, r.target_id): round(r.weight, 9) for r in got} == want


def test_a_frequent_tag_is_dealt_out(spark):
    cards = spark.range(400).selectExpr("cast(id as string) as id", "array('all') as tags")
    share = graph.shared_tag_edges(cards, block_rows=40).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in share) == 400 * 399 // 2 and max(r["count"] for r in share) < 400 * 399 // 2 / 5


def test_a_rebuilt_graph_groups_no_pairs(spark):
    cards = spark.range(60).selectExpr("cast(id as string) as id", "array('all', cast(id % 2 as string)) as tags", "array(float(id % 7), float(1)) as embedding", "cast(null as string) as superseded_by", "0D as archived")
    edges = graph.rebuild(cards, 0.999)
    assert edges.where("relation_type = 'shared_tag'").count() == 60 * 59 // 2
    assert "keys=[source_id" not in edges._jdf.queryExecution().toString()


def test_few_kinds_and_many_give_the_same_edges(spark, monkeypatch):
    """With few sets of tags, sets are compared by kinds and not for each pair; ids that stand twice and null tags included."""
    rng = random.Random(6)
    cards = spark.createDataFrame([(f"c{rng.randrange(150):03d}", [rng.choice([*"abcd", None]) for _ in range(rng.randrange(4))]) for _ in range(200)], SCHEMA)
    edges = lambda: graph.shared_tag_edges(cards, block_rows=9)
    by_kind = edges()
    assert "array_intersect" not in by_kind._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.source_id, r.target_id, round(r.weight, 9)) for r in by_kind.collect())
    monkeypatch.setattr(graph, "MOST_KINDS", 0)
    assert len(got) > 1000 and got == sorted((r.source_id, r.target_id, round(r.weight, 9)) for r in edges().collect())
