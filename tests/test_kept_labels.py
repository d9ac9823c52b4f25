"""Components from kept labels and new edges against components of all edges."""

import random

from cardloom.operators import graph


def rows(frame):
    return sorted((r.id, r.cluster) for r in frame.collect())


def test_three_batches_equal_the_whole(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(120):03d}", f"n{rng.randrange(120):03d}") for _ in range(90)]
    schema = "source_id string, target_id string"
    labels = None
    for k in range(3):
        labels = graph.contracted(spark.createDataFrame(pairs[k * 30 : (k + 1) * 30], schema), labels)
        want = graph.components(spark.createDataFrame([p for p in pairs[: (k + 1) * 30] if p[0] != p[1]], schema))
        alone = {x for p in pairs[: (k + 1) * 30] for x in p} - {r.id for r in want.select("id").collect()}
        assert rows(labels) == sorted([*rows(want), *((x, x) for x in alone)])
    assert rows(graph.contracted(spark.createDataFrame([], schema), labels)) == rows(labels)


def test_rounds_on_a_path_are_few(spark, monkeypatch):
    written = []
    stored = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: (written.append(1), stored(df))[1])
    order = list(range(256))
    random.Random(1).shuffle(order)
    path = spark.createDataFrame([(f"p{a:04d}", f"p{b:04d}") for a, b in zip(order, order[1:], strict=False)], "source_id string, target_id string")
    assert {c for _, c in rows(graph.contracted(path))} == {"p0000"}
    assert len(written) < 2 * 14  # two tables a round
