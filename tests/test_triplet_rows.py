"""The table function of triplets: it equals the column function, and makes no pandas column of each reply."""

import pandas as pd

from cardloom.functions import embed, registry

REPLIES = ['Here: [["a", "is", "b"], ["c", "has", 3]]', '[{"subject": "x", "predicate": "y", "object": "z"}]', "(a, b, c)\nd -> e -> f", "[1, 2]", "[[null, 1, 2]]", "", None]


def test_same_triplets(spark, monkeypatch):
    registry.register(spark)
    rows = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "i int, reply string")
    got = spark.sql("select i, t.* from {rows}, lateral llm_triplets(reply) t", rows=rows).collect()
    want = embed.parse_triplets.func(pd.Series(REPLIES, dtype=object))
    assert sorted((r.i, r.subject, r.predicate, r.object) for r in got) == sorted((i, *t) for i, ts in enumerate(want) for t in ts) and len(got) == 5

    def refused(*_, **__):
        raise AssertionError("a pandas column for one reply")

    monkeypatch.setattr(pd, "Series", refused)
    assert list(registry.Triplets.func().eval(REPLIES[0])) == [("a", "is", "b"), ("c", "has", "3")]
