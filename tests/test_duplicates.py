"""Word-set duplicates: all pairs by brute force, copies told once as links, texts that share a rare word only kept apart."""

import random

import numpy as np
from pyspark.sql import functions as F

from cardloom.operators import graph, lifecycle


def jaccard(a, b):
    return 10 * len(a & b) >= 7 * len(a | b)


def texts():
    rng = random.Random(3)
    out = []
    for n in (1, 2, 3, 5, 9, 11, 12, 13, 16, 17, 20, 24, 25, 40, 90, 300):
        for _ in range(4):
            base = [f"w{rng.randrange(4000)}" for _ in range(n)]
            out.append(" ".join(base))
            for share in (0.03, 0.1, 0.16, 0.18, 0.25, 0.3):  # around the threshold: words changed, left out, put in
                out.append(" ".join(f"x{rng.randrange(4000)}" if rng.random() < share else w for w in base))
                out.append(" ".join(w for w in base if rng.random() >= share))
                out.append(" ".join(base + [f"y{rng.randrange(4000)}" for _ in range(int(share * n * 1.4))]))
    return out


def cards_of(spark, facts):
    return spark.createDataFrame([(f"{i:04d}", f, s) for i, (f, s) in enumerate(facts)], "id string, fact string, scope string")


def test_all_pairs_by_brute_force(spark):
    facts = [(t, None if i % 5 else "s") for i, t in enumerate(texts())]
    facts += [(f.upper(), s) for f, s in facts[:40]] + facts[40:90] + [("", "s"), (None, "s"), (" \t ", "s"), ("", "s")]
    sets = [set((f or "").lower().split()) for f, _ in facts]
    want = {(f"{i:04d}", f"{j:04d}") for i in range(len(facts)) for j in range(i) if facts[i][1] == facts[j][1] and sets[i] and jaccard(sets[i], sets[j])}
    want = {(min(p), max(p)) for p in want}
    assert len(want) > 1000
    got = [(r.a, r.b) for r in lifecycle.duplicate_pairs(cards_of(spark, facts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    links = lifecycle.duplicate_links(cards_of(spark, facts))
    edges = lambda pairs: spark.createDataFrame(list(pairs), "source_id string, target_id string")
    assert sorted(graph.components(links.selectExpr("a as source_id", "b as target_id")).collect()) == sorted(graph.components(edges(want)).collect())


def test_copies_are_linked_once(spark):
    facts = [("one text that is there many times", "s")] * 200 + [("one text that is there many more times", "s")] * 100 + [("it is not so", "s"), ("it is so", "s")]
    assert lifecycle.duplicate_links(cards_of(spark, facts)).count() == 199 + 99 + 1
    assert lifecycle.duplicate_pairs(cards_of(spark, facts)).count() == 300 * 299 // 2


def test_a_shared_rare_word_makes_no_candidates(spark):
    rng = random.Random(5)
    facts = [(" ".join(["rare", *(f"w{rng.randrange(10**6)}" for _ in range(100))]), "s") for _ in range(300)]
    words = cards_of(spark, facts).select(F.monotonically_increasing_id().alias("num"), F.lit(0).cast("long").alias("space"), F.expr("transform(array_distinct(split(fact, ' ')), w -> xxhash64(w))").alias("ws"))
    assert lifecycle.near_sets(words, 0.7).count() == 0


def test_sets_that_are_split_up_meet(spark):
    """Large sets have keys by parts: copies around the threshold, across levels too, are found, and sets that share many words by chance are no candidates."""
    rng, facts = random.Random(11), []
    for n in (230, 256, 300, 360, 1000, 1100, 1400, 4096, 5000):
        base = [f"w{rng.randrange(20000)}" for _ in range(n)]
        facts.append((" ".join(base), "s"))
        for share in (0.05, 0.15, 0.17, 0.18, 0.19, 0.29, 0.31):
            facts.append((" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base), "s"))
            facts.append((" ".join(base[: int(len(base) * (1 - share))]), "s"))
    sets = [set(f.split()) for f, _ in facts]
    want = {(f"{j:04d}", f"{i:04d}") for i in range(len(facts)) for j in range(i) if jaccard(sets[i], sets[j])}
    assert len(want) > 300 and {(r.a, r.b) for r in lifecycle.duplicate_pairs(cards_of(spark, facts)).collect()} == want


def test_pairs_that_meet_by_chance_are_not_shuffled(spark):
    """Texts of 100 of the same 400 words share rare words in nearly every pair, but none is told as a candidate; a text has few keys."""
    rng = random.Random(13)
    words = spark.createDataFrame([(i, 0, rng.sample(range(1, 401), 100)) for i in range(300)], "num long, space long, ws array<long>")
    near = lifecycle.near_sets(words, 0.7)
    assert near.count() == 0
    joined = near._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in joined.split("Join Inner", 1)[1].split("\n", 1)[0]
    w, df, ends = np.arange(1, 101, dtype=np.uint64), np.ones(100, np.int64), np.array([0, 100])
    assert sum(len(key) for key, *_ in lifecycle.set_keys(w, df, ends, 0.7)) == 31


def test_many_near_copies(spark, monkeypatch):
    """A group of near copies is compared in blocks; a pair is told a few times, not for each rare word that it shares."""
    rng, base = random.Random(17), [f"w{i}" for i in range(300)]
    facts = [(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < 0.08 else w for w in base), rng.choice(["s", None])) for _ in range(60)]
    sets = [set(f.split()) for f, _ in facts]
    want = {(f"{j:04d}", f"{i:04d}") for i in range(60) for j in range(i) if facts[i][1] == facts[j][1] and jaccard(sets[i], sets[j])}
    monkeypatch.setattr(lifecycle, "SET_BLOCK", 7)
    got = [(r.a, r.b) for r in lifecycle.duplicate_pairs(cards_of(spark, facts)).collect()]
    assert len(want) > 500 and len(got) == len(want) and set(got) == want
    monkeypatch.undo()
    assert lifecycle.duplicate_links(cards_of(spark, facts)).count() <= 2 * 60
