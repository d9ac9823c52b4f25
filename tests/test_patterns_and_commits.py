"""Patterns in texts and likeness of names against brute force; sweeps in conflict; functions in SQL."""

import difflib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from cardloom.functions import embed, registry
from cardloom.operators import graph, patterns, sweep
from cardloom.operators.graph import shared_folder
from cardloom.sources.cards import EDGE_SCHEMA, SCHEMA
from cardloom.sources.versions import Conflict, Versions


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_patterns(spark, most):
    rng = random.Random(1)
    texts = [(i, "".join(rng.choices("abcdé ", k=rng.randint(0, 400)))) for i in range(60)] + [(60, None), (61, ""), (62, "aaaaaaaaaaaa")]
    words = {"".join(rng.choices("abcdé ", k=rng.randint(1, 9))) for _ in range(80)} | {"aaaaaaa", "b", "never in there", ""}
    words |= {t[k : k + 8] for _, t in texts if t and len(t) > 60 for k in (3, 30)}
    table = spark.createDataFrame([(w,) for w in sorted(words)] + [("b",), (None,)], "pattern string")
    got = patterns.containing(spark.createDataFrame(texts, "id long, text string"), table, most).collect()
    want = {(i, w) for i, t in texts for w in words if t and w and w in t}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert patterns.containing(spark.createDataFrame(texts, "id long, text string"), table.limit(0)).count() == 0


def test_cooccurrence_takes_a_table(spark):
    rows = spark.createDataFrame([(1, "Ada met BOB"), (2, "bob"), (3, "ada bob Zoe"), (4, None)], "id long, text string")
    names = spark.createDataFrame([("Zoe",), ("Bob",), ("ada",)], "entity string")
    got = sorted(tuple(r)[:2] + (r.object,) for r in graph.cooccurrence(rows, names).collect())
    assert got == [(1, "Bob", "ada"), (3, "Bob", "Zoe"), (3, "Bob", "ada"), (3, "Zoe", "ada")]


def brute(name, known, floor):
    lower = {k.lower(): k for k in sorted(known, reverse=True)}
    if name.lower() in lower:
        return lower[name.lower()]
    best = max(((difflib.SequenceMatcher(None, name.lower(), k).ratio(), v) for k, v in lower.items()), default=(0, ""))
    return best[1] if best[0] >= floor else name


@pytest.mark.parametrize("floor", [0.88, 0.7])
def test_likeness(spark, floor):
    rng = random.Random(6)
    known = {"".join(rng.choices("abcdefg", k=rng.randint(1, 14))) for _ in range(150)} | {"Ada Lovelace", "ADA LOVELACE", "x", "ñandú 😀"}

    def worn(k):
        s = list(k)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(s) + 1)
            if rng.random() < 0.5 or not s:
                s.insert(p, rng.choice("abcdefgz"))
            else:
                s.pop(min(p, len(s) - 1))
        return "".join(s)

    names = {worn(k) for k in known for _ in range(2)} | {"ada lovelace", "Ada Lovelac", "nobody at all", "", "X"}
    got = {r.name: r.entity for r in patterns.resolve(spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), spark.createDataFrame([(k,) for k in known] + [(None,)], "entity string"), floor).collect()}
    want = {n: brute(n, known, floor) for n in names}
    assert got == want and sum(want[n] != n for n in names) > 100
    assert patterns.resolve(spark.createDataFrame([("a",)], "name string"), spark.createDataFrame([], "entity string")).first().entity == "a"


def test_likeness_equals_the_function_of_lists(spark):
    known = ["France", "GERMANY", "UNITED KINGDOMS"]
    names = spark.createDataFrame([(n,) for n in ("FRANCE", "germani", "UNITED KINGDOM", "Spain")], "name string")
    got = {r.name: r.entity for r in patterns.resolve(names, spark.createDataFrame([(k,) for k in known], "entity string")).collect()}
    assert got == {r.name: r.e for r in names.select("name", embed.resolver(known)("name").alias("e")).collect()}


def card(i, fact, at, **more):
    base = {"id": i, "fact": fact, "evidence": "", "timestamp": at, "tags": ["t"], "source_tokens": 0, "embedding": None, "access_count": 1, "last_access": at, "superseded_by": None, "stability": 1.0, "importance": 0.0, "archived": 0.0, "scope": "s"}
    return tuple((base | more).values())


def test_sweeps_in_conflict(spark):
    store = Versions(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    rows = [card("a", "likes tea", 10.0), card("b", "Likes tea", 20.0), card("c", "old and cold", 5.0, access_count=0), card("d", "touched", 5.0, access_count=0)]
    edges = spark.createDataFrame([("c", "a", "semantic", 0.1, 0.0, "s"), ("a", "b", "semantic", 0.2, 0.0, "s")], EDGE_SCHEMA)
    touches = spark.createDataFrame([("d", 30.0), ("d", 40.0)], sweep.TOUCH_SCHEMA)
    v = store.commit_tables(0, {"cards": spark.createDataFrame(rows, SCHEMA), "edges": edges, "touches": touches})
    now = 10_000_000.0
    assert sweep.commit_sweep(store, now, base=v, rule="vitality", floor=0.2, cosine=False) == 2
    with pytest.raises(Conflict):  # another sweep of the version before
        sweep.commit_sweep(store, now, base=v, rule="vitality", floor=0.2, cosine=False)
    got = {r.id: r for r in store.read("cards", SCHEMA).collect()}
    assert set(got) == {"a", "b", "d"} and got["b"].superseded_by == "a" and got["a"].access_count == 2 and got["d"].access_count == 2
    assert [(r.source_id, r.target_id) for r in store.read("edges", EDGE_SCHEMA).collect()] == [("a", "b")] and store.read("touches", sweep.TOUCH_SCHEMA).count() == 0
    assert store.latest()[1]["report"]["merged_cards"] == 1 and store.read("cards", SCHEMA, v).count() == 4  # the version before stays whole
    assert store.rebased(lambda base, said: sweep.commit_sweep(store, now, base, cosine=False)) == 3


def test_functions_in_sql(spark):
    names = registry.register(spark)
    assert "llm_triplets" in names
    replies = spark.createDataFrame([(1, '[["Ada", "knows", "Bob"], ["Bob", "likes", "tea"]]'), (2, "nothing"), (3, None), (4, "(x, y, z)")], "id long, reply string")
    replies.createOrReplaceTempView("replies")
    got = sorted(tuple(r) for r in spark.sql("select id, t.* from replies, lateral llm_triplets(reply) t").collect())
    assert got == [(1, "Ada", "knows", "Bob"), (1, "Bob", "likes", "tea"), (4, "x", "y", "z")]
    r = spark.sql("select card_cosine(array(float(1), float(0)), array(float(2), float(0))) as c, card_retention(0, 10, 1) as r, card_jaccard(array('a', 'b'), array('b')) as j, card_tokens('two words') as t, llm_action('please DELETE it') as a, card_tags_of('My name is Ada') as tags").first()
    assert (r.c, r.r, r.j, r.a, r.tags) == (1.0, 1.0, 0.5, "DELETE", ["name"]) and r.t > 0


def test_lookups_keep_the_first_of_an_id(spark):
    from cardloom.operators import retrieval

    rows = [card("a", "my port is 22", 20.0), card("a", "my port is 23", 10.0), card("b", "no port", 5.0), card("c", "other", 1.0)]
    got = retrieval.sql_path(spark.createDataFrame(rows, SCHEMA), "what is my port?").collect()
    assert sorted((r.id, r.timestamp) for r in got) == [("a", 10.0), ("b", 5.0)]
