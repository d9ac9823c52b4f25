"""Edge cases of the card operators."""

import pytest

from cardloom.functions import embed
from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.operators import graph, lexical, lifecycle, lookup, reads, retrieval, search, sweep
from cardloom.plans import all as _  # noqa: F401
from cardloom.plans import registry
from cardloom.sources import cards as views
from cardloom.sources import io
from cardloom.streaming import tail


def one(spark, sql):
    return spark.sql(f"select {sql} as x").first()["x"]


@pytest.fixture(scope="module")
def cards(spark):
    return spark.createDataFrame(
        [("a", "User uses Mac", 1.0, ["x"], [1.0, 0.0], "s"), ("b", "user uses MAC", 2.0, ["x", "y"], [1.0, 0.0], "s"), ("c", "port 22 % done", 3.0, None, [0.0, 1.0], "t"), ("d", None, 4.0, [], None, "s")],
        "id string, fact string, timestamp double, tags array<string>, embedding array<float>, scope string",
    ).selectExpr("*", "'' as evidence", "0L as access_count", "0D as last_access", "1D as stability", "0D as importance", "0D as archived", "cast(null as string) as superseded_by", "0L as source_tokens")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_lookup(cards):
    assert ids(lookup.lookup(cards, "fact", "user USES mac")) == ["a", "b"]
    assert ids(lookup.lookup(cards, "fact", "%")) == ["c"]
    assert ids(lookup.lookup(cards, "tags", "y")) == ["b"]
    with pytest.raises(ValueError):
        lookup.lookup(cards, "id", "a")


def test_search_ties_scope_and_zero_query(cards):
    assert ids(search.vector_search(cards, [1.0, 0.0], 1, alpha=1.0)) == ["a"]
    assert ids(search.vector_search(cards, [0.0, 1.0], 5, alpha=1.0, scope="t")) == ["c"]
    assert ids(search.vector_search(cards, [0.0, 0.0], 5)) == []
    assert ids(search.vector_search(cards, [1.0], 2, alpha=1.0)) == ["a", "b"]


def test_negation_truth_table(spark):
    pairs = [("User uses Mac", "User does not use Mac", True), ("User uses Mac", "User uses Mac", False), ("a b c", "not x y z", False), ("", "not a", False)]
    for a, b, want in pairs:
        assert one(spark, X.are_negations(f"'{a}'", f"'{b}'")) is want, (a, b)


def test_scalars(spark):
    assert one(spark, S.tokens("''")) == 0 and one(spark, S.tokens("cast(null as string)")) == 0 and one(spark, S.tokens("'a'")) == 1
    assert one(spark, S.retention("0D", "100D", "1D", 24.0)) == 1.0
    assert one(spark, S.scope_build("map('b', '2', 'a', '1', 'c', '')")) == "a=1&b=2"
    assert one(spark, S.scope_parse("'a=1&&x&a=2'")) == {"a": "2"}
    assert one(spark, S.ttl_seconds("array('x', 'ttl:60')")) == 60.0
    assert one(spark, S.normalise("array(0f, 0f)")) == [0.0, 0.0]
    assert one(spark, S.stability_fold("1D", "0", "0D", "9")) == 10.0


def test_graph_and_merge(spark, cards):
    pairs = lifecycle.duplicate_pairs(cards)
    assert [(r.a, r.b) for r in pairs.collect()] == [("a", "b")]
    merged = lifecycle.merge_clusters(cards, pairs).collect()
    assert [(r.id, r.merged, r.tags) for r in merged] == [("a", 2, ["x", "y"])]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "source_id string, target_id string").selectExpr("*", "'k' as relation_type", "1D as weight", "0D as created_at")
    assert {r.id: r.cluster for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert sorted(ids(graph.multi_hop(e, ["a"], 1))) == ["b"]


def test_budget_and_fusion(spark):
    hits = spark.createDataFrame([(1, "a", 0.9, 10), (1, "b", 0.8, 10), (1, "c", 0.1, 900), (1, "d", 0.0, 1)], "query_id long, id string, score double, cost long")
    assert ids(lexical.with_budget(hits, 25).orderBy("id")) == ["a", "b"]
    v = spark.createDataFrame([("a", 1.0), ("b", 0.5)], "id string, score double")
    assert ids(lexical.rrf(v, v.where("id = 'b'"), k=2)) == ["b", "a"]


def test_import_export(spark, cards, tmp_path):
    io.write_jsonl(cards, f"file://{tmp_path}/c")
    back, skipped = io.read_jsonl(spark, f"file://{tmp_path}/c")
    assert sorted(ids(back)) == ["a", "b", "c"] and skipped.first()["skipped"] == 1
    io.write_csv(cards, f"file://{tmp_path}/csv")
    io.write_markdown(cards, f"file://{tmp_path}/md")
    assert one(spark, f"size({io.parse_tags(chr(39) + '{bad' + chr(39))})") == 0


def test_replies(spark):
    t = spark.createDataFrame([("(a, likes, b)", '{"action": "delete"}'), (None, None)], "t string, a string")
    got = t.select(embed.parse_triplets("t").alias("t"), embed.parse_action("a").alias("a")).collect()
    assert [(r.t, r.a) for r in got] == [([["a", "likes", "b"]], "DELETE"), ([], "ADD")]


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame([(1, "add", "a", "f", None, 1.0), (2, "put", "a", "g", None, 2.0), (3, "delete", "a", None, None, 3.0)], tail.LOG_SCHEMA)
    log.write.parquet(f"{tmp_path}/log")
    for _ in range(2):
        tail.run_once(tail.watch(spark, f"{tmp_path}/log"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert [r.event for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()] == ["new", "audit", "deleted"]


def test_long_ids_stay_whole(spark, tmp_path):
    n = [7, 999999, *range(1000000, 1000020)]
    spark.createDataFrame([(i, f"licensed text {i // 2} of {i // 2} and {i // 2 + 5000000} more", "en", "s") for i in n], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i % 3)], 1) for i in n], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    d = str(tmp_path)
    assert {r.id for r in views.cards_doc(spark, d).collect()} == {f"d{i:06d}" for i in n}
    assert {r.superseded_by for r in views.cards_vec(spark, d).collect()} - {None} == {f"v{i + 1:06d}" for i in n if i % 17 == 0}
    assert {r.id for r in views.cards_vec(spark, d).collect()} == {f"v{i:06d}" for i in n}
    q = registry.QUERIES
    assert {r.id for r in q["lookup_fact"](spark, d).collect()} == {f"d{i:06d}" for i in n}
    assert {(r.a, r.b) for r in q["dup_jaccard"](spark, d).collect()} == {(str(i), str(i + 1)) for i in range(1000000, 1000020, 2)}


def test_index(spark, cards, tmp_path):
    ix = lexical.build_index(cards)
    assert ids(lexical.bm25(ix, "mac", scope="s")) == ["a", "b"] and ids(lexical.bm25(ix, "MAC x"))[:2] == ["a", "b"]
    assert ids(lexical.bm25(ix, "")) == [] and ids(lexical.bm25(ix, "ma", prefix=True)) == ["a", "b"] and ids(lexical.bm25(ix, "ma")) == []
    d = spark.createDataFrame([("1", "Año pára"), ("2", "ano"), ("3", "pa\u0301ra para"), ("4", None)], "id string, fact string")
    ix = lexical.build_index(d)
    assert sorted(ids(lexical.bm25(ix, "para", folded=True))) == ["1", "3"] and ids(lexical.bm25(ix, "para")) == ["3"] and ids(lexical.bm25(ix, "pár", prefix=True, folded=False)) == ["1"]
    assert ids(lexical.bm25(lexical.build_index(d.limit(0)), "para")) == []
    path = f"file://{tmp_path}/t"
    d.write.parquet(path)
    first = lexical.index_of(spark.read.parquet(path), "t")
    assert lexical.index_of(spark.read.parquet(path), "t") is first
    spark.createDataFrame([("5", "para")], "id string, fact string").write.mode("append").parquet(path)
    assert sorted(ids(lexical.bm25(lexical.index_of(spark.read.parquet(path), "t"), "para", folded=True))) == ["1", "3", "5"]


def test_retrieval(spark, cards):
    ix = lexical.build_index(views.live(cards))
    assert ids(retrieval.hybrid_search(cards, ix, "mac", [0.0, 1.0], 3))[0] in ("a", "c") and ids(retrieval.hybrid_search(cards, ix, "", [], 3)) == []
    assert ids(retrieval.hybrid_search(cards, ix, "mac", [], 3, scope="s")) == ["a", "b"]
    assert ids(retrieval.recall(cards, [1.0, 0.0], 10.0, scope="t")) == ["c"] and ids(retrieval.recall(cards, [1.0, 0.0], 10.0, scope="zz")) == []
    assert retrieval.key_of("What is my project name?") == "project name" and retrieval.key_of("hello") is None
    assert (retrieval.salient("what is the port of SSH"), retrieval.salient("who are the"), retrieval.salient("")) == ("port", "who", None)
    a = retrieval.ask(cards, "what is my Mac?", [1.0, 0.0], 300, 7.0)
    assert sorted(ids(a.hits)) == ["a", "b"] and a.report.first()["route"] == "sql" and {(r["id"], r["at"]) for r in a.touches.collect()} == {("a", 7.0), ("b", 7.0)}
    a = retrieval.ask(cards, "what is my zebra?", [1.0, 0.0], 300)  # nothing stored: by vector
    assert a.report.first()["route"] == "vector" and sorted(ids(a.hits)) == ["a", "b"]
    assert ids(retrieval.ask(cards, "what is my Mac?", [1.0, 0.0], 0).hits) == [] and ids(retrieval.ask(cards.limit(0), "x", [1.0], 9).hits) == []
    assert retrieval.mix_alpha(7, 3) == 0.7 and retrieval.mix_alpha(0, 0) == 0.7 and retrieval.mix_alpha(None, 1, 0.5) == 0.5
    assert retrieval.scope_of_filter({"user_id": 5, "doc_id": "x"}) == "5" and retrieval.scope_of_filter({"a": 1}) is None and retrieval.scope_of_filter(None) is None


def test_sweep(spark, cards):
    none = spark.createDataFrame([], "source_id string, target_id string, relation_type string, weight double")
    plan = sweep.plan_sweep(cards, none, 20000.0, cosine=False)
    assert [tuple(r) for r in plan.superseded.collect()] == [("a", "b")] or [tuple(r) for r in plan.superseded.collect()] == [("b", "a")]
    after = sweep.apply_plan(cards, plan)
    assert after.columns == cards.columns and ids(views.live(after).orderBy("id")) == sorted(set(ids(views.live(cards))) - {plan.superseded.first()["id"]} - set(ids(plan.pruned)))
    r = plan.report.first()
    assert r["survivors"] == views.live(after).count() and r["merged_cards"] == 1
    empty = sweep.plan_sweep(cards.limit(0), none, 1.0).report.first()
    assert (empty["cards_before"], empty["survivors"], empty["tokens_reclaimed"]) == (0, 0, 0)
    with pytest.raises(ValueError, match="already there: a"):
        sweep.add(cards, none, cards.where("id = 'a'"))
    with pytest.raises(ValueError):
        sweep.add(cards.where("id <> 'a'"), none, cards.where("id = 'a'").union(cards.where("id = 'a'")))
    assert sorted(ids(sweep.forget(cards, None))) == sorted(ids(cards)) and "a" not in ids(sweep.forget(cards, "x"))
    once = sweep.archive(cards, cards.select("id"), 5.0)
    assert {r["archived"] for r in sweep.archive(once, cards.select("id"), 9.0).collect()} == {5.0}


def test_graph_merge_keeps_the_hub(spark, cards):
    members = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "k")], "id string, cluster string")
    weights = spark.createDataFrame([("c", 2.0)], "source_id string, compound_weight double")
    r = sweep.merge_graph_clusters(cards, members, weights).first()
    assert r["id"] == "c" and r["folded"] == ["a", "b"] and r["fact"] == "port 22 % done; User uses Mac; user uses MAC"


def test_targets_and_scalars(spark):
    t = lambda text, phrases: one(spark, X.target_id(X.lit(text), phrases))
    assert t("I switched to Rust", X.UPDATES) == "rust" and t('forget "My Old Home" now', X.DELETES) == "my_old_home" and t("forget that", X.DELETES) is None
    assert t("I no longer use Vim for my work", X.UPDATES) == "vim" and t("remove the red door and the key", X.DELETES) == "red_door" and t("hello", X.DELETES) is None
    assert [one(spark, S.human_size(x)) for x in ("-1D", "cast(null as double)", "0D", "1023D", "1024D", "1536D", "15360D", "1073741824D")] == ["0 B", "0 B", "0 B", "1023 B", "1 KB", "1.5 KB", "15 KB", "1 GB"]
    assert one(spark, X.evidence(X.lit("x" * 130 + ", I live here, and more"))) == "x" * 130 + ", I live here" and one(spark, X.evidence("cast(null as string)")) == ""
    assert one(spark, S.cosine("array(3D, 4D)", "array(6D, 8D)")) == pytest.approx(1.0) and one(spark, S.cosine("array(0D)", "array(1D)")) == 0
    assert one(spark, S.age_days("100D", "50D")) == 0 and one(spark, S.bar("2D", 4)) == "####"
    assert abs(embed.trigram_vector("") @ embed.trigram_vector("") - 1) < 1e-9 and not embed.signed_vector("  ").any() and abs(embed.signed_vector("a b") @ embed.signed_vector("A  b") - 1) > 1e-9
    assert reads.sample_queries([], 5) == [] and len(reads.sample_queries(["a, b", "c."], 5)) == 5 and reads.sample_queries(["a"], 2) == ["a", "a variant 1"]


def test_int8_query_and_dispatch(cards):
    assert search.quantised([0.0, 0.0]) == ([0, 0], 0.0) and search.quantised([127.0, -1.0])[0] == [127, -1]
    assert ids(search.auto_search(cards.where("embedding is not null"), [1.0, 0.0], 1, small=1, large=2, latched="float")) == ["a"]


def test_similar_pairs_prune_nothing_that_counts(spark):
    """Cells that can't share a pair don't meet; what is found is what all pairs give, also with vectors of other lengths and norms."""
    import numpy as np

    rng = np.random.default_rng(1)
    heart = rng.normal(size=(12, 16))
    m = heart[rng.integers(0, 12, 600)] + rng.normal(size=(600, 16)) * 0.25
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[:20] *= 3.0
    m[20] = 0
    rows = [(f"{i:04d}", [float(x) for x in (v[:9] if i % 50 == 7 else v)]) for i, v in enumerate(m)] + [("none", None), ("empty", [])]
    cards = spark.createDataFrame(rows, "id string, embedding array<float>")
    full = np.array([list(np.float32(v)) + [0.0] * (16 - len(v)) for _, v in rows[:600]], np.float64)
    want = {(rows[a][0], rows[b][0]) for a, b in zip(*np.nonzero(np.triu(full @ full.T > 0.8, 1)), strict=True)}
    for block in (40, 7, 5000):
        got = search.similar_pairs(cards, 0.8, block).collect()
        assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    pivots = heart / np.linalg.norm(heart, axis=1, keepdims=True)
    assert search.may_meet(pivots, np.full(12, 0.2), np.ones(12), 0.95).mean() < 0.3
    assert search.similar_pairs(cards.limit(0), 0.5).count() == 0


def test_shared_tags_with_a_floor(spark):
    rows = [(f"{i:03d}", ["hot", f"t{i % 9}", f"u{i % 5}", f"w{i % 4}"][: 1 + i % 4]) for i in range(90)] + [("x", []), ("y", None)]
    cards = spark.createDataFrame(rows, "id string, tags array<string>")
    every = {(r["source_id"], r["target_id"]): r["weight"] for r in graph.shared_tag_edges(cards).collect()}
    for floor in (0.3, 0.5, 0.75, 1.0):
        got = {(r["source_id"], r["target_id"]): r["weight"] for r in graph.shared_tag_edges(cards, floor).collect()}
        assert got == {k: w for k, w in every.items() if w >= floor}, floor


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(70) if i != 40], "source_id string, target_id string")
    got = {r["id"]: r["cluster"] for r in graph.components(path).collect()}
    assert got == {f"{i:03d}": "000" if i <= 40 else "041" for i in range(71)}
    assert graph.components(path.limit(0)).count() == 0


def test_resolver_skips_nothing_similar(spark):
    import difflib

    known = [f"{a}{b} corp{c}" for a in ("acme", "bolt", "cyan") for b in ("", "s", " inc") for c in ("", "oration")]
    names = [k.upper() if i % 3 == 0 else k[:-1] + "x" if i % 3 == 1 else k.replace("o", "0") for i, k in enumerate(known)] + ["zzz", "", None]

    def plain(n):
        if n is None:
            return None
        same = [k for k in known if k.lower() == n.lower()]
        best = max((difflib.SequenceMatcher(None, n.lower(), k.lower()).ratio(), k) for k in known)
        return same[0] if same else best[1] if best[0] >= 0.88 else n

    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = [r["x"] for r in d.select("i", embed.resolver(known)("n").alias("x")).orderBy("i").collect()]
    assert got == [plain(n) for n in names]


def test_sweeps_as_a_stream(spark, cards):
    import time

    from cardloom.streaming import sweeps

    none = spark.createDataFrame([], "source_id string, target_id string, relation_type string, weight double")
    state = {"cards": cards, "reports": []}

    def save(after, report):
        state["cards"] = graph.stored(after)
        state["reports"].append(report.first())

    q = sweeps.start(spark, lambda: (state["cards"], none), save, lambda: 20000.0, "1 second", cosine=False)
    until = time.time() + 90
    while len(state["reports"]) < 2 and time.time() < until and q.isActive:
        time.sleep(0.5)
    q.stop()
    assert [r["merged_cards"] for r in state["reports"][:2]] == [1, 0] and state["reports"][1]["cards_before"] == state["reports"][0]["survivors"]


def test_failover_and_zero_vectors(spark):
    def broken(text):
        raise OSError("down")

    d = spark.createDataFrame([("a b",), ("",), (None,)], "t string")
    got = [r["v"] for r in d.select(embed.failover(broken, lambda t: [0.0, 0.0], lambda t: [1.0] if t else [])("t").alias("v")).collect()]
    assert got[0] == [1.0] and len(got[1]) == embed.DIMS and not any(got[1])
    c = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [0.0, 0.0]), ("c", None)], "id string, embedding array<float>")
    assert [(r["id"], r["score"]) for r in search.cosine_search(c, [6.0, 8.0]).collect()] == [("a", pytest.approx(1.0)), ("b", 0.0)]
    assert search.one_dimension(c.where("embedding is null")).first()["dim"] is None
