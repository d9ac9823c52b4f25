"""Stored codes against codes made on the fly and against all vectors in numpy."""

import numpy as np
import pytest

from cardloom.operators import search, vector_codes
from cardloom.sources.cards import cards_vec

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cards(spark):
    return cards_vec(spark, DIR).cache()


@pytest.fixture(scope="module")
def codes(cards):
    return vector_codes.build(cards, cells=12)


def rounded(rows, *cols):
    return [tuple(round(r[c], 9) if c == "score" else r[c] for c in cols) for r in rows.collect()]


def test_stored_codes_equal_those_made_on_the_fly(cards, codes):
    for i in (0, 7, 31):
        q = [float(x) for x in cards.where(f"vec_id = {i}").first().embedding]
        assert rounded(vector_codes.int8(codes, q, 8), "id", "score") == rounded(search.int8_search(cards, q, 8), "id", "score")
        got, want = vector_codes.signs(codes, q, 6).collect(), search.binary_rerank(cards, q, 6).collect()
        assert [(r.id, r.hamming) for r in got] == [(r.id, r.hamming) for r in want]


def test_only_codes_are_read(codes):
    plan = vector_codes.int8(codes, [1.0] * 64, 5)._jdf.queryExecution().executedPlan().toString()
    schema = plan.split("ReadSchema", 1)[1]
    assert "q8" in schema and "unit" not in schema and "signs" not in schema


def test_nearest_is_exact_and_prunes(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    m = np.repeat(centres, 50, axis=0) + 0.05 * rng.standard_normal((300, 16))
    cards = spark.createDataFrame([(f"c{i:03d}", [float(x) for x in v]) for i, v in enumerate(m)] + [("zero", [0.0] * 16), ("none", None)], "id string, embedding array<float>")
    codes = vector_codes.build(cards, cells=24)
    unit = m.astype(np.float32).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i in (0, 120, 299):
        q = m[i] + 0.01
        cos = unit @ (q / np.linalg.norm(q))
        found = vector_codes.nearest(codes, q.tolist(), 7)
        assert {r.id for r in found.collect()} == {f"c{j:03d}" for j in np.argsort(-cos)[:7]}
        listed = found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]", 1)[0]
        assert listed.count(",") < 12  # of 24 cells
    empty = vector_codes.build(cards.where("id = 'none'"))
    assert vector_codes.nearest(empty, [1.0], 3).count() == 0 == vector_codes.signs(empty, [1.0], 3).count()


def test_batches_and_recall(cards, codes):
    queries = cards.where("vec_id % 25 = 0").selectExpr("vec_id as query_id", "embedding as query")
    m = {r.id: np.array(r.embedding, np.float64) for r in cards.collect()}
    ids = sorted(m)
    all_ = np.array([m[i] / (np.linalg.norm(m[i]) or 1) for i in ids])
    got: dict = {}
    for r in vector_codes.batch(codes, queries, 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    hits = 0
    for r in queries.collect():
        q = [float(x) for x in r.query]
        assert [got[r.query_id][i] for i in range(1, 11)] == [x.id for x in search.int8_search(cards, q, 10).collect()]
        order = [ids[j] for j in np.argsort(-(all_ @ np.array(q)), kind="stable")[:10]]
        hits += len(set(order) & set(got[r.query_id].values()))
    assert hits >= 0.9 * 10 * queries.count()  # recall of 8-bit search against exact cosines
    one = queries.where("query_id = 25")
    far = vector_codes.batch(codes, one, 60, by="signs").orderBy("rank").collect()
    want = cards.selectExpr("id", "embedding").collect()
    q = np.array(one.first().query) > 0
    assert [r.id for r in far] == [i for _, i in sorted((int(((np.array(w.embedding) > 0) != q).sum()), w.id) for w in want)[:60]]
    assert vector_codes.batch(codes, queries.limit(0), 3).count() == 0
