"""What searches of documents with vectors read: texts meet vectors for the hits only."""

from cardloom.functions import text as X
from cardloom.operators import lexical, retrieval
from cardloom.plans import more
from cardloom.plans.vectors import first_vector

DIR = "/root/testdata/sf0.001"


def test_an_index_is_built_without_a_join(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(lexical, "index_of", lambda cards, label, **how: seen.append(cards))
    more._index(spark, DIR)
    assert "Join" not in seen[0].select("id", "fact", "scope")._jdf.queryExecution().optimizedPlan().toString()
    whole = more.live(more.cards_full(spark, DIR)).select("id", "fact", "scope")
    assert sorted(seen[0].select("id", "fact", "scope").collect()) == sorted(whole.collect())


def test_hits_are_picked_before_cards_are_joined(spark):
    hits = retrieval.hybrid_search(more.cards_full(spark, DIR), more._index(spark, DIR), more.ASK, first_vector(spark, DIR, 1), 5)
    join = hits.select("id", "fact", "score")._jdf.queryExecution().optimizedPlan().toString().split("LeftOuter", 1)[1]
    assert " IN (" in join or " INSET " in join
    assert hits.count() == 5
    none = retrieval.hybrid_search(more.cards_full(spark, DIR), more._index(spark, DIR), "the", [0.0] * 64, 5)
    assert not X.words_of("the") and none.count() == 0
