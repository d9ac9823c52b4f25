"""The stored term index: batches, updates and merges against an index of all at once; what queries read; commits in conflict."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from cardloom.operators import lexical
from cardloom.operators.graph import shared_folder
from cardloom.operators.term_index import TermIndex
from cardloom.sources.cards import cards_doc
from cardloom.sources.versions import Conflict, Versions

DIR = "/root/testdata/sf0.001"
WORDS = "the with nicht para".split()


def folder(spark):
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def best(index, **how):
    return [(r.id, round(r.score, 9)) for r in index.bm25(WORDS, 15, **how).collect()]


@pytest.fixture(scope="module")
def cards(spark):
    return cards_doc(spark, DIR)


@pytest.fixture(scope="module")
def whole(spark, cards):
    index = TermIndex(spark, folder(spark))
    index.append(cards)
    return index


def plain_bm25(cards, words, n, prefix=False):
    """BM25 by its formula over all cards on the driver."""
    import math
    import re

    docs = {r.id: re.findall(r"[^\W_]+", (r.fact or "").lower()) for r in cards.collect()}
    al, score = sum(map(len, docs.values())) / len(docs), {}
    for w in words:
        f = {i: sum(x.startswith(w) if prefix else x == w for x in ws) for i, ws in docs.items()}
        df = sum(v > 0 for v in f.values())
        idf = math.log((len(docs) - df + 0.5) / (df + 0.5)) if df else 0
        for i, v in f.items():
            if v:
                score[i] = score.get(i, 0) + (idf if idf > 0 else 0.000001) * v * 2.2 / (v + 1.2 * (0.25 + 0.75 * len(docs[i]) / al))
    return [(i, round(s, 9)) for i, s in sorted(score.items(), key=lambda x: (-x[1], x[0]))[:n]]


@pytest.mark.parametrize("prefix", [False, True])
def test_scores(cards, whole, prefix):
    assert best(whole, prefix=prefix) == plain_bm25(cards, WORDS, 15, prefix)


def test_batches_updates_and_merges_equal_a_rebuild(spark, cards, whole):
    index = TermIndex(spark, folder(spark), block_docs=16)
    index.append(cards.where("doc_id % 3 = 0"))
    index.append(cards.where("doc_id % 3 = 1").withColumn("fact", F.lit("other words with nothing para")))
    index.append(cards.where("doc_id % 3 = 2"))
    snap = index.snapshot()
    assert len(snap.segments) == 3 and snap.nd == cards.count() and not snap.gone
    index.upsert(cards.where("doc_id % 3 = 1"))
    for prefix in (False, True):
        assert best(index, prefix=prefix) == best(whole, prefix=prefix)
    index.append(cards.withColumn("id", F.concat(F.lit("x"), "id")))
    index.delete(cards.selectExpr("concat('x', id) as id").union(spark.createDataFrame([("never there",)], "id string")))
    assert (index.snapshot().nd, index.snapshot().words) == (whole.snapshot().nd, whole.snapshot().words)
    assert best(index, prefix=True) == best(whole, prefix=True)
    before = index.snapshot().version
    index.merge()
    after = index.snapshot()
    assert len(after.segments) == 1 and not after.gone and index.merge() is None
    assert best(index, prefix=True) == best(whole, prefix=True) and best(index, scope="lang=es") == best(whole, scope="lang=es")
    assert index.snapshot(before).nd == after.nd  # the version before can still be read
    index.versions.vacuum(1)
    assert best(index) == best(whole)


def test_skipped_blocks_change_nothing(spark, cards, whole):
    index = TermIndex(spark, folder(spark), block_docs=4)
    index.append(cards)
    for n in (1, 5, 15):
        for scope in (None, "lang=es"):
            a = index.bm25(["para", "nicht"], n, scope=scope, skip_from=1)
            assert [(r.id, round(r.score, 9)) for r in a.collect()] == [(r.id, round(r.score, 9)) for r in whole.bm25(["para", "nicht"], n, scope=scope).collect()]


def test_a_query_reads_its_buckets_only(whole):
    plan = whole.bm25(["para"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket#" in plan.split("PartitionFilters", 1)[1].split("PushedFilters", 1)[0]
    files = whole.rows(["para"], whole.snapshot())._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(base,para)" in files


def test_odd_cards(spark):
    index = TermIndex(spark, folder(spark))
    assert index.bm25(["a"]).count() == 0 and index.snapshot().nd == 0
    rows = [("1", "Ärger über Öl", "s"), ("2", None, None), ("3", "", "s"), ("4", "arger argere", "s"), ("5", "x " * 5000, None)]
    index.append(spark.createDataFrame(rows, "id string, fact string, scope string"))
    index.append(spark.createDataFrame([], "id string, fact string, scope string"))
    assert {r.id for r in index.bm25(["arger"], folded=True).collect()} == {"1", "4"} and {r.id for r in index.bm25(["arger"]).collect()} == {"4"}
    assert {r.id for r in index.bm25(["arg"], prefix=True, folded=True).collect()} == {"1", "4"} and {r.id for r in index.bm25(["a"], prefix=True, folded=True).collect()} == {"1", "4"}
    assert index.bm25([]).count() == 0 and index.snapshot().nd == 5


def test_substrings(spark, cards):
    index = TermIndex(spark, folder(spark), kind="trigrams", block_docs=16)
    odd = spark.createDataFrame([("odd1", "100%_sure 😀😀😀x"), ("odd2", None), ("odd3", "ab"), ("odd4", "AB\nab")], "id string, fact string")
    all_ = cards.select("id", "fact").union(odd)
    index.append(all_.where("id < 'd000100'"))
    index.append(all_.where("id >= 'd000100'"))
    facts = {r.id: (r.fact or "") for r in all_.collect()}
    low = {i: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for i, t in facts.items()}
    rng = random.Random(4)
    values = ["Licensed under", "%_s", "😀😀x", "ab", "b\na", "no such text at all"] + [t[k : k + 9] for t in rng.sample([t for t in facts.values() if len(t) > 50], 5) for k in [rng.randrange(40)]]
    for v in values:
        want = {i for i, t in low.items() if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in v) in t}
        assert {r.id for r in index.containing(v).collect()} == want, v
    index.delete(spark.createDataFrame([("odd1",)], "id string"))
    assert index.containing("😀😀x").count() == 0 and index.containing("%_").count() == 0


def test_cosine_from_the_index(spark, cards):
    index = TermIndex(spark, folder(spark), kind="ascii")
    index.append(cards)
    assert [(r.id, round(r.score, 12)) for r in index.cosine({"the": 2, "with": 1}, 20).collect()] == [(r.id, round(r.score, 12)) for r in lexical.tf_cosine(cards, "the with the", 20).collect()]


def test_commits_in_conflict(spark):
    v = Versions(spark, folder(spark))
    cards, edges = spark.range(3).selectExpr("id"), spark.range(2).selectExpr("id as e")
    assert v.commit_tables(0, {"cards": cards, "edges": edges}) == 1
    with pytest.raises(Conflict):
        v.commit_tables(0, {"cards": cards})
    tries = []

    def grow(base, said):
        if not tries:  # another writer is faster once
            tries.append(v.commit_tables(base, {"edges": edges.limit(1)}))
        return v.commit_tables(base, {"cards": v.read("cards", "id long").union(cards)})

    assert v.rebased(grow) == 3
    assert v.read("cards", "id long").count() == 6 and v.read("edges", "e long").count() == 1 and v.read("cards", "id long", 1).count() == 3
    # a version that isn't complete: readers take the one before, writers wait for it, or take over what was left behind
    out = v._fs.create(v._file(4), False)
    out.write(bytearray(b'{"tab'))
    out.close()
    assert v.latest()[0] == 3
    with pytest.raises(Conflict):
        v.commit_tables(3, {"cards": cards})
    patient = Versions(spark, v.path, grace=-1.0)
    assert patient.commit(3, patient.at(3)) == 4 and v.vacuum(1) >= 1 and v.read("cards", "id long").count() == 6


def test_an_append_beside_another_fails(spark, cards, monkeypatch):
    a = TermIndex(spark, folder(spark))
    a.append(cards.limit(5))
    write = TermIndex._segment

    def late(self, *args):
        monkeypatch.setattr(TermIndex, "_segment", write)
        TermIndex(spark, a.path).append(cards.where("doc_id = 100"))
        return write(self, *args)

    monkeypatch.setattr(TermIndex, "_segment", late)
    with pytest.raises(Conflict):
        a.append(cards.where("doc_id = 101"))
    assert a.snapshot().nd == 6


def test_no_posting_is_shuffled(spark, cards, monkeypatch):
    plans, write = [], TermIndex._write_blocks

    def seen(self, rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(self, rows, name)

    monkeypatch.setattr(TermIndex, "_write_blocks", seen)
    TermIndex(spark, folder(spark)).append(cards.limit(50))
    made = plans[0].split("MapInArrow")
    assert "Exchange" not in made[0] and "hashpartitioning(blk" in made[1]


def test_a_task_sorts_a_slice_of_blocks(spark, cards, monkeypatch):
    from cardloom.operators import term_index

    monkeypatch.setattr(term_index, "SLICE_DOCS", 64, raising=False)
    index = TermIndex(spark, folder(spark), block_docs=16)
    index.append(cards)
    seg = index.snapshot().segments[0]
    rows = spark.read.parquet(f"{index.path}/blocks/seg={seg['name']}").where("bucket >= 0").withColumn("file", F.input_file_name())
    # so few blocks in a file whatever the size of the index, and only a file for a bucket and slice
    assert seg["blocks"] > 8 and rows.groupBy("file").agg(F.max("blk") - F.min("blk")).agg(F.max("(max(blk) - min(blk))")).first()[0] < 8
    assert rows.select("file").distinct().count() <= index.buckets * (seg["docs"] // 64 + 1)


def test_words_of_a_block_are_counted_in_parts(spark, cards, whole, monkeypatch):
    from cardloom.operators import term_index

    block = lambda: {r["term"]: r for b in term_index._pack("words")(iter([batch])) for r in b.to_pylist()}
    import pyarrow as pa

    texts = ["a b a", None, "", "b b c", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 5, pa.int32()), pa.array(range(5), pa.int16()), pa.array(texts)], ["blk", "ord", "text"])
    want = block()
    assert want["a"] == {"term": "a", "blk": 3, "n": 2, "max_tf": 2, "min_len": 1, "ords": [0, 4], "tfs": [2, 1], "norms": None}
    assert want["c"]["tfs"] is None and (want[""]["tfs"], want[""]["norms"]) == ([3, 0, 0, 3, 1], [5, 0, 0, 5, 1])
    monkeypatch.setattr(term_index, "WORDS_AT_ONCE", 2)
    assert block() == want


def test_texts_are_dealt_without_being_held(spark, cards):
    index = TermIndex(spark, folder(spark))
    for blocks, most in ((1, 2), (126, 200), (1600, 200), (16_000, 2000), (80_000, 4096)):
        plan = index._placed(cards.selectExpr("id", "cast(doc_id as int) as blk", "2L as h"), blocks)._jdf.queryExecution().executedPlan().toString()
        assert plan.split("hashpartitioning(blk#", 1)[1].split(")")[0].split(", ")[1].startswith(str(most)), plan


def test_batches_count_their_cards_beside_their_postings(spark, cards):
    index = TermIndex(spark, folder(spark), block_docs=16)
    index.append(cards.where("doc_id % 2 = 0"))
    index.upsert(cards.where("doc_id % 4 = 0").withColumn("fact", F.lit("a b a")))
    snap = index.snapshot()
    for s in snap.segments:
        assert spark.read.parquet(f"{index.path}/blocks/seg={s['name']}/bucket=-1").agg(F.sum("n")).first()[0] == s["docs"]
    want = cards.where("doc_id % 2 = 0").selectExpr("id", "if(doc_id % 4 = 0, 3, size(regexp_extract_all(lower(coalesce(fact, '')), '[\\\\p{L}\\\\p{N}]+', 0))) as len")
    assert sorted(index.docs(snap).select("id", "len").collect()) == sorted(want.collect())
    assert {r["norm2"] for r in index.docs(snap).where("len = 3").select("norm2").collect()} >= {5}
    assert index.rows(["the"], snap, prefix=True).where("term = ''").count() == 0
