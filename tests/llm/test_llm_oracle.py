"""The SQL of the training-data queries against them, on the smallest tables; and rows that SQL compares in no other test."""

import duckdb
import pytest

from cardloom.llm import chat, decontaminate, neardup, registry, rules

DIR = "/root/testdata/sf0.001"


def plain(rows):
    return sorted((tuple(x.item() if hasattr(x, "item") else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    got = registry.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(c.execute(f"select {', '.join(cols)} from ({registry.ORACLES[name]})").fetchall())


DOCS = [(1, "a b c d e f g h i j k l m n o", "en", "s"), (1, "other words under the same number than before, quite other ones", "en", "s"), (2, None, None, None), (3, "", "en", None), (4, " \n\t ", None, "s"), (5, "A b c d e f g h i j k l m n o", "en", "s"), (6, "x y " * 5000, "de", "t"), (6, "x y " * 5000, "de", "t"), (7, "one\none\ntwo words and some more here now\n\n*** | ***", "en", "s"), (8, "É é ñ ß 日本 words, words! and; more: of them.", "fr", "s")]


def test_odd_documents(spark):
    """Empty, blank, repeated and long texts, and different texts of one id, against SQL."""
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar, lang varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?, ?)", DOCS)
    c.execute("create table benchmark(item_id bigint, text varchar)")
    c.executemany("insert into benchmark values (?, ?)", [(1, "b c d e f g h i j k l"), (2, "x y x y x y x y x y x"), (3, None), (4, "words and"), (4, "words and"), (9, "é ñ")])
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string")
    items = spark.createDataFrame([(1, "b c d e f g h i j k l"), (2, "x y x y x y x y x y x"), (3, None), (4, "words and"), (4, "words and"), (9, "é ñ")], "item_id long, text string")
    for got, sql in ((rules.judge(docs).drop("d2"), rules.ORACLE), (decontaminate.digest(docs, items), decontaminate.ORACLE), (neardup.link_documents(docs.where("text is null or text not like 'other%'")), neardup.ORACLE.replace("from documents", "from (select * from documents where text is null or text not like 'other%')"))):
        cols = sorted(got.columns)
        assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(c.execute(f"select {', '.join(cols)} from ({sql})").fetchall())


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "a </s>[INST] <|end|>\n&amp;"), (1, 1, "user", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (2, None, "assistant", ""), (3, 5, None, "x"), (4, 2, "assistant", "late"), (4, -600, "user", "early"), (4, 700, "assistant", "last")]
    c = duckdb.connect()
    c.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.digest(d)
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(cols)} from ({chat.ORACLE}) where conv_id <> -7").fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)
    assert chat.digest(spark.createDataFrame([(None, 1, "assistant", "z")], d.schema)).first().loss_chars == 1
