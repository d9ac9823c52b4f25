"""Queries on texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.operators import graph, lexical, lookup, search
from cardloom.operators.term_index import TermIndex
from cardloom.plans.registry import query
from cardloom.plans.vectors import first_vector
from cardloom.sources.cards import cards_doc, cards_vec, padded, read

WORDS = "the with nicht para"
TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


def bm25_sql(match: str, n: int) -> str:
    words = ", ".join(f"('{w}')" for w in WORDS.split())
    return f"""docs as (select 'd' || lpad(cast(doc_id as varchar), 6, '0') as id, {TOK} as ws from documents), st as (select count(*) as nd, avg(len(ws)) as al from docs), qs as (select * from (values {words}) as t(q)),
h as (select id, len(ws) as len, q, len(list_filter(ws, lambda w: {match})) as f from docs, qs where len(list_filter(ws, lambda w: {match})) > 0), df as (select q, count(*) as df from h group by q),
bm as (select id, sum(greatest(ln((nd - df + 0.5) / (df + 0.5)), 0.000001) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / al))) as score from h join df using (q), st group by id), lex as (select * from bm order by score desc, id limit {n})"""


@query("lookup_exact_nocase", "select c_custkey, c_name from customer where lower(c_name) = 'customer#000000042' or lower(c_name) = lower((select min(c_name) from customer))")
def lookup_exact_nocase(spark, d):
    name = read(spark, d, "customer").agg(F.min("c_name")).first()[0]
    cards = read(spark, d, "customer").selectExpr("c_custkey", "c_name", "c_name as fact")
    return lookup.exact(cards, name.upper()).union(lookup.exact(cards, "customer#000000042")).select("c_custkey", "c_name").distinct()


@query("lookup_substring", "select 'd' || lpad(cast(doc_id as varchar), 6, '0') as id from documents where contains(lower(text), 'licensed under')")
def lookup_substring(spark, d):
    return lookup.substring(cards_doc(spark, d), "Licensed under").select("id")


@query("lookup_fact", "select 'd' || lpad(cast(doc_id as varchar), 6, '0') as id from documents where contains(lower(text), 'licensed')")
def lookup_fact(spark, d):
    return lookup.lookup(cards_doc(spark, d), "fact", "licensed").select("id")


@query("lookup_tag", "select 'd' || lpad(cast(doc_id as varchar), 6, '0') as id from documents where lang = 'de' or source = 'de'")
def lookup_tag(spark, d):
    return lookup.lookup(cards_doc(spark, d), "tags", "de").select("id")


@query("lookup_any_tag", "select 'd' || lpad(cast(doc_id as varchar), 6, '0') as id from documents where lang in ('de', 'src3') or source in ('de', 'src3')")
def lookup_any_tag(spark, d):
    return lookup.any_tag(cards_doc(spark, d), ["de", "src3"]).select("id")


@query("lookup_metadata", "select 'v' || lpad(cast(vec_id as varchar), 6, '0') as id from embeddings where label = 3")
def lookup_metadata(spark, d):
    return lookup.with_metadata(cards_vec(spark, d), {"label": "3"}).select("id")


@query("batch_get", "select 'v' || lpad(cast(vec_id as varchar), 6, '0') as id, vec_id from embeddings where vec_id in (3, 5, 17)")
def batch_get(spark, d):
    return lookup.get_many(cards_vec(spark, d), ["v000003", "v000005", "v000017"]).select("id", "vec_id")


def _index(spark, d):
    """The postings of all documents, kept for the session."""
    return lexical.index_of(cards_doc(spark, d), "documents")


@query("bm25_topk", f"with {bm25_sql('w = q', 20)} select id, round(score, 6) as score from lex")
def bm25_topk(spark, d):
    return lexical.bm25(_index(spark, d), WORDS, 20).select("id", F.round("score", 6).alias("score"))


@query("bm25_prefix_topk", f"with {bm25_sql('starts_with(w, q)', 20)} select id, round(score, 6) as score from lex")
def bm25_prefix_topk(spark, d):
    return lexical.bm25(_index(spark, d), WORDS, 20, prefix=True).select("id", F.round("score", 6).alias("score"))


@query("tf_cosine_topk", "with t as (select 'd' || lpad(cast(doc_id as varchar), 6, '0') as id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as term from documents), f as (select id, term, count(*) as tf from t group by 1, 2), s as (select id, sum(case when term = 'the' then 2 * tf when term = 'with' then tf else 0 end) as d, sqrt(sum(tf * tf)) as n from f group by id) select id, round(d / (n * sqrt(5)), 6) as score from s where d > 0 order by d / (n * sqrt(5)) desc, id limit 20")
def tf_cosine_topk(spark, d):
    return lexical.tf_cosine(cards_doc(spark, d), "the with the", 20).select("id", F.round("score", 6).alias("score"))


VEC = "vec as (select 'd' || lpad(cast(vec_id as varchar), 6, '0') as id, least(1, greatest(0, list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)))) as cos from embeddings)"


def _vectors(spark, d):
    """Vectors stand for the documents of the same number."""
    q = first_vector(spark, d)
    return cards_vec(spark, d).selectExpr(f"concat('d', {padded('vec_id')}) as id", f"least(1D, greatest(0D, {S.dot('embedding', search._vector(q))})) as cos")


EDGES = "edges as (select 'd' || lpad(cast(doc_id as varchar), 6, '0') as source_id, 'd' || lpad(cast((doc_id * 7) % 500 as varchar), 6, '0') as target_id from documents)"


@query("two_pass_topk", f"with {bm25_sql('w = q', 50)}, {VEC}, sp as (select min(score) as lo, max(score) as hi from lex) select id, round(0.3 * case when hi = lo then 1 else (score - lo) / (hi - lo) end + 0.7 * cos, 6) as score from lex join vec using (id), sp order by 0.3 * case when hi = lo then 1 else (score - lo) / (hi - lo) end + 0.7 * cos desc, id limit 10")
def two_pass_topk(spark, d):
    return lexical.two_pass(_index(spark, d), _vectors(spark, d), WORDS).select("id", F.round("score", 6).alias("score"))


def rrf_sql(boost: bool) -> str:
    b = ", hit as (select target_id as id, 0.5 / (1 + 0.001 * (count(distinct source_id) - 1) * (count(distinct source_id) - 1)) as boost from edges where source_id in (select id from lex) group by 1)" if boost else ""
    return f"with {bm25_sql('w = q', 30)}, {VEC}, {EDGES}, v as (select id, row_number() over (order by cos desc, id) as rv from vec order by cos desc, id limit 30), l as (select id, row_number() over (order by score desc, id) as rb from lex){b} select id, round(coalesce(0.7 / (60 + rv), 0) + coalesce(0.3 / (60 + rb), 0){' + coalesce(boost, 0)' if boost else ''}, 6) as score from v full join l using (id){' left join hit using (id)' if boost else ''} order by coalesce(0.7 / (60 + rv), 0) + coalesce(0.3 / (60 + rb), 0){' + coalesce(boost, 0)' if boost else ''} desc, id limit 14"


def _hybrid(spark, d, boost):
    lex = lexical.bm25(_index(spark, d), WORDS, 30)
    vec = _vectors(spark, d).selectExpr("id", "cos as score").orderBy(F.desc("score"), "id").limit(30)
    edges = cards_doc(spark, d).selectExpr("id as source_id", f"concat('d', {padded('(doc_id * 7) % 500')}) as target_id")
    return lexical.rrf(vec, lex, lexical.graph_boost(lex, edges) if boost else None, k=14).select("id", F.round("score", 4 if boost else 6).alias("score"))


@query("rrf_hybrid", rrf_sql(False))
def rrf_hybrid(spark, d):
    return _hybrid(spark, d, False)


@query("hybrid_graph_boost", rrf_sql(True).replace(", 6) as score from v", ", 4) as score from v"))
def hybrid_graph_boost(spark, d):
    return _hybrid(spark, d, True)


TOKENS = "case when coalesce(text, '') = '' then 0 else greatest(1, (len(regexp_extract_all(text, '\\S+|\\s+')) + greatest(1, length(text) // 4)) // 2) end"


@query("token_estimate", f"select doc_id, cast({TOKENS} as bigint) as tokens from documents")
def token_estimate(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"{S.tokens('text')} as tokens")


@query("token_footprint", f"select lang, cast(sum({TOKENS}) as bigint) as tokens, count(*) as cards from documents group by lang")
def token_footprint(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.expr(f"sum({S.tokens('text')})").alias("tokens"), F.count("*").alias("cards"))


@query("lexical_boost_rerank", "select doc_id, round(least(1, 0.2 + least(0.5, 0.04 * (cast(list_contains(regexp_extract_all(lower(text), '[a-z][a-z-]*|[0-9]+(?:[.][0-9]+)?'), 'licensed') as int) + cast(list_contains(regexp_extract_all(lower(text), '[a-z][a-z-]*|[0-9]+(?:[.][0-9]+)?'), 'license') as int)) + case when regexp_matches(lower(text), '(^|[^\\w])2[.]0([^\\w]|$)') then 0.4 else 0 end) + case when len(regexp_extract_all(text, '[0-9]+(?:[.][0-9]+)?')) >= 2 then least(0.15, 0.65 - least(0.5, 0.04 * (cast(list_contains(regexp_extract_all(lower(text), '[a-z][a-z-]*|[0-9]+(?:[.][0-9]+)?'), 'licensed') as int) + cast(list_contains(regexp_extract_all(lower(text), '[a-z][a-z-]*|[0-9]+(?:[.][0-9]+)?'), 'license') as int)) + case when regexp_matches(lower(text), '(^|[^\\w])2[.]0([^\\w]|$)') then 0.4 else 0 end)) else 0 end), 6) as boosted from documents")
def lexical_boost_rerank(spark, d):
    hits = read(spark, d, "documents").selectExpr("doc_id", "text as fact", "0.2D as score")
    return lexical.lexical_boost(hits, "which licensed license 2.0").select("doc_id", F.round("boosted", 6).alias("boosted"))


@query("budget_greedy")
def budget_greedy(spark, d):
    hits = search.batch_topk(cards_vec(spark, d), cards_vec(spark, d).where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as query"), 50)
    cost = read(spark, d, "documents").selectExpr(f"concat('v', {padded('doc_id')}) as id", f"{S.tokens('text')} as cost")
    return lexical.with_budget(hits.withColumnRenamed("cos", "score").join(cost, "id"), 2000)


@query("fingerprint_dedup", "with f as (select doc_id, sha256(text || '||' || case when lang < source then lang || ',' || source else source || ',' || lang end) as fp from documents) select fp, count(*) as copies, min(doc_id) as first_id from f group by fp having count(*) > 1")
def fingerprint_dedup(spark, d):
    f = cards_doc(spark, d).withColumn("fp", F.expr(S.fingerprint("fact", "tags")))
    return f.groupBy("fp").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("dup_exact", "select min(doc_id) as first_id, count(*) as copies from documents where text is not null group by lower(text) having count(*) > 1")
def dup_exact(spark, d):
    return read(spark, d, "documents").where("text is not null").groupBy(F.sha2(F.lower("text"), 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1").select("first_id", "copies")


@query("tag_counts", "select tag, count(*) as n from (select unnest([lang, source]) as tag from documents) group by tag")
def tag_counts(spark, d):
    return cards_doc(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("cooccur_triplets", "with n as (select unnest(['the', 'und', 'para', 'dans']) as e), f as (select doc_id, e from documents, n where contains(lower(text), e)) select a.doc_id as id, a.e as subject, 'co_occurs' as predicate, b.e as object from f a join f b on a.doc_id = b.doc_id and a.e < b.e")
def cooccur_triplets(spark, d):
    return graph.cooccurrence(read(spark, d, "documents").selectExpr("doc_id as id", "text"), ["the", "und", "para", "dans"])


# ---- the stored index: batches, updates, trigrams -----------------------------------------------------------------


def _new_index(spark, kind="words", **how):
    return TermIndex(spark, f"{graph.shared_folder(spark)}/cardloom/index-{uuid.uuid4().hex}", kind, **how)


@query("bm25_appended", f"with {bm25_sql('w = q', 20)} select id, round(score, 6) as score from lex")
def bm25_appended(spark, d):
    """An index that grew by two batches, of which one came first with other texts, then was put right, against all cards at once."""
    cards, index = cards_doc(spark, d), _new_index(spark)
    index.append(cards.where("doc_id % 2 = 0"))
    index.append(cards.where("doc_id % 2 = 1").withColumn("fact", F.concat(F.lit("the "), F.coalesce("fact", F.lit("")))))
    index.upsert(cards.where("doc_id % 2 = 1"))
    return lexical.bm25(index, WORDS, 20).select("id", F.round("score", 6).alias("score"))


@query("bm25_merged", f"with {bm25_sql('w = q', 20).replace('from documents)', 'from documents where doc_id % 5 <> 3)')} select id, round(score, 6) as score from lex")
def bm25_merged(spark, d):
    """Two segments, a deletion of every fifth card, and a merge."""
    cards, index = cards_doc(spark, d), _new_index(spark)
    index.append(cards.where("doc_id % 3 = 0"))
    index.append(cards.where("doc_id % 3 <> 0"))
    index.delete(cards.where("doc_id % 5 = 3").select("id"))
    index.merge()
    return lexical.bm25(index, WORDS, 20).select("id", F.round("score", 6).alias("score"))


def _trigrams(spark, d):
    return lexical.index_of(cards_doc(spark, d), "document trigrams", kind="trigrams")


@query("substring_indexed", "select 'd' || lpad(cast(doc_id as varchar), cast(greatest(6, length(cast(doc_id as varchar))) as int), '0') as id from documents where contains(lower(text), 'licensed under')")
def substring_indexed(spark, d):
    return lookup.substring(cards_doc(spark, d), "Licensed under", index=_trigrams(spark, d)).select("id")


@query("tf_cosine_indexed", "with t as (select 'd' || lpad(cast(doc_id as varchar), cast(greatest(6, length(cast(doc_id as varchar))) as int), '0') as id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as term from documents), f as (select id, term, count(*) as tf from t group by 1, 2), s as (select id, sum(case when term = 'the' then 2 * tf when term = 'with' then tf else 0 end) as d, sqrt(sum(tf * tf)) as n from f group by id) select id, round(d / (n * sqrt(5)), 6) as score from s where d > 0 order by d / (n * sqrt(5)) desc, id limit 20")
def tf_cosine_indexed(spark, d):
    return lexical.tf_cosine(lexical.index_of(cards_doc(spark, d), "document words", kind="ascii"), "the with the", 20).select("id", F.round("score", 6).alias("score"))
