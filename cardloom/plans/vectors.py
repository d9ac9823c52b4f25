"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.operators import search, vector_codes
from cardloom.plans.registry import query
from cardloom.sources.cards import AS_OF, cards_vec, live, read

CARDS = """cards as (select 'v' || lpad(cast(vec_id as varchar), 6, '0') as id, 1704067200 + vec_id * 600.0 as timestamp, vec_id % 5 as access_count, 1704067200 + vec_id * 600.0 + (vec_id % 7) * 86400 as last_access,
 case when vec_id % 17 = 0 then 1 end as dead, 1 + (vec_id % 4) * 0.5 as stability, (vec_id % 3) / 2.0 as importance, case when vec_id % 23 = 0 then 1 else 0 end as archived, 'user_id=' || (label % 3) as scope, 'label=' || label as tag, embedding::double[] as e, vec_id, label from embeddings),
live as (select * from cards where dead is null and archived = 0), q as (select embedding::double[] as qe from embeddings where vec_id = 0)"""
COS = "least(1, greatest(0, list_dot_product(e, qe)))"
RET = f"least(1, exp(-(({AS_OF} - last_access) / 3600) / (stability * 168)))"


def first_vector(spark, sf_dir, vec_id: int = 0) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]]


def out(df, *more):
    return df.select("id", *more, F.round("score", 6).alias("score"))


@query("vec_topk", f"with {CARDS} select id, round({COS}, 6) as score from live, q order by {COS} desc, timestamp, id limit 10")
def vec_topk(spark, d):
    return out(search.vector_search(live(cards_vec(spark, d)), first_vector(spark, d), 10, alpha=1.0))


@query("vec_topk_recency", f"with {CARDS}, s as (select *, {COS} as c, {RET} as r, rank() over (order by {COS} desc) as k from live, q) select id, round(c, 6) as cos, round(0.7 * c + 0.3 * r, 6) as score from s where k <= 10 order by 0.7 * c + 0.3 * r desc, timestamp, id limit 10")
def vec_topk_recency(spark, d):
    return out(search.vector_search(live(cards_vec(spark, d)), first_vector(spark, d), 10, as_of=AS_OF, half_life_hours=168.0), F.round("cos", 6).alias("cos"))


@query("vec_topk_all_fused", f"with {CARDS} select id, round(0.7 * {COS} + 0.3 * {RET}, 6) as score from live, q order by 0.7 * {COS} + 0.3 * {RET} desc, timestamp, id limit 10")
def vec_topk_all_fused(spark, d):
    return out(search.vector_search(live(cards_vec(spark, d)), first_vector(spark, d), 10, as_of=AS_OF, half_life_hours=168.0, rerank="all"))


@query("vec_topk_scoped", f"with {CARDS} select id, scope, round({COS}, 6) as score from live, q where scope = 'user_id=1' order by {COS} desc, timestamp, id limit 10")
def vec_topk_scoped(spark, d):
    return out(search.vector_search(live(cards_vec(spark, d)), first_vector(spark, d), 10, alpha=1.0, scope="user_id=1"), "scope")


@query("vec_batch_topk", "with p as (select a.vec_id as query_id, 'v' || lpad(cast(b.vec_id as varchar), 6, '0') as id, least(1, greatest(0, list_dot_product(a.embedding::double[], b.embedding::double[]))) as c from embeddings a, embeddings b where a.vec_id % 100 = 0), r as (select *, row_number() over (partition by query_id order by c desc, id) as rank from p) select query_id, id, round(c, 6) as cos, cast(rank as int) as rank from r where rank <= 5")
def vec_batch_topk(spark, d):
    c = cards_vec(spark, d)
    return search.batch_topk(c, c.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding as query")).withColumn("cos", F.round("cos", 6))


@query("vec_prefix_topk", f"with {CARDS}, p as (select id, timestamp, list_dot_product(e[1:32], (select embedding::double[] from embeddings where vec_id = 0)[1:32]) as c from live) select id, round(least(1, greatest(0, c)), 6) as score from p order by least(1, greatest(0, c)) desc, timestamp, id limit 10")
def vec_prefix_topk(spark, d):
    """A query of 32 values against 64: the common prefix counts."""
    return out(search.vector_search(live(cards_vec(spark, d)), first_vector(spark, d)[:32], 10, alpha=1.0))


MRL = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})))".format("e[1:16]", "qe[1:16]")


@query("mrl_topk", f"with {CARDS} select id, round({MRL}, 6) as score from live, q order by {MRL} desc, id limit 10")
def mrl_topk(spark, d):
    return out(search.truncated_search(live(cards_vec(spark, d)), first_vector(spark, d), 16, 10))


INT8 = "select *, list_transform(e, lambda x: cast(round_even(x / (list_max(list_transform(e, lambda y: abs(y))) / 127), 0) as double)) as a, list_transform(qe, lambda x: cast(round_even(x / (list_max(list_transform(qe, lambda y: abs(y))) / 127), 0) as double)) as b from live, q"


@query("int8_topk", f"with {CARDS}, z as ({INT8}) select id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) as score from z order by list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) desc, id limit 10")
def int8_topk(spark, d):
    return out(search.int8_search(live(cards_vec(spark, d)), first_vector(spark, d), 10))


@query("binary_rerank", f"with {CARDS}, h as (select *, list_sum(list_transform(range(1, 65), lambda i: case when (e[i] > 0) <> (qe[i] > 0) then 1 else 0 end)) as hamming from live, q), n as (select * from h order by hamming, id limit 50) select id, cast(hamming as bigint) as hamming, round(list_dot_product(e, qe), 6) as score from n order by list_dot_product(e, qe) desc, id limit 5")
def binary_rerank(spark, d):
    return out(search.binary_rerank(live(cards_vec(spark, d)), first_vector(spark, d), 5), F.col("hamming").cast("long").alias("hamming"))


@query("auto_search", f"with {CARDS}, z as ({INT8}) select id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) as score from z order by list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) desc, id limit 5")
def auto_search(spark, d):
    return out(search.auto_search(live(cards_vec(spark, d)), first_vector(spark, d), 5))


@query("vector_health", "select 'v' || lpad(cast(vec_id as varchar), 6, '0') as id, cast(len(embedding) as bigint) as dim, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, sqrt(list_dot_product(embedding::double[], embedding::double[])) between 0.95 and 1.05 as is_normalized from embeddings")
def vector_health(spark, d):
    n = S.norm("embedding")
    return cards_vec(spark, d).selectExpr("id", "cast(size(embedding) as bigint) as dim", f"round({n}, 6) as norm", f"{n} between 0.95D and 1.05D as is_normalized")


@query("embedding_stats", "select round(avg(len(embedding)), 6) as avg_dim, count(*) as n, cast(sum(len(embedding) * 4) as bigint) as float32_bytes, cast(sum(len(embedding) + 8) as bigint) as int8_bytes from embeddings where embedding is not null")
def embedding_stats(spark, d):
    return cards_vec(spark, d).where("embedding is not null").selectExpr("round(avg(size(embedding)), 6) as avg_dim", "count(*) as n", "cast(sum(size(embedding) * 4) as bigint) as float32_bytes", "cast(sum(size(embedding) + 8) as bigint) as int8_bytes")


@query("sq8_values", "select vec_id, round(list_max(list_transform(embedding::double[], lambda x: abs(x))) / 127, 9) as scale, cast(list_sum(list_transform(embedding::double[], lambda x: round_even(x / (list_max(list_transform(embedding::double[], lambda y: abs(y))) / 127), 0))) as bigint) as total from embeddings")
def sq8_values(spark, d):
    return read(spark, d, "embeddings").selectExpr("vec_id", f"round({S.sq8_scale('embedding')}, 9) as scale", f"aggregate({S.sq8('embedding')}, 0L, (s, x) -> s + x) as total")


# ---- stored codes ------------------------------------------------------------------------------------------------


@query("int8_stored", f"with {CARDS}, z as ({INT8}) select id, round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) as score from z order by list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))) desc, id limit 10")
def int8_stored(spark, d):
    codes = vector_codes.build(live(cards_vec(spark, d)))
    return vector_codes.int8(codes, first_vector(spark, d), 10).select("id", F.round("score", 6).alias("score"))


@query("signs_stored", f"with {CARDS}, h as (select *, list_sum(list_transform(range(1, 65), lambda i: case when (e[i] > 0) <> (qe[i] > 0) then 1 else 0 end)) as hamming from live, q), n as (select *, list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)) as c from h order by hamming, id limit 50) select id, cast(hamming as bigint) as hamming, round(c, 6) as score from n order by c desc, id limit 5")
def signs_stored(spark, d):
    codes = vector_codes.build(live(cards_vec(spark, d)))
    return vector_codes.signs(codes, first_vector(spark, d), 5).select("id", F.col("hamming").cast("long").alias("hamming"), F.round("score", 6).alias("score"))


@query("nearest_by_cells", f"with {CARDS}, c as (select id, list_dot_product(e, qe) / sqrt(list_dot_product(e, e) * list_dot_product(qe, qe)) as c from live, q) select id, round(c, 6) as score from c order by c desc, id limit 10")
def nearest_by_cells(spark, d):
    codes = vector_codes.build(live(cards_vec(spark, d)), cells=16)
    return vector_codes.nearest(codes, first_vector(spark, d), 10).select("id", F.round("score", 6).alias("score"))
