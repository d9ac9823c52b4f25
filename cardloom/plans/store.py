"""Queries on the life of cards: decay, statistics, graph, consolidation, history, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardloom.functions import embed
from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.operators import graph, lifecycle, search
from cardloom.plans.registry import query
from cardloom.streaming import state
from cardloom.plans.vectors import CARDS
from cardloom.sources import io
from cardloom.sources.cards import AS_OF, cards_user, cards_vec, live, padded, read

USERS = "u as (select user_id, count(*) as access_count, min(epoch_us(ts)) / 1000000.0 as timestamp, max(epoch_us(ts)) / 1000000.0 as last_access, arg_max(event_type, (epoch_us(ts), event_id)) as last_type from events group by user_id)"
NOW = f"{AS_OF!r}"


@query("touch_log", f"with {USERS} select user_id, access_count, round(timestamp, 3) as timestamp, round(last_access, 3) as last_access, last_type from u")
def touch_log(spark, d):
    return cards_user(spark, d).select("user_id", "access_count", F.round("timestamp", 3).alias("timestamp"), F.round("last_access", 3).alias("last_access"), "last_type")


@query("retention", f"with {USERS} select user_id, round(least(1, greatest(0, exp(-(({NOW} - last_access) / 3600) / 168))), 6) as retention from u")
def retention(spark, d):
    return cards_user(spark, d).selectExpr("user_id", f"round({S.retention('last_access', NOW + 'D', '1D', 168.0)}, 6) as retention")


@query("vitality", f"with {USERS} select user_id, round(0.7 * exp(-(ln(2) / 2592000) * greatest(0, {NOW} - last_access)) + 0.3 * ln(1 + access_count), 6) as vitality from u")
def vitality(spark, d):
    return cards_user(spark, d).selectExpr("user_id", f"round({S.vitality('last_access', 'timestamp', 'access_count', NOW + 'D')}, 6) as vitality")


@query("stability_fold", "select vec_id, round(case vec_id % 5 when 0 then s when 1 then least(10, s * b1) when 2 then least(10, least(10, s * b1) * b2) when 3 then least(10, least(10, least(10, s * b1) * b2) * b3) else least(10, least(10, least(10, least(10, s * b1) * b2) * b3) * b4) end, 6) as stability from (select vec_id, 1 + (vec_id % 4) * 0.5 as s, 1 + 0.5 * ln(2) + 0.3 * i as b1, 1 + 0.5 * ln(3) + 0.3 * i as b2, 1 + 0.5 * ln(4) + 0.3 * i as b3, 1 + 0.5 * ln(5) + 0.3 * i as b4 from (select vec_id, (vec_id % 3) / 2.0 as i from embeddings))")
def stability_fold(spark, d):
    return cards_vec(spark, d).selectExpr("vec_id", f"round({S.stability_fold('stability', '0', 'importance', 'vec_id % 5')}, 6) as stability")


@query("fold_touches", f"with {USERS} select user_id, access_count, round(last_access, 3) as last_access from u")
def fold_touches(spark, d):
    log = read(spark, d, "events").selectExpr("cast(user_id as string) as id", "unix_micros(cast(ts as timestamp)) / 1000000D as at")
    blank = log.select("id").distinct().selectExpr("id", "0L as access_count", "0D as last_access", "1D as stability", "0D as importance")
    return lifecycle.fold_touches(blank, log).selectExpr("cast(id as bigint) as user_id", "access_count", "round(last_access, 3) as last_access")


@query("vitality_histogram", f"with {USERS}, v as (select least(1, exp(-(({NOW} - last_access) / 3600) / 168)) as v from u) select case when v >= 0.66 then 'high' when v >= 0.33 then 'mid' else 'low' end as bucket, count(*) as n from v group by 1")
def vitality_histogram(spark, d):
    v = cards_user(spark, d).selectExpr(f"{S.retention('last_access', NOW + 'D', '1D', 168.0)} as v")
    return v.groupBy(F.expr("case when v >= 0.66 then 'high' when v >= 0.33 then 'mid' else 'low' end").alias("bucket")).agg(F.count("*").alias("n"))


AGE = "case when {0} < 3600 then '<1h' when {0} < 86400 then '<1d' when {0} < 604800 then '<7d' when {0} < 2592000 then '<30d' else '>30d' end"


@query("age_buckets", f"select {AGE.format(f'greatest(0, {NOW} - epoch_us(ts) / 1000000.0)')} as bucket, count(*) as n from events group by 1")
def age_buckets(spark, d):
    a = f"greatest(0D, {NOW}D - unix_micros(cast(ts as timestamp)) / 1000000D)"
    return read(spark, d, "events").groupBy(F.expr(AGE.format(a)).alias("bucket")).agg(F.count("*").alias("n"))


@query("turnover_stats", f"with {CARDS} select count(*) as total, count(*) filter (where dead is null) as active, count(dead) as superseded, round(count(dead) / count(*), 6) as ratio, round(avg(access_count), 6) as mean_access, count(*) filter (where access_count = 0) as never_accessed, round(count(*) / ((max(timestamp) - min(timestamp)) / 86400), 6) as cards_per_day from cards")
def turnover_stats(spark, d):
    return cards_vec(spark, d).selectExpr("count(*) as total", "count_if(superseded_by is null) as active", "count(superseded_by) as superseded", "round(count(superseded_by) / count(*), 6) as ratio", "round(avg(access_count), 6) as mean_access", "count_if(access_count = 0) as never_accessed", "round(count(*) / ((max(timestamp) - min(timestamp)) / 86400), 6) as cards_per_day")


@query("top_accessed", f"with {USERS} select user_id, access_count from u order by access_count desc nulls last, user_id limit 5")
def top_accessed(spark, d):
    return cards_user(spark, d).select("user_id", "access_count").orderBy(F.desc_nulls_last("access_count"), "user_id").limit(5)


@query("recent_cards", f"with {CARDS} select id, timestamp from live order by timestamp desc, id limit 5")
def recent_cards(spark, d):
    return live(cards_vec(spark, d)).select("id", "timestamp").orderBy(F.desc("timestamp"), "id").limit(5)


@query("live_cards", f"with {CARDS} select id, scope, tag from live")
def live_cards(spark, d):
    return live(cards_vec(spark, d)).selectExpr("id", "scope", "tags[0] as tag")


@query("decay_candidates", f"with {CARDS} select id, round(0.7 * exp(-(ln(2) / 2592000) * greatest(0, {NOW} - last_access)) + 0.3 * ln(1 + access_count), 6) as vitality from live order by 0.7 * exp(-(ln(2) / 2592000) * greatest(0, {NOW} - last_access)) + 0.3 * ln(1 + access_count), timestamp, id limit 10")
def decay_candidates(spark, d):
    return live(cards_vec(spark, d)).withColumn("v", F.expr(S.vitality("last_access", "timestamp", "access_count", NOW + "D"))).orderBy("v", "timestamp", "id").limit(10).select("id", F.round("v", 6).alias("vitality"))


@query("latency_percentiles", "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.99), 6) as p99, round(quantile_disc(value, 0.95), 6) as p95_nearest from events group by event_type")
def latency_percentiles(spark, d):
    return read(spark, d, "events").groupBy("event_type").agg(F.expr("round(percentile(value, 0.5), 6) as p50"), F.expr("round(percentile(value, 0.9), 6) as p90"), F.expr("round(percentile(value, 0.99), 6) as p99"), F.expr("round(percentile_disc(0.95) within group (order by value), 6) as p95_nearest"))


SIM = "sim as (select 'v' || lpad(cast(a.vec_id as varchar), 6, '0') as a, 'v' || lpad(cast(b.vec_id as varchar), 6, '0') as b, list_dot_product(a.embedding::double[], b.embedding::double[]) as cos, a.vec_id as av, b.vec_id as bv from embeddings a join embeddings b on a.vec_id < b.vec_id where list_dot_product(a.embedding::double[], b.embedding::double[]) > 0.35)"
BOTH = "e2 as (select a, b from sim union select b, a from sim)"
REACH = "reach as (select a as id, a as m from e2 union select reach.id, e2.b from reach join e2 on e2.a = reach.m)"


def edges(spark, d, threshold=0.35):
    return graph.semantic_edges(cards_vec(spark, d), threshold)


def nodes(spark, d, threshold=0.35):
    return search.similar_nodes(cards_vec(spark, d), threshold)


@query("edges_semantic", f"with {SIM} select a as source_id, b as target_id, 'semantic' as relation_type, round(cos, 6) as weight from sim")
def edges_semantic(spark, d):
    return edges(spark, d).withColumn("weight", F.round("weight", 6))


@query("edges_shared_tag", "with t as (select s_suppkey as k, unnest(list_distinct(['n' || s_nationkey, 'b' || cast(floor(s_acctbal / 1000) as int)])) as tag from supplier), p as (select a.k as x, b.k as y, count(*) as n from t a join t b on a.tag = b.tag and lpad(cast(a.k as varchar), 6, '0') < lpad(cast(b.k as varchar), 6, '0') group by 1, 2) select lpad(cast(x as varchar), 6, '0') as source_id, lpad(cast(y as varchar), 6, '0') as target_id, 'shared_tag' as relation_type, round(n / (4 - n), 6) as weight from p")
def edges_shared_tag(spark, d):
    s = read(spark, d, "supplier").selectExpr(f"{padded('s_suppkey')} as id", "array(concat('n', s_nationkey), concat('b', cast(floor(s_acctbal / 1000) as int))) as tags")
    return graph.shared_tag_edges(s).withColumn("weight", F.round("weight", 6))


@query("neighbors", f"with {SIM} select a as source_id, b as target_id, round(cos, 6) as weight from sim where a = 'v000010' order by cos desc, b")
def neighbors(spark, d):
    return graph.neighbours_of(cards_vec(spark, d), "v000010", 0.35).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


@query("compound_weight", f"with {SIM} select a as source_id, round(sum(cos), 6) as compound_weight from sim group by a")
def compound_weight(spark, d):
    return graph.node_weights(nodes(spark, d)).withColumn("compound_weight", F.round("compound_weight", 6))


@query("graph_density", f"with {SIM} select 'v' || lpad(cast(vec_id as varchar), 6, '0') as id, round(coalesce(m, 0), 6) as density from embeddings left join (select av, avg(cos) as m from sim group by av) on av = vec_id")
def graph_density(spark, d):
    c = cards_vec(spark, d)
    return graph.node_density(c, nodes(spark, d)).withColumn("density", F.round("density", 6))


@query("graph_stats", f"with {SIM} select count(*) as edges, round(avg(cos), 4) as avg_weight, round(max(cos), 6) as max_weight, round(min(cos), 6) as min_weight, (select count(*) from (select a from sim union select b from sim)) as nodes from sim")
def graph_stats(spark, d):
    return graph.node_stats(nodes(spark, d)).withColumns({"max_weight": F.round("max_weight", 6), "min_weight": F.round("min_weight", 6)})


@query("clusters", f"with recursive {SIM}, {BOTH}, {REACH}, c as (select id, min(m) as cluster from reach group by id) select id, cluster, count(*) over (partition by cluster) as size from c qualify count(*) over (partition by cluster) >= 3")
def clusters(spark, d):
    return graph.clusters(graph.node_links(nodes(spark, d)), 3, 0.0)


@query("multi_hop", f"with {SIM}, {BOTH}, h1 as (select distinct b as id from e2 where a = 'v000010'), h2 as (select distinct b as id from e2 where a in (select id from h1)) select id, 1 as hop from h1 union all select id, 2 from h2 where id not in (select id from h1) and id <> 'v000010'")
def multi_hop(spark, d):
    return graph.near_hops(cards_vec(spark, d), ["v000010"], threshold=0.35)


@query("prune_edges", "select event_id, user_id from events where epoch_us(ts) / 1000000.0 >= 1706659200 - 604800")
def prune_edges(spark, d):
    e = read(spark, d, "events").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) / 1000000D as created_at")
    return graph.prune_edges(e, AS_OF).select("event_id", "user_id")


@query("upsert_edges", "select cast(l_suppkey as varchar) as source_id, cast(l_partkey as varchar) as target_id, 'supplies' as relation_type, round(least(1, max(l_discount * 12)), 6) as weight, max(l_quantity) as created_at from lineitem group by 1, 2")
def upsert_edges(spark, d):
    e = read(spark, d, "lineitem").selectExpr("cast(l_suppkey as string) as source_id", "cast(l_partkey as string) as target_id", "'supplies' as relation_type", "l_discount * 12 as weight", "l_quantity as created_at", "l_linenumber")
    return graph.upsert_edges(e.where("l_linenumber = 1").drop("l_linenumber"), e.where("l_linenumber <> 1").drop("l_linenumber")).withColumn("weight", F.round("weight", 6))


PAIRS = "with w as (select doc_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) as ws from documents where text is not null), t as (select doc_id, len(ws) as n, unnest(ws) as x from w), p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as i from t a join t b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2), pairs as (select a, b from p where i >= 0.7 * (na + nb - i))"


def _cards(spark, d):
    return read(spark, d, "documents").selectExpr(f"{padded('doc_id')} as id", "text as fact", "'' as evidence", "array(lang, source) as tags", "1704067200D + doc_id * 60 as timestamp", "0D as last_access", "doc_id % 4 as access_count", "'default' as scope", "doc_id")


@query("dup_jaccard", PAIRS + " select lpad(cast(a as varchar), 6, '0') as a, lpad(cast(b as varchar), 6, '0') as b from pairs")
def dup_jaccard(spark, d):
    return lifecycle.duplicate_pairs(_cards(spark, d))


@query("merge_clusters", PAIRS.replace("with w", "with recursive w", 1) + ", e2 as (select a, b from pairs union select b, a from pairs), reach as (select a as id, a as m from e2 union select reach.id, e2.b from reach join e2 on e2.a = reach.m), c as (select id, min(m) as cluster from reach group by id) select case when count(distinct lower(trim(text))) = 1 then lpad(cast(min(id) as varchar), 6, '0') else lpad(cast(max(id) as varchar), 6, '0') end as id, count(*) as merged, cast(sum(id % 4) as bigint) as access_count from c join documents on doc_id = id group by cluster")
def merge_clusters(spark, d):
    c = _cards(spark, d)
    return lifecycle.merge_clusters(c, lifecycle.duplicate_links(c)).select("id", "merged", "access_count")


@query("dup_cosine", f"with {SIM.replace('0.35', '0.4')} select a, b, round(cos, 6) as cos from sim")
def dup_cosine(spark, d):
    return edges(spark, d, 0.4).selectExpr("source_id as a", "target_id as b", "round(weight, 6) as cos")


def each_customer(spark, d, values: str, columns: str):
    """One row for each customer: the statements of `values` (numbered in the column k) in turn, over as many rows as the table has."""
    said = spark.sql(f"select * from ({values}) as t(k, {columns})")
    return read(spark, d, "customer").withColumn("k", F.expr(f"cast(c_custkey % {values.count('(')} as int)")).join(F.broadcast(said), "k")


def each_sql(values: str, columns: str) -> str:
    return f"(select * from customer join ({values}) as t(k, {columns}) on k = c_custkey % {values.count('(')})"


NEG = "values (0, 'User uses Mac', 'User does not use Mac'), (1, 'She likes tea', 'She never likes tea'), (2, 'It runs on Linux', 'It runs on Windows'), (3, 'He works here', 'He works here'), (4, 'The build is not fast', 'The build is fast'), (5, 'They lack time', 'Birds sing without rest')"


@query("negation_pairs", f"select c_custkey, a, b, a in ('User uses Mac', 'She likes tea', 'The build is not fast') as opposite from {each_sql(NEG, 'a, b')}")
def negation_pairs(spark, d):
    return each_customer(spark, d, NEG, "a, b").select("c_custkey", "a", "b", F.expr(X.are_negations("a", "b")).alias("opposite"))


@query("prune_plan", f"with {CARDS}, {SIM} select id from cards where {NOW} - timestamp >= 3600 and access_count = 0 and exp(-(({NOW} - last_access) / 3600) / 24) < 0.15 and vec_id not in (select av from sim)")
def prune_plan(spark, d):
    return lifecycle.prune_plan(cards_vec(spark, d), graph.compound_weight(edges(spark, d)), AS_OF).select("id")


@query("prune_plan_vitality", f"with {CARDS} select id from cards where {NOW} - timestamp >= 3600 and access_count = 0 and 0.7 * exp(-(ln(2) / 2592000) * greatest(0, {NOW} - last_access)) < 0.4")
def prune_plan_vitality(spark, d):
    none = spark.createDataFrame([], "source_id string, compound_weight double")
    return lifecycle.prune_plan(cards_vec(spark, d), none, AS_OF, floor=0.4, rule="vitality").select("id")


@query("consolidation_report", PAIRS.replace("with w", "with recursive w", 1) + ", e2 as (select a, b from pairs union select b, a from pairs), reach as (select a as id, a as m from e2 union select reach.id, e2.b from reach join e2 on e2.a = reach.m), c as (select id, min(m) as cluster from reach group by id) select (select count(*) from documents) as cards_before, (select count(*) from documents) - count(*) + count(distinct cluster) as cards_after, count(distinct cluster) as clusters from c")
def consolidation_report(spark, d):
    c = _cards(spark, d)
    merged = lifecycle.merge_clusters(c, lifecycle.duplicate_links(c)).agg(F.coalesce(F.sum("merged"), F.lit(0)).alias("m"), F.count("*").alias("clusters"))
    return merged.withColumn("cards_before", c.agg(F.count("*").alias("n")).scalar()).selectExpr("cards_before", "cards_before - m + clusters as cards_after", "clusters")


@query("new_only", "with f as (select *, row_number() over (partition by text, lang, source order by doc_id) as rn from documents), h as (select distinct text, lang, source from documents where doc_id < 100) select f.doc_id from f left join h on f.text = h.text and f.lang = h.lang and f.source = h.source where f.doc_id >= 100 and h.text is null and not exists (select 1 from documents o where o.doc_id >= 100 and o.doc_id < f.doc_id and o.text = f.text and o.lang = f.lang and o.source = f.source)")
def new_only(spark, d):
    c = _cards(spark, d)
    return lifecycle.new_only(c.where("doc_id >= 100"), c.where("doc_id < 100")).select("doc_id")


SCOPES = "values (0, 'user_id=1', 'user_id=1&agent_id=2'), (1, 'user_id=1', 'user_id=2'), (2, '', 'user_id=2'), (3, 'user_id=1', ''), (4, 'agent_id=2&user_id=1', 'user_id=1'), (5, 'user_id=1&agent_id=2', 'run_id=7&agent_id=2&user_id=1')"


@query("scope_match", f"select c_custkey, q, c, (q, c) not in (('user_id=1', 'user_id=2'), ('agent_id=2&user_id=1', 'user_id=1')) as visible from {each_sql(SCOPES, 'q, c')}")
def scope_match(spark, d):
    t = each_customer(spark, d, SCOPES, "q, c").withColumns({"qm": F.expr(S.scope_parse("q")), "cm": F.expr(S.scope_parse("c"))})
    return t.select("c_custkey", "q", "c", F.expr(S.scope_visible("qm", "cm")).alias("visible"))


@query("scope_canonical", "select o_orderkey, 'agent_id=' || (o_orderkey % 7) || '&user_id=' || o_custkey as scope from orders")
def scope_canonical(spark, d):
    return read(spark, d, "orders").selectExpr("o_orderkey", f"{S.scope_build(chr(109) + 'ap(' + repr('user_id') + ', cast(o_custkey as string), ' + repr('agent_id') + ', cast(o_orderkey % 7 as string), ' + repr('run_id') + ', ' + repr('') + ')')} as scope")


@query("ttl_expired", f"select event_id from events where epoch_us(ts) / 1000000.0 + (event_id % 20) * 86400 < {NOW}")
def ttl_expired(spark, d):
    c = read(spark, d, "events").selectExpr("event_id", "unix_micros(cast(ts as timestamp)) / 1000000D as timestamp", "array(event_type, concat('ttl:', (event_id % 20) * 86400)) as tags")
    return c.join(lifecycle.unexpired(c, AS_OF).select("event_id"), "event_id", "left_anti").select("event_id")


@query("latest_wins", "select o_custkey as id, arg_max(o_orderkey, o_orderkey) as last_order, arg_max(o_orderstatus, o_orderkey) as status from orders group by 1 having arg_max(o_orderstatus, o_orderkey) <> 'F'")
def latest_wins(spark, d):
    log = read(spark, d, "orders").selectExpr("o_orderkey as seq", "if(o_orderstatus = 'F', 'delete', 'put') as op", "o_custkey as id", "o_orderstatus as status")
    return lifecycle.latest(log).selectExpr("id", "seq as last_order", "status")


@query("history_versions", "select o_custkey as card_id, o_orderkey, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as int) as version from orders")
def history_versions(spark, d):
    log = read(spark, d, "orders").selectExpr("o_custkey as card_id", "o_orderkey", "o_orderdate as seen_at")
    return lifecycle.versions(log).select("card_id", "o_orderkey", "version")


@query("rollback_state", "select o_custkey as card_id, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) where rn = 2")
def rollback_state(spark, d):
    log = read(spark, d, "orders").selectExpr("o_custkey as card_id", "o_orderkey", "o_orderdate as seen_at")
    return lifecycle.rollback(log, "previous").select("card_id", "o_orderkey")


@query("snapshot_diff", "select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'deleted' else 'modified' end as change from (select * from orders where o_orderkey % 10 <> 0) a full join (select o_orderkey, case when o_orderkey % 7 = 0 then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderkey % 11 <> 0) b on a.o_orderkey = b.o_orderkey where a.o_orderkey is null or b.o_orderkey is null or a.o_orderstatus <> b.o_orderstatus")
def snapshot_diff(spark, d):
    o = read(spark, d, "orders")
    new = o.where("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.expr("if(o_orderkey % 7 = 0, 'X', o_orderstatus)"))
    return lifecycle.snapshot_diff(o.where("o_orderkey % 10 <> 0"), new, "o_orderkey", ["o_orderstatus"])


@query("dangling_some", "select vec_id, 'v' || (vec_id * 2) as superseded_by from embeddings where vec_id * 2 not in (select vec_id from embeddings)")
def dangling_some(spark, d):
    """Each card points at the one of twice its number: the upper half at none."""
    c = read(spark, d, "embeddings").selectExpr("concat('v', vec_id) as id", "vec_id", "concat('v', vec_id * 2) as superseded_by")
    return lifecycle.dangling(c).select("vec_id", "superseded_by")


@query("watch_changes", "with l as (select user_id, event_id, ts, case when event_type < 'd' then event_type end as into_, props from events), w as (select *, row_number() over (partition by user_id order by event_id) as n, lag(into_) over (partition by user_id order by event_id) as was from l) select user_id as id, event_id as seq, case when n > 1 then 'superseded' when into_ is null then 'new' else 'audit' end as kind, left(props, 60) as fact, into_ as superseded_by from w where n = 1 or into_ is distinct from was")
def watch_changes(spark, d):
    """Each event is a new state of its user's card; the stream's form is tested against this one."""
    log = read(spark, d, "events").selectExpr("cast(user_id as string) as id", "event_id as seq", "cast(ts as timestamp) as at", "props as fact", "if(event_type < 'd', event_type, null) as superseded_by")
    return state.changes(log).selectExpr("cast(id as bigint) as id", "seq", "kind", "fact", "superseded_by")


@query("dangling_refs", f"with {CARDS} select id, 'v' || lpad(cast(vec_id + 1 as varchar), 6, '0') as superseded_by from cards where dead = 1 and vec_id + 1 not in (select vec_id from embeddings)")
def dangling_refs(spark, d):
    return lifecycle.dangling(cards_vec(spark, d)).select("id", "superseded_by")


SAYINGS = "values (0, 'Forget my old address'), (1, 'Actually I switched to Rust'), (2, 'My name is Ada and I like tea'), (3, 'It was red and now blue'), (4, 'scratch that'), (5, 'hello there'), (6, ''), (7, 'I use Emacs. I live in Oslo.')"


@query("triage_classify", f"select c_custkey, case when k in (0, 4) then 'DELETE' when k in (1, 3) then 'UPDATE' else 'ADD' end as action, case k when 0 then 0.65 when 1 then 0.71 when 2 then 0.71 when 3 then 0.7 when 4 then 0.72 when 5 then 0.62 when 6 then 0 else 0.71 end as confidence, k in (3, 4, 5) as escalated from {each_sql(SAYINGS, 'text')}")
def triage_classify(spark, d):
    return lifecycle.classify(each_customer(spark, d, SAYINGS, "text")).select("c_custkey", "action", F.round("confidence", 6).alias("confidence"), "escalated")


@query("triage_conversations", "with t as (select conv_id, turn, lower(text) as l from conversations where role = 'user') select conv_id, turn, len(list_filter(['forget', 'remove', 'delete', 'stop remembering', 'clear my', 'ignore that i said'], lambda p: contains(l, p))) > 0 as asks_delete from t")
def triage_conversations(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.expr(f"{X.hits('text', X.DELETES)} > 0").alias("asks_delete"))


@query("extract_tags", f"select c_custkey, case k when 2 then 'name,preference' when 7 then 'language,tool,location' else '' end as tags from {each_sql(SAYINGS, 'text')}")
def extract_tags(spark, d):
    return each_customer(spark, d, SAYINGS, "text").select("c_custkey", F.expr(f"array_join({X.tags('text')}, ',')").alias("tags"))


@query("extract_fact", f"select c_custkey, case k when 1 then 'I switched to Rust' when 7 then 'I use Emacs. I live in Oslo' else text end as fact from {each_sql(SAYINGS, 'text')}")
def extract_fact(spark, d):
    return each_customer(spark, d, SAYINGS, "text").select("c_custkey", F.expr(X.fact("text")).alias("fact"))


QUESTIONS = "values (0, 'what is my name?'), (1, 'tell me a story'), (2, 'current project status'), (3, 'who am i'), (4, 'nothing special here')"


@query("route_structured", f"select c_custkey, k in (0, 2, 3) as structured from {each_sql(QUESTIONS, 'text')}")
def route_structured(spark, d):
    return each_customer(spark, d, QUESTIONS, "text").select("c_custkey", F.expr(X.structured("text")).alias("structured"))


@query("content_words", "select doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9_]+')), lambda w: not list_contains([" + ", ".join(repr(w) for w in X.STOPWORDS) + "], w))) as n_words from documents")
def content_words(spark, d):
    return read(spark, d, "documents").selectExpr("doc_id", f"cast(size({X.content_words('text')}) as bigint) as n_words")


@query("evidence_merge", "select c_mktsegment, count(*) as n, (select string_agg(x, ' | ' order by x) from (select distinct n_name as x from nation order by x limit 3)) as evidence from customer group by 1")
def evidence_merge(spark, d):
    names = read(spark, d, "nation").agg(F.sort_array(F.collect_list("n_name")).alias("ns")).selectExpr(f"{S.merge_evidence('ns')} as evidence")
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("evidence", names.scalar())


@query("tags_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, 0 as tags from events")
def tags_json(spark, d):
    """Properties are objects, so the tolerant reader of tag lists gives an empty list."""
    return read(spark, d, "events").selectExpr("event_id", "cast(get_json_object(props, '$.k') as bigint) as k", f"size({io.parse_tags('props')}) as tags")


@query("export_csv", f"with {CARDS} select id, tag as tags, printf('%.6f', sqrt(list_dot_product(e, e))) as vector_norm from cards")
def export_csv(spark, d):
    return io.csv_frame(cards_vec(spark, d)).select("id", "tags", "vector_norm")


@query("upsert_rows", "select c_custkey, case when c_custkey % 3 = 0 then upper(c_mktsegment) || '!' else c_mktsegment end as fact from customer")
def upsert_rows(spark, d):
    c = read(spark, d, "customer").selectExpr("cast(c_custkey as string) as id", "c_mktsegment as fact", "0D as timestamp")
    new = c.where("cast(id as bigint) % 3 = 0").selectExpr("id", "concat(upper(fact), '!') as fact", "1D as timestamp")
    return io.upsert(c, new).selectExpr("cast(id as bigint) as c_custkey", "fact")


@query("hash_embed")
def hash_embed(spark, d):
    return read(spark, d, "documents").select("doc_id", embed.hash_embed("text").alias("embedding"))


@query("blob_roundtrip", "select vec_id, true as same from embeddings")
def blob_roundtrip(spark, d):
    e = read(spark, d, "embeddings")
    return e.select("vec_id", (io.unpack_float32(io.pack_float32("embedding")) == F.col("embedding")).alias("same"))


REPLIES = """values (0, '["a", "b"]'), (1, '```json\\n{"facts": ["c"]}\\n```'), (2, '- d\\n- e'), (3, 'no list')"""


@query("parse_llm_json", f"select c_custkey, case k when 0 then 'a,b' when 1 then 'c' when 2 then 'd,e' else '' end as facts, 'ADD' as action from {each_sql(REPLIES, 'reply')}")
def parse_llm_json(spark, d):
    return each_customer(spark, d, REPLIES, "reply").select("c_custkey", F.array_join(embed.parse_facts("reply"), ",").alias("facts"), embed.parse_action("reply").alias("action"))


@query("resolve_entity", "select n_name, case n_name when 'FRANCE' then 'France' when 'UNITED KINGDOM' then 'UNITED KINGDOMS' else n_name end as entity from nation")
def resolve_entity(spark, d):
    return read(spark, d, "nation").select("n_name", embed.resolver(["France", "GERMANY", "UNITED KINGDOMS"])("n_name").alias("entity"))
