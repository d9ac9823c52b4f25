"""Consolidation and mutations: what a sweep would do and did, cluster merges, deletions, archive, events, dispatch.

A mutation takes tables and gives the tables after it; nothing is changed in place. A plan is computed from one
snapshot and applied at once (apply_plan), so that a sweep is all or nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.operators import graph, lifecycle, lookup, patterns, search
from cardloom.sources.cards import EDGE_SCHEMA, SCHEMA, live
from cardloom.sources.versions import Versions

TOUCH_SCHEMA = "id string, at double"

COSINE = 0.84
TOKENS = f"{S.tokens('fact')} + {S.tokens('evidence')}"


# ---- duplicates and merges ---------------------------------------------------------------------------------------


def duplicates(cards: DataFrame, floor: float = 0.7, threshold: float = COSINE, linked: bool = False) -> DataFrame:
    """(a, b): equal but for case, of a word Jaccard of floor or a cosine over threshold, and not negations of each other. With linked, copies of a fact have a link to the first of them only: the same components."""
    by_words = lifecycle.duplicate_links(cards, floor) if linked else lifecycle.duplicate_pairs(cards, floor)
    if "embedding" not in cards.columns:
        return by_words
    near = search.similar_pairs(cards, threshold).select("a", "b")
    facts = cards.select("id", "fact")
    said = graph.stored(near.join(facts.selectExpr("id as a", "fact as fa"), "a").join(facts.selectExpr("id as b", "fact as fb"), "b"))
    return by_words.union(said.where(f"not {X.are_negations('fa', 'fb')}").select("a", "b")).distinct()


def fold(rows: DataFrame, top: str, fact: str, most_evidence: int) -> DataFrame:
    """One row for each cluster of two cards or more of rows (cards with cluster): cluster, the survivor's id and time, merged fact, tags, evidence, accesses; and folded, the other ids.

    top: SQL that aggregates the survivor as struct(timestamp, id, fact, evidence). fact: SQL over it and `facts`, the first distinct facts. Clusters
    are aggregated; only distinct tags and the first few texts meet in a row. `folded` does hold all ids, and is made
    only where it is asked for; folded_into() has them as rows.
    """
    more = [c for c in ("stability", "importance") if c in rows.columns]
    agg = rows.groupBy("cluster").agg(F.expr(top).alias("top"), F.count("*").alias("n"), F.sum("access_count").alias("access_count"), F.max("last_access").alias("last_access"), *[F.max(c).alias(c) for c in more], F.sort_array(F.collect_list(F.struct("timestamp", "id"))).alias("members"))
    # 200 characters of joined facts are at most so many facts
    facts = lifecycle.cluster_texts(rows, "fact", 202).withColumnRenamed("texts", "facts")
    evidence = lifecycle.cluster_texts(rows.where("trim(evidence) <> ''"), "evidence", most_evidence + 1)
    both = agg.where("n > 1").join(lifecycle.cluster_tags(rows), "cluster", "left").join(evidence, "cluster", "left")
    if "facts" in fact:
        both = both.join(facts, "cluster", "left")
    none = "cast(array() as array<string>)"
    merged = S.merge_evidence(f"concat(array(coalesce(top.evidence, '')), coalesce(texts, {none}))", most_evidence)
    return both.selectExpr("cluster", "top.id as id", f"{fact} as fact", f"{merged} as evidence", "top.timestamp as timestamp", f"coalesce(tags, {none}) as tags", "access_count", "last_access", *more, "transform(filter(members, m -> m.id <> top.id), m -> m.id) as folded")


def folded_into(members: DataFrame, merged: DataFrame) -> DataFrame:
    """(id, superseded_by) for the members (id, cluster) of merged clusters, but their survivors."""
    return members.join(merged.select("cluster", F.col("id").alias("superseded_by")), "cluster").where("id <> superseded_by").select("id", "superseded_by")


def merge_members(cards: DataFrame, comp: DataFrame) -> DataFrame:
    """Clusters of near copies (id, cluster) folded: into the earliest card if all facts are equal but for case, else into the newest."""
    one, said = "struct(timestamp, id, fact, evidence)", "lower(trim(fact))"
    same = f"(count(fact) = 0 or count(fact) = count(*) and min({said}) = max({said}))"
    top = f"if({same}, min_by({one}, struct(timestamp, id)), max_by({one}, struct(timestamp, id)))"
    return fold(cards.join(comp, "id"), top, "top.fact", 3)


def merge_duplicates(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """merge_members() of the components of pairs (a, b)."""
    return merge_members(cards, graph.components(pairs.selectExpr("a as source_id", "b as target_id")))


def merge_graph_clusters(cards: DataFrame, members: DataFrame, weights: DataFrame) -> DataFrame:
    """Clusters (id, cluster) folded into their hub: the largest compound weight, then accesses, time, id. Facts are joined, 200 characters at most."""
    weighted = members.join(weights.selectExpr("source_id as id", "compound_weight"), "id", "left").selectExpr("id", "cluster", "coalesce(compound_weight, 0D) as weight")
    hub = "max_by(struct(timestamp, id, fact, evidence), struct(weight, access_count, timestamp, id))"
    return fold(cards.join(weighted, "id"), hub, S.merge_facts("array_distinct(concat(array(trim(top.fact)), coalesce(facts, cast(array() as array<string>))))"), 2)


# ---- the sweep ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    survivors: DataFrame  # merged cards: id, fact, evidence, tags, access_count, last_access
    superseded: DataFrame  # id, superseded_by
    pruned: DataFrame  # id, value: retention or vitality
    report: DataFrame  # one row


def _scored(cards: DataFrame, survivors: DataFrame) -> DataFrame:
    """cards with the merged accesses of those that are survivors."""
    s = survivors.selectExpr("id", "access_count as n", "last_access as at")
    return cards.join(s, "id", "left").withColumns({"access_count": F.expr("coalesce(n, access_count)"), "last_access": F.expr("coalesce(at, last_access)")}).drop("n", "at")


def plan_sweep(cards: DataFrame, edges: DataFrame, now: float, rule: str = "retention", floor: float | None = None, with_graph: bool = True, cosine: bool = True, cluster_weight: float = 0.8) -> Plan:
    """What a sweep of the live cards does: duplicates folded, cold cards pruned, tight clusters of the graph merged.

    rule="vitality" and with_graph=False is the dry run: it judges by vitality and leaves the graph alone.
    """
    alive = graph.stored(live(cards))
    some = alive if cosine else alive.drop("embedding")
    comp = graph.components(duplicates(some, linked=True).selectExpr("a as source_id", "b as target_id"))
    merged = graph.stored(merge_members(alive, comp).drop("folded"))
    gone = folded_into(comp, merged)
    left = _scored(alive, merged).join(gone.select("id"), "id", "left_anti")
    weights = graph.compound_weight(edges)
    none = weights.limit(0)
    pruned = lifecycle.prune_plan(left, weights if rule == "retention" else none, now, floor if floor is not None else 0.15 if rule == "retention" else 0.05, rule)
    last = "if(last_access = 0, timestamp, last_access)"
    value = S.retention(last, f"{now!r}D", "1D", 24.0) if rule == "retention" else S.vitality("last_access", "timestamp", "access_count", f"{now!r}D")
    pruned = graph.stored(pruned.selectExpr("id", f"{value} as value"))
    keep = ["id", "fact", "evidence", "tags", "access_count", "last_access"]
    survivors = merged.select(*keep)
    if with_graph:
        tight = graph.clusters(edges, 3, cluster_weight).select("id", "cluster").join(gone.select("id"), "id", "left_anti").join(pruned.select("id"), "id", "left_anti").join(alive.select("id"), "id", "left_semi")
        big = tight.groupBy("cluster").agg(F.count("*").alias("size")).where("size >= 3")
        tied = graph.stored(tight.join(big.select("cluster"), "cluster", "left_semi").select("id", "cluster"))
        hubs = graph.stored(merge_graph_clusters(alive, tied, weights).drop("folded"))
        gone = gone.union(folded_into(tied, hubs))
        # a card that survived both takes the graph's form
        survivors = hubs.select(*keep).union(survivors.join(hubs.select("id"), "id", "left_anti"))
    gone, survivors = graph.stored(gone), graph.stored(survivors)
    before = alive.agg(F.expr(f"coalesce(sum({TOKENS}), 0L)").alias("tokens_before"), F.count("*").alias("cards_before"))
    after = after_sweep(alive, survivors, gone, pruned)
    then = after.agg(F.expr(f"coalesce(sum({TOKENS}), 0L)").alias("tokens_after"), F.count("*").alias("survivors"))
    cold = pruned.agg(F.count("*").alias("decayed_cards"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("pruned_mean"))
    one = lambda t, c: t.select(c).scalar()  # noqa: E731  tables of one row
    counts = before.withColumns({"tokens_after": one(then, "tokens_after"), "survivors": one(then, "survivors"), "merged_cards": gone.agg(F.count("*").alias("n")).scalar(), "decayed_cards": one(cold, "decayed_cards"), "pruned_mean": one(cold, "pruned_mean")})
    return Plan(survivors, gone, pruned, counts.withColumn("tokens_reclaimed", F.expr("greatest(0, tokens_before - tokens_after)")))


def after_sweep(alive: DataFrame, survivors: DataFrame, superseded: DataFrame, pruned: DataFrame) -> DataFrame:
    """The live cards after a plan."""
    left = alive.join(superseded.select("id"), "id", "left_anti").join(pruned.select("id"), "id", "left_anti")
    s = survivors.selectExpr("id", "struct(fact, evidence, tags, access_count, last_access) as s")
    new = {c: F.expr(f"if(s is null, {c}, s.{c})") for c in ("fact", "evidence", "tags", "access_count", "last_access")}
    return left.join(s, "id", "left").withColumns(new).drop("s")


def apply_plan(cards: DataFrame, plan: Plan) -> DataFrame:
    """All cards after the plan, in one table to be put in place of the old: survivors rewritten, folded cards marked, pruned ones gone."""
    rest = cards.join(plan.pruned.select("id"), "id", "left_anti")
    s = plan.survivors.selectExpr("id", "struct(fact, evidence, tags, access_count, last_access) as s")
    new = {c: F.expr(f"if(s is null, {c}, s.{c})") for c in ("fact", "evidence", "tags", "access_count", "last_access")}
    marked = rest.join(s, "id", "left").withColumns(new).drop("s").join(plan.superseded.withColumnRenamed("superseded_by", "into"), "id", "left")
    return marked.withColumn("superseded_by", F.expr("coalesce(into, superseded_by)")).drop("into").select(*cards.columns)


def dry_run(cards: DataFrame, now: float, floor: float = 0.05, cosine: bool = True) -> Plan:
    """The plan without the graph, by vitality; nothing is written but tables on the way."""
    return plan_sweep(cards, cards.sparkSession.createDataFrame([], "source_id string, target_id string, relation_type string, weight double"), now, "vitality", floor, with_graph=False, cosine=cosine)


def space_summary(cards: DataFrame, edges: DataFrame, now: float, cosine: bool = True) -> DataFrame:
    """One row: what a sweep pruned and merged, cards before and after, and the compression ratio."""
    r = plan_sweep(cards, edges, now, cosine=cosine).report
    n = edges.agg(F.count("*").alias("n"))
    return r.withColumn("edges", n.scalar()).selectExpr("decayed_cards as pruned_count", "merged_cards as clusters_merged", "edges", "cards_before as active_cards_before", "survivors as active_cards_after", "round(1D - survivors / cast(greatest(1, cards_before) as double), 4) as compression_ratio")


def commit_sweep(store: Versions, now: float, base: int | None = None, **how) -> int:
    """A sweep of the tables cards, edges and touches of a store, committed as one version: touches folded into their cards and emptied, cards after the
    plan, edges without those at pruned cards, and the report. From `base`, the newest version if none is given; Conflict if another writer was faster."""
    v, said = store.latest() if base is None else (base, store.at(base))
    tables = said["tables"]
    cards, edges = store.folders(tables.get("cards", []), SCHEMA), store.folders(tables.get("edges", []), EDGE_SCHEMA)
    touches = store.folders(tables.get("touches", []), TOUCH_SCHEMA)
    touched = graph.stored(lifecycle.fold_touches(cards, touches).select(*cards.columns))
    plan = plan_sweep(touched, edges, now, **how)
    gone = plan.pruned.select("id")
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    report = plan.report.first().asDict()
    return store.commit_tables(v, {"cards": apply_plan(touched, plan), "edges": left.select(*edges.columns), "touches": touches.limit(0)}, report=report, swept_at=now)


# ---- mutations ---------------------------------------------------------------------------------------------------


def add(cards: DataFrame, edges: DataFrame, new: DataFrame, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """cards and edges after new cards came in, linked to the live ones; an id that is already there is an error."""
    both = new.select("id").join(cards.select("id"), "id", "left_semi").union(new.groupBy("id").count().where("count > 1").select("id"))
    if clash := both.limit(5).collect():
        raise ValueError(f"ids that are already there: {', '.join(r['id'] for r in clash)}")
    links = graph.auto_link(new, live(cards), threshold).withColumn("created_at", F.lit(0.0))
    old = edges if "created_at" in edges.columns else edges.withColumn("created_at", F.lit(0.0))
    return cards.unionByName(new.select(*cards.columns)), graph.upsert_edges(old.select(*links.columns), links)


def delete(cards: DataFrame, ids: DataFrame) -> DataFrame:
    return cards.join(ids.select("id"), "id", "left_anti")


def delete_scope(cards: DataFrame, edges: DataFrame, scope: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cards without those of the scope, edges without those at them, and the number that went."""
    gone = cards.where(F.col("scope") == scope).select("id")
    left = edges.join(gone.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(gone.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return cards.where(~F.col("scope").eqNullSafe(scope)), left.select(*edges.columns), gone.agg(F.count("*").alias("deleted"))


def archive(cards: DataFrame, ids: DataFrame, now: float) -> DataFrame:
    """cards with the ids archived at now; what was archived before keeps its time."""
    hit = cards.join(ids.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    return hit.withColumn("archived", F.expr(f"if(hit and coalesce(archived, 0D) = 0, {now!r}D, archived)")).select(*cards.columns)


def forget(cards: DataFrame, tag: str | None) -> DataFrame:
    """cards without those of a session, agent or crew; without a tag nothing goes."""
    return cards if not tag else cards.where(~F.coalesce(F.array_contains("tags", tag), F.lit(False)))


def remember(cards: DataFrame, history: DataFrame, new: DataFrame, now: float, ttl: float | None = None, scope: str = "default") -> tuple[DataFrame, DataFrame]:
    """cards and history after new facts (id, fact, evidence, tags, embedding): with ttl tag and scope, put in place of cards with their ids, old versions noted."""
    tagged = new.withColumns({"tags": F.expr(f"array_append(coalesce(tags, cast(array() as array<string>)), 'ttl:{ttl:g}')" if ttl else "coalesce(tags, cast(array() as array<string>))"), "scope": F.lit(scope), "timestamp": F.lit(float(now))})
    full = tagged.withColumns({c: F.lit(None).cast(t) if c not in ("access_count", "last_access", "stability", "importance", "archived", "source_tokens") else F.lit(1 if c == "stability" else 0).cast(t) for c, t in cards.dtypes if c not in tagged.columns})
    was = cards.join(new.select("id"), "id", "left_semi").selectExpr("id as card_id", "fact", f"{now!r}D as seen_at")
    return delete(cards, new).unionByName(full.select(*cards.columns)), history.unionByName(was.select(*history.columns))


# ---- events that can be taken back once --------------------------------------------------------------------------


def record(cards: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """History rows of changes (id, new_fact, event): event_id, card_id, scope, old_fact, new_fact, event_type, created_at, rolled_back."""
    c = changes.join(cards.select("id", "scope", F.col("fact").alias("old_fact")), "id", "left")
    return c.selectExpr(f"sha2(concat_ws('|', id, event, coalesce(new_fact, ''), '{now!r}'), 256) as event_id", "id as card_id", "coalesce(scope, 'default') as scope", "old_fact", "new_fact", "event as event_type", f"{now!r}D as created_at", "false as rolled_back")


def roll_back(cards: DataFrame, history: DataFrame, events: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """cards and history after events (event_id) were taken back: each once, and only where the card is still there and not superseded. Every one leaves a row of its own."""
    there = cards.where("superseded_by is null").select(F.col("id").alias("card_id"))
    ok = history.where(~F.col("rolled_back")).join(events.select("event_id"), "event_id", "left_semi").join(there, "card_id", "left_semi")
    last = ok.groupBy("card_id").agg(F.max_by("old_fact", F.struct("created_at", "event_id")).alias("back")).withColumnRenamed("card_id", "id")
    fact = cards.join(last.withColumn("hit", F.lit(True)), "id", "left").withColumn("fact", F.expr("if(hit, back, fact)")).select(*cards.columns)
    done = history.join(ok.select("event_id", F.lit(True).alias("hit")), "event_id", "left").withColumn("rolled_back", F.expr("rolled_back or coalesce(hit, false)")).select(*history.columns)
    notes = ok.selectExpr("sha2(concat(event_id, '|rollback'), 256) as event_id", "card_id", "scope", "old_fact", "cast(null as string) as new_fact", "'rollback' as event_type", f"{now!r}D as created_at", "false as rolled_back")
    return fact, done.unionByName(notes.select(*history.columns))


# ---- dispatch of raw statements ----------------------------------------------------------------------------------


def dispatch(cards: DataFrame, statements: DataFrame) -> DataFrame:
    """(sid, action, confidence, escalated, target, fact, tags, evidence, card_ids) for statements (sid, text).

    A deletion points at all live cards with the target as tag, or else in the fact; an update at the first of them; an
    addition, and an update without any, at none. Targets meet cards as tags by key, and facts by patterns.containing().
    """
    judged = lifecycle.classify(statements).withColumn("target", F.expr(f"case action when 'DELETE' then {X.target_id('text', X.DELETES)} when 'UPDATE' then {X.target_id('text', X.UPDATES)} end"))
    wanted = judged.where("target is not null").select("target", "action").distinct()
    alive = live(cards).select("id", "timestamp", "fact", "tags")
    by_tag = alive.select("id", "timestamp", F.explode("tags").alias("target")).join(wanted.select("target").distinct(), "target")
    said = patterns.containing(alive.select(F.struct("timestamp", "id").alias("id"), lookup.nocase("fact").alias("text")), wanted.select(F.col("target").alias("pattern")))
    by_fact = said.select(F.col("pattern").alias("target"), F.col("id.id").alias("id"), F.col("id.timestamp").alias("timestamp"))
    hits = by_tag.select("target", F.struct("timestamp", "id").alias("c"), F.lit(0).alias("try")).union(by_fact.select("target", F.struct("timestamp", "id"), F.lit(1)))
    best = hits.groupBy("target").agg(F.min("try").alias("first"))
    kept = hits.join(best, "target").where("try = first").groupBy("target").agg(F.sort_array(F.collect_set("c")).alias("cs")).selectExpr("target", "transform(cs, c -> c.id) as ids")
    out = judged.join(kept, "target", "left")
    ids = "case when action = 'DELETE' then coalesce(ids, cast(array() as array<string>)) when action = 'UPDATE' and ids is not null then slice(ids, 1, 1) else cast(array() as array<string>) end"
    return out.selectExpr("sid", "action", "confidence", "escalated", "target", f"{X.fact('text')} as fact", f"{X.tags('text')} as tags", f"{X.evidence('text')} as evidence", f"{ids} as card_ids")
