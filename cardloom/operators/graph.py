"""Edges between cards: building, statistics, neighbours, components, hops."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.operators import patterns
from cardloom.operators.search import BROADCAST_VECTORS, MOST_PARTITIONS, reached, similar_between, similar_nodes, similar_pairs
from cardloom.sources.cards import live


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where all executors can write: spark.checkpoint.dir; where it is unset and all runs in one process, a folder of our own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="cards-"))
    return _own[0]


def stored(df: DataFrame) -> DataFrame:
    """df, written and read again: loops get no long lineage, and lost executors nothing to recompute."""
    path = f"{shared_folder(df.sparkSession)}/cardloom/core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by stored() that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def semantic_edges(cards: DataFrame, threshold: float = 0.75, recall: float | None = None) -> DataFrame:
    """Edges from the lower to the higher id with cosine over the threshold; all of them, or about the share `recall` without comparing all where vectors don't cluster."""
    return similar_pairs(cards, threshold, recall=recall).selectExpr("a as source_id", "b as target_id", "'semantic' as relation_type", "least(1D, greatest(0D, cos)) as weight")


#: Rows of a tag that meet in one group: a tag of more is dealt in blocks, and each two of these are a group.
TAG_BLOCK = 2000
#: So many different sets of tags are few: each two of them that share a tag are a row.
MOST_KINDS = 1000


def shared_tag_edges(cards: DataFrame, floor: float = 0.0, block_rows: int = TAG_BLOCK) -> DataFrame:
    """Edges between cards that share tags, weighted by Jaccard, of at least floor.

    Only tags that two cards have make pairs. Without a floor all pairs of a tag are edges, by definition: rows of a tag are dealt in blocks, so no task has a
    whole frequent tag, and a pair is told where its first shared tag brings it together, so pairs aren't shuffled. With a floor, cards meet
    at their rarest tags only (a pair of that Jaccard shares one of the first n - ceil(floor * n) + 1), so that a tag that
    many cards have makes no pairs of its own, and sizes that can't reach the floor don't meet.
    """
    own = cards.select("id", F.array_distinct("tags").alias("tags")).where("size(tags) > 0")
    if floor <= 0:
        sets = _hashed_tags(own).where("size(ts) > 0").withColumn("ts", F.array_sort("ts"))
        kinds = stored(sets.groupBy("ts", "n").agg(F.count("*").alias("c")).selectExpr("cast(monotonically_increasing_id() as string) as id", "n", "ts", "c"))
        if kinds.count() <= MOST_KINDS:
            return _met_by_kind(sets, kinds, block_rows)
        return _met_by_tag(sets, block_rows).selectExpr("source_id", "target_id", "'shared_tag' as relation_type", "weight")
    flat = own.select("id", F.explode("tags").alias("tag"))
    df = flat.groupBy("tag").agg(F.count("*").alias("df"))
    rare = stored(flat.join(df, "tag").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "tag"))).alias("ts")).selectExpr("id", "ts.tag as ts", f"explode(slice(ts.tag, 1, cast(size(ts) - ceil({floor}D * size(ts)) + 1 as int))) as tag"))
    both = rare.alias("a").join(rare.alias("b"), F.expr(f"a.tag = b.tag and a.id < b.id and least(size(a.ts), size(b.ts)) >= {floor}D * greatest(size(a.ts), size(b.ts))"))
    scored = both.selectExpr("a.id as source_id", "b.id as target_id", "'shared_tag' as relation_type", f"{S.jaccard('a.ts', 'b.ts')} as weight")
    return scored.where(F.col("weight") >= floor).distinct()


def _hashed_tags(own: DataFrame) -> DataFrame:
    """(id, n, ts): tags as 64-bit hashes, as pairs are many and compare numbers; n counts a null tag too."""
    return own.selectExpr("id", "size(tags) as n", "transform(filter(tags, t -> t is not null), t -> xxhash64(t)) as ts")


def _met_by_tag(sets: DataFrame, block_rows: int) -> DataFrame:
    """(source_id, target_id, weight, and pairs where sets have a number of copies c) of all pairs of sets (id, n, ts, perhaps c) that share a tag."""
    sets = sets if "c" in sets.columns else sets.withColumn("c", F.lit(1))
    flat = sets.withColumn("tag", F.explode("ts"))
    parts = stored(flat.groupBy("tag").agg(F.count("*").alias("m")).where("m > 1").selectExpr("tag", f"cast(ceil(m / {block_rows}) as bigint) as parts"))
    groups = parts.agg(F.expr("coalesce(sum(parts * (parts + 1) div 2), 0)")).first()[0]
    blocked = flat.join(parts, "tag").withColumn("blk", F.expr("pmod(xxhash64(id), parts)"))
    dealt = blocked.withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)"))).selectExpr("tag", "least(blk, other) as i", "greatest(blk, other) as j", "blk", "id", "n", "ts", "c")
    # few bytes make many pairs: partitions by the number of groups, not by size
    dealt = dealt.repartition(min(MOST_PARTITIONS, max(1, int(groups))), "tag", "i", "j")
    met = dealt.alias("a").join(dealt.alias("b"), F.expr("a.tag = b.tag and a.i = b.i and a.j = b.j and a.id < b.id and (a.i = a.j or a.blk <> b.blk)"))
    both = met.selectExpr("a.id as source_id", "b.id as target_id", "a.tag as tag", "a.n + b.n as n", "array_intersect(a.ts, b.ts) as both", "a.c * b.c as pairs")
    return both.where("get(both, 0) = tag").selectExpr("source_id", "target_id", "size(both) / cast(n - size(both) as double) as weight", "pairs")


def _met_by_kind(sets: DataFrame, kinds: DataFrame, block_rows: int) -> DataFrame:
    """shared_tag_edges() of cards (id, n, ts) that have few different sets of tags, kinds (id, n, ts, c): sets are compared once for each two kinds, and cards of such kinds are put together block by block."""
    within = kinds.where("c > 1").selectExpr("id as k", "id as l", "size(ts) / cast(2 * n - size(ts) as double) as weight")
    meet = _met_by_tag(kinds, block_rows).selectExpr("source_id as k", "target_id as l", "weight").union(within)
    blocks = lambda x, i: kinds.selectExpr(f"id as {x}", f"explode(sequence(0L, cast(ceil(c / {block_rows}) as bigint) - 1)) as {i}")
    groups = stored(meet.join(blocks("k", "i"), "k").join(blocks("l", "j"), "l").where("k <> l or i <= j").withColumn("g", F.monotonically_increasing_id()))
    # a few bytes a row make many pairs: partitions by the pairs that there may be, not by size
    rows = kinds.agg(F.expr("coalesce(sum(c), 0L)")).first()[0]
    n = min(MOST_PARTITIONS, max(1, min(groups.count(), 64), rows * rows // 8_000_000))
    parts = F.broadcast(kinds.selectExpr("id as kind", "ts", "n", f"cast(ceil(c / {block_rows}) as bigint) as parts"))
    cards = stored(sets.join(parts, ["ts", "n"]).selectExpr("id", "kind", "pmod(xxhash64(id), parts) as blk"))
    a = cards.join(groups, F.expr("kind = k and blk = i")).selectExpr("g", "id as x", "weight", "k = l and i = j as own").repartition(n, "g")
    b = cards.join(groups, F.expr("kind = l and blk = j")).selectExpr("g", "id as y").repartition(n, "g")
    return a.join(b, "g").where("if(own, x < y, x <> y)").selectExpr("least(x, y) as source_id", "greatest(x, y) as target_id", "'shared_tag' as relation_type", "weight")


def shared_tag_totals(cards: DataFrame, block_rows: int = TAG_BLOCK) -> DataFrame:
    """One row (n, weight): how many edges shared_tag_edges(cards) has and the sum of their weights, without forming them. Cards of equal tags are counted, and only different sets of tags meet."""
    own = _hashed_tags(cards.select("id", F.array_distinct("tags").alias("tags")).where("size(tags) > 0")).where("size(ts) > 0").withColumn("ts", F.array_sort("ts"))
    kinds = stored(own.groupBy("ts", "n").agg(F.count("*").alias("c")).selectExpr("cast(monotonically_increasing_id() as string) as id", "n", "ts", "c"))
    within = kinds.selectExpr("c * (c - 1) div 2 as pairs", "size(ts) / cast(2 * n - size(ts) as double) as weight")
    # an id that stands twice makes no edge with itself
    twice = own.groupBy("id").agg(F.collect_list(F.struct("ts", "n")).alias("ks")).where("size(ks) > 1")
    itself = twice.selectExpr("inline(flatten(transform(ks, (x, i) -> transform(slice(ks, i + 2, size(ks)), y -> struct(x.n + y.n as n, size(array_intersect(x.ts, y.ts)) as k)))))").where("k > 0").selectExpr("-1L as pairs", "k / cast(n - k as double) as weight")
    all_ = within.unionByName(_met_by_tag(kinds, block_rows).select("pairs", "weight")).unionByName(itself)
    return all_.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n"), F.coalesce(F.expr("sum(pairs * weight)"), F.lit(0.0)).alias("weight"))


def neighbours_of(cards: DataFrame, card_id: str, threshold: float = 0.75) -> DataFrame:
    """The semantic edges from one card to those of higher ids, best first: its vector against all, without building the graph."""
    one = cards.where(F.col("id") == card_id).selectExpr("id as source_id", "embedding as e0").limit(1)
    near = cards.where((F.col("id") > card_id) & F.col("embedding").isNotNull()).join(F.broadcast(one)).selectExpr("source_id", "id as target_id", "'semantic' as relation_type", f"{S.dot('embedding', 'e0')} as weight")
    return near.where(F.col("weight") > threshold).withColumn("weight", F.expr("least(1D, greatest(0D, weight))")).orderBy(F.desc("weight"), "target_id")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Weights clamped to 0..1; of equal edges the largest weight and the latest time stay."""
    both = old.unionByName(new).withColumn("weight", F.expr("least(1D, greatest(0D, weight))"))
    return both.groupBy("source_id", "target_id", "relation_type").agg(F.max("weight").alias("weight"), F.max("created_at").alias("created_at"))


def neighbours(edges: DataFrame, node: str, min_weight: float = 0.0, relation_types: list[str] | None = None) -> DataFrame:
    out = edges.where((F.col("source_id") == node) & (F.col("weight") >= min_weight))
    return (out.where(F.col("relation_type").isin(relation_types)) if relation_types else out).orderBy(F.desc("weight"), "target_id")


def compound_weight(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    return edges.where(F.col("weight") >= min_weight).groupBy("source_id").agg(F.sum("weight").alias("compound_weight"))


def density(cards: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean outgoing weight of each card, 0 without edges."""
    mean = edges.groupBy(F.col("source_id").alias("id")).agg(F.avg("weight").alias("density"))
    return cards.select("id").join(mean, "id", "left").selectExpr("id", "coalesce(density, 0D) as density")


def graph_stats(edges: DataFrame) -> DataFrame:
    nodes = edges.select(F.col("source_id").alias("n")).union(edges.select("target_id")).agg(F.countDistinct("n").alias("nodes"))
    return edges.agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 4).alias("avg_weight"), F.max("weight").alias("max_weight"), F.min("weight").alias("min_weight")).withColumn("nodes", nodes.scalar())


# ---- what semantic edges come to, from sums of cards instead of edges (search.similar_nodes) ---------------------------


def node_sums(nodes: DataFrame) -> DataFrame:
    """(id, n, total, top, low): of each card with a semantic edge the number, sum, greatest and smallest weight of its edges to higher ids (0 and null without any)."""
    return nodes.groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("top").alias("top"), F.min("low").alias("low"))


def node_stats(nodes: DataFrame) -> DataFrame:
    """graph_stats() of the semantic edges."""
    return node_sums(nodes).selectExpr("coalesce(sum(n), 0L) as edges", "round(sum(total) / nullif(sum(n), 0), 4) as avg_weight", "max(top) as max_weight", "min(low) as min_weight", "count(*) as nodes")


def node_density(cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """density() of the semantic edges."""
    mean = node_sums(nodes).where("n > 0").selectExpr("id", "total / n as density")
    return cards.select("id").join(mean, "id", "left").selectExpr("id", "coalesce(density, 0D) as density")


def node_weights(nodes: DataFrame) -> DataFrame:
    """compound_weight() of the semantic edges."""
    return node_sums(nodes).where("n > 0").selectExpr("id as source_id", "total as compound_weight")


def node_links(nodes: DataFrame) -> DataFrame:
    """Edges (source_id, target_id), some for each card and pair of blocks, with the same components as the semantic edges."""
    return nodes.selectExpr("link as source_id", "id as target_id").where("source_id < target_id").distinct()


def near_hops(cards: DataFrame, start: list[str], hops: int = 2, threshold: float = 0.75, small: int = BROADCAST_VECTORS) -> DataFrame:
    """multi_hop() over the semantic edges: the cards of each step are put against those not yet reached, and the graph isn't built."""
    seen = None
    last, rest = (cards.where(c).select("id", "embedding") for c in (F.col("id").isin(start), ~F.col("id").isin(start)))
    for h in range(1, hops + 1):
        ids = stored(reached(last, rest, threshold, small=small))
        seen = ids.withColumn("hop", F.lit(h)) if seen is None else seen.union(ids.withColumn("hop", F.lit(h)))
        last, rest = rest.join(ids, "id", "left_semi"), rest.join(ids, "id", "left_anti")
    return seen if seen is not None else cards.select("id", F.lit(0).alias("hop")).limit(0)


def prune_edges(edges: DataFrame, now: float, keep_days: float = 7.0) -> DataFrame:
    return edges.where(F.col("created_at") >= now - keep_days * 86400)


def components(edges: DataFrame, min_weight: float = 0.0) -> DataFrame:
    """(id, cluster): the smallest id reachable, edges taken both ways. Least labels spread and jump until nothing moves."""
    e = edges.where(F.col("weight") >= min_weight) if "weight" in edges.columns else edges
    both = stored(e.selectExpr("source_id as a", "target_id as b").union(e.selectExpr("target_id", "source_id")).distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as id", "least(a, m) as cluster"))
    while True:
        near = both.join(labels.selectExpr("id as b", "cluster"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("m"))
        step = labels.join(near, "id").selectExpr("id", "cluster as old", "least(cluster, m) as cluster")
        jump = step.join(labels.selectExpr("id as cluster", "cluster as up"), "cluster").selectExpr("id", "old", "least(cluster, up) as cluster")
        seen = Observation()  # counted while the table is written
        before, labels = labels, stored(jump.observe(seen, F.expr("count_if(cluster < old)").alias("moved")).select("id", "cluster"))
        dropped(before)
        if not seen.get["moved"]:
            dropped(both)
            return labels


def clusters(edges: DataFrame, min_size: int = 3, min_weight: float = 0.8) -> DataFrame:
    found = components(edges, min_weight)
    big = found.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    return found.join(big, "cluster").select("id", "cluster", "size")


def multi_hop(edges: DataFrame, start: list[str], hops: int = 2, min_weight: float = 0.0) -> DataFrame:
    """(id, hop) of all nodes within so many undirected steps, without the start."""
    e = edges.where(F.col("weight") >= min_weight)
    both = e.selectExpr("source_id as a", "target_id as b").union(e.selectExpr("target_id", "source_id")).distinct()
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], "id string, hop int")
    for h in range(1, hops + 1):
        step = both.join(seen.where(F.col("hop") == h - 1).select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        seen = seen.union(step.join(seen, "id", "left_anti").withColumn("hop", F.lit(h)))
    return seen.where("hop > 0")


def within(edges: DataFrame, start: DataFrame, hops: int = 2, min_weight: float = 0.0) -> DataFrame:
    """(id): the nodes of start (id) and all within so many undirected steps of any of them."""
    e = edges.where(F.col("weight") >= min_weight) if "weight" in edges.columns else edges
    both = e.selectExpr("source_id as a", "target_id as b").union(e.selectExpr("target_id", "source_id"))
    seen = start.select("id").distinct()
    for _ in range(hops):
        seen = seen.union(both.join(seen.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"))).distinct()
    return seen


#: Tags of at most so many new cards go to every task.
BROADCAST_CARDS = 50_000


def tag_links(new: DataFrame, cards: DataFrame, small: int = BROADCAST_CARDS) -> DataFrame:
    """(source_id, target_id, weight) from new cards to others that share a tag: Jaccard of their tag sets. They meet by tag; few new ones are broadcast, with more of them a common tag's rows are split by adaptive execution."""
    sets = lambda t, id_: t.select(F.col("id").alias(id_), F.array_distinct("tags").alias("ts")).where("size(ts) > 0")
    one = sets(new, "source_id").select("source_id", F.size("ts").alias("x"), F.explode("ts").alias("tag"))
    two = sets(cards, "target_id").select("target_id", F.size("ts").alias("y"), F.explode("ts").alias("tag"))
    few = new.limit(small + 1).count() <= small
    met = two.join(F.broadcast(one) if few else one, "tag").where("source_id <> target_id")
    return met.groupBy("source_id", "target_id", "x", "y").agg(F.count("*").alias("k")).selectExpr("source_id", "target_id", "k / cast(x + y - k as double) as weight")


def auto_link(card: DataFrame, cards: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Edges from new cards to others: semantic over the threshold; by shared tags only where there is no semantic one. No pair is formed that neither a vector nor a tag brings together."""
    near = stored(similar_between(card, cards, threshold))
    semantic = near.selectExpr("a as source_id", "b as target_id", "'semantic' as relation_type", "least(1D, greatest(0D, cos)) as weight")
    tagged = tag_links(card, cards).join(near.selectExpr("a as source_id", "b as target_id"), ["source_id", "target_id"], "left_anti")
    return semantic.unionByName(tagged.selectExpr("source_id", "target_id", "'shared_tag' as relation_type", "weight"))


def bulk_link(cards: DataFrame, threshold: float = 0.75, recall: float | None = None) -> DataFrame:
    """All edges among cards, of both kinds independently, from the lower id to the higher."""
    return semantic_edges(cards, threshold, recall).unionByName(shared_tag_edges(cards))


def rebuild(cards: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The whole graph anew, from live cards only."""
    return bulk_link(live(cards), threshold)


def rebuild_totals(cards: DataFrame, threshold: float = 0.75) -> DataFrame:
    """(relation_type, n, weight): number and sum of weights of the edges of rebuild(cards), from sums of cards and counts of equal tags."""
    alive = live(cards)
    near = similar_nodes(alive, threshold).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("weight"))
    return near.selectExpr("'semantic' as relation_type", "n", "weight").unionByName(shared_tag_totals(alive).selectExpr("'shared_tag' as relation_type", "n", "weight"))


def cooccurrence(rows: DataFrame, entities: list[str] | DataFrame) -> DataFrame:
    """(id, subject, predicate, object): unordered pairs of entities (a list, or a table: entity) that both occur in a text, whatever their case. Each row of rows (id, text) has an id of its own."""
    known = entities if isinstance(entities, DataFrame) else rows.sparkSession.createDataFrame([(e,) for e in entities], "entity string")
    known = known.select("entity", F.lower("entity").alias("pattern")).distinct()
    found = patterns.containing(rows.select("id", F.lower("text").alias("text")), known).join(known, "pattern")
    both = found.groupBy("id").agg(F.sort_array(F.collect_set("entity")).alias("es"))
    pairs = both.select("id", F.expr("explode(flatten(transform(es, (x, i) -> transform(slice(es, i + 2, size(es)), y -> struct(x as subject, 'co_occurs' as predicate, y as object)))))").alias("t"))
    return pairs.select("id", "t.subject", "t.predicate", "t.object")


# ---- labels kept between runs --------------------------------------------------------------------------------------


def contracted(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, cluster) after new edges (source_id, target_id) came to a graph whose labels are known: the same as components() of all edges, from labels and new edges only.

    New edges are taken between the labels of their ends; what is left of them is contracted by rounds of large-star and small-star (each node hands its larger
    neighbours, then all of its smaller ones, to the least of them), whose number is about the logarithm of the longest path. Labels that didn't meet a new edge stay as they are.
    """
    new = edges.selectExpr("source_id as a", "target_id as b")
    nodes = new.select(F.col("a").alias("id")).union(new.select("b")).distinct()
    if labels is not None:
        known = labels.select("id", "cluster")
        of = nodes.join(known, "id", "left").selectExpr("id", "coalesce(cluster, id) as cluster")
    else:
        known, of = None, nodes.selectExpr("id", "id as cluster")
    of = stored(of)
    ends = new.join(of.selectExpr("id as a", "cluster as u"), "a").join(of.selectExpr("id as b", "cluster as v"), "b").selectExpr("u", "v").where("u <> v")
    star = _stars(ends)
    moved = star.selectExpr("v as old", "u as to")
    fresh = of.join(moved, of["cluster"] == moved["old"], "left").selectExpr("id", "coalesce(to, cluster) as cluster")
    if known is None:
        return stored(fresh)
    kept = known.join(moved, known["cluster"] == moved["old"], "left").selectExpr("id", "coalesce(to, cluster) as cluster")
    return stored(kept.unionByName(fresh.join(known.select("id"), "id", "left_anti")))


def _stars(edges: DataFrame) -> DataFrame:
    """(u, v), u < v: every node v of edges (u, v) beside the least node u of its component, by alternating star operations until nothing changes."""
    now, seen = stored(edges.selectExpr("greatest(u, v) as v", "least(u, v) as u").where("u < v").distinct()), None
    while True:
        # large star: larger neighbours go to the least of a node and its neighbours
        both = now.select("u", "v").union(now.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) as m")
        large = stored(both.join(least, "u").where("v > u").selectExpr("v", "m as u").where("u < v").distinct())
        # small star: a node and its smaller neighbours go to the least of these
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").selectExpr("u as v", "m as u").union(low.selectExpr("v", "m as u")).where("u < v").distinct()
        count = Observation()
        after = stored(small.observe(count, F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("h")))
        state = (count.get["n"], count.get["h"])
        dropped(now, large)
        now = after
        if state == seen:
            return now
        seen = state
