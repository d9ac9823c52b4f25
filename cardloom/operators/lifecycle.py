"""Write path as logs: latest wins, touches, history, rollback, expiry, diffs, consolidation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.operators import graph
from cardloom.operators.search import MOST_PARTITIONS, _joined


def latest(log: DataFrame) -> DataFrame:
    """Current rows of an operation log (seq, op, id, ...): the last operation of each id, without deletes. Two-phase aggregation, no window."""
    cols = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("seq")).alias("x"))
    return last.where("x.op <> 'delete'").select("id", "x.*").drop("op")


def fold_touches(cards: DataFrame, touches: DataFrame) -> DataFrame:
    """cards after their touches (id, at): accesses, last access, stability."""
    t = touches.groupBy("id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    out = cards.join(t, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumns({"stability": F.expr(S.stability_fold("stability", "access_count", "importance", "n")), "last_access": F.expr("greatest(last_access, coalesce(at, 0D))"), "access_count": F.expr("access_count + n")}).drop("n", "at")


def versions(log: DataFrame) -> DataFrame:
    """Each snapshot (card_id, seen_at, ...) with its version within the card."""
    return log.withColumn("version", F.row_number().over(Window.partitionBy("card_id").orderBy("seen_at", *[c for c in log.columns if c not in ("card_id", "seen_at")])))


def rollback(log: DataFrame, to: str = "latest") -> DataFrame:
    """The snapshot that undoing brings back: the latest of each card, or with to="previous" the one before."""
    v = versions(log).withColumn("newest", F.max("version").over(Window.partitionBy("card_id")))
    return v.where("version = newest" if to == "latest" else "version = newest - 1").drop("newest")


def unexpired_column(cards: DataFrame, now: float) -> DataFrame:
    """Cards without an expiration, or before it."""
    return cards.where(F.col("expiration").isNull() | (F.col("expiration") > F.lit(now)))


def unexpired(cards: DataFrame, now: float) -> DataFrame:
    """Cards without a ttl tag, or within it."""
    return cards.where(f"coalesce(timestamp + {S.ttl_seconds('tags')} >= {now!r}D, true)")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], since: float | None = None) -> DataFrame:
    """(key, change): added, deleted, modified or superseded rows, of both sides only those from `since` on.

    Where the tables have superseded_by, only rows without it are active: one that got it is superseded, and the row it
    points at isn't added; one that is gone altogether is deleted. Without the column all rows are active.
    """
    if since is not None:
        old, new = old.where(F.col("timestamp") >= since), new.where(F.col("timestamp") >= since)
    dead = lambda t: F.col("superseded_by") if "superseded_by" in t.columns else F.lit(None).cast("string")
    a = old.where(dead(old).isNull()).select(F.col(key).alias("k"), F.struct(*fields).alias("x"))
    b = new.select(F.col(key).alias("k"), F.struct(*fields).alias("y"), dead(new).alias("into"))
    both = a.join(b, "k", "full_outer")
    out = both.selectExpr("k", "case when x is null and into is null then 'added' when x is null then null when y is null then 'deleted' when into is not null then 'superseded' when x <=> y then null else 'modified' end as change").where("change is not null")
    if "superseded_by" in new.columns:
        targets = b.where("into is not null").join(a.select("k"), "k", "left_semi").select(F.col("into").alias("k"), F.lit(True).alias("target")).distinct()
        out = out.join(targets, out["k"].cast("string") == targets["k"], "left").where("not (change = 'added' and coalesce(target, false))").select(out["k"], "change")
    return out.withColumnRenamed("k", key)


def superseded_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, superseded_by, old_fact, new_fact) of rows that were active in old and point at another one in new; a target that is missing has an empty fact."""
    was = old.where("superseded_by is null").select("id", F.col("fact").alias("old_fact"))
    now = new.where("superseded_by is not null").select("id", "superseded_by").join(was, "id")
    return now.join(new.select(F.col("id").alias("superseded_by"), F.col("fact").alias("new_fact")), "superseded_by", "left").selectExpr("id", "superseded_by", "old_fact", "coalesce(new_fact, '') as new_fact")


def dangling(cards: DataFrame) -> DataFrame:
    """Cards superseded by an id that isn't there."""
    return cards.where("superseded_by is not null").join(cards.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti")


def new_only(incoming: DataFrame, cards: DataFrame) -> DataFrame:
    """Incoming cards whose fingerprint is not yet in their scope; of equal incoming ones the first."""
    f = F.expr(S.fingerprint("fact", "tags"))
    have = cards.select(f.alias("fp"), "scope")
    rest = [c for c in incoming.columns if c != "scope"]
    first = incoming.withColumn("fp", f).groupBy("fp", "scope").agg(F.min_by(F.struct(*rest), F.struct("timestamp", "id")).alias("x")).select("fp", "scope", "x.*")
    return first.join(have, ["fp", "scope"], "left_anti")


#: Words of sets that are put into keys at once, and words of sets for each task that sorts their keys.
SOME_WORDS, WORDS_A_TASK = 200_000, 1_000_000
#: Sets of a block that are compared in one task.
SET_BLOCK = 1000
#: So many ids are broadcast.
BROADCAST_IDS = 500_000
#: So many words, the most frequent ones, are ranked by how many cards have them; all others count as rarer than these.
RANKED_WORDS = 1 << 20
_MIX, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return (x ^ (x >> np.uint64(32))) * _SPREAD


#: Sets of so many words and more are split up by a hash: into 4 parts, of 4 times as many into 16, and so on.
WHOLE_SET = 256
_SIZES = WHOLE_SET * 4 ** np.arange(16)


def set_keys(words: np.ndarray, df: np.ndarray, ends: np.ndarray, floor: float) -> Iterator[tuple[np.ndarray, ...]]:
    """For each level: key, place of the set, size of its part, own, word's df, the two words before it in its part (0: none), and four columns of bits, for the keys of sets of words (uint64; set i has those from ends[i] to ends[i + 1]).

    At level k a set has 4^k parts. Two sets of a Jaccard of at least floor have it in a part of theirs too, as it is a mean of those of the parts; so there they share one of the
    rarest words: of s words, the first s - ceil(floor * s) + 1. A pair meets at the level of its smaller set, so larger ones have keys of the levels below that may concern them;
    own tells the level of the set's own size. The bits are of the words of a part, each of which turns one of 256: two parts differ by at least as many words as bits.
    """
    n = np.diff(ends)
    top, low = (np.searchsorted(_SIZES, x, side="right") for x in (n, np.ceil(floor * n - 1e-9)))
    of = np.repeat(np.arange(len(n)), n)
    for level in range(int(top.max(initial=0)) + 1):
        some = np.flatnonzero(((low <= level) & (level <= top))[of])
        if not len(some):
            continue
        w, i = words[some], of[some]
        part = _mixed(w ^ _SPREAD) % np.uint64(4**level)
        order = np.lexsort((w, df[some], part, i))
        w, i, part, d = w[order], i[order], part[order], df[some][order]
        starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (part[1:] != part[:-1])])
        size = np.diff(np.r_[starts, len(w)])
        bit, turned = _mixed(w + _MIX) >> np.uint64(56), np.zeros((len(w), 4), np.uint64)
        turned[np.arange(len(w)), (bit >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (bit & np.uint64(63))
        bits = np.bitwise_xor.reduceat(turned, starts, axis=0)
        group = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(w)) - starts[group]
        before = [np.where(at >= k, np.roll(w, k), np.uint64(0)) for k in (1, 2)]
        first = at <= (size - np.ceil(floor * size - 1e-9))[group]
        group, w, i, d, p, q = group[first], w[first], i[first], d[first], before[0][first], before[1][first]
        yield (_mixed(w + np.uint64((level + 1) * int(_SPREAD) % (1 << 64))), i, size[group], top[i] == level, d, p, q, *bits[group].T)


def near_sets(words: DataFrame, floor: float) -> DataFrame:
    """(a, b): all pairs of sets (num, space, ws: hashes of words) of a space that have a Jaccard of at least floor, and few others.

    Sets meet by rare words (set_keys). A pair is told only if its parts' bits differ by no more than that Jaccard allows, so pairs that share a rare word by chance aren't shuffled.
    Of the words that two parts share it is told at the first one of each run, as at least one of them comes before a word whose like before it is shared too.
    """
    df = words.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df")).where("df > 1")
    known = df.orderBy(F.desc("df"), "w").limit(RANKED_WORDS).toPandas().sort_values("w")  # two numbers for each of so many words
    sent = words.sparkSession.sparkContext.broadcast((known["w"].to_numpy(np.int64), known["df"].to_numpy(np.int64)))
    all_known = len(known) < RANKED_WORDS

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for b in batches:
            nums, spaces, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            ends, flat, at = lists.offsets.to_numpy(), lists.values.to_numpy(), 0
            while at < len(nums):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + SOME_WORDS, side="right")) - 1)
                some = flat[ends[at] : ends[to]]
                df = np.zeros(len(some), np.int64)
                if len(known):
                    near = np.minimum(np.searchsorted(known, some), len(known) - 1)
                    df = np.where(known[near] == some, counts[near], 0)
                n = np.diff(ends[at : to + 1])
                for key, i, size, own, d, p, q, *bits in set_keys(some.view(np.uint64), df, ends[at : to + 1] - ends[at], floor):
                    # a word of one set only brings it together with none
                    met = d > 0 if all_known else np.full(len(d), True)
                    columns = [key.view(np.int64) ^ spaces[at:to][i], nums[at:to][i], n[i].astype(np.int32), size.astype(np.int32), own, *(x.view(np.int64) for x in (p, q, *bits))]
                    yield pa.RecordBatch.from_arrays([pa.array(c[met]) for c in columns], ["key", "num", "n", "s", "own", "p", "q", "b0", "b1", "b2", "b3"])
                at = to

    keys = words.select("num", "space", "ws").mapInArrow(keyed, "key long, num long, n int, s int, own boolean, p long, q long, b0 long, b1 long, b2 long, b3 long")
    # by words, not by bytes: a task sorts some ten MB of keys
    total = words.agg(F.expr("coalesce(sum(size(ws)), 0L)")).first()[0]
    keys = keys.repartition(min(MOST_PARTITIONS, 1 + total // WORDS_A_TASK), "key")
    alike = " and ".join(f"least(a.{x}, b.{x}) >= {floor}D * greatest(a.{x}, b.{x}) - 1e-9D" for x in "ns")
    apart = " + ".join(f"bit_count(a.b{i} ^ b.b{i})" for i in range(4))
    new = "not (a.p <> 0 and (a.p = b.p or a.p = b.q) or a.q <> 0 and (a.q = b.p or a.q = b.q))"
    both = keys.alias("a").join(keys.alias("b"), F.expr(f"a.key = b.key and a.num < b.num and (a.own or b.own) and {alike} and {new} and {apart} <= {(1 - floor) / (1 + floor)!r}D * (a.s + b.s) + 1e-9D"))
    return both.select(F.expr("a.num").alias("a"), F.expr("b.num").alias("b")).distinct()


def _compared(near: DataFrame, sets: DataFrame, floor: float, linked: bool = False) -> DataFrame:
    """(a, b, apart): ids of the pairs (a, b: num) of sets (num, id, scope, ws, negated) of one scope that have a Jaccard of at least floor; apart: only one of the two is negated.
    With linked, pairs that aren't apart leave their group as links from the first set of each component, no more than the group has sets.

    A pair goes to the group of the least set that its first one is near to, so that a set is sent to the few groups that its pairs are in and not to each pair. Small groups
    are put together; of one with many sets each two of its blocks are a group.
    """
    ends = near.select(F.col("a").alias("num"), F.col("b").alias("o")).union(near.select("b", "a"))
    lead = graph.stored(ends.groupBy("num").agg(F.min("o").alias("o")).selectExpr("num as a", "least(num, o) as lead"))
    pairs = graph.stored(near.join(F.broadcast(lead) if lead.count() <= BROADCAST_IDS else lead, "a"))
    uses = graph.stored(pairs.select("lead", F.explode(F.array("a", "b")).alias("num")).distinct())
    big = graph.stored(uses.groupBy("lead").agg(F.count("*").alias("m")).where(f"m > {SET_BLOCK}").selectExpr("lead", f"cast(ceil(m / {SET_BLOCK}) as bigint) as parts"))
    bundles = 1 + uses.count() // SET_BLOCK
    block = lambda x: f"pmod(xxhash64({x}), coalesce(parts, 1L))"
    group = f"if(parts is null, pmod(xxhash64(lead), {bundles}L), lead + {bundles}L) as g"
    dealt = pairs.join(big, "lead", "left").selectExpr(group, f"least({block('a')}, {block('b')}) as i", f"greatest({block('a')}, {block('b')}) as j", "a", "b")
    sent = uses.join(big, "lead", "left").selectExpr("num", group, f"{block('num')} as k", "explode(sequence(0L, coalesce(parts, 1L) - 1)) as o").selectExpr("num", "g", "least(k, o) as i", "greatest(k, o) as j").distinct()
    rows = sent.join(sets.select("num", "id", "scope", "negated", "ws"), "num")

    def compare(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows["num"]))
        nums, n = rows["num"].to_numpy(), pc.list_value_length(rows["ws"]).to_numpy()
        flat, starts = pc.list_flatten(rows["ws"]).to_numpy(), np.r_[0, np.cumsum(n)]
        words, flat = np.unique(flat, return_inverse=True)
        held = np.zeros(len(words), bool)
        a, b = (np.searchsorted(nums, pairs[c].to_numpy()) for c in "ab")
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        kept = np.zeros(len(a), bool)
        at = 0
        while at < len(a):
            own, to = flat[starts[a[at]] : starts[a[at] + 1]], int(np.searchsorted(a, a[at], side="right"))
            held[own] = True
            # the sets against one, so many words at once
            while at < to:
                end = at + max(1, int(np.searchsorted(np.cumsum(n[b[at:to]]), SOME_WORDS)))
                each = n[b[at:end]]
                begin = np.cumsum(each) - each
                places = np.repeat(starts[b[at:end]] - begin, each) + np.arange(each.sum())
                both = np.add.reduceat(held[flat[places]].astype(np.int64), begin)
                kept[at:end] = both >= floor * (len(own) + each - both)
                at = end
            held[own] = False
        x, y = (rows.take(pa.array(s[kept])) for s in (a, b))
        scoped = pc.or_(pc.fill_null(pc.equal(x["scope"], y["scope"]), False), pc.and_(pc.is_null(x["scope"]), pc.is_null(y["scope"])))
        ok = pc.and_(scoped, pc.not_equal(x["id"], y["id"])).to_numpy()
        a, b, apart = a[kept][ok], b[kept][ok], pc.not_equal(x["negated"], y["negated"]).to_numpy()[ok]
        if linked:
            label = _joined(np.arange(len(nums)), a[~apart], b[~apart])
            ends = np.flatnonzero(label != np.arange(len(nums)))
            a, b, apart = np.r_[label[ends], a[apart]], np.r_[ends, b[apart]], np.r_[np.zeros(len(ends), bool), apart[apart]]
        x, y = (rows["id"].take(pa.array(s)) for s in (a, b))
        less = pc.less(x, y)
        return pa.table({"a": pc.if_else(less, x, y), "b": pc.if_else(less, y, x), "apart": apart})

    return dealt.groupBy("g", "i", "j").cogroup(rows.groupBy("g", "i", "j")).applyInArrow(compare, "a string, b string, apart boolean")


def _of_pairs(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a pair (a, b). Few keys are sent to the rows, so that texts and sets of no pair aren't shuffled."""
    ids = graph.stored(pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct())
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, "left_semi")


def _duplicates(cards: DataFrame, floor: float, linked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs of different facts (with linked, links that connect the same), each told by the first card of its scope that has it; (first, id): the other cards with that fact."""
    said = graph.stored(cards.where("trim(fact) <> ''").selectExpr("id", "scope", "sha2(fact, 256) as h"))
    first = said.groupBy("scope", "h").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("scope").alias("s"), F.col("h").alias("g"), "first")
    split_up = "array_distinct(filter(split(lower(trim(coalesce(fact, ''))), '\\\\s+'), w -> w <> ''))"
    copies = graph.stored(said.join(first, F.expr("h = g and scope <=> s and id <> first")).select("first", "id"))
    told = cards.join(copies.select("id"), "id", "left_anti").selectExpr("id", "scope", "xxhash64(scope) as space", f"transform({split_up}, w -> xxhash64(w)) as ws", f"{X.negated('fact')} as negated")
    words = graph.stored(told.where("size(ws) > 0").withColumn("num", F.monotonically_increasing_id()))
    near = graph.stored(near_sets(words, floor))
    picked = graph.stored(_of_pairs(words, near, "num"))
    same = graph.stored(_compared(near, picked, floor, linked))
    # only pairs of which one side is negated need a look at their facts
    apart = same.where("apart").select("a", "b")
    facts = _of_pairs(cards.select("id", "fact"), apart, "id")
    seen = apart.join(facts.selectExpr("id as a", "fact as fa"), "a").join(facts.selectExpr("id as b", "fact as fb"), "b").where(f"not {X.are_negations('fa', 'fb')}")
    links = graph.stored(same.where("not apart").select("a", "b").union(seen.select("a", "b")).distinct())
    return links, copies.join(words.select(F.col("id").alias("first")), "first", "left_semi")


def duplicate_links(cards: DataFrame, floor: float = 0.7) -> DataFrame:
    """(a, b): as many links as connect what duplicate_pairs() connects; a card is linked to the first one of its fact, and only these to each other."""
    links, copies = _duplicates(cards, floor, linked=True)
    return links.union(copies.selectExpr("first as a", "id as b"))


def duplicate_pairs(cards: DataFrame, floor: float = 0.7) -> DataFrame:
    """(a, b) of one scope with equal facts, or a Jaccard of lower-case words of at least floor, that are not negations of each other; all pairs of equal facts are told.

    Different facts meet by keys that pairs of that similarity are sure to share (set_keys) and are compared in full.
    """
    links, copies = _duplicates(cards, floor)
    # a link stands for all pairs of the cards with its two facts
    ends = links.select(F.col("a").alias("first")).union(links.select("b")).distinct()
    all_of = graph.stored(copies.select("first", "id").union(ends.selectExpr("first", "first as id")))
    between = links.join(all_of.selectExpr("first as a", "id as x"), "a").join(all_of.selectExpr("first as b", "id as y"), "b").select("x", "y")
    equal = copies.union(copies.selectExpr("first", "first as id").distinct())
    within = equal.alias("u").join(equal.alias("v"), F.expr("u.first = v.first and u.id < v.id")).selectExpr("u.id as x", "v.id as y")
    return between.union(within).selectExpr("least(x, y) as a", "greatest(x, y) as b")


def cluster_tags(rows: DataFrame) -> DataFrame:
    """cluster, tags: the distinct tags of a cluster's rows (cluster, timestamp, id, tags), in order of time. Tags are made distinct before they meet."""
    flat = rows.select("cluster", "timestamp", "id", F.posexplode("tags").alias("p", "tag"))
    first = flat.groupBy("cluster", "tag").agg(F.min(F.struct("timestamp", "id", "p")).alias("at"))
    return first.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("at", "tag"))).alias("ts")).selectExpr("cluster", "ts.tag as tags")


def cluster_texts(rows: DataFrame, column: str, most: int) -> DataFrame:
    """cluster, texts: the first `most` distinct texts (trimmed) of a column of a cluster's rows, in order of time; the others are left out before any meet."""
    said = rows.select("cluster", "timestamp", "id", F.trim(column).alias("text")).where("text is not null")
    first = said.groupBy("cluster", "text").agg(F.min(F.struct("timestamp", "id")).alias("at"))
    near = first.withColumn("n", F.row_number().over(Window.partitionBy("cluster").orderBy("at"))).where(F.col("n") <= most)
    return near.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("at", "text"))).alias("ts")).selectExpr("cluster", "ts.text as texts")


def merge_clusters(cards: DataFrame, pairs: DataFrame) -> DataFrame:
    """One survivor for each component of pairs (a, b): the earliest card if all facts are equal but for case, else the newest; accesses summed, tags and evidence united in time order.

    Whatever the size of a cluster, only its distinct tags and its first texts come together in a row.
    """
    comp = graph.components(pairs.selectExpr("a as source_id", "b as target_id"))
    rows = cards.join(comp, "id")
    said = "lower(trim(fact))"
    agg = rows.groupBy("cluster").agg(
        F.expr(f"coalesce(min({said}) = max({said}), false)").alias("same"), F.count("*").alias("merged"), F.sum("access_count").alias("access_count"), F.max("last_access").alias("last_access"),
        F.expr("min_by(struct(id, fact), struct(timestamp, id))").alias("first"), F.expr("max_by(struct(id, fact), struct(timestamp, id))").alias("last"),
    )
    both = agg.join(cluster_tags(rows), "cluster", "left").join(cluster_texts(rows.where("trim(evidence) <> ''"), "evidence", 3), "cluster", "left")
    return both.selectExpr("if(same, first, last) as s", "*").selectExpr("s.id as id", "s.fact as fact", "merged", "access_count", "last_access", "coalesce(tags, cast(array() as array<string>)) as tags", f"{S.merge_evidence('coalesce(texts, cast(array() as array<string>))')} as evidence")


def prune_plan(cards: DataFrame, centrality: DataFrame, now: float, floor: float = 0.15, rule: str = "retention") -> DataFrame:
    """Cards to prune: an hour old, never accessed, without edges and of retention under floor; or, with rule="vitality", of vitality under floor."""
    c = cards.join(centrality.select(F.col("source_id").alias("id"), "compound_weight"), "id", "left")
    last = "if(last_access = 0, timestamp, last_access)"
    weak = f"{S.retention(last, f'{now!r}D', '1D', 24.0)} < {floor}D and coalesce(compound_weight, 0D) = 0" if rule == "retention" else f"{S.vitality('last_access', 'timestamp', 'access_count', f'{now!r}D')} < {floor}D"
    return c.where(f"{now!r}D - timestamp >= 3600 and access_count = 0 and {weak}").drop("compound_weight")


def classify(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows plus action, confidence and escalated: keyword signals; ties go to DELETE, then UPDATE; under .6 the text is looked at again."""
    n = {k: X.hits(text, p) for k, p in (("d", X.DELETES), ("u", X.UPDATES), ("a", X.ADDS))}
    out = rows.withColumns({f"n_{k}": F.expr(v) for k, v in n.items()})
    out = out.withColumns({f"s_{k}": F.expr(X.signal(f"n_{k}")) for k in n})
    top = out.withColumn("best", F.expr("greatest(s_d, s_u, s_a)")).withColumn("act", F.expr("case when s_d = best then 'DELETE' when s_u = best then 'UPDATE' else 'ADD' end"))
    again = f"lower({text}) rlike '(don\\'t remember|do not remember|not actually|didn\\'t mean|did not mean|scratch that)'"
    was = f"lower({text}) rlike '\\\\bwas\\\\b.*\\\\bnow\\\\b'"
    blank = f"coalesce(trim({text}), '') = ''"
    cols = {
        "action": F.expr(f"case when {blank} then 'ADD' when best >= 0.6 then act when {again} then 'DELETE' when {was} then 'UPDATE' when n_d > 0 then 'DELETE' when n_u > 0 then 'UPDATE' else 'ADD' end"),
        "confidence": F.expr(f"case when {blank} then 0D when best >= 0.6 then best when {again} then 0.72D when {was} then 0.7D else 0.62D end"),
        "escalated": F.expr(f"not ({blank}) and best < 0.6"),
    }
    return top.withColumns(cols).drop("n_d", "n_u", "n_a", "s_d", "s_u", "s_a", "best", "act")
