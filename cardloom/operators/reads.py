"""Read operators: rankings, point reads with vitality, overviews, sessions, metrics, reports."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.operators import lookup
from cardloom.sources.cards import live


def with_vitality(cards: DataFrame, now: float) -> DataFrame:
    return cards.withColumn("vitality", F.expr(S.vitality("last_access", "timestamp", "access_count", f"{now!r}D")))


def active(cards: DataFrame, now: float, n: int = 20, tags: list[str] | None = None, floor: float = 0.0) -> DataFrame:
    """The n liveliest live cards with any of the tags."""
    some = live(cards)
    some = lookup.any_tag(some, tags) if tags else some
    return with_vitality(some, now).where(F.col("vitality") >= floor).orderBy(F.desc("vitality"), "timestamp", "id").limit(n)


def decaying(cards: DataFrame, now: float, n: int = 20) -> DataFrame:
    """The n live cards closest to being pruned, with their tokens."""
    return with_vitality(live(cards), now).withColumn("tokens", F.expr(f"{S.tokens('fact')} + {S.tokens('evidence')}")).orderBy("vitality", "timestamp", "id").limit(n)


def newest(cards: DataFrame, n: int = 20, tags: list[str] | None = None) -> DataFrame:
    some = live(cards)
    return (lookup.any_tag(some, tags) if tags else some).orderBy(F.desc("timestamp"), "id").limit(n)


def get(cards: DataFrame, card_id: str, now: float) -> DataFrame:
    """One card, dead or alive, with vitality, age and the health of its vector."""
    norm = S.norm("embedding")
    one = with_vitality(cards.where(F.col("id") == card_id), now)
    return one.withColumns({"age_days": F.expr(S.age_days("timestamp", f"{now!r}D")), "dim": F.expr("coalesce(size(embedding), 0)"), "norm": F.expr(norm), "is_normalized": F.expr(f"coalesce({norm} between 0.95D and 1.05D, false)")})


def tag_nocase(cards: DataFrame, tag: str) -> DataFrame:
    """Cards with a tag, whatever its case."""
    return cards.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def overview(cards: DataFrame) -> DataFrame:
    """One row: counts, kinds of vectors (float32: `embedding`, int8: `q_embedding` if there is one), bytes, tokens."""
    q = "q_embedding is not null" if "q_embedding" in cards.columns else "false"
    return cards.agg(
        F.count("*").alias("total"), F.expr("count_if(superseded_by is null)").alias("active"), F.expr("count_if(superseded_by is not null)").alias("superseded"), F.expr("count_if(coalesce(archived, 0) <> 0)").alias("archived"),
        F.expr("count_if(embedding is not null)").alias("float32"), F.expr(f"count_if({q})").alias("int8"),
        F.expr("coalesce(sum(4 * size(embedding)), 0L)").alias("float32_bytes"), F.expr(f"coalesce(sum({S.tokens('fact')} + {S.tokens('evidence')}), 0L)").alias("tokens"),
    ).withColumn("vectors", F.expr("case when float32 = 0 and int8 = 0 then 'none' when int8 = 0 then 'float32' when float32 = 0 then 'int8' else 'mixed' end"))


def dashboard(cards: DataFrame, now: float, fresh: float = 0.66, aging: float = 0.33) -> DataFrame:
    """One row: live cards by vitality, tokens in all, the five newest and the five weakest ids."""
    some = with_vitality(live(cards), now)
    five = lambda order: F.slice(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["id"]), 1, 5)
    first = newest(cards, 5).agg(five(F.struct((-F.col("timestamp")).alias("o"), "id")).alias("recent"))
    weak = with_vitality(live(cards), now).orderBy("vitality", "id").limit(5).agg(five(F.struct("vitality", "id")).alias("weakest"))
    out = some.agg(F.count("*").alias("cards"), F.expr(f"count_if(vitality >= {fresh})").alias("fresh"), F.expr(f"count_if(vitality >= {aging} and vitality < {fresh})").alias("aging"), F.expr(f"count_if(vitality < {aging})").alias("decayed"), F.expr(f"coalesce(sum({S.tokens('fact')} + {S.tokens('evidence')}), 0L)").alias("tokens"))
    return out.withColumns({"recent": first.scalar(), "weakest": weak.scalar()})


def session_history(cards: DataFrame, session: str, key: str = "session_id") -> DataFrame:
    """The live cards of one session, oldest first."""
    return lookup.by_tag(live(cards), f"{key}={session}").orderBy("timestamp", "id")


def session_counts(cards: DataFrame, key: str = "session_id") -> DataFrame:
    """(session, cards) of all sessions."""
    tags = live(cards).select("id", F.explode("tags").alias("t")).where(F.startswith("t", F.lit(f"{key}=")))
    return tags.selectExpr(f"substring(t, {len(key) + 2}) as session").groupBy("session").agg(F.count("*").alias("cards"))


def metrics(cards: DataFrame, answers: DataFrame) -> DataFrame:
    """One row: live cards, and tokens used and saved so far, summed over the log of answers (tokens_used, tokens_saved)."""
    sums = answers.agg(F.struct(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("u"), F.coalesce(F.sum("tokens_saved"), F.lit(0)).alias("s"), F.count("*").alias("n")).alias("x"))
    return live(cards).agg(F.count("*").alias("cards")).withColumn("x", sums.scalar()).selectExpr("cards", "x.n as answers", "x.u as tokens_used", "x.s as tokens_saved")


def cost_report(answers: DataFrame, price_per_million: float = 0.02) -> DataFrame:
    """One row over answers (tokens_used, raw_tokens, write_ms, read_ms, correct): tokens a fact and saved, mean and median latency, share of right answers, cost of the raw tokens."""
    return answers.agg(
        F.round(F.avg("tokens_used"), 1).alias("tokens_per_fact"), F.round(F.avg("raw_tokens") - F.avg("tokens_used"), 1).alias("saved_per_fact"), F.round(F.avg("write_ms"), 3).alias("write_mean"), F.round(F.percentile("write_ms", 0.5), 3).alias("write_median"),
        F.round(F.avg("read_ms"), 3).alias("read_mean"), F.round(F.percentile("read_ms", 0.5), 3).alias("read_median"), F.round(F.avg(F.col("correct").cast("int")), 3).alias("recall"), F.round(F.sum("raw_tokens") * price_per_million / 1e6, 6).alias("cost"),
    )


def scaling_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: cards and tokens before and after a sweep, the reduction in per cent and whether it is a quarter."""
    tokens = lambda c: live(c).agg(F.struct(F.count("*").alias("n"), F.expr(f"coalesce(sum({S.tokens('fact')} + {S.tokens('evidence')}), 0L)").alias("t")).alias("x"))
    out = before.sparkSession.range(1).select(tokens(before).scalar().alias("a"), tokens(after).scalar().alias("b"))
    return out.selectExpr("a.n as cards_before", "b.n as cards_after", "a.t as tokens_before", "b.t as tokens_after", "if(a.t = 0, 0D, round(100D * (a.t - b.t) / a.t, 1)) as reduction_pct", "a.t > 0 and 4 * (a.t - b.t) >= a.t as target_met")


def nearest_rank(values: DataFrame, column: str, ranks: tuple[int, ...] = (50, 95, 99), around: float = 0.001) -> DataFrame:
    """One row of percentiles by nearest rank: values that occur, exactly.

    A digest brackets each rank; what is below the bracket is counted, and only the distinct values within it are summed up in order, so no task has all values. A bracket
    that misses its rank is widened, in the end to all values.
    """
    some = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    shares = [r / 100 for r in ranks]
    at = ", ".join(f"{min(1.0, max(0.0, s + e))!r}D" for s in shares for e in (-around, around))
    seen = some.agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), F.expr(f"percentile_approx(v, array({at}), 10000)").alias("b")).first()
    if not seen["n"]:
        return values.agg(*[F.expr(f"percentile_disc({s!r}) within group (order by {column})").alias(f"p{r}") for r, s in zip(ranks, shares, strict=True)])
    out = None
    brackets = [(seen["b"][2 * i], seen["b"][2 * i + 1]) for i in range(len(ranks))]
    counts = some.agg(*[F.struct(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).alias(f"c{i}") for i, (low, high) in enumerate(brackets)]).first()
    for i, (r, s) in enumerate(zip(ranks, shares, strict=True)):
        want, (low, high), (below, upto) = max(1, math.ceil(s * seen["n"])), brackets[i], counts[i]
        if not below < want <= upto:
            low, high, below = seen["least"], seen["most"], 0
        inside = some.where(F.col("v").between(low, high)).groupBy("v").agg(F.count("*").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("v")) + below)
        one = inside.where(F.col("upto") >= want).agg(F.min("v").alias(f"p{r}"))
        out = one if out is None else out.withColumn(f"p{r}", one.scalar())
    return out


def sample_queries(facts: list[str], n: int, seed: int = 42) -> list[str]:
    """n questions from fragments of facts (the first clause, 60 characters at most), shuffled by the seed; further rounds are numbered."""
    parts = [p for f in facts if f and (p := f.split(".")[0].split(",")[0].strip()[:60])]
    random.Random(seed).shuffle(parts)
    return [parts[i % len(parts)] + (f" variant {i // len(parts)}" if i >= len(parts) else "") for i in range(n)] if parts else []


def health(cards: DataFrame, indexed: int, warn: float = 0.2, fail: float = 0.4) -> DataFrame:
    """One row: vectors that are zero or not of unit length, share of superseded cards (ok, warn from 20 %, fail from 40 %), cards
    that point at none, and by how many cards the index differs from the live ones. indexed: cards in the index (its snapshot's nd)."""
    norm = S.norm("embedding")
    dangling = cards.where("superseded_by is not null").join(cards.select(F.col("id").alias("superseded_by")), "superseded_by", "left_anti").agg(F.count("*").alias("n"))
    alive = live(cards).agg(F.count("*").alias("n"))
    out = cards.agg(F.count("*").alias("cards"), F.expr(f"count_if(embedding is not null and not ({norm} between 0.95D and 1.05D))").alias("odd_vectors"), F.expr("coalesce(count_if(superseded_by is not null) / cast(count(*) as double), 0D)").alias("bloat"))
    out = out.withColumns({"dangling": dangling.scalar(), "drift": F.abs(alive.scalar() - F.lit(indexed))})
    return out.selectExpr("cards", "odd_vectors", "round(bloat, 4) as bloat", f"case when bloat >= {fail} then 'fail' when bloat >= {warn} then 'warn' else 'ok' end as bloat_status", "dangling", "drift")
