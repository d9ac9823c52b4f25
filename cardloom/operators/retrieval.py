"""Retrieval end to end: hybrid search, its retention-weighted form, the question router, recall and search of a client.

A question is text and vector; what depends on the question alone (its words, its key, its route) is decided on the
driver, everything over cards is declared as DataFrames. Lists that are ranked or fused are bounded by their top-n.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.operators import graph, lexical, lookup, search
from cardloom.operators.lifecycle import unexpired
from cardloom.operators.term_index import TermIndex
from cardloom.sources.cards import live

#: How many more candidates are fused than are returned, and fetched where some may be expired.
SPARE, TTL_SPARE = 4, 8
POOL = 50


def entity_sources(index: TermIndex, query: str, n: int, scope: str | None = None) -> DataFrame:
    """(id, score): cards with any content word of the query, whole words only, best first."""
    return lexical.bm25(index, X.words_of(query), n, folded=True, scope=scope)


def hybrid_search(cards: DataFrame, index: TermIndex, query: str, vector: list[float], k: int = 5, alpha: float = 0.7, top_n: int = 30, scope: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The k best live cards by reciprocal rank fusion of cosine and BM25 (content words as prefixes), with the boost of cards
    that lexical hits link to; order: score, then time, then id. A query without content words or a zero vector leaves that branch empty."""
    alive = live(cards)
    vec = search.vector_search(alive, vector, top_n, alpha=1.0, scope=scope).select("id", "score", "timestamp")
    lex = lexical.bm25(index, X.words_of(query), top_n, prefix=True, folded=True, scope=scope)
    boosts = None if edges is None else lexical.graph_boost(lex, edges)
    fused = graph.stored(lexical.rrf(vec, lex, boosts, alpha, k + SPARE, depth=top_n).select("id", "score"))
    # the few ids are known before their cards are read, so that a scan keeps these cards only, whatever cards are joined from
    ids = [r["id"] for r in fused.select("id").collect()]
    return alive.where(F.col("id").isin(ids)).join(F.broadcast(fused), "id").orderBy(F.desc("score"), "timestamp", "id").limit(k)


def hybrid_retention(cards: DataFrame, index: TermIndex, query: str, vector: list[float], edges: DataFrame, now: float, k: int = 5, alpha: float = 0.7, branch: int = 60, scope: str | None = None, boost: float = 0.1, trigrams: TermIndex | None = None) -> DataFrame:
    """(id, score): as hybrid_search, but what lies within two steps of a card whose fact contains a content word gets boost * retention. trigrams: an index of the facts that finds these cards without a scan (its texts have A-Z lowered only)."""
    alive = live(cards)
    vec = search.vector_search(alive, vector, branch, alpha=1.0, scope=scope).select("id", "score", "timestamp")
    lex = lexical.bm25(index, X.words_of(query), branch, prefix=True, folded=True, scope=scope)
    words = X.words_of(query)
    if trigrams is None:
        seeds = alive.where(" or ".join(f"contains(lower(fact), {X.lit(w)})" for w in words) or "false").select("id")
    else:
        seeds = alive.limit(0).select("id")
        for w in words:  # of one question
            seeds = seeds.union(lookup.substring(alive, w, index=trigrams).select("id"))
    near = graph.within(edges, seeds, 2)
    kept = alive.join(near, "id", "left_semi").select("id", F.expr(f"{boost}D * {S.retention('last_access', f'{now!r}D', 'stability', 24.0)}").alias("boost"))
    return lexical.rrf(vec, lex, kept, alpha, k, depth=branch).select("id", "score")


# ---- the router -------------------------------------------------------------------------------------------------

# Fixed value, equal to the reference's for equal results: where a question names its key.
KEY = re.compile(r"\b(?:my|the\s+user's?)\s+(?P<key>[a-zA-Z][a-zA-Z\- ]{0,40}?)\s*(?:\?|$|is\b|are\b)", re.I)


def structured(question: str) -> bool:
    """Whether the question asks for a stored state."""
    return any(re.search(p, question, re.I) for p in X.STRUCTURED)


def key_of(question: str) -> str | None:
    found = KEY.search(question)
    key = found["key"].strip().rstrip("?.!,;:").strip() if found else ""
    return key or None


def salient(question: str) -> str | None:
    """The first word of three letters or more that is no stopword; if all are, the first."""
    words = re.findall(r"[A-Za-z][A-Za-z\-]{2,}", question)
    return next((w for w in words if w.lower() not in X.SALIENT_STOPWORDS), words[0] if words else None)


def first_of(hits: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row for each key: that of the least `order`."""
    cols = [c for c in hits.columns if c != key]
    return hits.groupBy(key).agg(F.min_by(F.struct(*cols), F.expr(order)).alias("x")).select(key, "x.*")


def sql_path(cards: DataFrame, question: str, index: TermIndex | None = None) -> DataFrame:
    """Cards for the key of the question: by fact, or else by tag; or else by its salient word in the fact. Of several rows of an id the first stays. index: trigrams of the facts."""
    alive, key, word, tries = live(cards), key_of(question), salient(question), []
    if key:
        tries += [lookup.lookup(alive, "fact", key, index), lookup.by_tag(alive, key)]
    if word:
        tries.append(lookup.lookup(alive, "fact", word, index))
    if not tries:
        return alive.limit(0)
    found = tries[0].withColumn("try", F.lit(0))
    for n, t in enumerate(tries[1:], 1):
        found = found.union(t.withColumn("try", F.lit(n)))
    found = graph.stored(found)  # read for the first try that finds any, and for its rows
    first = found.agg(F.coalesce(F.min("try"), F.lit(0)).alias("t"))
    return first_of(found.where(F.col("try") == first.scalar()).drop("try"), "timestamp").select(*cards.columns)


@dataclass(frozen=True)
class Answer:
    hits: DataFrame  # id, fact, score, cost, route
    report: DataFrame  # route, tokens_used, tokens_saved, hits
    touches: DataFrame  # id, at


def ask(cards: DataFrame, question: str, vector: list[float], budget: int = 300, now: float = 0.0, index: TermIndex | None = None) -> Answer:
    """The question routed (stored states by lookup, all others and lookups without a hit by vector and words), cut to a token
    budget; what was returned is to be appended to the touch log. index: trigrams of the facts, for lookups."""
    alive = lexical.token_cost(live(cards))
    hits, route = None, "vector"
    if structured(question):
        hits = lexical.token_cost(sql_path(cards, question, index)).selectExpr("id", "fact", "1D as score", "cost", "0 as n_match", "0D as raw")
        if hits.isEmpty():
            hits = None
        else:
            route = "sql"
    if hits is None:
        near = search.vector_search(live(cards), vector, POOL, alpha=1.0).withColumnRenamed("score", "raw").withColumn("score", F.col("raw"))
        hits = lexical.token_cost(lexical.lexical_boost(near, question)).selectExpr("id", "fact", "boosted as score", "cost", "n_match", "raw")
    kept = lexical.with_budget(hits.selectExpr("'q' as query_id", "*"), budget, ties=["n_match", "raw"])
    kept = graph.stored(kept.join(hits.select("id", "fact"), "id").selectExpr("id", "fact", "score", "cost", f"'{route}' as route"))
    raw = alive.agg(F.coalesce(F.expr(f"sum({S.tokens('concat(coalesce(fact, ' + repr('') + '), ' + repr(' ') + ', coalesce(evidence, ' + repr('') + '))')})"), F.lit(0)).alias("raw"))
    report = kept.agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("tokens_used"), F.count("*").alias("hits")).withColumn("raw", raw.scalar()).selectExpr(f"'{route}' as route", "tokens_used", "greatest(0, raw - tokens_used) as tokens_saved", "hits")
    return Answer(kept, report, kept.selectExpr("id", f"{now!r}D as at"))


# ---- a client with a default scope and expiry --------------------------------------------------------------------

PUBLIC = ["id", "fact", "evidence", "score", "tags", "timestamp"]


def mix_alpha(vector_weight: float | None, text_weight: float | None, default: float = 0.7) -> float:
    """The share of the vector branch that two weights stand for."""
    if vector_weight is None or text_weight is None:
        return default
    return vector_weight / (vector_weight + text_weight) if vector_weight + text_weight > 0 else default


def scope_of_filter(wanted: dict[str, object] | None) -> str | None:
    """The scope that a metadata filter names: the first of scope, user_id, doc_id that is set."""
    return next((str(wanted[k]) for k in ("scope", "user_id", "doc_id") if wanted and wanted.get(k) is not None), None)


def recall(cards: DataFrame, vector: list[float], now: float, k: int = 5, alpha: float = 0.7, scope: str = "default", has_ttl: bool = False) -> DataFrame:
    """The nearest unexpired cards of the scope, without their vectors. Expired ones are dropped after the search, which therefore fetches some more if there may be any."""
    hits = search.vector_search(live(cards), vector, k + (TTL_SPARE if has_ttl else 0), alpha, scope, now)
    return unexpired(hits, now).select(*PUBLIC).orderBy(F.desc("score"), "timestamp", "id")


def client_search(cards: DataFrame, index: TermIndex, query: str, vector: list[float], now: float, k: int = 5, alpha: float = 0.7, top_n: int = 30, scope: str = "default", has_ttl: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """recall() by hybrid search."""
    hits = hybrid_search(cards, index, query, vector, k + (TTL_SPARE if has_ttl else 0), alpha, top_n, scope, edges)
    return unexpired(hits, now).select(*PUBLIC).orderBy(F.desc("score"), "timestamp", "id")


def with_metadata_after(hits: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Of hits that are already cut to the top k those with all k=v tags: there may be fewer than k."""
    return lookup.with_metadata(hits, wanted)


def of_session(hits: DataFrame, tag: str) -> DataFrame:
    """Of hits that are already cut to the top k those of one agent, crew or session."""
    return lookup.by_tag(hits, tag)


def scoped_lookup(cards: DataFrame, field: str, value: str, now: float, scope: str | None = None, index: TermIndex | None = None) -> DataFrame:
    """lookup() among unexpired live cards (column `expiration`, null: never), of the scope, the default one, or none."""
    some = live(cards).where(F.col("expiration").isNull() | (F.col("expiration") > F.lit(now)))
    if scope is not None:
        some = some.where((F.col("scope") == scope) | (F.col("scope") == "default") | F.col("scope").isNull())
    return lookup.lookup(some, field, value, index)
