"""Lexical search over a term index: BM25, TF cosine, rank fusion, lexical boost, token budget."""

from __future__ import annotations

import hashlib
import uuid

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.functions import text as X
from cardloom.operators import graph
from cardloom.operators.term_index import ASCII, TermIndex

RRF = 60


def build_index(cards: DataFrame, text: str = "fact", kind: str = "words") -> TermIndex:
    """An index of cards in a folder of its own among the shared ones."""
    index = TermIndex(cards.sparkSession, f"{graph.shared_folder(cards.sparkSession)}/cardloom/index-{uuid.uuid4().hex}", kind)
    index.append(cards, text)
    return index


_indexes: dict[tuple[str, str, str], tuple[str, TermIndex]] = {}


def index_of(cards: DataFrame, label: str, text: str = "fact", kind: str = "words") -> TermIndex:
    """The index of cards, built at the first call of a session and again when their files have changed (by path, size or time). label tells views of the same files apart."""
    spark = cards.sparkSession
    jvm, conf, seen = spark._jvm, spark._jsc.hadoopConfiguration(), []
    for f in sorted(cards.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{f} {status.getLen()} {status.getModificationTime()}")
    state = hashlib.sha256("\n".join(seen).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, f"{label} {min(cards.inputFiles(), default='').rpartition('/')[0]}", kind)
    was = _indexes.get(key)
    if was is None or was[0] != state:
        if was is not None:  # files have changed: nothing but results not yet read goes by the index before
            was[1].drop()
        _indexes[key] = (state, build_index(cards, text, kind))
    return _indexes[key][1]


def bm25(cards: DataFrame | TermIndex, query: str | list[str], n: int = 30, prefix: bool = False, text: str = "fact", folded: bool = False, scope: str | None = None) -> DataFrame:
    """(id, score): the n best cards, higher is better. With prefix=True each word stands for all terms that begin with it, as one.

    query: a text, split by blanks, or a list of words. With folded=True diacritics don't count. Statistics are those of all
    cards, whatever the scope. Cards may be an index, else one is made for this query.
    """
    index = cards if isinstance(cards, TermIndex) else build_index(cards, text)
    return index.bm25(query.lower().split() if isinstance(query, str) else query, n, prefix, folded, scope)


def tf_cosine(cards: DataFrame | TermIndex, query: str, k: int = 10, text: str = "fact") -> DataFrame:
    """Cosine of raw term counts of [a-z0-9]+ words. Cards may be an index of kind `ascii`; else their texts are split up for this query."""
    from collections import Counter

    import re

    q = Counter(re.findall(r"[a-z0-9]+", query.lower()))
    if isinstance(cards, TermIndex):
        return cards.cosine(q, k)
    qn = sum(v * v for v in q.values()) ** 0.5 or 1.0
    words = cards.select("id", F.explode(F.expr(ASCII.format(text))).alias("term"))
    tf = words.groupBy("id", "term").agg(F.count("*").alias("tf"))
    weight = "case " + " ".join(f"when term = {X.lit(w)} then {v}" for w, v in q.items()) + " else 0 end" if q else "0"
    sums = tf.groupBy("id").agg(F.expr(f"sum(tf * ({weight}))").alias("d"), F.expr("sqrt(cast(sum(tf * tf) as double))").alias("n"))
    return sums.where("d > 0").selectExpr("id", f"d / (n * {qn!r}D) as score").orderBy(F.desc("score"), "id").limit(k)


def ranked(hits: DataFrame, depth: int, name: str) -> DataFrame:
    """(id, name): the positions, from 1, of the `depth` best of hits (id, score, and timestamp for ties if there is one). The window sees no more rows than that."""
    order = [F.desc("score"), *(["timestamp"] if "timestamp" in hits.columns else []), F.col("id")]
    return hits.orderBy(*order).limit(depth).select("id", F.row_number().over(Window.orderBy(*order)).alias(name))


def rrf(vec: DataFrame, lex: DataFrame, boosts: DataFrame | None = None, alpha: float = 0.7, k: int = 10, depth: int = 1000) -> DataFrame:
    """Reciprocal rank fusion of the `depth` best of two ranked lists (id, score); boosts only for ids in one of them."""
    a, b = ranked(vec, depth, "rv"), ranked(lex, depth, "rb")
    both = a.join(b, "id", "full_outer")
    if boosts is not None:
        both = both.join(boosts.select("id", "boost"), "id", "left")
    else:
        both = both.withColumn("boost", F.lit(0.0))
    score = f"coalesce({alpha}D / ({RRF} + rv), 0D) + coalesce({1 - alpha}D / ({RRF} + rb), 0D) + coalesce(boost, 0D)"
    return both.withColumn("score", F.expr(score)).orderBy(F.desc("score"), "id").limit(k)


def graph_boost(lex: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, boost) of the targets of edges from lexical hits: 0.5 / (1 + 0.001 * (n - 1)^2), n distinct sources."""
    n = edges.join(F.broadcast(lex.select(F.col("id").alias("source_id"))), "source_id", "left_semi").groupBy("target_id").agg(F.countDistinct("source_id").alias("n"))
    return n.selectExpr("target_id as id", "0.5D / (1 + 0.001D * (n - 1) * (n - 1)) as boost")


def two_pass(cards: DataFrame | TermIndex, vectors: DataFrame, query: str, k: int = 10) -> DataFrame:
    """BM25 candidates (50), re-ranked by 0.3 * min-max BM25 + 0.7 * cosine; vectors: (id, cos). With fewer candidates than k: the k best by cosine."""
    lex = graph.stored(bm25(cards, query, 50))
    if lex.count() < k:
        return vectors.selectExpr("id", "cos as score").orderBy(F.desc("score"), "id").limit(k)
    span = lex.agg(F.struct(F.min("score").alias("lo"), F.max("score").alias("hi")).alias("r"))
    both = lex.join(vectors, "id").withColumn("r", span.scalar())
    return both.selectExpr("id", "0.3D * if(r.hi = r.lo, 1D, (score - r.lo) / (r.hi - r.lo)) + 0.7D * cos as score").orderBy(F.desc("score"), "id").limit(k)


def lexical_boost(hits: DataFrame, query: str) -> DataFrame:
    """hits (id, fact, score) plus boosted score and n_match: verbatim numbers, identifiers and words of the query in the fact."""
    import re

    # Fixed values, equal to the reference's for equal results: token patterns, weights and caps.
    tokens = re.findall(r"[A-Za-z][A-Za-z\-]*|\d+(?:\.\d+)?", query)
    nums = sorted({t for t in tokens if re.fullmatch(r"\d+(?:\.\d+)?", t)})
    ids = {t for t in tokens if t not in nums and re.fullmatch(r"(?:[A-Z][A-Z0-9]{1,}|[A-Za-z0-9]+(?:[-_.][A-Za-z0-9]+)+)", t)}
    words = sorted({t.lower() for t in tokens if t.isalpha() and t not in ids and t.lower() not in X.LEX_STOPWORDS} - {t.lower() for t in ids})
    numeric = bool(nums) or any(w in X.NUMERIC_WORDS for w in words)
    terms = "regexp_extract_all(lower(fact), '[a-z][a-z-]*|[0-9]+(?:[.][0-9]+)?', 0)"
    n = [" + ".join([f"if({c}, 1, 0)" for c in cs]) or "0" for cs in ([f"lower(fact) rlike {X.lit(r'(?<!\w)' + re.escape(t) + r'(?!\w)')}" for t in nums], [f"array_contains({terms}, {X.lit(t.lower())})" for t in sorted(ids)], [f"array_contains({terms}, {X.lit(t)})" for t in words])]
    out = hits.withColumns({"n_num": F.expr(n[0]), "n_id": F.expr(n[1]), "n_word": F.expr(n[2])})
    primary = "least(0.5D, 0.4D * n_num + 0.15D * n_id + 0.04D * n_word)"
    total = f"if({str(numeric).lower()} and size(regexp_extract_all(fact, '[0-9]+(?:[.][0-9]+)?', 0)) >= 2, least(0.65D, {primary} + 0.15D), {primary})"
    return out.withColumns({"boosted": F.expr(f"least(1D, score + {total})"), "n_match": F.expr("n_num + n_id + n_word")}).drop("n_num", "n_id", "n_word")


def with_budget(hits: DataFrame, budget: int, ties: list[str] | None = None, salts: int = 64) -> DataFrame:
    """The hits (query_id, id, score, cost) of each query that a token budget admits, best first; ties: columns that break ties of score, larger first, before the id.

    Taken while they fit; a weak hit (score under .35) whose value per token is under a quarter of the mean so far ends it. A query may have any
    number of hits: each that costs takes a token at least, so only the first `budget` + 1 of them by rank can matter. They are
    ranked within `salts` parts first, and only what is left of those meets in one group (with the hits that cost nothing, which always stay).
    """
    cols = ["query_id", "id", "score", "cost"]
    by = ["score", *(ties or []), "id"]
    order = [F.desc(c) for c in by[:-1]] + [F.col("id")]
    some = hits.select(*cols, *(ties or [])).where("score > 0")
    ranks = some.where("cost > 0").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*order))).where(F.col("rank") <= budget + 1)
    near = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= budget + 1).drop("salt", "rank")

    def take(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(by, ascending=[False] * (len(by) - 1) + [True])
        kept, value, used = [], 0.0, 0
        for i, score, cost in zip(g.index, g["score"], g["cost"], strict=True):
            if cost > 0:
                if used + cost > budget or (kept and score / cost < 0.25 * value / max(1, used) and score < 0.35):
                    break
                used += cost
            kept.append(i)
            value += score
        return g.loc[kept, cols]

    return near.unionByName(some.where("cost <= 0")).groupBy("query_id").applyInPandas(take, hits.select(*cols).schema)


def token_cost(cards: DataFrame) -> DataFrame:
    return cards.withColumn("cost", F.expr(f"{S.tokens('fact')} + {S.tokens('evidence')}"))
