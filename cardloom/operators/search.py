"""Top-k similarity: exact, recency-fused, batched, quantised, truncated."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardloom.functions import scalars as S

HALF_LIFE = 24.0


def _vector(q: list[float]) -> str:
    return "array(" + ", ".join(f"cast({float(x)!r} as double)" for x in q) + ")"


def vector_search(cards: DataFrame, query: list[float], k: int = 5, alpha: float = 0.7, scope: str | None = None, as_of: float | None = None, half_life_hours: float = HALF_LIFE, rerank: str = "topk") -> DataFrame:
    """The k best cards by alpha * cosine + (1 - alpha) * retention, best first.

    With rerank="topk" retention re-orders only the k nearest by cosine and those that tie with the k-th; with "all"
    it ranks every card. The scope is filtered before anything is scored; an empty or zero query finds nothing.
    """
    some = cards.where("embedding is not null")
    if not query or not any(query):
        some = some.limit(0)
    if scope is not None:
        some = some.where(F.col("scope") == scope)
    scored = some.withColumn("cos", F.expr(f"least(1D, greatest(0D, {S.dot('embedding', _vector(query))}))"))
    if rerank == "topk":
        # the k-th best cosine from a top-k, then one filter: no window over all rows
        kth = scored.select("cos").orderBy(F.desc("cos")).limit(k).agg(F.min("cos").alias("kth"))
        scored = scored.where(F.col("cos") >= kth.scalar())
    if as_of is None or alpha >= 1:
        fused = scored.withColumn("score", F.col("cos"))
    else:
        fused = scored.withColumn("score", F.expr(S.hybrid_score("cos", S.retention("last_access", f"{as_of!r}D", "stability", half_life_hours), alpha)))
    return fused.orderBy(F.desc("score"), "timestamp", "id").limit(k)


def batch_topk(cards: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096) -> DataFrame:
    """(query_id, id, cos, rank): the k nearest cards of every query (query_id, query).

    The queries go in blocks of block_rows, each broadcast (block_rows x dimension floats) against one pass over the
    cards: a task keeps the k best of each query by matrix product, and only those are shuffled.
    """
    out = None
    rows = queries.where("query is not null").select("query_id", "query").toLocalIterator()
    while block := [r for _, r in zip(range(block_rows), rows, strict=False)]:
        ids = [r["query_id"] for r in block]
        width = max(len(r["query"]) for r in block)
        sent = cards.sparkSession.sparkContext.broadcast(np.array([list(r["query"]) + [0.0] * (width - len(r["query"])) for r in block], np.float64))

        def best(batches: Iterator[pd.DataFrame], sent=sent, ids=ids, width=width) -> Iterator[pd.DataFrame]:
            q, kept = sent.value, None
            for b in batches:
                if not len(b):
                    continue
                cos = (q @ _matrix(b["embedding"], width).T).clip(0, 1)
                if len(b) > k:  # what is at least as near as the k-th of this batch
                    at, row = np.nonzero(cos >= np.partition(cos, len(b) - k, axis=1)[:, [len(b) - k]])
                else:
                    at, row = np.repeat(np.arange(len(ids)), len(b)), np.tile(np.arange(len(b)), len(ids))
                part = pd.DataFrame({"query_id": np.array(ids)[at], "id": b["id"].to_numpy()[row], "cos": cos[at, row]})
                kept = part if kept is None else pd.concat([kept, part])
                kept = kept.sort_values(["query_id", "cos", "id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
            if kept is not None:
                yield kept

        part = cards.where("embedding is not null").select("id", "embedding").mapInPandas(best, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, cos double")
        out = part if out is None else out.union(part)
    if out is None:
        return cards.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, id string, cos double, rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def quantised(query: list[float]) -> tuple[list[int], float]:
    """8-bit values and scale of one vector: half to even, within -128..127; zeros for a zero vector."""
    q = np.array(query, np.float64)
    scale = float(np.abs(q).max(initial=0.0)) / 127
    return (np.clip(np.rint(q / scale), -128, 127).astype(int).tolist() if scale else [0] * len(q)), scale


def int8_search(cards: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """Cosine of 8-bit quantised vectors: integer dot product over the norms of the quantised vectors. The query is quantised once, here."""
    b, _ = quantised(query)
    lit = f"array({', '.join(f'{x}L' for x in b)})" if b else "cast(array() as array<bigint>)"
    norm = float(np.sqrt(np.square(np.array(b, np.float64)).sum()))
    q = cards.withColumn("qa", F.expr(S.sq8("embedding")))
    idot = f"aggregate(zip_with(qa, {lit}, (x, y) -> cast(x as bigint) * y), 0L, (s, v) -> s + v)"
    inorm = "sqrt(cast(aggregate(qa, 0L, (s, x) -> s + cast(x as bigint) * cast(x as bigint)) as double))"
    return q.withColumn("score", F.expr(f"coalesce(try_divide(cast({idot} as double), {inorm} * {norm!r}D), 0D)")).drop("qa").orderBy(F.desc("score"), "id").limit(k)


def binary_rerank(cards: DataFrame, query: list[float], k: int = 5, pool: int = 10) -> DataFrame:
    """The pool * k nearest by Hamming distance of sign bits, re-ranked by cosine."""
    d = len(query)
    near = cards.withColumn("hamming", F.expr(S.hamming(S.sign_words("embedding", d), S.sign_words(_vector(query), d)))).orderBy("hamming", "id").limit(pool * k)
    return near.withColumn("score", F.expr(S.dot("embedding", _vector(query)))).orderBy(F.desc("score"), "id").limit(k)


def cosine_search(cards: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """Cosine with both sides brought to unit length first; zero vectors score 0."""
    return cards.where("embedding is not null").withColumn("score", F.expr(S.cosine("embedding", _vector(query)))).orderBy(F.desc("score"), "id").limit(k)


def one_dimension(cards: DataFrame) -> DataFrame:
    """One row: the dimension of all vectors (null if they differ or there are none) and their number."""
    return cards.where("embedding is not null").agg(F.expr("if(min(size(embedding)) = max(size(embedding)), min(size(embedding)), null)").alias("dim"), F.count("*").alias("n"))


def truncated_search(cards: DataFrame, query: list[float], dims: int, k: int = 5) -> DataFrame:
    """Cosine of the first dims values, each side of unit length again."""
    return cards.withColumn("score", F.expr(S.dot(S.truncate("embedding", dims), S.truncate(_vector(query), dims)))).orderBy(F.desc("score"), "id").limit(k)


def auto_search(cards: DataFrame, query: list[float], k: int = 5, small: int = 2000, large: int = 3000, latched: str = "int8") -> DataFrame:
    """8-bit search on stores of up to `small` cards, exact search on those of over `large`; between, the path taken last (latched)."""
    n = cards.limit(large + 1).count()
    path = "int8" if n <= small else "float" if n > large else latched
    return int8_search(cards, query, k) if path == "int8" else vector_search(cards, query, k, alpha=1.0)


def _matrix(vectors, width: int) -> np.ndarray:
    """Vectors as rows, cut or filled with zeros to width: dot products go over the common prefix."""
    m = np.zeros((len(vectors), width))
    for i, e in enumerate(vectors):
        m[i, : min(len(e), width)] = e[:width]
    return m


def _pivots(some: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n smallest hashes of ids, of unit length: n x dimension floats."""
    rows = some.orderBy(F.xxhash64("id"), "id").limit(n).select("embedding").collect()
    pivots = _matrix([r[0] for r in rows], max(len(r[0]) for r in rows))
    return pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)


def _cells(some: DataFrame, n: int) -> tuple[np.ndarray, DataFrame]:
    """n pivots, and id, embedding, cell, angle, norm of each card: its nearest pivot and how far it is."""
    pivots = _pivots(some, n)
    sent = some.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                norms = np.array([np.linalg.norm(np.asarray(e, np.float64)) for e in b["embedding"]])
                cos = _matrix(b["embedding"], sent.value.shape[1]) @ sent.value.T / np.maximum(norms, 1e-300)[:, None]
                cell = cos.argmax(1)
                yield b.assign(cell=cell.astype(np.int64), angle=np.arccos(cos[np.arange(len(b)), cell].clip(-1, 1)), norm=norms)

    return pivots, some.mapInPandas(nearest, "id string, embedding array<float>, cell long, angle double, norm double")


def may_meet(pivots: np.ndarray, radius: np.ndarray, norm: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of cells can share a pair over the threshold: the angle between the pivots less both radii bounds the cosine."""
    angle = np.arccos((pivots @ pivots.T).clip(-1, 1)) - radius[:, None] - radius[None, :] - 1e-7
    np.fill_diagonal(angle, 0.0)
    return norm[:, None] * norm[None, :] * np.cos(angle.clip(0, np.pi)) > threshold - 1e-9


#: At most so many cells: the table of those that may meet has their square.
MAX_CELLS = 1024
#: A side of a join with at most so many vectors is sent to all tasks.
BROADCAST_VECTORS = 4096
PAIR = "a string, b string, cos double"
#: Where cells don't prune: blocks of up to so many rows and values, about so many of them before they grow.
MOST_ROWS, BLOCK_VALUES, BLOCKS = 8192, 1 << 22, 24
#: At most so many partitions for pairs of blocks.
MOST_PARTITIONS = 4096


def _dealt(celled: DataFrame, known: DataFrame) -> DataFrame:
    """(i, j, blk, id, embedding): each row once for every pair of blocks (i <= j) that it belongs to. celled (cell, id, embedding), known (cell, parts, others: cells that may meet, with their parts); blocks of a cell are dealt by a hash."""
    blocked = celled.join(F.broadcast(known), "cell").withColumn("blk", F.expr("cell * 1048576 + pmod(xxhash64(id), parts)"))
    dealt = blocked.select("blk", "id", "embedding", F.explode("others").alias("o")).select("blk", "id", "embedding", F.expr("explode(transform(sequence(0L, o.parts - 1), t -> o.cell * 1048576 + t))").alias("other"))
    return dealt.selectExpr("least(blk, other) as i", "greatest(blk, other) as j", "blk", "id", "embedding")


#: Rows of a block that are multiplied at a time.
STRIP = 512


def _strips(m: np.ndarray, other: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, product) over the threshold, by strips of the rows x of m: with the rows y of other, or, without one, with the rows y > x of m.

    Products are taken in single precision first; what its rounding could bring over the threshold is taken again in double.
    """
    k = m if other is None else other
    with np.errstate(all="ignore"):  # what is too large for single precision passes, and is taken in double
        a, b = m.astype(np.float32), k.astype(np.float32)
        room = (m.shape[1] + 8) * 2.0**-22 * np.linalg.norm(m, axis=1).max(initial=0.0) * np.linalg.norm(k, axis=1).max(initial=0.0)
        for at in range(0, len(a), STRIP):
            first = 0 if other is not None else at
            near = np.flatnonzero(~(a[at : at + STRIP] @ b[first:].T <= np.float32(threshold - room - 1e-6 * abs(threshold))))
            x, y = at + near // (len(b) - first), first + near % (len(b) - first)
            if other is None:
                x, y = x[x < y], y[x < y]
            cos = np.concatenate([(m[x[i : i + 65536]] * k[y[i : i + 65536]]).sum(1) for i in range(0, len(x), 65536)] or [np.zeros(0)])
            yield x[cos > threshold], y[cos > threshold], cos[cos > threshold]


def _sides(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """Of a group of one or two blocks: ids of the first, its vectors, those of the second (None if there is one block), ids of both."""
    m, width = g["blk"].to_numpy(), max(map(len, g["embedding"]))
    one, two = g[m == m.min()], g[m != m.min()]
    ids = one["id"].to_numpy()
    return ids, _matrix(one["embedding"], width), _matrix(two["embedding"], width) if len(two) else None, np.concatenate([ids, two["id"].to_numpy()])


def _pairs_of_blocks(threshold: float):
    """For a group of one or two blocks: pairs over the threshold; those within one of two blocks come from that block's own group."""

    def pairs(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids, m, other, both = _sides(g)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if other is not None or key[-1] == key[-2]:  # a block whose other one is empty meets nothing
            out += [(x, y if other is None else y + len(ids), cos) for x, y, cos in _strips(m, other, threshold)]
        x, y, cos = (np.concatenate(c) for c in zip(*out, strict=True))
        i, j = both[x], both[y]
        return pd.DataFrame({"a": np.where(i < j, i, j), "b": np.where(i < j, j, i), "cos": cos})[i != j]

    return pairs


def _blocks(cards: DataFrame, threshold: float, block_rows: int, most_rows: int) -> DataFrame:
    """(i, j, blk, id, embedding) of all cards with a vector, for each pair of blocks that may have a pair over the threshold; dealt by pairs of blocks."""
    some, spark = cards.where("embedding is not null and size(embedding) > 0").select("id", "embedding"), cards.sparkSession
    about = some.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n = min(MAX_CELLS, max(1, -(-about["n"] // block_rows)))
    table = None
    if n > 1:
        pivots, celled = _cells(some, n)
        found = {r["cell"]: r for r in celled.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.count("*").alias("n")).collect()}  # a row for a cell
        cells = sorted(found)
        meet = may_meet(pivots[cells], np.array([found[c]["angle"] for c in cells]), np.array([found[c]["norm"] for c in cells]), threshold)
        if meet.mean() < 0.5:
            parts = [-(-found[c]["n"] // block_rows) for c in cells]
            table = [(c, parts[i], [(cells[j], parts[j]) for j in np.flatnonzero(meet[i]).tolist()]) for i, c in enumerate(cells)]
    if table is None:
        # where cells prune little, a row is sent less often in fewer, larger blocks
        rows = min(most_rows, max(block_rows, about["n"] // BLOCKS), max(block_rows, BLOCK_VALUES // max(1, about["dim"] or 1)))
        celled, parts = some.withColumn("cell", F.lit(0)), [max(1, -(-about["n"] // rows))]
        table = [(0, parts[0], [(0, parts[0])])]
    known = spark.createDataFrame(table, "cell long, parts long, others array<struct<cell: long, parts: long>>")
    at = {c: p for c, p, _ in table}
    groups = sum(at[c] * p for c, _, others in table for _, p in others) // 2 + len(table)
    # few bytes make much work: partitions by the number of pairs of blocks, not by size
    return _dealt(celled, known).repartition(min(MOST_PARTITIONS, max(1, groups)), "i", "j")


def similar_pairs(cards: DataFrame, threshold: float, block_rows: int = 2000, recall: float | None = None) -> DataFrame:
    """(a, b, cos) with a < b and dot product over the threshold, exactly; or, with a recall below 1, most of them (hashed_pairs).

    Cards go to the cell of their nearest pivot. Two cells meet only if the triangle inequality of angles allows a pair over
    the threshold: exact, and far fewer than all where vectors gather in clusters (where they don't, the work is quadratic).
    Cells are dealt in blocks of about block_rows by a hash; each pair of blocks is one group in which matrix products are
    taken by strips, so only pairs over the threshold leave it, and no row pairs are formed. A row is sent once for each block it
    meets; where cells would prune less than half of the pairs, blocks of up to MOST_ROWS take their place.
    """
    if recall is not None:
        return hashed_pairs(cards, threshold, recall, block_rows)
    return _blocks(cards, threshold, block_rows, MOST_ROWS).groupBy("i", "j").applyInPandas(_pairs_of_blocks(threshold), PAIR)


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label (the least place of each place's component) after edges x, y."""
    while len(x):
        u, v = label[x], label[y]
        x, y, u, v = (c[u != v] for c in (x, y, u, v))
        np.minimum.at(label, np.maximum(u, v), np.minimum(u, v))
        while (up := label[label]).tobytes() != label.tobytes():
            label = up
    return label


#: What a card's edges within one pair of blocks come to: the least id that they connect it with; their number, sum of weights (0 to 1), greatest and
#: smallest one, of edges to higher ids.
NODE = "id string, link string, n long, total double, top double, low double"


def similar_nodes(cards: DataFrame, threshold: float, block_rows: int = 2000, most_rows: int | None = None) -> DataFrame:
    """NODE for every card and pair of blocks in which it has a pair over the threshold: what similar_pairs comes to, without pairs leaving their group.

    Sums of n and total over the rows of an id are those over all its pairs, and links connect the same cards as the pairs do.
    """

    def nodes(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        ids, m, other, both = _sides(g)
        label, n, total, top, low, met = np.arange(len(both)), np.zeros(len(both), np.int64), np.zeros(len(both)), np.full(len(both), -np.inf), np.full(len(both), np.inf), np.zeros(len(both), bool)
        order = both.argsort(kind="stable")
        place = order.argsort(kind="stable")  # by id
        by_id = both[order]
        for x, y, cos in _strips(m, other, threshold) if other is not None or key[-1] == key[-2] else ():
            x, y, w = place[x], place[y if other is None else y + len(ids)], cos.clip(0, 1)
            x, y = np.minimum(x, y), np.maximum(x, y)
            if (same := by_id[x] == by_id[y]).any():
                x, y, w = x[~same], y[~same], w[~same]
            n += np.bincount(x, minlength=len(n))
            total += np.bincount(x, w, minlength=len(n))
            np.maximum.at(top, x, w)
            np.minimum.at(low, x, w)
            met[x], met[y] = True, True
            label = _joined(label, x, y)
        out = pd.DataFrame({"id": by_id, "link": by_id[label], "n": n, "total": total, "top": pd.Series(top).where(n > 0), "low": pd.Series(low).where(n > 0)})
        return out[met]

    return _blocks(cards, threshold, block_rows, most_rows or MOST_ROWS).groupBy("i", "j").applyInPandas(nodes, NODE)


def reached(new: DataFrame, old: DataFrame, threshold: float, block_rows: int = 8192, small: int = BROADCAST_VECTORS) -> DataFrame:
    """(id): cards of old whose dot product with any card of new is over the threshold, each once; no pairs leave a task.

    Up to `small` new vectors go to every task, more of them meet the old ones in blocks of both sides.
    """
    one, two = (t.where("embedding is not null and size(embedding) > 0").select("id", "embedding") for t in (new, old))
    few = one.select("embedding").limit(small + 1).collect()
    if not few:
        return two.select("id").limit(0)

    def hit(rows: pd.DataFrame, m: np.ndarray, width: int) -> pd.DataFrame:
        found = np.zeros(len(rows), bool)
        for x, _, _ in _strips(_matrix(rows["embedding"], width), m, threshold):
            found[x] = True
        return rows.loc[found, ["id"]]

    if len(few) <= small:
        width = max(len(r[0]) for r in few)
        sent = old.sparkSession.sparkContext.broadcast(_matrix([r[0] for r in few], width))

        def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield hit(b, sent.value, width)

        return two.mapInPandas(against, "id string").distinct()
    p, q = (max(1, -(-t.count() // block_rows)) for t in (one, two))
    mine = one.selectExpr("0 as side", "id", "embedding", f"pmod(xxhash64(id), {p}L) as i", f"explode(sequence(0L, {q - 1}L)) as j")
    theirs = two.selectExpr("1 as side", "id", "embedding", f"explode(sequence(0L, {p - 1}L)) as i", f"pmod(xxhash64(id), {q}L) as j")

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        a, b, width = g[g["side"] == 0], g[g["side"] == 1], max(map(len, g["embedding"]))
        return hit(b.reset_index(drop=True), _matrix(a["embedding"], width), width) if len(a) and len(b) else b[["id"]].iloc[:0]

    dealt = mine.unionByName(theirs).repartition(min(MOST_PARTITIONS, p * q), "i", "j")
    return dealt.groupBy("i", "j").applyInPandas(meet, "id string").distinct()


# ---- pairs by random hyperplanes: no clusters needed, most pairs found, all found ones exact --------------------------------


def hash_shape(cosine: float, recall: float, n: int, most: int = 512, row: float = 500.0) -> tuple[int, int, float]:
    """(bits, tables, share): how many sign bits make a key and how many keys a vector gets, so that a pair at the cosine shares a key
    with probability `recall`, at the least cost; share: of all pairs of unrelated vectors those that are looked at. A row sent costs as much as `row` pairs."""
    p = 1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    best = None
    for bits in range(1, 41):
        tables = math.ceil(math.log(1 - recall) / math.log1p(-(p**bits))) if p < 1 else 1
        if tables > most:
            break
        cost = tables * (row + n * 0.5**bits / 2)
        if best is None or cost < best[0]:
            best = cost, bits, tables
    return best[1], best[2], min(1.0, best[2] * 0.5 ** best[1])


def hashed_pairs(cards: DataFrame, threshold: float, recall: float = 0.9, block_rows: int = 2000, seed: int = 7) -> DataFrame:
    """(a, b, cos): pairs of dot product over the threshold, at least about the share `recall` of those at it and more of nearer ones.

    A vector gets a key in each table: the signs of its products with random directions. Vectors that share a key meet, whether they gather in clusters or not;
    a key that very many share is dealt in blocks like a cell of similar_pairs. Products are taken in full, and a pair found
    in several tables is told once. A dot product over the threshold needs a cosine over threshold / largest norm squared.
    """
    some, spark = cards.where("embedding is not null and size(embedding) > 0").select("id", "embedding"), cards.sparkSession
    about = some.agg(F.count("*").alias("n"), F.max(F.expr(S.norm("embedding"))).alias("norm"), F.max(F.size("embedding")).alias("dim")).first()
    if not about["n"]:
        return spark.createDataFrame([], PAIR)
    bits, tables, _ = hash_shape(threshold / max(about["norm"] ** 2, 1e-300), recall, about["n"])
    directions = np.random.default_rng(seed).standard_normal((about["dim"], tables * bits))
    sent, powers = spark.sparkContext.broadcast(directions), 1 << np.arange(bits, dtype=np.int64)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                signs = (_matrix(part["embedding"], len(sent.value)) @ sent.value > 0).reshape(len(part), tables, bits)
                yield pd.DataFrame({"id": part["id"], "embedding": part["embedding"], "keys": list(signs @ powers)})

    keyed = some.mapInPandas(keys, "id string, embedding array<float>, keys array<long>").select("id", "embedding", F.posexplode("keys").alias("t", "key"))
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    # a key's blocks meet each other: (i, j) of them, in a row's own copy for each block that it meets
    blocked = keyed.join(sizes, ["t", "key"]).withColumn("parts", F.expr(f"ceil(n / {block_rows})")).withColumn("blk", F.expr("pmod(xxhash64(id), parts)"))
    dealt = blocked.select("t", "key", "blk", "id", "embedding", F.explode(F.expr("sequence(0L, parts - 1)")).alias("other")).selectExpr("t", "key", "least(blk, other) as i", "greatest(blk, other) as j", "blk", "id", "embedding")
    found = dealt.groupBy("t", "key", "i", "j").applyInPandas(_pairs_of_blocks(threshold), PAIR)
    return found.groupBy("a", "b").agg(F.max("cos").alias("cos"))


# ---- pairs between two sides -------------------------------------------------------------------------------------------


def similar_between(new: DataFrame, old: DataFrame, threshold: float, block_rows: int = 2000, small: int = BROADCAST_VECTORS) -> DataFrame:
    """(a, b, cos): cosines over the threshold (0 or more) of vectors of new (a) with those of old (b) of other ids, exactly.

    Up to `small` new vectors go to every task, as a matrix, and old ones are passed by once, without a shuffle. More of them
    are put in cells with the old ones; blocks of either side meet where the angles between their cells allow a pair.
    """
    one, two = (t.where("embedding is not null and size(embedding) > 0").select("id", "embedding") for t in (new, old))
    spark, few = new.sparkSession, one.limit(small + 1).collect()
    if len(few) <= small:
        if not few:
            return spark.createDataFrame([], PAIR)
        width = max(len(r["embedding"]) for r in few)
        sent = spark.sparkContext.broadcast((np.array([r["id"] for r in few], object), _matrix([r["embedding"] for r in few], width)))

        def against(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = sent.value
            for b in batches:
                for at in range(0, len(b), 1000):
                    part = b.iloc[at : at + 1000]
                    yield _over(ids, m, part["id"].to_numpy(), _matrix(part["embedding"], max(map(len, part["embedding"]))), threshold)

        return two.mapInPandas(against, PAIR)
    both = one.withColumn("side", F.lit(0)).unionByName(two.withColumn("side", F.lit(1)))
    n = min(MAX_CELLS, max(1, -(-both.count() // block_rows)))
    # angles don't depend on lengths, so cells are those of unit vectors; a product of the common length only isn't bounded by angles of whole vectors
    even = both.agg(F.min(F.size("embedding")) == F.max(F.size("embedding"))).first()[0]
    pivots = _pivots(both, n if even else 1)
    celled = _sided(both, pivots)
    found = celled.groupBy("side", "cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()  # two rows for a cell
    cells = {s: sorted(r["cell"] for r in found if r["side"] == s) for s in (0, 1)}
    at = {(r["side"], r["cell"]): r for r in found}
    parts = {k: -(-r["n"] // block_rows) for k, r in at.items()}
    table = []
    for s in (0, 1):
        mine, theirs = cells[s], cells[1 - s]
        angle = np.arccos((pivots[mine] @ pivots[theirs].T).clip(-1, 1)) - np.array([at[s, c]["angle"] for c in mine])[:, None] - np.array([at[1 - s, c]["angle"] for c in theirs])[None, :] - 1e-7
        meet = np.cos(angle.clip(0, np.pi)) > threshold - 1e-9 if even else np.ones(angle.shape, bool)
        table += [(s, c, parts[s, c], [(theirs[j], parts[1 - s, theirs[j]]) for j in np.flatnonzero(meet[i]).tolist()]) for i, c in enumerate(mine)]
    known = spark.createDataFrame(table, "side int, cell long, parts long, others array<struct<cell: long, parts: long>>")
    blocked = celled.join(F.broadcast(known), ["side", "cell"]).withColumn("blk", F.expr("cell * 1048576 + pmod(xxhash64(id), parts)"))
    dealt = blocked.select("side", "blk", "id", "embedding", F.explode("others").alias("o")).select("side", "blk", "id", "embedding", F.expr("explode(transform(sequence(0L, o.parts - 1), t -> o.cell * 1048576 + t))").alias("other"))
    dealt = dealt.selectExpr("if(side = 0, blk, other) as i", "if(side = 0, other, blk) as j", "side", "id", "embedding")

    def pairs(g: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, g["embedding"]))
        a, b = g[g["side"] == 0], g[g["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "cos": []}).astype({"a": object, "b": object, "cos": float})
        return _over(a["id"].to_numpy(), _matrix(a["embedding"], width), b["id"].to_numpy(), _matrix(b["embedding"], width), threshold)

    return dealt.groupBy("i", "j").applyInPandas(pairs, PAIR)


def _over(ids: np.ndarray, m: np.ndarray, others: np.ndarray, k: np.ndarray, threshold: float) -> pd.DataFrame:
    """(a, b, cos) over the threshold of two matrices, products over the common length, norms over the whole."""
    width = min(m.shape[1], k.shape[1])
    scale = np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(k, axis=1)[None, :]
    cos = np.divide(m[:, :width] @ k[:, :width].T, scale, out=np.zeros(scale.shape), where=scale > 0)
    x, y = np.nonzero((cos > threshold) & (ids[:, None] != others[None, :]))
    return pd.DataFrame({"a": ids[x], "b": others[y], "cos": cos[x, y]})


def _sided(both: DataFrame, pivots: np.ndarray) -> DataFrame:
    """both (id, embedding, side) with cell and angle of each row's nearest pivot."""
    sent = both.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                m = _matrix(b["embedding"], sent.value.shape[1])
                cos = m @ sent.value.T / np.maximum(np.array([np.linalg.norm(np.asarray(e, np.float64)) for e in b["embedding"]]), 1e-300)[:, None]
                cell = cos.argmax(1)
                yield b.assign(cell=cell.astype(np.int64), angle=np.arccos(cos[np.arange(len(b)), cell].clip(-1, 1)))

    return both.mapInPandas(nearest, "id string, embedding array<float>, side int, cell long, angle double")
