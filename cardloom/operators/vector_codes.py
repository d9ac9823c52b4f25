"""Codes of vectors, made once and kept beside them: 8-bit values, sign bits, and the coarse cell that a vector lies in.

A folder has the table `codes` (one row a vector, by cell: id, q8 and its norm, sign words, the vector at unit length) and the table `cells` (a
row for each cell: its pivot, and how far its vectors are at most). Searches read the columns that they need: 8-bit search
no vectors at all, sign search the words, and then the vectors of its few candidates. `nearest` is exact: it looks at the
cells that are nearest first, and then only at those that the angle to their pivot, less their radius, leaves a chance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import scalars as S
from cardloom.functions.text import lit
from cardloom.operators import graph, search

CELLS = 64
CODES = "id string, q8 array<tinyint>, q8_norm double, signs array<bigint>, unit array<double>, angle double, cell int"
#: Queries that are answered in one pass over the codes.
BLOCK = 1024


@dataclass(frozen=True)
class Codes:
    spark: SparkSession
    path: str
    dims: int

    def table(self) -> DataFrame:
        return self.spark.read.schema(CODES).parquet(f"{self.path}/codes")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")


def build(cards: DataFrame, path: str | None = None, cells: int = CELLS) -> Codes:
    """Codes of all cards with a vector (id, embedding), in a folder of their own; cells: of them at most so many (a row each on the driver)."""
    spark = cards.sparkSession
    path = path or f"{graph.shared_folder(spark)}/cardloom/codes-{uuid.uuid4().hex}"
    some = cards.where("embedding is not null and size(embedding) > 0").select("id", "embedding")
    dims = some.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not dims:
        spark.createDataFrame([], CODES).write.parquet(f"{path}/codes")
        spark.createDataFrame([], "cell int, pivot array<double>, radius double, n long").write.parquet(f"{path}/cells")
        return Codes(spark, path, 0)
    pivots, celled = search._cells(some, cells)
    one = celled.withColumn("q8", F.expr(S.sq8("embedding")))
    norm = "sqrt(cast(aggregate(q8, 0L, (s, x) -> s + cast(x as bigint) * cast(x as bigint)) as double))"
    rows = one.selectExpr("id", "q8", f"{norm} as q8_norm", f"{S.sign_words('embedding', dims)} as signs", f"{S.normalise('embedding')} as unit", "angle", "cast(cell as int) as cell")
    rows.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{path}/codes")
    far = spark.read.schema(CODES).parquet(f"{path}/codes").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    at = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pivots)], "cell int, pivot array<double>")
    at.join(far, "cell").coalesce(1).write.parquet(f"{path}/cells")
    return Codes(spark, path, dims)


def int8(codes: Codes, query: list[float], k: int = 5) -> DataFrame:
    """(id, score): cosine of 8-bit values, from the stored ones and their norms."""
    b, _ = search.quantised(query)
    norm = float(np.sqrt(np.square(np.array(b, np.float64)).sum()))
    q = f"array({', '.join(f'{x}L' for x in b)})" if b else "cast(array() as array<bigint>)"
    idot = f"aggregate(zip_with(q8, {q}, (x, y) -> cast(x as bigint) * y), 0L, (s, v) -> s + v)"
    return codes.table().select("id", F.expr(f"coalesce(try_divide(cast({idot} as double), q8_norm * {norm!r}D), 0D)").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def signs(codes: Codes, query: list[float], k: int = 5, pool: int = 10) -> DataFrame:
    """(id, hamming, score): of the pool * k nearest by sign bits the k best by cosine; only their vectors are read."""
    words = S.sign_words(search._vector(query), codes.dims)
    near = codes.table().select("id", "cell", F.expr(S.hamming("signs", words)).alias("hamming")).orderBy("hamming", "id").limit(pool * k).collect()
    if not near:
        return codes.table().select("id", F.lit(0).alias("hamming"), F.lit(0.0).alias("score")).limit(0)
    where = f"cell in ({', '.join(str(c) for c in sorted({r['cell'] for r in near}))}) and id in ({', '.join(lit(r['id']) for r in near)})"
    known = codes.spark.createDataFrame([(r["id"], r["hamming"]) for r in near], "id string, hamming int")
    return codes.table().where(where).join(F.broadcast(known), "id").select("id", "hamming", F.expr(_unit_cosine(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _unit_cosine(query: list[float]) -> str:
    n = float(np.linalg.norm(np.array(query, np.float64))) or 1.0
    return S.dot("unit", search._vector([x / n for x in query]))


def nearest(codes: Codes, query: list[float], k: int = 5, probe: int = 4) -> DataFrame:
    """(id, score): the k best by cosine, exactly. The `probe` nearest cells give a k-th best; cells whose bound is under it are left out of the scan."""
    cells = codes.cells().collect()  # a row for a cell
    if not cells:
        return codes.table().select("id", F.lit(0.0).alias("score")).limit(0)
    q = np.zeros(codes.dims)
    q[: len(query)] = query[: codes.dims]
    q /= np.linalg.norm(q) or 1.0
    angle = np.arccos(np.clip(np.array([r["pivot"] for r in cells]) @ q, -1, 1))
    bound = np.cos(np.maximum(angle - np.array([r["radius"] for r in cells]) - 1e-7, 0))
    order = np.argsort(angle)

    def best(some: list[int]) -> DataFrame:
        where = f"cell in ({', '.join(str(cells[i]['cell']) for i in some)})"
        return codes.table().where(where).select("id", F.expr(_unit_cosine(query)).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    first = best(order[:probe].tolist()).collect()
    least = first[-1]["score"] if len(first) == k else -2.0
    return best([i for i in order.tolist() if bound[i] >= least - 1e-9])


def batch(codes: Codes, queries: DataFrame, k: int = 5, by: str = "int8") -> DataFrame:
    """(query_id, id, score, rank) for queries (query_id, query): by 8-bit cosine, or, by="signs", by sign bits (score: minus the bits that differ).

    Queries go in blocks, each against one pass over the codes; a task keeps the k best of a query, and only those are shuffled.
    """
    out, rows = None, queries.where("query is not null").select("query_id", "query").toLocalIterator()
    while block := [r for _, r in zip(range(BLOCK), rows, strict=False)]:
        ids, some = [r["query_id"] for r in block], [list(r["query"]) for r in block]
        if by == "int8":
            q = np.array([search.quantised((v + [0.0] * codes.dims)[: codes.dims])[0] for v in some], np.float64)
            sent = codes.spark.sparkContext.broadcast((q, np.linalg.norm(q, axis=1)))
            source = codes.table().select("id", "q8", "q8_norm")
        else:
            bits = np.array([(v + [0.0] * codes.dims)[: codes.dims] for v in some]) > 0
            wide = np.zeros((len(some), -(-codes.dims // 32) * 32), np.int64)
            wide[:, : codes.dims] = bits
            sent = codes.spark.sparkContext.broadcast((wide.reshape(len(some), -1, 32) @ (1 << np.arange(32, dtype=np.int64)), None))
            source = codes.table().select("id", "signs")

        def best(batches: Iterator[pa.RecordBatch], sent=sent, ids=ids) -> Iterator[pa.RecordBatch]:
            q, norms = sent.value
            for b in batches:
                for at in range(0, b.num_rows, 4096):
                    part = b.slice(at, 4096)
                    n = part.num_rows
                    m = part.column(1).flatten().to_numpy().reshape(n, -1)
                    if norms is not None:
                        scale = norms[:, None] * part.column(2).to_numpy()[None, :]
                        score = np.divide(q @ m.T.astype(np.float64), scale, out=np.zeros(scale.shape), where=scale > 0)
                    else:
                        score = -sum(np.bitwise_count(q[:, w, None] ^ m[None, :, w]).astype(np.float64) for w in range(q.shape[1]))
                    names = np.array(part.column(0).to_pylist(), object)
                    order = np.argsort(names, kind="stable")  # ties go to the smaller id
                    top = order[np.argsort(-score[:, order], axis=1, kind="stable")[:, :k]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(ids)), top.shape[1]).astype(np.int32)), pa.array(names[top.ravel()].tolist(), pa.string()), pa.array(np.take_along_axis(score, top, 1).ravel())], names=["q", "id", "score"])

        found = source.mapInArrow(best, "q int, id string, score double")
        named = codes.spark.createDataFrame(list(enumerate(ids)), f"q int, query_id {queries.schema['query_id'].dataType.simpleString()}")
        found = found.join(F.broadcast(named), "q").select("query_id", "id", "score")
        out = found if out is None else out.union(found)
    if out is None:
        return queries.select("query_id").limit(0).selectExpr("query_id", "'' as id", "0D as score", "1 as rank")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
