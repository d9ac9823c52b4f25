"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader.

Tokens are runs of word characters and runs of other visible characters; unigrams and bigrams are hashed into
2**18 slots. A document is a sparse vector of log-damped n-gram counts of unit length; its score is the logistic of a sparse
dot product. Training (FTRL-Proximal, per-coordinate rates, L1 and L2) takes at most `max_rows` labelled
documents, those with the smallest hash of their id, in hash order; that bound is a parameter and holds for
training only. Every document is scored, whole.

Defined results: null and empty texts score the bias alone; with no labels the score is 0.5; rows with a null
label teach nothing; a document with several labels is used with each; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import arrow_map, column, mix, read

BITS = 18
MAX_ROWS = 8000
THRESHOLD = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Hashes(dict):
    """Word to 32-bit hash, remembered; emptied when large, so that memory stays bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values; slot 0 is the bias."""
    words = TOKEN.findall(text or "")
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)
    slots = (mix(np.concatenate([h, pairs])) % np.uint64((1 << BITS) - 1)).astype(np.int64) + 1
    slots, n = np.unique(slots, return_counts=True)
    v = 1 + np.log(n)
    return np.append(slots, 0), np.append(v * (4 / np.sqrt((v * v).sum())), 1.0)


def fit(rows: list[tuple[str | None, int]], epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.3) -> np.ndarray:
    """FTRL-Proximal over the rows in the given order."""
    z, g2 = np.zeros(1 << BITS), np.zeros(1 << BITS)
    data = [(*features(t), float(y)) for t, y in rows]

    def weights(s: np.ndarray) -> np.ndarray:
        zs = z[s]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(g2[s])) / alpha + l2))

    for _ in range(epochs if data else 0):
        for s, v, y in data:
            w = weights(s)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[s] += g - (np.sqrt(g2[s] + g * g) - np.sqrt(g2[s])) / alpha * w
            g2[s] += g * g
    return weights(np.arange(1 << BITS)).astype(np.float32)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", key: str = "doc_id", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from at most max_rows labelled rows."""
    ranked = labelled.where(F.col(label_col).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k"), F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"))
    rows = ranked.orderBy("h", "k", "y", "t").limit(max_rows)
    return fit([(r["t"], r["y"]) for r in rows.toLocalIterator()])


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """docs plus score (0 to 1)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batch: pa.RecordBatch) -> list:
        w, out = sent.value, []
        for text in column(batch, text_col):
            s, v = features(text)
            out.append(float(1 / (1 + np.exp(-np.clip(float(w[s] @ v), -35, 35)))))
        return [pa.array(out, pa.float64())]

    return arrow_map(docs, [T.StructField("score", T.DoubleType())], run)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality").where("quality is not null")
    # only the ids are ranked in full; texts are joined for the bounded sample alone
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(MAX_ROWS)
    weights = train(docs.join(F.broadcast(sample), "doc_id"))
    out = score(docs, weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
