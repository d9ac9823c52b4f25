"""Language identification by multilingual mixture inference.

Training counts hashed character trigrams per language over all training rows (partial counts in each task, one
sum per language and bucket) and turns them into smoothed log-likelihoods. A document is a mixture: expectation-
maximisation estimates the proportion of each language from its n-gram likelihoods; languages are then dropped,
smallest proportion first, as long as the penalised likelihood (BIC: half a log of the n-gram count for each
language) does not get worse. The predicted language has the largest proportion in the set that remains.

A text is counted in parts of CHUNK_CHARS that end at characters other than letters, and likelihoods are taken in blocks
of BLOCK_CELLS, so that memory follows neither the length of a text nor the number of languages.

Defined results: null, empty or letterless texts are `und` with score 0, and so is everything if nothing was
learned; ties go to the language that sorts first; rows without a language teach nothing; repeated rows are
counted as often as they occur; an empty table gives no rows; other columns are ignored, and keep_known() returns them
unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import arrow_map, column, mix, read, with_row

BUCKETS = 1 << 15
#: At most so many languages are learned from: it bounds the broadcast table to 128 MB of float32.
MAX_LANGS = 1000
EM_STEPS = 25
CHUNK_CHARS = 250_000
#: n-grams x languages whose likelihoods are in memory at once: 32 MB of float64.
BLOCK_CELLS = 1 << 22
_APART = re.compile(r"[\W\d_]")

OUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType()))]

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: itself if a letter, else a space."""
    if not _letter:
        table = np.full(0x110000, 32, np.uint32)
        for a in range(0x110000):
            if chr(a).isalpha():
                table[a] = a
        _letter.append(table)
    return _letter[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row number and bucket of every trigram of letters and word edges in the texts; none where there is no letter."""
    low = [(t or "").lower() + "\x00" for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(low)), [len(t) for t in low])
    points = _letters()[points]
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (row[1:] != row[:-1])
    points, row = np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint64), row[keep]
    a, b, c = points[:-2], points[1:-1], points[2:]
    good = b != 32
    with np.errstate(over="ignore"):
        code = (a[good] << np.uint64(42)) | (b[good] << np.uint64(21)) | c[good]
    return row[good], (mix(code) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about CHUNK_CHARS characters, with the number of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > CHUNK_CHARS or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end at a character other than a letter: the same trigrams in all."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        m = _APART.search(text, at + CHUNK_CHARS)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, bucket and number of the trigrams of the texts, by row and bucket."""
    rows, buckets, numbers = [], [], []
    for k, t in enumerate(texts):
        if t and len(t) > 2 * CHUNK_CHARS:
            total = sum(np.bincount(grams([part])[1], minlength=BUCKETS) for part in _parts(t))
            some = np.flatnonzero(total)
            rows.append(np.full(len(some), k))
            buckets.append(some)
            numbers.append(total[some])
    row, bucket = grams([None if t and len(t) > 2 * CHUNK_CHARS else t for t in texts])
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    if not rows:
        return key // BUCKETS, key % BUCKETS, n
    row, bucket, n = (np.concatenate(x) for x in ([*rows, key // BUCKETS], [*buckets, key % BUCKETS], [*numbers, n]))
    order = np.argsort(row, kind="stable")
    return row[order], bucket[order], n[order]


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and log-likelihoods [bucket, language].

    Every row counts. The driver gets one row of counts for each language: bounded by MAX_LANGS.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = column(b, text_col), column(b, lang_col)
            for at, part in _slices(texts):
                names, which = np.unique(np.array(langs[at : at + len(part)], dtype=object).astype(str), return_inverse=True)
                row, bucket, times = counts(part)
                for k, n in enumerate(names):
                    own = which[row] == k
                    total[str(n)] = total.get(str(n), 0) + np.bincount(bucket[own], times[own], BUCKETS).astype(np.int64)
        for n, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([n] * len(some)), pa.array(some, pa.int64()), pa.array(c[some], pa.int64())], names=["lang", "bucket", "n"])

    parts = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col), F.col(lang_col)).mapInArrow(count, "lang string, bucket long, n long")
    summed = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one compact row per language: at most BUCKETS pairs each
    rows = summed.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    rows.sort(key=lambda r: r["lang"])
    table = np.zeros((BUCKETS, len(rows)))
    for k, r in enumerate(rows):
        table[r["b"], k] = r["n"]
    # each language is smoothed towards the mean of all, and that towards the uniform
    shape = table / np.maximum(table.sum(0), 1)
    base = shape.mean(1, keepdims=True) if rows else np.zeros((BUCKETS, 1))
    like = 0.97 * shape + 0.02 * base + 0.01 / BUCKETS
    return [r["lang"] for r in rows], np.log(like).astype(np.float32)


def infer(texts: list[str | None], langs: list[str], logs: np.ndarray) -> list[tuple[str, float, list[str]]]:
    """Predicted language, its proportion and the chosen set for each text."""
    out: list[tuple[str, float, list[str]]] = [("und", 0.0, [])] * len(texts)
    if not langs:
        return out
    for at, part in _slices(texts):
        row, bucket, n = counts(part)
        docs, first = np.unique(row, return_index=True)
        if not len(docs):
            continue
        doc = np.repeat(np.arange(len(docs)), np.diff(np.append(first, len(row))))
        n = n.astype(np.float64)
        like = _Likelihoods(logs, bucket)
        total = np.add.reduceat(n, first)
        open_ = np.ones((len(docs), len(langs)), bool)
        share, best = _em(like, n, doc, first, total, open_)
        active = np.ones(len(docs), bool)
        for _ in range(len(langs) - 1):  # backward selection by penalised likelihood
            left = open_.sum(1)
            active &= left > 1
            if not active.any():
                break
            some = np.flatnonzero(active)
            least = np.where(open_[some], share[some], np.inf).argmin(1)
            trial = open_[some].copy()
            trial[np.arange(len(some)), least] = False
            rows = active[doc]
            place = np.full(len(docs), -1)
            place[some] = np.arange(len(some))
            sub = place[doc[rows]]
            f = np.searchsorted(sub, np.arange(len(some)))
            s, b = _em(like.of(rows), n[rows], sub, f, total[some], trial)
            gain = b + 0.5 * np.log(total[some] + 1) >= best[some]
            took = some[gain]
            open_[took], share[took], best[took] = trial[gain], s[gain], b[gain]
            active[some[~gain]] = False
        top = share.argmax(1)
        for d, r in enumerate(docs):
            chosen = [langs[k] for k in np.flatnonzero(open_[d])]
            out[at + int(r)] = (langs[top[d]], float(min(1.0, share[d, top[d]])), chosen)
    return out


class _Likelihoods:
    """exp(logs[bucket]) by language and row, in blocks of rows: kept if they fit one block, made again each time if not."""

    def __init__(self, logs: np.ndarray, bucket: np.ndarray):
        self.logs, self.bucket, self.step = logs, bucket, max(1, BLOCK_CELLS // max(1, logs.shape[1]))
        self.whole = self._of(slice(None)) if len(bucket) <= self.step else None

    def _of(self, part: slice) -> np.ndarray:
        # a language's rows lie together, as languages are few
        return np.ascontiguousarray(np.exp(self.logs[self.bucket[part]]).T, np.float64)

    def of(self, rows: np.ndarray) -> _Likelihoods:
        out = object.__new__(_Likelihoods)
        out.logs, out.bucket, out.step = self.logs, self.bucket[rows], self.step
        out.whole = self.whole[:, rows] if self.whole is not None else None
        return out

    def blocks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for at in range(0, len(self.bucket), self.step):
            part = slice(at, min(len(self.bucket), at + self.step))
            yield part, self.whole if self.whole is not None else self._of(part)


def _em(like, n, doc, first, total, allowed):
    """Proportions [document, language] and log-likelihoods; doc is sorted, and first has each document's first row."""

    def summed(part, values):
        if part.stop - part.start == len(doc):
            return slice(None), np.add.reduceat(values, first, axis=-1)
        at = np.flatnonzero(np.diff(doc[part], prepend=-1))
        return doc[part][at], np.add.reduceat(values, at, axis=-1)

    share = np.ascontiguousarray((allowed / allowed.sum(1, keepdims=True)).T)  # [language, document]
    for _ in range(EM_STEPS if (allowed.sum(1) > 1).any() else 1):
        new = np.zeros_like(share)
        for part, block in like.blocks():
            w = share.take(doc[part], axis=1)
            w *= block
            w *= n[part] / w.sum(0)
            docs, sums = summed(part, w)
            new[:, docs] += sums
        share = new / total
    fit = np.zeros(len(total))
    for part, block in like.blocks():
        docs, sums = summed(part, n[part] * np.log((block * share.take(doc[part], axis=1)).sum(0)))
        fit[docs] += sums
    return share.T, fit


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs plus lang_pred, score (the proportion of that language, 0 to 1) and lang_set."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list:
        found = infer(column(batch, text_col), *sent.value)
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.list_(pa.string())))]

    return arrow_map(docs, OUT, run, rows=1024)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")


def keep_known(docs: DataFrame, min_share: float = 0.5) -> DataFrame:
    """The documents with a language: not `und`, and one language of at least min_share. Columns of docs."""
    found = predict(with_row(docs, "text"), train(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= min_share)).select("row.*")
