"""An index of terms that is kept in a folder, grows by segments, and is searched without reading what a query doesn't need.

Postings lie in rows of blocks: one row has the postings of one term among about BLOCK_DOCS cards at most (places of cards in the block and term counts, as
arrays; counts that are all 1 are left out), and beside them how many they are, the largest count and the smallest length. What belongs to a card (id, length, scope) stands once, in the table of
cards, by block and place. Texts are shuffled to their block once and made into its rows there, so no single posting is shuffled. Rows are written by
bucket, a hash of the first letters of the term, and by slice, so many blocks as have SLICE_DOCS cards, and sorted by term
within: a file for a bucket and slice. A query reads the folders of its words' buckets only (partition filters), there the row groups
of its words, and of most columns only what it asks for.

An appended batch is a segment of its own, so appending costs what the batch costs. Deleted and replaced cards are
tombstones, which hide them in older segments; merge() makes one segment of several, puts small blocks together and drops what is hidden, row by row. Each of these is a commit of
`sources.versions`: readers see the state before or after, and of two writers from one state the second gets a conflict.

Scores are those of an index built anew: the number of cards and words and the frequencies of terms are of live cards. Searches for whole words in large
indexes skip blocks: the largest count and the smallest length bound what a block can score; the blocks with the highest bounds are scored
first, and what cannot reach the n-th best of these isn't read.

Kinds: `words` (letters and digits, also without diacritics), `ascii` (a-z and 0-9) for word search, `trigrams` (of text with A-Z lowered) for substrings.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.functions import text as X
from cardloom.sources.versions import Versions

BLOCK_DOCS = 4096
#: Smaller segments are cut in up to so many blocks, of so many cards at least, as a block is made by one task; places are 16-bit numbers.
SPREAD, LEAST_DOCS, MOST_DOCS = 48, 512, 16384
#: At most so many partitions for blocks; up to FILES_AT_ONCE, Spark deals rows out without holding or sorting them, so texts go to no more while partitions have under BLOCKS_AT_ONCE blocks.
MOST_PARTITIONS, FILES_AT_ONCE, BLOCKS_AT_ONCE = 4096, 200, 8
#: Letters of a term that choose its bucket: prefixes of so many letters or more need one bucket.
BUCKET_LETTERS = 3
BUCKETS = 16
#: Blocks are skipped where an index has more of them; so many blocks are scored to begin with.
SKIP_FROM, FIRST = 64, 8
K1, B = 1.2, 0.75

KINDS = {"words": re.compile(r"[^\W_]+"), "ascii": re.compile("[a-z0-9]+"), "trigrams": None}
#: SQL of the words of kind `ascii`.
ASCII = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+', 0)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKS = "base string, term string, blk int, n int, max_tf int, min_len int, ords array<smallint>, tfs array<int>, bucket int, seg string"
DOCS = "id string, blk int, ord smallint, len int, norm2 long, scope string, text string, seg string"


#: Cards whose postings of a bucket are sorted and written by one task, and the most tasks for that.
SLICE_DOCS, MOST_SLICES = 32_768, 1024
#: Terms that leave a block at a time; so many words are counted at a time.
TERMS, WORDS_AT_ONCE = 20_000, 1 << 20
#: Lengths and square sums of a block's cards leave it as a row of their own, of no term, in this bucket.
CARDS_BUCKET = -1
PACKED = "term string, blk int, n int, max_tf int, min_len int, ords array<smallint>, tfs array<int>, norms array<bigint>"
CARDS = "blk int, ords array<smallint>, tfs array<int>, norms array<bigint>"


def _terms(kind: str, text: str | None) -> list[str]:
    """The terms of a kind in a text, which is in lower case already, as often as they are in it."""
    if not text:
        return []
    return [text[i : i + 3] for i in range(len(text) - 2)] if kind == "trigrams" else KINDS[kind].findall(text)


class _Block:
    """The postings of one block, held as numbers: (term, place) pairs and counts."""

    def __init__(self, kind: str, blk: int):
        self.kind, self.blk, self.ids, self.cards = kind, blk, defaultdict(count().__next__), 0
        self.words, self.places, self.sizes, self.keys, self.tfs = array("i"), [], [], [], []

    def add(self, place: int, text: str | None) -> None:
        had = len(self.words)
        self.words.extend(map(self.ids.__getitem__, _terms(self.kind, text)))
        self.places.append(place)
        self.sizes.append(len(self.words) - had)
        self.cards = max(self.cards, place + 1)
        if len(self.words) >= WORDS_AT_ONCE:
            self._count()

    def _count(self) -> None:
        """Words so far become counts; all words of a card are counted at once."""
        key, tf = np.unique(np.array(self.words, np.int64) << 16 | np.repeat(np.array(self.places, np.int64), self.sizes), return_counts=True)
        self.keys.append(key)
        self.tfs.append(tf.astype(np.int32))
        self.words, self.places, self.sizes = array("i"), [], []

    def rows(self) -> Iterator[pa.RecordBatch]:
        """PACKED rows by term, TERMS at a time, and one for the cards. Counts that are all 1 are left out, as are those of trigrams."""
        self._count()
        names = sorted(self.ids)
        rank = np.empty(len(names), np.int64)
        rank[np.array([self.ids[w] for w in names], np.int64)] = np.arange(len(names))
        key, tf = np.concatenate(self.keys), np.concatenate(self.tfs)
        key = rank[key >> 16] << 16 | key & 0xFFFF
        order = np.argsort(key)
        term, ords, tf = key[order] >> 16, (key[order] & 0xFFFF).astype(np.int16), tf[order]
        length = np.bincount(ords, tf, self.cards).astype(np.int32)
        n = np.bincount(term, minlength=len(names)).astype(np.int32)
        first = np.concatenate([[0], n.cumsum()])
        for at in range(0, len(names), TERMS):
            f = first[at : at + TERMS + 1]
            some, o, t = n[at : at + TERMS], ords[f[0] : f[-1]], tf[f[0] : f[-1]]
            most = np.maximum.reduceat(t, f[:-1] - f[0])
            told = (most > 1) & (self.kind != "trigrams")
            lists = [pa.ListArray.from_arrays(pa.array((f - f[0]).astype(np.int32)), pa.array(o))]
            lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.where(told, some, 0).cumsum()]).astype(np.int32)), pa.array(t[np.repeat(told, some)]), mask=pa.array(~told)))
            yield self._batch(names[at : at + TERMS], some, most, np.minimum.reduceat(length[o], f[:-1] - f[0]), *lists, pa.nulls(len(some), pa.list_(pa.int64())))
        zero, of = np.zeros(1, np.int32), lambda x: pa.ListArray.from_arrays(pa.array([0, self.cards], pa.int32()), pa.array(x))
        norm2 = np.bincount(ords, tf.astype(np.float64) ** 2, self.cards).astype(np.int64)
        yield self._batch([""], zero + self.cards, zero, zero, of(np.arange(self.cards, dtype=np.int16)), of(length), of(norm2))

    def _batch(self, terms: list[str], n: np.ndarray, max_tf: np.ndarray, min_len: np.ndarray, *lists: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(terms), *map(pa.array, (np.full(len(n), self.blk, np.int32), n, max_tf, min_len)), *lists], ["term", "blk", "n", "max_tf", "min_len", "ords", "tfs", "norms"])


def _pack(kind: str):
    """For partitions (blk, ord, text) in order of blocks: PACKED rows, a block at a time. Holds the postings of one block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            for k, o, text in zip(b["blk"].to_pylist(), b["ord"].to_pylist(), b["text"], strict=True):
                if block is None or k != block.blk:
                    if block is not None:
                        yield from block.rows()
                    block = _Block(kind, k)
                block.add(o, text.as_py())
        if block is not None:
            yield from block.rows()

    return pack


@dataclass(frozen=True)
class Snapshot:
    """What a version of the index says: segments (name, docs, blocks), tombstone folders, live cards and words."""

    version: int
    segments: list[dict]
    gone: list[dict]
    nd: int
    words: int


class TermIndex:
    def __init__(self, spark: SparkSession, path: str, kind: str = "words", buckets: int = BUCKETS, block_docs: int = BLOCK_DOCS):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)
        said = self.versions.latest()[1]
        # what was chosen when the index was made stays
        self.kind, self.buckets, self.block_docs = said.get("kind", kind), said.get("buckets", buckets), min(said.get("block_docs", block_docs), MOST_DOCS)

    # ---- state ----

    def snapshot(self, version: int | None = None) -> Snapshot:
        v, said = self.versions.latest() if version is None else (version, self.versions.at(version))
        return Snapshot(v, said.get("segments", []), said.get("gone", []), said.get("nd", 0), said.get("words", 0))

    def _commit(self, base: int, segments: list[dict], gone: list[dict], nd: int, words: int) -> int:
        tables = {"blocks": [f"blocks/seg={s['name']}" for s in segments], "docs": [f"docs/seg={s['name']}" for s in segments], "gone": [g["folder"] for g in gone]}
        return self.versions.commit(base, {"kind": self.kind, "buckets": self.buckets, "block_docs": self.block_docs, "segments": segments, "gone": gone, "nd": nd, "words": words, "tables": tables})

    def _scan(self, table: str, schema: str, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*[f"{self.path}/{table}/seg={s['name']}" for s in segments])

    def _hidden(self, snap: Snapshot) -> DataFrame:
        """(id, until): cards that are hidden in segments before number `until`."""
        frames = [self.spark.read.schema("id string").parquet(f"{self.path}/{g['folder']}").withColumn("until", F.lit(g["seq"])) for g in snap.gone]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out.groupBy("id").agg(F.max("until").alias("until"))

    def _live(self, rows: DataFrame, snap: Snapshot) -> DataFrame:
        """Rows (id, seg, ..) without those that a later tombstone hides."""
        if not snap.gone:
            return rows
        known = rows.join(self._hidden(snap), "id", "left")
        return known.where("until is null or cast(left(seg, 8) as int) >= until").drop("until")

    def docs(self, snap: Snapshot | None = None) -> DataFrame:
        snap = snap or self.snapshot()
        return self._live(self._scan("docs", DOCS, snap.segments), snap)

    # ---- writing ----

    def _segment(self, cards: DataFrame, text: str, number: int) -> dict:
        """Write the postings of a new segment, from one pass over its texts, and then its cards, with what that pass told of them."""
        n = cards.count()
        blocks = max(1, -(-n // self.block_docs), min(SPREAD, n // LEAST_DOCS))
        made = {"name": f"{number:08d}-{uuid.uuid4().hex}", "docs": n, "blocks": blocks}
        scope = F.col("scope") if "scope" in cards.columns else F.lit(None).cast("string")
        said = F.translate(F.col(text), UPPER, LOWER) if self.kind == "trigrams" else F.lower(F.col(text))
        told = cards.select("id", scope.alias("scope"), said.alias("text")).selectExpr("id", "scope", "text", f"cast(pmod(xxhash64(id), {blocks}) as int) as blk", "xxhash64(text) as h")
        packed = self._placed(told.drop("scope"), blocks).select("blk", "ord", "text").mapInArrow(_pack(self.kind), PACKED)
        base = f"if(octet_length(term) = length(term), term, {X.unaccented('term')})" if self.kind == "words" else "term"
        self._write_blocks(packed.selectExpr(f"{base} as base", "*").withColumn("bucket", F.expr(f"if(term = '', {CARDS_BUCKET}, {self._bucket('base')})")), made)
        counted = self.spark.createDataFrame([], CARDS) if n == 0 else self.spark.read.schema(CARDS).parquet(f"{self.path}/blocks/seg={made['name']}/bucket={CARDS_BUCKET}")
        lengths = counted.selectExpr("blk", "inline(arrays_zip(ords, tfs, norms)) as (ord, len, norm2)")
        docs = self._placed(told.select("id", "blk", "h", "scope", "text" if self.kind == "trigrams" else F.lit(None).cast("string").alias("text")), blocks).drop("h")
        docs.join(lengths, ["blk", "ord"]).select("id", "blk", "ord", "len", "norm2", "scope", "text").sortWithinPartitions("blk", "ord").write.parquet(f"{self.path}/docs/seg={made['name']}")
        total = self.spark.read.parquet(f"{self.path}/docs/seg={made['name']}").agg(F.coalesce(F.sum("len"), F.lit(0))).first()[0]
        return made | {"words": int(total)}

    def _placed(self, cards: DataFrame, blocks: int) -> DataFrame:
        """cards (id, blk, h, ..) with ord, their places in their blocks, which lie in one partition each."""
        dealt = cards.repartition(min(MOST_PARTITIONS, 2 * blocks, max(FILES_AT_ONCE, blocks // BLOCKS_AT_ONCE)), "blk")  # by the number of blocks: few bytes make much work
        return dealt.withColumn("ord", F.expr("cast(row_number() over (partition by blk order by id, h) - 1 as smallint)"))

    def _write_blocks(self, rows: DataFrame, seg: dict) -> None:
        """Rows by bucket and slice of blocks: what a task sorts doesn't grow with the index, so it stays in memory."""
        slices = min(MOST_SLICES, max(1, -(-seg["docs"] // SLICE_DOCS)))
        to = F.expr(f"cast(greatest(bucket, 0) * {slices} + blk * {slices} div {seg['blocks']} as int)")
        # most terms are their own base: it is told again after the shuffle
        dealt = rows.withColumn("base", F.expr("nullif(base, term)")).repartitionById(self.buckets * slices, to).withColumn("base", F.coalesce("base", "term"))
        dealt.sortWithinPartitions("bucket", "base", "term", "blk").write.partitionBy("bucket").parquet(f"{self.path}/blocks/seg={seg['name']}")

    def _bucket(self, base: str) -> str:
        return f"cast(pmod(xxhash64(left({base}, {BUCKET_LETTERS})), {self.buckets}) as int)"

    def append(self, cards: DataFrame, text: str = "fact") -> int:
        """Add cards (id, text, and scope if there is one) that the index doesn't have."""
        snap = self.snapshot()
        new = self._segment(cards, text, snap.version + 1)
        return self._commit(snap.version, [*snap.segments, new], snap.gone, snap.nd + new["docs"], snap.words + new["words"])

    def _hide(self, ids: DataFrame, snap: Snapshot) -> tuple[list[dict], int, int]:
        """Tombstones for those of ids that the index has, and how many cards and words that takes away. Reads ids and lengths of cards, no postings."""
        known = self.docs(snap).select("id", "len").join(ids.select("id").distinct(), "id", "left_semi")
        folder = self.versions.write(known, "gone")
        n, words = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return [*snap.gone, {"folder": folder, "seq": snap.version + 1}] if n else snap.gone, n, int(words)

    def delete(self, ids: DataFrame) -> int:
        """Take cards away (id)."""
        snap = self.snapshot()
        gone, n, words = self._hide(ids, snap)
        return self._commit(snap.version, snap.segments, gone, snap.nd - n, snap.words - words)

    def upsert(self, cards: DataFrame, text: str = "fact") -> int:
        """Add cards, in place of those with their ids; both in one commit."""
        snap = self.snapshot()
        gone, n, words = self._hide(cards, snap)
        new = self._segment(cards, text, snap.version + 1)
        return self._commit(snap.version, [*snap.segments, new], gone, snap.nd - n + new["docs"], snap.words - words + new["words"])

    def merge(self, fewest: int = 2) -> int | None:
        """One segment of all, without hidden cards and without tombstones, if there are so many segments or any tombstone. Texts aren't read again."""
        snap = self.snapshot()
        if len(snap.segments) < fewest and not snap.gone:
            return None
        number = snap.version + 1
        name = f"{number:08d}-{uuid.uuid4().hex}"
        cards = self._scan("docs", DOCS, snap.segments)
        live = self._live(cards.select("id", "seg", "blk", "ord"), snap).select("seg", "blk", "ord")
        # blocks of a few cards go together, in turn
        table, to, held = [], 0, 0
        for r in live.groupBy("seg", "blk").agg(F.count("*").alias("n")).orderBy("seg", "blk").collect():  # a row for a block
            if held and held + r["n"] > self.block_docs:
                to, held = to + 1, 0
            held += r["n"]
            table.append((r["seg"], r["blk"], to))
        joined = self.spark.createDataFrame(table, "seg string, blk int, to int")
        order = Window.partitionBy("to").orderBy("seg", "blk", "ord")
        folder = self.versions.write(live.join(F.broadcast(joined), ["seg", "blk"]).withColumn("place", F.row_number().over(order) - 1), "places")
        places = self.spark.read.schema("seg string, blk int, ord smallint, to int, place int").parquet(f"{self.path}/{folder}")
        # for a block the new place of each of its cards, by the old one; null where it is hidden
        moved = cards.select("seg", "blk", "ord").join(places, ["seg", "blk", "ord"], "left").groupBy("seg", "blk").agg(F.max("to").alias("to"), F.expr("array_sort(collect_list(struct(ord, cast(place as smallint) as place))).place as places"))
        old = self._scan("blocks", BLOCKS, snap.segments).where(f"bucket <> {CARDS_BUCKET}").join(moved.where("to is not null"), ["seg", "blk"])
        told = old.selectExpr("base", "term", "bucket", "to as blk", "min_len", "filter(zip_with(ords, coalesce(tfs, transform(ords, o -> 1)), (o, f) -> struct(places[o] as ord, f as tf)), x -> x.ord is not null) as ps").where("size(ps) > 0")
        # least lengths are bounds: those of hidden cards may stay
        packed = told.groupBy("base", "term", "bucket", "blk").agg(F.flatten(F.collect_list("ps")).alias("ps"), F.min("min_len").alias("min_len"))
        tfs = "cast(null as array<int>) as tfs" if self.kind == "trigrams" else "if(array_max(ps.tf) > 1, ps.tf, null) as tfs"
        made = {"name": name, "docs": snap.nd, "words": snap.words, "blocks": to + 1}
        self._write_blocks(packed.selectExpr("base", "term", "blk", "size(ps) as n", "array_max(ps.tf) as max_tf", "min_len", "ps.ord as ords", tfs, "bucket"), made)
        kept = cards.join(places, ["seg", "blk", "ord"]).selectExpr("id", "to as blk", "cast(place as smallint) as ord", "len", "norm2", "scope", "text")
        kept.repartition("blk").sortWithinPartitions("blk", "ord").write.parquet(f"{self.path}/docs/seg={name}")
        return self._commit(snap.version, [made], [], snap.nd, snap.words)

    def drop(self) -> None:
        """Delete the index and its files."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    # ---- searching ----

    def rows(self, words: list[str], snap: Snapshot, prefix: bool = False, folded: bool = False) -> DataFrame:
        """Block rows of the terms that words stand for, with q, the word: only their buckets are listed, only their row groups read."""
        term = "base" if folded else "term"
        forms = {w: X.fold(w) if self.kind == "words" else w for w in words}
        near = [f"(startswith(base, {X.lit(b)})" if prefix else f"(base = {X.lit(b)}" for b in forms.values()]
        at = [f" and bucket = {self._bucket(X.lit(b))})" if not prefix or len(b) >= BUCKET_LETTERS else ")" for b in forms.values()]
        match = f"filter({X.array_of(words)}, q -> {f'startswith({term}, q)' if prefix else f'{term} = q'})" if words else "cast(array() as array<string>)"
        found = self._scan("blocks", BLOCKS, snap.segments).where(" or ".join(map("".join, zip(near, at, strict=True))) or "false")
        return found.withColumn("q", F.explode(F.expr(match)))

    def postings(self, rows: DataFrame, snap: Snapshot, wanted: str = "true") -> DataFrame:
        """(q, id, len, scope, norm2, f) from block rows, f summed over the terms of a word; live cards only. wanted: a condition for the blocks that rows are of."""
        flat = rows.selectExpr("q", "seg", "blk", "inline(arrays_zip(ords, coalesce(tfs, cast(array() as array<int>)))) as (ord, tf)").groupBy("q", "seg", "blk", "ord").agg(F.sum(F.coalesce("tf", F.lit(1))).alias("f"))
        cards = self._live(self._scan("docs", DOCS, snap.segments).where(wanted), snap)
        return flat.join(cards.select("seg", "blk", "ord", "id", "len", "scope", "norm2"), ["seg", "blk", "ord"]).select("q", "id", "len", "scope", "norm2", "f")

    def bm25(self, words: list[str], n: int = 30, prefix: bool = False, folded: bool = False, scope: str | None = None, skip_from: int = SKIP_FROM) -> DataFrame:
        """(id, score) of the n best cards. Frequencies are those of all live cards, whatever the scope."""
        snap = self.snapshot()
        words = list(dict.fromkeys(w for w in words if w))
        rows = self.rows(words, snap, prefix, folded)
        if not prefix and not snap.gone and sum(s["blocks"] for s in snap.segments) > skip_from:
            skipped = self._skipping(rows, snap, n, scope)
            if skipped is not None:
                return skipped
        hit = self.postings(rows, snap)
        df = hit.groupBy("q").agg(F.count("*").alias("df"))  # as many rows as words
        inside = hit if scope is None else hit.where(F.col("scope") == scope)
        return self._best(inside.join(F.broadcast(df), "q"), snap, n)

    def _part(self, snap: Snapshot, f: str = "f", length: str = "len") -> str:
        """SQL for what a word adds to a card's score."""
        al = max(snap.words / max(snap.nd, 1), 1e-300)
        idf = f"ln(({snap.nd} - df + 0.5D) / (df + 0.5D))"
        return f"if({idf} <= 0, 0.000001D, {idf}) * {f} * {K1 + 1}D / ({f} + {K1}D * (1 - {B}D + {B}D * {length} / {al!r}D))"

    def _best(self, hit: DataFrame, snap: Snapshot, n: int) -> DataFrame:
        return hit.groupBy("id").agg(F.sum(F.expr(self._part(snap))).alias("score")).orderBy(F.desc("score"), "id").limit(n)

    def _skipping(self, rows: DataFrame, snap: Snapshot, n: int, scope: str | None) -> DataFrame | None:
        """The n best by blocks whose bound allows it; None where a word stands for several terms, whose cards can't be counted from block heads."""
        heads = rows.select("q", "term", "seg", "blk", "n", "max_tf", "min_len")
        words = heads.groupBy("q").agg(F.sum("n").alias("df"), F.count_distinct("term").alias("terms")).collect()  # a row for a word
        if any(r["terms"] > 1 for r in words):
            return None
        df = self.spark.createDataFrame([(r["q"], r["df"]) for r in words], "q string, df long")
        bound = self._part(snap, "max_tf", "min_len")
        # a card's words are in one block of cards, so bounds add up over the words of a block
        blocks = heads.join(F.broadcast(df), "q").groupBy("seg", "blk").agg(F.sum(F.expr(bound)).alias("bound"))
        top = blocks.orderBy(F.desc("bound"), "seg", "blk").limit(FIRST)

        first = self._among(rows, top, df, snap, n, scope).collect()  # n rows at most
        least = first[-1]["score"] if len(first) == n else 0.0
        # ties with the n-th best may win by id; a little room for sums in another order
        return self._among(rows, blocks.where(F.col("bound") >= least * (1 - 1e-12)), df, snap, n, scope)

    def _among(self, rows: DataFrame, picked: DataFrame, df: DataFrame, snap: Snapshot, n: int, scope: str | None) -> DataFrame:
        """The n best cards in the blocks picked; (seg, blk) is pushed to the scan as a list where there are few, else joined."""
        wanted = self._listed(picked)
        rows = rows.join(picked.select("seg", "blk"), ["seg", "blk"], "left_semi") if wanted is None else rows.where(wanted)
        hit = self.postings(rows, snap, wanted or "true")
        inside = hit if scope is None else hit.where(F.col("scope") == scope)
        return self._best(inside.join(F.broadcast(df), "q"), snap, n)

    def _listed(self, blocks: DataFrame, most: int = 1000) -> str | None:
        """A condition that picks blocks (seg, blk), for the scan to push down; None where there are more than `most`."""
        few = blocks.select("seg", "blk").distinct().limit(most + 1).collect()
        if len(few) > most:
            return None
        by_seg: dict[str, list[int]] = {}
        for r in few:
            by_seg.setdefault(r["seg"], []).append(r["blk"])
        return " or ".join(f"(seg = {X.lit(s)} and blk in ({', '.join(map(str, b))}))" for s, b in by_seg.items()) or "false"

    def cosine(self, counts: dict[str, int], k: int = 10) -> DataFrame:
        """(id, score): cosine of raw term counts with those of a query; lengths of cards come from the table of cards."""
        snap = self.snapshot()
        hit = self.postings(self.rows(list(counts), snap), snap)
        weight = "case " + " ".join(f"when q = {X.lit(w)} then {v}" for w, v in counts.items()) + " else 0 end" if counts else "0"
        dots = hit.groupBy("id", "norm2").agg(F.expr(f"sum(f * ({weight}))").alias("d"))
        norm = sum(v * v for v in counts.values()) ** 0.5 or 1.0
        return dots.where("d > 0").selectExpr("id", f"d / (sqrt(cast(norm2 as double)) * {norm!r}D) as score").orderBy(F.desc("score"), "id").limit(k)

    def containing(self, value: str, rarest: int = 4) -> DataFrame:
        """(id, text): cards whose text (A-Z lowered) contains value; `trigrams` indexes only.

        Block heads tell how frequent each trigram of value is; cards with all of the `rarest` few are candidates, their blocks of texts are read and
        looked at. Values of under three characters are looked for in all texts.
        """
        if self.kind != "trigrams":
            raise ValueError("substrings need an index of trigrams")
        snap, low = self.snapshot(), value.translate(str.maketrans(UPPER, LOWER))
        docs = self._scan("docs", DOCS, snap.segments)
        said = F.contains("text", F.lit(low))
        if len(low) < 3:
            return self._live(docs.where(said), snap).select("id", "text")
        grams = list(dict.fromkeys(low[i : i + 3] for i in range(len(low) - 2)))
        rows = self.rows(grams, snap)
        sizes = {r["q"]: r["n"] for r in rows.groupBy("q").agg(F.sum("n").alias("n")).collect()}  # a row for a trigram of value
        if len(sizes) < len(grams):
            return docs.where("false").select("id", "text")
        chosen = sorted(grams, key=lambda g: (sizes[g], g))[:rarest]
        flat = self.rows(chosen, snap).select("q", "seg", "blk", F.explode("ords").alias("ord"))
        found = flat.groupBy("seg", "blk", "ord").agg(F.count("*").alias("k")).where(F.col("k") == len(chosen))
        wanted = self._listed(found)
        docs = docs if wanted is None else docs.where(wanted)  # read only these blocks of texts
        return self._live(docs.join(found.select("seg", "blk", "ord"), ["seg", "blk", "ord"], "left_semi").where(said), snap).select("id", "text")
