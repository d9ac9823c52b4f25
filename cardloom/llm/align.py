"""Tokens of two vocabularies laid side by side, and how often their ids go together in the corpus.

Tokenizer A is byte-level BPE (a `tokenizers` file) over space + text, B a SentencePiece model, which puts the space there
itself. Where tokens of both end at the same byte, the text is cut: between two cuts lies a group of A tokens and the group of B tokens
that spell the same bytes. Every A token of a group is linked with every B token of it. The count of a pair of ids is the number of
documents that link it anywhere; a document's links are weighed by these counts.

Two passes. The first tokenises each text once, digests its groups, and writes postings: for each A id in a slice of documents one row with
arrays of (B id, place of the document in the slice, links in it). The second is a cogroup on the A id: postings are shuffled by
it and sorted within partitions (Spark spills), and a task streams them run by run: it counts documents for each B id, takes the maximum, and
emits what each posting gives its document. These contributions, arrays by slice, are summed by document. An id with more than `run` postings
is dealt out over as many runs as it takes, by slice; its counts are made before, map-side first, and go ahead of each
of its runs in the same sorted stream. So a run holds about `run` postings whatever the corpus has.

Texts of more than SLICE_CHARS characters are tokenised in parts, cut between a letter and a space before a letter, where neither tokenizer has a
token across; a text without such places is taken whole.

Defined results: null and empty texts, and texts that aren't given back byte for byte (U+2581 in the text; A gives back all), have no
tokens: zeros, and '' as digest; repeated rows are documents of their own; ties for the highest count all count; special tokens' strings
are plain text; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import BATCH_ROWS, Temporary, give_back, materialise, read

VOCABULARY_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Documents of a slice, the unit of postings (1,024 at most, so that row numbers of up to a million partitions leave room for the place in a slice); postings of a run.
SLICE = 512
RUN = 1 << 18
SLICE_CHARS = 500_000
#: Contributions that a task adds up before it emits them.
HELD = 1 << 20
SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
# Fixed value: how byte-level vocabularies of this kind part a text before they merge.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes may differ between versions of Unicode, and thus between the two libraries: all beyond Latin and common punctuation, odd numbers and separators.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e]")


class SideA:
    """The byte-level vocabulary of a `tokenizers` file. Plain texts are encoded by tiktoken with the same merges, which is several times faster; others by `tokenizers`."""

    def __init__(self, path: str):
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(path)
        self.bpe.encode_special_tokens = True
        self.bpe.no_truncation()
        decoded = {c: bytes([b]) for b, c in byte_characters().items()}
        special = {t.content for t in self.bpe.get_added_tokens_decoder().values()}
        self.surface = [b""] * self.bpe.get_vocab_size()
        for token, i in self.bpe.get_vocab(with_added_tokens=True).items():
            self.surface[i] = token.encode() if token in special else b"".join(decoded[c] for c in token)
        ranks = {x: i for i, x in enumerate(self.surface) if self.bpe.id_to_token(i) not in special}
        if not all(bytes([x]) in ranks for x in range(256)):
            raise ValueError("a byte has no token: texts wouldn't come back whole")
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = [ranks[b"".join(decoded[c] for c in "".join(m if isinstance(m, list) else m.split(" ")))] for m in merges]
        # merges in the order of ids are what tiktoken goes by
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None

    def encode(self, text: str) -> list[int]:
        if self.fast is None or UNUSUAL.search(text):
            return self.bpe.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class SideB:
    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = []
        for i in range(self.sp.get_piece_size()):
            p = self.sp.id_to_piece(i)
            self.surface.append(bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace("\u2581", " ").encode())

    def encode(self, text: str) -> list[int]:
        """Ids of text, which begins with a space; the model puts one there itself."""
        return self.sp.encode(text[1:], num_threads=1)


_sides: dict[tuple, tuple] = {}


def sides(path_a: str, path_b: str) -> tuple[SideA, SideB, np.ndarray, np.ndarray, np.ndarray]:
    if (path_a, path_b) not in _sides:
        a, b = SideA(path_a), SideB(path_b)
        names = np.array([[f"{i}{sign}" for i in range(max(len(a.surface), len(b.surface)))] for sign in ",|;"], object)
        _sides[path_a, path_b] = a, b, np.array([len(x) for x in a.surface]), np.array([len(x) for x in b.surface]), names
    return _sides[path_a, path_b]


def parts(text: str) -> Iterator[str]:
    """The text in parts that begin with a space and are tokenised alike alone and together."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        m = SAFE_CUT.search(text, at + SLICE_CHARS)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def tokens(text: str | None, a: SideA, b: SideB) -> tuple[list[int], list[int]]:
    """Ids of both sides; none where a side doesn't give the text back."""
    if not text:
        return [], []
    ids_a: list[int] = []
    ids_b: list[int] = []
    try:
        for part in parts(" " + text):
            two, want = b.encode(part), part.encode()
            # A has a token for every byte, so it gives back all that it is given
            if b"".join(map(b.surface.__getitem__, two)) != want:
                return [], []
            one = a.encode(part)
            ids_a += one
            ids_b += two
    except UnicodeEncodeError:  # a lone surrogate has no bytes
        return [], []
    return ids_a, ids_b


def align(ids_a: list[int], ids_b: list[int], len_a: np.ndarray, len_b: np.ndarray, names: np.ndarray) -> tuple[int, int, str, np.ndarray, np.ndarray]:
    """n_groups, n_links, digest of the groups, distinct linked pairs (a << 32 | b) and the links of each."""
    if not ids_a:
        return 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.array(ids_a), np.array(ids_b)
    ends_a, ends_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    size_a, size_b = np.bincount(group_a), np.bincount(group_b)
    # both sides in the order of the digest, each id with the sign that follows it: , within a side, | between sides, ; between groups
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    text = np.empty(len(a) + len(b), np.int64)
    sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sign_a[first_a + size_a - 1], sign_b[first_b + size_b - 1] = 1, 2
    text[np.arange(len(a)) + first_b[group_a]] = a + sign_a * len(names[0])
    text[np.arange(len(b)) + (first_a + size_a)[group_b]] = b + sign_b * len(names[0])
    digest = hashlib.sha256("".join(names.ravel()[text].tolist())[:-1].encode()).hexdigest()
    pairs, links = linked(a, b, size_a, size_b)
    return len(cuts), int((size_a * size_b).sum()), digest, pairs, links


def linked(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs and their links, a bounded number of links at a time; a group too large for that by its distinct ids."""
    first_a, first_b, n = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, size_a * size_b
    found, many = [], []
    for g in np.flatnonzero(n > at_once).tolist():
        x, cx = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        y, cy = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        found.append((x[:, None] << 32 | y[None, :]).ravel())
        many.append((cx[:, None] * cy[None, :]).ravel())
    rest = np.flatnonzero(n <= at_once)
    block = (np.cumsum(n[rest]) - n[rest]) // at_once
    for own in np.split(rest, np.flatnonzero(np.diff(block)) + 1) if len(rest) else []:
        k = n[own]
        inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        wide = np.repeat(size_b[own], k)
        p, c = np.unique(a[np.repeat(first_a[own], k) + inside // wide] << 32 | b[np.repeat(first_b[own], k) + inside % wide], return_counts=True)
        found.append(p)
        many.append(c)
    if len(found) == 1:
        return found[0], many[0]
    p, where = np.unique(np.concatenate(found), return_inverse=True)
    return p, np.bincount(where, np.concatenate(many)).astype(np.int64)


#: Columns of what the first pass writes: of documents, then of postings.
DOC = [("of", T.LongType()), ("place", T.IntegerType()), ("key", None), ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType())]
POSTINGS = [("a", T.IntegerType()), ("slice", T.LongType()), ("b", T.ArrayType(T.IntegerType())), ("doc", T.ArrayType(T.IntegerType())), ("links", T.ArrayType(T.LongType()))]


def postings(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = MODEL_B) -> DataFrame:
    """From (row, text, key), row being unique: one row for each document (a is null), with its slice and place in it, and the postings of each slice (of is null). A slice is named after its first row."""
    columns = [n for n, _ in (*DOC, *POSTINGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, len_a, len_b, names = sides(path_a, path_b)
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                batch = big.slice(at, SLICE)
                rows = batch.column(0).to_pylist()
                told, pairs, links = [], [], []
                for text in batch.column(1).to_pylist():
                    ids_a, ids_b = tokens(text, a, b)
                    n_groups, n_links, digest, p, m = align(ids_a, ids_b, len_a, len_b, names)
                    told.append((len(ids_a), len(ids_b), n_groups, n_links, digest))
                    pairs.append(p)
                    links.append(m)
                doc = np.repeat(np.arange(len(rows)), [len(p) for p in pairs])
                pair, link = np.concatenate(pairs), np.concatenate(links)
                order = np.argsort(pair, kind="stable")
                pair, link, doc = pair[order], link[order], doc[order]
                ids, first = np.unique(pair >> 32, return_index=True)
                offsets = pa.array([*first.tolist(), len(pair)], pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((pair & 0xFFFFFFFF).astype(np.int32), doc.astype(np.int32), link)]
                n, k = len(rows), len(ids)
                values = [pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.int64(),) * 4 + (pa.string(),), strict=True)]
                own = [pa.array(np.full(n, rows[0])), pa.array(np.arange(n, dtype=np.int32)), batch.column(2), *values]
                of_slice = [pa.array(ids.astype(np.int32)), pa.array(np.full(k, rows[0])), *lists]
                yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, x.type) for x in of_slice)], names=columns)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(k, x.type) for x in own), *of_slice], names=columns)
        give_back()

    fields = [T.StructField(n, docs.schema["key"].dataType if t is None else t) for n, t in (*DOC, *POSTINGS)]
    return docs.select("row", "text", "key").mapInArrow(run, T.StructType(fields))


def _by_id(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """a, ids, n (arrays) from keys a << 32 | id."""
    a, first = np.unique(keys >> 32, return_index=True)
    offsets = pa.array([*first.tolist(), len(keys)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((keys & 0xFFFFFFFF).astype(np.int32), n)]
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), *lists], names=["a", "ids", "n"])


def counted(lists: DataFrame) -> DataFrame:
    """a, ids, n: for each A id of postings (a, b) the B ids, and how many postings each has. Tasks count what they read, then a task an id adds up."""

    def summed(parts: list) -> list:
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype(np.int64))]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            a, b = batch.column(0).to_numpy().astype(np.int64), batch.column(1)
            held.append(np.unique(np.repeat(a << 32, np.diff(b.offsets.to_numpy())) | b.flatten().to_numpy(), return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = summed(held)
                if len(held[0][0]) > HELD:
                    yield _by_id(*held[0])
                    held = []
        if held:
            yield _by_id(*summed(held)[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for i, a in enumerate(batch.column(0).to_pylist()):
                if a != now:
                    if held:
                        yield _by_id(*summed(held)[0])
                    now, held = a, []
                held.append((batch.column(1)[i].values.to_numpy() | np.int64(a << 32), batch.column(2)[i].values.to_numpy()))
                if len(held) > 64:
                    held = summed(held)
        if held:
            yield _by_id(*summed(held)[0])

    schema = "a int, ids array<int>, n array<long>"
    return lists.select("a", "b").mapInArrow(count, schema).repartition("a").sortWithinPartitions("a").mapInArrow(add, schema)


def contributions(stream: DataFrame) -> DataFrame:
    """slice, doc, best, total (arrays) from postings sorted by (a, salt, head first): sums of what a task's runs give each document of a slice."""

    def counts(b: np.ndarray, heads: list) -> tuple[np.ndarray, int]:
        if heads:
            ids, n = (np.concatenate(x) for x in zip(*heads, strict=True))
            order = np.argsort(ids)
            return n[order][np.searchsorted(ids[order], b)], int(n.max())
        _, where, n = np.unique(b, return_inverse=True, return_counts=True)
        return n[where], int(n.max())

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            rows, best, total = (np.concatenate(x) for x in zip(*held, strict=True))
            row, where = np.unique(rows, return_inverse=True)
            sums = [np.zeros(len(row), np.int64) for _ in range(2)]
            np.add.at(sums[0], where, best)
            np.add.at(sums[1], where, total)
            slices, first = np.unique(row >> 10, return_index=True)
            offsets = pa.array([*first.tolist(), len(row)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((row & 1023).astype(np.int32), *sums)]
            whole = pa.RecordBatch.from_arrays([pa.array(slices), *lists], names=["slice", "doc", "best", "total"])
            for at in range(0, len(slices), 1000):
                yield whole.slice(at, 1000)
            held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads, own, held, n = None, [], [], [], 0

        def close() -> int:
            if not own:
                return 0
            b, row, m = (np.concatenate(x) for x in zip(*own, strict=True))
            c, top = counts(b, heads)
            held.append((row, np.where(c == top, m, 0), m * c))
            return len(b)

        for batch in batches:
            ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)  # a, salt, head (0) or postings (1)
            starts = np.flatnonzero(np.any(np.diff(ids, axis=0, prepend=ids[:1] - 1) != 0, axis=1)).tolist()
            for i, j in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if (k := tuple(ids[i, :2].tolist())) != key:
                    n += close()
                    key, heads, own = k, [], []
                    if n > HELD:
                        yield from flush(held)
                        n = 0
                part = batch.slice(i, j - i)
                b, doc, m = (part.column(x).flatten().to_numpy() for x in (4, 5, 6))
                if ids[i, 2] == 0:
                    heads.append((b, m))
                else:
                    own.append((b, np.repeat(part.column(3).to_numpy() << 10, np.diff(part.column(4).offsets.to_numpy())) | doc, m))
        close()
        yield from flush(held)
        give_back()

    return stream.mapInArrow(run, "slice long, doc array<int>, best array<long>, total array<long>")


def by_document(given: DataFrame) -> DataFrame:
    """slice, doc, n_best, count_sum: contributions of all tasks summed, a slice after the other from sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, SLICE), np.int64)

        def told() -> pa.RecordBatch:
            some = np.flatnonzero(sums[1])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), now)), pa.array(some.astype(np.int32)), pa.array(sums[0, some]), pa.array(sums[1, some])], names=["slice", "doc", "n_best", "count_sum"])

        for batch in batches:
            for i, s in enumerate(batch.column(0).to_pylist()):
                if s != now:
                    if now is not None:
                        yield told()
                    now, sums = s, np.zeros((2, SLICE), np.int64)
                doc, best, total = (batch.column(k)[i].values.to_numpy() for k in (1, 2, 3))
                np.add.at(sums[0], doc, best)
                np.add.at(sums[1], doc, total)
        if now is not None:
            yield told()
        give_back()

    return given.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice long, doc int, n_best long, count_sum long")


def weigh(docs: DataFrame, key: str = "doc_id", text_col: str = "text", path_a: str = VOCABULARY_A, path_b: str = MODEL_B, run: int = RUN) -> DataFrame:
    """One row for each row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    tmp = Temporary()
    told = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{key}`").alias("key"))
    found = tmp.keep(postings(told, path_a, path_b), "postings", "zstd", batch=BATCH_ROWS)
    lists = found.where("a is not null").select("a", "slice", "b", "doc", "links")
    # as many runs as an id needs: at most as many rows as the vocabulary has ids
    runs = F.broadcast(lists.groupBy("a").agg(F.ceil(F.sum(F.size("b")) / run).alias("runs")).where("runs > 1"))
    dealt = lists.join(runs, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("slice"), F.col("runs")), F.lit(0)))
    # a row for each id that is dealt out, with arrays over the ids of B at most
    whole = counted(lists.join(runs, "a", "left_semi")).join(runs, "a")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("salt")
    heads = whole.select("a", salts, F.lit(0).alias("kind"), F.lit(0).cast("long").alias("slice"), F.col("ids").alias("b"), F.col("ids").alias("doc"), F.col("n").alias("links"))
    stream = dealt.select("a", "salt", F.lit(1).alias("kind"), "slice", "b", "doc", "links").unionByName(heads)
    given = contributions(stream.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind"))
    sums = by_document(given).withColumnsRenamed({"slice": "of", "doc": "place"})
    zero = F.lit(0).cast("long")
    told = found.where("a is null").join(sums, ["of", "place"], "left").select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    out = materialise(told, "alignment", "zstd", batch=10_000)
    tmp.drop()
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weigh(read(spark, sf_dir, "documents").select("doc_id", "text"))
