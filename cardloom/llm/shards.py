"""Training-order materialisation of token ids.

Documents are tokenised and put back to back, an end token after each; what a task reads is one stream, cut into
sequences of `seq_len` tokens (only the last sequence of a task is padded, with end tokens). The sequences are counted
in the order in which they were tokenised; a keyed Feistel permutation with cycle-walking turns that count into a
global slot, so that slots 0..N-1 are each taken once and the order looks random but can be recomputed from the key.
Shard s holds slots [s * shard_rows, (s + 1) * shard_rows) and is written by one task as one file of fixed-stride
records (seq_len little-endian uint16 ids): record i of the training order is at byte (i mod shard_rows) * 2 * seq_len
of shard i div shard_rows, so a reader can start anywhere and go on sequentially. A document is the `n_tokens` ids from
token `start` of sequence `first_seq` on, and over into the following sequences' slots.

On the way ids are compressed: by block in the token table, and in the shuffle all sequences of a task that go to one
shard as one piece. A writer holds one shard (32 MB by default).

A task writes under a name of its own and renames at the end; an attempt that finds the shard already there drops its
own file, so repeated and speculative attempts are harmless, also where a rename may not overwrite. Shards carry the number of the
run that wrote them, and only the manifest, written last, says which run counts. A folder with a manifest is in use: a second
run there is an error, also one that began before the first had ended. What failed attempts and runs that died leave is
deleted when a run has published its manifest, and so is the token table.

Defined results: null texts count as empty; an empty text is only the end token; long texts span many sequences;
repeated rows each have a place of their own; a null key is kept; an empty table gives no shards and an empty
manifest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import arrow_map, column, materialise, mix, new_path, read, release

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
SEQ_LEN = 256
SHARD_ROWS = 1 << 16
KEY = 20240131
ROUNDS = 6
CODEC, LEVEL = "zstd", 5
#: Bytes of ids in a block of the token table, and those that a task sorts into shards at once.
BLOCK_BYTES = 1 << 20
HELD_BYTES = 1 << 26

# Fixed value: how the vocabulary's tokenizer parts a text, in terms of Python's own character classes.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_odd: list[frozenset[str]] = []


def _oddities() -> frozenset[str]:
    """Characters that Python's classes place elsewhere: numbers that are no decimal digits, and U+001C to U+001F."""
    if not _odd:
        numbers = (chr(c) for c in range(0x80, 0x110000) if chr(c).isalnum() and unicodedata.category(chr(c)) in ("No", "Nl"))
        _odd.append(frozenset(numbers) | frozenset("\x1c\x1d\x1e\x1f"))
    return _odd[0]


class Tokenizer(dict):
    """Part of a text to its ids as little-endian uint16; remembers parts, and forgets all when there are too many."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(ranks.values()) > 0xFFFF:
            raise ValueError("ids don't fit 16 bits")
        self.bpe = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, part: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        self[part] = out = array("H", self.bpe._encode_single_piece(part)).tobytes() if sys.byteorder == "little" else np.array(self.bpe._encode_single_piece(part), "<u2").tobytes()
        return out

    def encode(self, text: str) -> bytes:
        if not _oddities().isdisjoint(set(text)):
            return np.array(self.bpe.encode_ordinary(text), "<u2").tobytes()
        return b"".join(map(self.__getitem__, PARTS.findall(text)))


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network over the next even power of two, walked until below n."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        v = (left << half) | right
        out[todo] = v
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def unfeistel(y: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """The inverse of feistel()."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = y.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        v = out[todo]
        left, right = v >> half, v & mask
        for k in keys[::-1]:
            left, right = right ^ (mix(left ^ k) & mask), left
        v = (left << half) | right
        out[todo] = v
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """Ids as compressed little-endian uint16, so that phrases said again are found."""
    return pa.Codec(CODEC, compression_level=LEVEL).compress(ids.astype("<u2", copy=False).tobytes(), asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    """The n ids of pack()."""
    return np.frombuffer(pa.decompress(blob, 2 * n, CODEC, asbytes=True), "<u2")


#: (key, at, n_tokens, crc32) of a document, at: its first token in the task's stream; or (first, n_seq, block): packed sequences, first: the number of the first one in the task.
_TOKENS = [T.StructField(n, T.LongType()) for n in ("at", "n_tokens", "tokens_crc32", "first", "n_seq")] + [T.StructField("block", T.BinaryType())]


def tokenise(docs: DataFrame, key: str, text_col: str, vocabulary: str, seq_len: int) -> DataFrame:
    """Rows of documents and of blocks of sequences (see _TOKENS), and `part`: the task they come from."""
    key_type = T.StructField("key", docs.schema[key].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        tok, end, kind = tokenizer(vocabulary), np.array([END], "<u2").tobytes(), to_arrow_type(key_type.dataType)
        at = first = 0
        rest, waiting = [], 0  # ids that aren't in a block yet, and their bytes

        def block(raw: bytes) -> pa.RecordBatch:
            n = len(raw) // (2 * seq_len)
            row = [None, None, None, None, first, n, pack(np.frombuffer(raw, "<u2"))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [kind, *[pa.int64()] * 5, pa.binary()], strict=True)], names=names)

        names = ["key", *(f.name for f in _TOKENS)]
        for big in batches:
            for b in (big.slice(i, 128) for i in range(0, big.num_rows, 128)):
                tokens = [(tok.encode(t) if t else b"") + end for t in column(b, text_col)]
                n = np.array([len(x) // 2 for x in tokens], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                none = pa.nulls(len(n), pa.int64())
                keys = b.column(b.schema.get_field_index(key)).cast(kind)
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(n), pa.array([zlib.crc32(x) for x in tokens], pa.int64()), none, none, pa.nulls(len(n), pa.binary())], names=names)
                rest += tokens
                waiting += sum(map(len, tokens))
                if waiting >= BLOCK_BYTES:
                    raw = b"".join(rest)
                    whole = len(raw) // (2 * seq_len) * 2 * seq_len
                    for i in range(0, whole, BLOCK_BYTES // (2 * seq_len) * 2 * seq_len or 2 * seq_len):
                        piece = raw[i : min(whole, i + (BLOCK_BYTES // (2 * seq_len) * 2 * seq_len or 2 * seq_len))]
                        yield block(piece)
                        first += len(piece) // (2 * seq_len)
                    rest, waiting = [raw[whole:]], len(raw) - whole
        if waiting:
            raw = b"".join(rest)
            raw += end * (-(len(raw) // 2) % seq_len)
            yield block(raw)

    out = docs.select(key, text_col).mapInArrow(run, T.StructType([key_type, *_TOKENS]))
    return out.withColumn("part", F.spark_partition_id())


def _place(tokens: DataFrame, base: dict[int, int], total: int, seq_len: int, shard_rows: int, order_key: int) -> DataFrame:
    """(shard, n, slots, chunk): the sequences of a task that go to one shard, packed, and their slots within the shard."""
    sent = tokens.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, slot = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
            order = np.argsort(slot)
            ids, slot = ids[order], slot[order]
            shards, at = np.unique(slot // shard_rows, return_index=True)
            ends = [*at[1:], len(slot)]
            within = (slot % shard_rows).astype("<i4")
            return pa.RecordBatch.from_arrays(
                [pa.array(shards.astype(np.int32)), pa.array(np.array(ends) - at, pa.int64()), pa.array([within[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.array([pack(ids[a:b].ravel()) for a, b in zip(at, ends, strict=True)], pa.binary())],
                names=["shard", "n", "slots", "chunk"],
            )

        for b in batches:
            for part, first, n, blob in zip(column(b, "part"), column(b, "first"), column(b, "n_seq"), column(b, "block"), strict=True):
                index = sent.value[part] + first + np.arange(n)
                held.append((unpack(blob, n * seq_len).reshape(n, seq_len), feistel(index, total, order_key)))
                size += n * seq_len * 2
                if size >= HELD_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    blocks = tokens.where("block is not null").select("part", "first", "n_seq", "block")
    return blocks.mapInArrow(run, "shard int, n long, slots binary, chunk binary")


def publish(store: fs.FileSystem, name: str, final: str) -> None:
    """Rename a finished file, unless another attempt has already done so."""
    if store.get_file_info(final).type == fs.FileType.NotFound:
        try:
            store.move(name, final)
            return
        except OSError:  # another attempt came first: where a rename doesn't overwrite, it fails
            if store.get_file_info(final).type == fs.FileType.NotFound:
                raise
    store.delete_file(name)


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, order_key: int = KEY) -> DataFrame:
    """Write the shards and manifest.json below path, which must have no manifest yet; gives one row for each document: key, first_seq, start, slot (of first_seq), shard, byte_offset, n_tokens, tokens_crc32 (of the ids with the end token)."""
    spark, number = docs.sparkSession, uuid.uuid4().hex
    store, folder = fs.FileSystem.from_uri(path)
    unused(store, folder)
    tokens = materialise(tokenise(docs, key, text_col, vocabulary, seq_len), "tokens", "zstd")
    # one small row for each task that tokenised
    sums = tokens.where("block is not null").groupBy("part").agg(F.sum("n_seq").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in sums]) if sums else np.zeros(1, np.int64)
    total, base = int(ends[-1]), {r["part"]: int(e) - r["n"] for r, e in zip(sums, ends, strict=False)}
    n_shards = -(-total // shard_rows)
    ranges = _place(tokens, base, total, seq_len, shard_rows, order_key).repartitionById(max(1, n_shards), F.col("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(path)
        open_: dict[int, list] = {}  # a partition is one shard
        for b in batches:
            for shard, n, slots, chunk in zip(column(b, "shard"), column(b, "n"), column(b, "slots"), column(b, "chunk"), strict=True):
                size = min(shard_rows, total - shard * shard_rows)
                got = open_.setdefault(shard, [np.empty((size, seq_len), "<u2"), 0])
                got[0][np.frombuffer(slots, "<i4")] = unpack(chunk, n * seq_len).reshape(n, seq_len)
                got[1] += n
        for shard, (ids, n) in open_.items():
            if n != len(ids):
                raise RuntimeError(f"shard {shard} got {n} of {len(ids)} sequences")
            name = f"{folder}/.tmp-{uuid.uuid4().hex}"
            with store.open_output_stream(name) as out:
                out.write(ids)
            publish(store, name, _file(folder, shard, number))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([zlib.crc32(ids)], pa.int64())], names=["shard", "sequences", "crc32"])

    store.create_dir(folder, recursive=True)
    sent = spark.sparkContext.broadcast(base)

    def locate(batch: pa.RecordBatch) -> list:
        at = np.array(column(batch, "at"), np.int64)
        first = np.array([sent.value[p] for p in column(batch, "part")], np.int64) + at // seq_len
        slot = feistel(first, total, order_key)
        return [pa.array(x) for x in (first, at % seq_len, slot, slot // shard_rows, slot % shard_rows * 2 * seq_len)]

    fields = [T.StructField(n, T.LongType()) for n in ("first_seq", "start", "slot", "shard", "byte_offset")]
    found = arrow_map(tokens.where("block is null").select("key", "at", "part", "n_tokens", "tokens_crc32"), fields, locate, rows=8192)
    placed = materialise(found.select(F.col("key").alias(key), "first_seq", "start", "slot", "shard", "byte_offset", "n_tokens", "tokens_crc32"), "places", "zstd")
    done = materialise(ranges.mapInArrow(write, "shard int, sequences long, crc32 long"), "shards")
    if (n := done.count()) != n_shards:
        raise RuntimeError(f"{n} of {n_shards} shards were written")
    unused(store, folder)
    draft = f"{folder}/.manifest-{number}"
    with store.open_output_stream(draft) as f:
        f.write(json.dumps({"run": number, "sequences": total, "seq_len": seq_len, "shard_rows": shard_rows, "shards": n_shards, "dtype": "<u2", "pad": END, "order_key": order_key}).encode())
    store.move(draft, f"{folder}/manifest.json")
    if manifest(path)["run"] != number:
        raise FileExistsError(f"another run has written {path}")
    for f in store.get_file_info(fs.FileSelector(folder)):
        if f.base_name.startswith((".tmp-", ".manifest-")) or f.base_name.startswith("shard-") and number not in f.base_name:
            store.delete_file(f.path)
    release(tokens)
    release(done)
    return placed


def unused(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(f"{folder}/manifest.json").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} has a corpus already")


def _file(folder: str, shard: int, run: str) -> str:
    return f"{folder}/shard-{run}-{shard:08d}.bin"


def manifest(path: str) -> dict:
    store, folder = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_sequences(path: str, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids) from slot `start` on, in training order."""
    store, folder = fs.FileSystem.from_uri(path)
    m = manifest(path)
    for shard in range(start // m["shard_rows"], m["shards"]):
        with store.open_input_file(_file(folder, shard, m["run"])) as f:
            slot = max(start, shard * m["shard_rows"])
            f.seek((slot - shard * m["shard_rows"]) * 2 * m["seq_len"])
            while raw := f.read(2 * m["seq_len"]):
                if stop is not None and slot >= stop:
                    return
                yield slot, np.frombuffer(raw, "<u2")
                slot += 1


def read_document(path: str, first_seq: int, start: int, n_tokens: int) -> np.ndarray:
    """The ids of one document, with its end token, by its place."""
    m = manifest(path)
    index = np.arange(first_seq, first_seq - (-(start + n_tokens) // m["seq_len"]))
    slots = feistel(index, m["sequences"], m["order_key"])
    got = [ids for s in slots.tolist() for _, ids in read_sequences(path, s, s + 1)]
    return np.concatenate(got)[start : start + n_tokens]


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "shards"))
