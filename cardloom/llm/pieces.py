"""SentencePiece encoding by forward-filtering backward-sampling, and lossless decoding.

All segmentations of a text into vocabulary pieces form a lattice. The forward pass sums, for every position, the
weights of all segmentations up to it; the backward pass draws a segmentation from the end, each arc with its
posterior probability, so that whole segmentations are drawn in proportion to the product of their piece weights.
Draws are hashes of (seed, row key, word number, step): a row gets the same segmentation on any cluster.

No piece of a model crosses from a word into the next word's space mark, and characters without a piece stand
alone, so the lattice falls apart into words. It is built once for each distinct word of a slice, and all words
of a slice are sampled together in numpy.

Weights: a unigram model brings log-probabilities. A BPE model brings merge ranks, which are no probabilities;
its pieces get -log(rank + 10) instead. `alpha` flattens either. Characters without a piece, and U+2581 itself,
which the model uses as its space mark, become UTF-8 byte pieces, so that decoding gives back every text exactly.

A text of more than SLICE_CHARS characters is taken in parts that end between words. A word of more than LONG characters
(an encoded file, a script without spaces) is taken in windows: the forward pass keeps only the sums before each window,
and the backward pass makes a window's sums again when it gets there, so that memory follows the text, not the lattice.

Defined results: null gives null pieces, an empty text no pieces; the length of texts and words is not limited;
repeated rows with the same key get the same pieces; a null key counts as a key of its own; an empty table gives no rows;
columns with the output names are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import arrow_map, column, mix, read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 0.5
SEED = 17
MARK = 0x2581
#: Stands for U+2581 of a text; beyond Unicode, so no piece has it.
LITERAL_MARK = 0x110001
SLICE_CHARS = 250_000
#: Up to this length of words forward weights are plain products; beyond it logarithms.
LINEAR = 40
#: Words are sampled together with others of up to the same of these lengths; longer ones one by one.
WIDTHS = (8, 12, 20, 40, 120, 1000)
#: Longer words are sampled in windows of LONG_BLOCK characters.
LONG = 20_000
LONG_BLOCK = 8192

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))


class Model:
    """Tables of one SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_at = sp.piece_to_id("<0x00>")
        self.surface: list[bytes] = [b""] * n
        pieces, scores = [], []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.surface[i] = p.replace("▁", " ").encode()
                pieces.append((p, i))
                scores.append(sp.get_score(i))
        raw = np.array(scores)
        if np.all(raw[raw > -1e8] == np.round(raw[raw > -1e8])):  # merge ranks
            rank = np.where(raw > -1e8, -raw, len(raw))
            weight = -np.log(rank + 10)
        else:
            weight = np.maximum(raw, raw[raw > -1e8].min())
        self.longest = max(len(p) for p, _ in pieces)
        self.weight = np.full(n, -np.inf)
        self.weight[[i for _, i in pieces]] = weight
        self.by_text = dict(pieces)
        self.known = np.zeros(0x110002, bool)
        self.known[[ord(p) for p, _ in pieces if len(p) == 1]] = True
        for p, _ in pieces:
            if "▁" in p.lstrip("▁") or not all(self.known[ord(c)] for c in p):
                raise ValueError(f"piece {p!r} crosses words or has a character without a piece")
        hashes = np.array([_hash(np.array([ord(c) for c in p])) for p, _ in pieces], np.uint64)
        ids = np.array([i for _, i in pieces])
        self.tables = []  # direct-address tables; what collides in one goes to the next
        salt = 0
        while len(ids):
            bits = max(8, (8 * len(ids)).bit_length())  # small enough for a core's cache
            slot = (mix(hashes + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64)
            table, keys = np.full(1 << bits, -1, np.int32), np.zeros(1 << bits, np.uint64)
            _, first = np.unique(slot, return_index=True)
            table[slot[first]], keys[slot[first]] = ids[first], hashes[first]
            self.tables.append((np.uint64(salt), np.uint64(64 - bits), table, keys))
            rest = np.setdiff1d(np.arange(len(ids)), first)
            hashes, ids, salt = hashes[rest], ids[rest], salt + 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece id of each substring hash, or -1."""
        out = np.full(hashes.shape, -1, np.int32)
        for salt, shift, table, keys in self.tables:
            slot = (mix(hashes + salt) >> shift).astype(np.int64)
            got = np.flatnonzero(keys[slot] == hashes)
            out[got] = table[slot[got]]
        return out


_models: dict[str, Model] = {}


def load(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _hash(points: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(len(points), _B))])[: len(points)]
        return (mix(points.astype(np.uint64) + np.uint64(1)) * powers).sum(dtype=np.uint64)


def row_seed(key: object, seed: int) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(f"{key!r}", seed=seed))


def draws(row_seeds: np.ndarray, words: np.ndarray, step: int | np.ndarray) -> np.ndarray:
    """Uniform in [0, 1) for each (row, number of the word in its row) and step."""
    with np.errstate(over="ignore"):
        x = mix(mix(row_seeds + words.astype(np.uint64) * _B) + np.asarray(step, np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _lattice(model: Model, points: np.ndarray, prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, size: np.ndarray, alpha: float):
    """For words of similar length: cumulated weight of the arcs by length [word, end, length - 1], and their pieces."""
    n, width, longest = len(start), int(size.max()), min(model.longest, int(size.max()))
    arcs = np.full((n, width + 1, longest), -1, np.int32)
    for length in range(1, longest + 1):
        w, p = np.nonzero(np.arange(length, width + 1)[None, :] <= size[:, None])
        end = start[w] + p + length
        with np.errstate(over="ignore"):
            arcs[w, p + length, length - 1] = model.find((prefix[end] - prefix[end - length]) * inverse[end - length])
    longest = max(1, int((arcs >= 0).any((0, 1)).nonzero()[0].max(initial=0)) + 1)
    arcs = arcs[:, :, :longest]
    cum = np.zeros((n, width + 1, longest))
    if width <= LINEAR:  # products of weights are far from underflow
        weight = np.append(np.exp(alpha * model.weight), 0.0)[arcs]
        forward = np.zeros((n, width + longest + 1))
        forward[:, longest] = 1.0  # position p is at column p + longest
        for p in range(1, width + 1):
            c = cum[:, p, :]
            np.multiply(weight[:, p, :], forward[:, p : p + longest][:, ::-1], out=c)
            np.cumsum(c, 1, out=c)
            forward[:, p + longest] = c[:, -1]
        return cum, arcs
    score = np.append(alpha * model.weight, -np.inf)[arcs]
    forward = np.full((n, width + longest + 1), -np.inf)
    forward[:, longest] = 0.0
    for p in range(1, width + 1):
        with np.errstate(invalid="ignore", divide="ignore"):
            a = score[:, p, :] + forward[:, p : p + longest][:, ::-1]
            top = a.max(1)
            c = np.cumsum(np.exp(a - top[:, None]), 1)
            forward[:, p + longest] = np.where(np.isfinite(top), top + np.log(c[:, -1]), -np.inf)
            cum[:, p, :] = c
    return cum, arcs


def _long_word(model: Model, points: np.ndarray, seed: np.uint64, number: int, alpha: float) -> list[int]:
    """Sampled pieces of one word, last one first, in windows."""
    n, longest = len(points), model.longest
    table = np.append(np.exp(alpha * model.weight), 0.0)

    def window(at: int, sums: list[float], kept: list | None) -> list[float]:
        """The forward sums of the `longest` positions before the window's end, from those before its start; kept gets each position's arcs.

        Sums are scaled together when they get small; what is kept of a position was made on one scale.
        """
        to, low = min(n, at + LONG_BLOCK), max(0, at - longest)
        part = points[low:to].astype(np.uint64)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(part), _B)]))
            inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(part), _B_INV)]))
            prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(part + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
            arcs = np.full((to - at, longest), -1, np.int32)
            for length in range(1, longest + 1):
                end = np.arange(max(at + 1, length), to + 1)
                arcs[end - at - 1, length - 1] = model.find((prefix[end - low] - prefix[end - length - low]) * inverse[end - length - low])
        place, shorter = np.nonzero(arcs >= 0)
        pieces = arcs[place, shorter]
        weights, back, bounds = table[pieces].tolist(), shorter.tolist(), np.searchsorted(place, np.arange(to - at + 1)).tolist()
        values = list(sums)
        for k in range(to - at):
            total, cum = 0.0, []
            for i in range(bounds[k], bounds[k + 1]):
                total += weights[i] * values[k + longest - 1 - back[i]]
                cum.append(total)
            values.append(total)
            if total < 1e-150:
                values[-longest:] = [v / total for v in values[-longest:]]
            if kept is not None:
                kept.append((cum, bounds[k]))
        if kept is not None:
            kept.append((pieces, back))
        return values[-longest:]

    starts, sums = [], [0.0] * (longest - 1) + [1.0]
    for at in range(0, n, LONG_BLOCK):
        starts.append(sums)
        sums = window(at, sums, None)
    out: list[int] = []
    position, seeds, words = n, np.array([seed]), np.array([number])
    u, first = [], 0
    for at in reversed(range(0, n, LONG_BLOCK)):
        kept: list = []
        window(at, starts.pop(), kept)
        pieces, back = kept.pop()
        while position > at:
            cum, bound = kept[position - at - 1]
            if len(out) - first >= len(u):
                first, u = len(out), draws(seeds, words, np.arange(len(out), len(out) + 4096)).tolist()
            i = bound + min(bisect_right(cum, u[len(out) - first] * cum[-1]), len(cum) - 1)
            out.append(int(pieces[i]))
            position -= back[i] + 1
    return out


def _edges(model: Model, points: np.ndarray, rows: np.ndarray | None) -> np.ndarray:
    """Whether a word begins at each point (space marks being MARK): at rows' starts, around characters without a piece, at spaces after others."""
    known, mark = model.known[points], points == MARK
    edge = np.ones(len(points), bool)
    edge[1:] = ~known[1:] | ~known[:-1] | (mark[1:] & ~mark[:-1])
    if rows is not None:
        edge[1:] |= rows[1:] != rows[:-1]
    return edge


def _marked(points: np.ndarray) -> np.ndarray:
    return np.where(points == MARK, LITERAL_MARK, np.where(points == 32, MARK, points))


def _encode_long(model: Model, text: str, seed: np.uint64, alpha: float) -> np.ndarray:
    """The pieces of one long text, in parts of about SLICE_CHARS characters that end between words."""
    raw = np.frombuffer((" " + text).encode("utf-32-le"), np.uint32)
    out, at, number, n = [], 0, 0, len(raw)
    while at < n:
        to = min(n, at + SLICE_CHARS)
        if to < n:  # back to where a word begins
            edge = np.flatnonzero(_edges(model, _marked(raw[at : to + 1].astype(np.int64)), None)[1:])
            low = to
            to = at + 1 + int(edge[-1]) if len(edge) else n
            while not len(edge) and low < n:  # one long word: on to where the next one begins
                edge = np.flatnonzero(_edges(model, _marked(raw[low : low + SLICE_CHARS + 1].astype(np.int64)), None)[1:])
                to = low + 1 + int(edge[0]) if len(edge) else n
                low += SLICE_CHARS
        points = raw[at:to]
        if to - at > SLICE_CHARS + LONG:
            out.append(_with_bytes(model, np.array(_long_word(model, _marked(points), seed, number, alpha)[::-1], np.int64)))
            number += 1
        else:
            ids, words = _encode_points(model, _marked(points.astype(np.int64)), np.zeros(to - at, np.int64), 1, np.array([seed]), alpha, number)
            out += ids
            number += words
        at = to
    return np.concatenate(out)


def _encode_slice(model: Model, texts: list[str], seeds: np.ndarray, alpha: float) -> list[np.ndarray]:
    if len(texts) == 1 and len(texts[0]) > SLICE_CHARS:
        return [_encode_long(model, texts[0], seeds[0], alpha)]
    points = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    return _encode_points(model, _marked(points), rows, len(texts), seeds, alpha)[0]


def _encode_points(model: Model, points: np.ndarray, rows: np.ndarray, n_rows: int, seeds: np.ndarray, alpha: float, number0: int = 0) -> tuple[list[np.ndarray], int]:
    """The pieces of each row, and the number of words; the first word of each row has the number number0."""
    known = model.known[points]
    edge = _edges(model, points, rows)
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(points)))
    row = rows[start]
    number = number0 + np.arange(len(start)) - np.searchsorted(row, row)  # of the word in its row
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), _B)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), _B_INV)]))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * powers[:-1], dtype=np.uint64)])
        hashes = (prefix[start + size] - prefix[start]) * inverse[start]
    lonely = ~known[start]
    count = np.ones(len(start), np.int64)
    at_word: list[np.ndarray] = [np.flatnonzero(lonely)]
    at_step: list[np.ndarray] = [np.zeros(len(at_word[0]), np.int64)]
    got: list[np.ndarray] = [-1 - points[start[at_word[0]]]]
    for w in np.flatnonzero(~lonely & (size > LONG)).tolist():
        found = _long_word(model, points[start[w] : start[w] + size[w]], seeds[row[w]], int(number[w]), alpha)
        at_word.append(np.full(len(found), w))
        at_step.append(np.arange(len(found)))
        got.append(np.array(found, np.int64))
        count[w] = len(found)
    todo = np.flatnonzero(~lonely & (size <= LONG))
    _, first, which = np.unique(hashes[todo] ^ size[todo].astype(np.uint64), return_index=True, return_inverse=True)
    kinds = todo[first]  # one occurrence of each distinct word
    by_size = np.argsort(size[kinds], kind="stable")
    place = np.empty(len(kinds), np.int64)
    place[by_size] = np.arange(len(kinds))
    order = np.argsort(place[which], kind="stable")
    todo, which = todo[order], place[which][order]
    kinds = kinds[by_size]
    at = 0
    while at < len(kinds):
        width = next((w for w in WIDTHS if size[kinds[at]] <= w), None)
        most = 1 if width is None else max(1, 60_000 // width)
        to = at + 1 if width is None else min(at + most, int(np.searchsorted(size[kinds], width, side="right")))
        cum, arcs = _lattice(model, points, prefix, inverse, start[kinds[at:to]], size[kinds[at:to]], alpha)
        a, b = np.searchsorted(which, [at, to])
        words, kind = todo[a:b], which[a:b] - at
        position = size[words].copy()
        step = 0
        while len(words):
            u = draws(seeds[row[words]], number[words], step)
            c = cum[kind, position]
            length = (c <= (u * c[:, -1])[:, None]).sum(1)
            at_word.append(words)
            at_step.append(np.full(len(words), step))
            got.append(arcs[kind, position, length].astype(np.int64))
            position = position - length - 1
            step += 1
            more = position > 0
            count[words[~more]] = step
            words, kind, position = words[more], kind[more], position[more]
        at = to
    offset = np.concatenate([[0], np.cumsum(count)])
    word, step = np.concatenate(at_word), np.concatenate(at_step)
    ids = np.empty(offset[-1], np.int64)
    ids[offset[word] + count[word] - 1 - step] = np.concatenate(got)
    ends = offset[np.searchsorted(row, np.arange(n_rows + 1))]
    return [_with_bytes(model, ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], len(start)


def _with_bytes(model: Model, ids: np.ndarray) -> np.ndarray:
    """Characters without a piece, given as -1 - code point, become byte pieces."""
    odd = ids < 0
    if odd.any():
        points = np.where(odd, -1 - ids, 0)
        points = np.where(points == LITERAL_MARK, MARK, points)
        n = np.where(odd, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), 1)
        whole = np.repeat(ids, n)
        raw = "".join(map(chr, points[odd])).encode("utf-8")
        whole[whole < 0] = np.frombuffer(raw, np.uint8).astype(np.int64) + model.bytes_at
        ids = whole
    return ids.astype(np.int32)


def encode(texts: list[str | None], keys: list[object], model: Model, alpha: float = ALPHA, seed: int = SEED) -> list[np.ndarray | None]:
    """Sampled piece ids of each text; verified to decode to the text."""
    out: list[np.ndarray | None] = [None if t is None else np.zeros(0, np.int32) for t in texts]
    todo, size = [], 0
    for i, t in enumerate(texts):
        if t and len(t) > SLICE_CHARS:  # by itself
            out[i] = _encode_slice(model, [t], np.array([row_seed(keys[i], seed)], np.uint64), alpha)[0]
        elif t:
            todo.append(i)
            size += len(t)
        if todo and (size > SLICE_CHARS or i + 1 == len(texts)):
            seeds = np.array([row_seed(keys[k], seed) for k in todo], np.uint64)
            for k, ids in zip(todo, _encode_slice(model, [texts[k] for k in todo], seeds, alpha), strict=True):
                out[k] = ids
            todo, size = [], 0
    for k, ids in enumerate(out):
        if ids is not None and decode(ids, model) != texts[k]:  # two strings of one 64-bit hash
            raise ArithmeticError(f"pieces of row {keys[k]!r} don't give back its text")
    return out


def decode(ids: np.ndarray, model: Model) -> str:
    """The text of the pieces; the mark that encoding puts first is taken away."""
    return b"".join(b"".join(map(model.surface.__getitem__, ids[at : at + 100_000].tolist())) for at in range(0, len(ids), 100_000)).decode("utf-8")[1:]


def encode_column(df: DataFrame, key: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """df plus piece_ids."""

    def run(batch: pa.RecordBatch) -> list:
        ids = encode(column(batch, text_col), column(batch, key), load(model), alpha, seed)
        return [_lists(ids)]

    return arrow_map(df, [T.StructField("piece_ids", T.ArrayType(T.IntegerType()))], run, rows=1024)


def _lists(ids: list[np.ndarray | None]) -> pa.Array:
    sizes = [0 if x is None else len(x) for x in ids]
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32(), mask=np.array([x is None for x in ids] + [False]))
    flat = np.concatenate([np.zeros(0, np.int32), *[x for x in ids if x is not None]])
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))


def decode_column(df: DataFrame, ids_col: str = "piece_ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """df plus the text of its pieces; null pieces give null."""

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array([None if x is None else decode(np.array(x, np.int32), load(model)) if len(x) else "" for x in column(batch, ids_col)], pa.string())]

    return arrow_map(df, [T.StructField(out_col, T.StringType())], run)


DIGESTS = [T.StructField("n_pieces", T.LongType()), T.StructField("pieces_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())]


def _digests(ids: list[np.ndarray | None], texts: list[str | None], model: Model) -> list[pa.Array]:
    n = [0 if a is None else len(a) for a in ids]
    sha = [None if a is None else hashlib.sha256(a.astype("<i4").tobytes()).hexdigest() for a in ids]
    same = [(a is None and t is None) or (a is not None and (decode(a, model) if len(a) else "") == t) for a, t in zip(ids, texts, strict=True)]
    return [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())]


def digest_column(df: DataFrame, ids_col: str = "piece_ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """df plus n_pieces, pieces_sha256 (of the ids as little-endian int32) and lossless (decoding gives the text)."""

    def run(batch: pa.RecordBatch) -> list:
        ids = [x.values.to_numpy(zero_copy_only=False) if x.is_valid else None for x in batch.column(batch.schema.get_field_index(ids_col))]
        return _digests(ids, column(batch, text_col), load(model))

    return arrow_map(df, DIGESTS, run)


def encode_digest_column(df: DataFrame, key: str = "doc_id", text_col: str = "text", model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """encode_column() and digest_column() in one pass: a task has one Python worker instead of two."""

    def run(batch: pa.RecordBatch) -> list:
        texts = column(batch, text_col)
        ids = encode(texts, column(batch, key), load(model), alpha, seed)
        return [_lists(ids), *_digests(ids, texts, load(model))]

    return arrow_map(df, [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), *DIGESTS], run, rows=1024)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: its number of pieces, their digest and whether the text came back."""
    out = encode_digest_column(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_pieces", "pieces_sha256", "lossless")


def brute(text: str, key: object, model: Model, alpha: float = ALPHA, seed: int = SEED) -> list[int]:
    """Reference for tests: the same sampler over the whole text's lattice, position by position, without splitting it into words."""
    points = [LITERAL_MARK if c == "▁" else MARK if c == " " else ord(c) for c in " " + text]
    shown = ["▁" if p == MARK else None if p == LITERAL_MARK else chr(p) for p in points]
    n, forward, arcs = len(points), [0.0], [[]]
    for p in range(1, n + 1):
        found = []
        for length in range(1, min(p, model.longest) + 1):
            part = shown[p - length : p]
            piece = model.by_text.get("".join(part)) if all(part) else None
            if piece is not None:
                found.append((length, forward[p - length] + alpha * model.weight[piece], piece))
        if not found:
            found = [(1, forward[p - 1], None)]
        top = max(w for _, w, _ in found)
        total = sum(np.exp(w - top) for _, w, _ in found)
        forward.append(top + np.log(total))
        arcs.append([(length, np.exp(w - top) / total, piece) for length, w, piece in found])
    # number the words as encode() does, so that the same draws are used
    word, number = [], -1
    for i, p in enumerate(points):
        if i == 0 or not model.known[p] or not model.known[points[i - 1]] or (p == MARK and points[i - 1] != MARK):
            number += 1
        word.append(number)
    out, p, step, last = [], n, 0, None
    while p > 0:
        step = step + 1 if word[p - 1] == last else 0
        last = word[p - 1]
        u = draws(np.array([row_seed(key, seed)], np.uint64), np.array([last]), step)[0]
        c = 0.0
        for length, w, piece in arcs[p]:
            c += w
            if u < c:
                break
        if piece is None:
            c = "▁" if points[p - 1] == LITERAL_MARK else chr(points[p - 1])
            out.extend(model.bytes_at + b for b in reversed(c.encode()))
        else:
            out.append(piece)
        p -= length
    return out[::-1]
