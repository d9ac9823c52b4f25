"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all test items are put into one generalised suffix automaton; the words of every
document are streamed through it, and the length of the longest suffix of what was read that occurs in an
item is tracked. Where that length reaches the window size, the last `window` words are hit; an item shorter
than the window counts as one window of its own length and is found through the suffix links.

The automaton is built once, on the driver, and broadcast as flat arrays of 32-bit numbers, some 100 bytes for a word
of the items; its size is checked, as a block has at most `block_words` words. With more items there are more blocks, and
a task has one Python worker still, which takes them one after another for each slice of documents, so that one block is
in its memory at a time; the hits of the blocks are united.

Defined results: null or word-less texts have no words, no hits and no items; an item without id is hit but not listed; null or word-less items match
nothing; repeated documents and items are each reported; empty tables give no rows or no hits; very long texts are
streamed whole; other columns are ignored, and decontaminate() returns them unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import arrow_map, ascii_lower, column, read, with_row

WINDOW = 10
BLOCK_WORDS = 1_000_000
#: Documents that go through the blocks together, where there are several.
SLICE_CHARS = 16_000_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _Growing:
    """The automaton while it is built: most states have one arc, kept in arrays; those with more have a dict."""

    def __init__(self):
        self.one_word, self.one_to, self.many = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])

    def get(self, state: int, c: int) -> int | None:
        if self.one_word[state] == c:
            return self.one_to[state]
        arcs = self.many.get(state)
        return arcs.get(c) if arcs is not None else None

    def set(self, state: int, c: int, to: int) -> None:
        arcs = self.many.get(state)
        if arcs is not None:
            arcs[c] = to
        elif self.one_word[state] in (-1, c):
            self.one_word[state], self.one_to[state] = c, to
        else:
            self.many[state] = {self.one_word[state]: self.one_to[state], c: to}
            self.one_word[state] = -2

    def arcs(self, state: int) -> list[tuple[int, int]]:
        if state in self.many:
            return sorted(self.many[state].items())
        return [(self.one_word[state], self.one_to[state])] if self.one_word[state] >= 0 else []

    def _split(self, p: int, q: int, c: int) -> int:
        clone = len(self.link)
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.one_word.append(self.one_word[q])
        self.one_to.append(self.one_to[q])
        if q in self.many:
            self.many[clone] = dict(self.many[q])
        self.link[q] = clone
        while p >= 0 and self.get(p, c) == q:
            self.set(p, c, clone)
            p = self.link[p]
        return clone

    def extend(self, last: int, c: int) -> int:
        q = self.get(last, c)
        if q is not None:  # another item already has these words
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        new, p = len(self.link), last
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.one_word.append(-1)
        self.one_to.append(-1)
        while p >= 0 and self.get(p, c) is None:
            self.set(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self.get(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return new


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, in flat arrays, with the items that own each window.

    The arcs of a state are a sorted run of `arc_word`; the root's have a table of their own. The items in which the words
    of a state occur are those whose positions end in its subtree of suffix links: a run of `owner`.
    """

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window, self.vocabulary, self.ids = window, {}, [k for k, _ in items]
        g, ends, ended = _Growing(), array("i"), array("i")  # of each position: its state, its item
        self.short: dict[int, list[int]] = {}  # by state: items of fewer than `window` words that end here, whole
        for n, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = g.extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                ends.append(last)
                ended.append(n)
            if 0 < len(words) < window:
                self.short.setdefault(last, []).append(n)
        self.link, self.length = g.link, g.length
        size = len(g.link)
        self.root = array("i", [-1]) * len(self.vocabulary)
        for c, to in g.arcs(0):
            self.root[c] = to
        self.arc_at, self.arc_word, self.arc_to = array("i", [0, 0]), array("i"), array("i")
        for v in range(1, size):
            for c, to in g.arcs(v):
                self.arc_word.append(c)
                self.arc_to.append(to)
            self.arc_at.append(len(self.arc_word))
            g.many.pop(v, None)
        # the tree of suffix links, walked so that a subtree is a run of numbers; link and length sort it
        link, order = np.array(self.link), np.argsort(np.array(self.length), kind="stable")[1:].tolist()
        below, tin, free = [1] * size, [0] * size, [1] * size
        for v in reversed(order):
            below[self.link[v]] += below[v]
        # for each state, the nearest state on its suffix path (itself included) at which a short item ends
        self.near = array("i", [-1]) * size
        for v in order:
            p = self.link[v]
            tin[v] = free[p]
            free[p] += below[v]
            free[v] = tin[v] + 1
            self.near[v] = v if v in self.short else self.near[p]
        del link, free
        tin, below = np.array(tin), np.array(below)
        at = tin[np.array(ends, np.int64)] if len(ends) else np.zeros(0, np.int64)
        by = np.argsort(at, kind="stable")
        self.owner = np.array(ended, np.int32)[by]
        before = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=size))])
        self.owned_from, self.owned_to = before[tin].astype(np.int32), before[tin + below].astype(np.int32)

    def nbytes(self) -> int:
        """Bytes of the arrays, without the vocabulary."""
        return sum(len(x) * 4 for x in (self.link, self.length, self.root, self.arc_at, self.arc_word, self.arc_to, self.near, self.owner, self.owned_from, self.owned_to))

    def step(self, state: int, c: int) -> int:
        """The state after word c, or -1."""
        if state == 0:
            return self.root[c]
        a, b = self.arc_at[state], self.arc_at[state + 1]
        if b - a > 1:
            a = bisect_left(self.arc_word, c, a, b)
        return self.arc_to[a] if a < b and self.arc_word[a] == c else -1

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Maximal hit runs [first word, end) and the numbers of the items with occurring windows."""
        link, length, near, window = self.link, self.length, self.near, self.window
        root, arc_at, arc_word, arc_to = self.root, self.arc_at, self.arc_word, self.arc_to
        state = size = 0
        runs: list[tuple[int, int]] = []
        items: set[int] = set()
        windows: set[int] = set()  # states of windows that were hit: each state's items are looked up once
        for i, c in enumerate(map(self.vocabulary.get, words)):
            if c is None:
                state = size = 0
                continue
            while state:
                a, b = arc_at[state], arc_at[state + 1]
                if b - a > 1:
                    a = bisect_left(arc_word, c, a, b)
                if a < b and arc_word[a] == c:
                    state = arc_to[a]
                    size += 1
                    break
                state = link[state]
                size = length[state]
            else:
                state = root[c]
                if state < 0:
                    state = size = 0
                    continue
                size = 1
            start = -1
            if size >= window:
                start, v = i + 1 - window, state
                while length[link[v]] >= window:
                    v = link[v]
                windows.add(v)
            v = near[state]
            while v >= 0:  # short items whose whole text ends here
                if length[v] <= size:
                    items.update(self.short[v])
                    start = min(start, i + 1 - length[v]) if start >= 0 else i + 1 - length[v]
                v = near[link[v]] if v else -1
            if start >= 0:
                while runs and runs[-1][1] >= start:
                    start = min(start, runs.pop()[0])
                runs.append((start, i + 1))
        if windows:
            found = np.zeros(len(self.ids), bool)
            for v in windows:
                found[self.owner[self.owned_from[v] : self.owned_to[v]]] = True
            items.update(np.flatnonzero(found).tolist())
        return runs, items


def _blocks(items: Iterator, block_words: int) -> Iterator[list]:
    block, size = [], 0
    for item_id, text in items:
        words = WORD.findall(ascii_lower(text or ""))
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((item_id, words))
        size += len(words)
    yield block


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _slices(texts: list[str | None], whole: bool) -> Iterator[list[str | None]]:
    """Runs of texts of about SLICE_CHARS characters; all of them at once if `whole`."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= SLICE_CHARS and not whole:
            yield part
            part, size = [], 0
    yield part


HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_runs", T.ArrayType(T.LongType())),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, cut_col: str | None = None) -> DataFrame:
    """docs plus n_words, hit_runs (word positions first, end, first, end, ...), hit_items (ids as text, sorted) and,
    as cut_col, the text without those words: made in the same pass, so that a task has one Python worker."""
    fields = HITS + ([T.StructField(cut_col, T.StringType())] if cut_col else [])
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(SuffixAutomaton(block, window)) for block in _blocks(items.select(item_id, item_text).toLocalIterator(), block_words)]

    def run(batch: pa.RecordBatch) -> list:
        n_words, all_runs, all_items, rest = [], [], [], []
        for texts in _slices(column(batch, text_col), len(sent) == 1):
            words = [WORD.findall(ascii_lower(t)) if t else [] for t in texts]
            found: list[tuple[list, list]] = [([], []) for _ in texts]
            for b in sent:
                auto = b.value
                for (runs, ids), w in zip(found, words, strict=True):
                    new, numbers = auto.match(w)
                    runs += new
                    ids += [str(auto.ids[i]) for i in numbers if auto.ids[i] is not None]
                if len(sent) > 1:  # read again for the next slice: one block at a time is held
                    del auto
                    b.__dict__.pop("_value", None)
            for (runs, ids), w, t in zip(found, words, texts, strict=True):
                n_words.append(len(w))
                all_runs.append([x for r in (runs if len(sent) == 1 else _union(runs)) for x in r])
                all_items.append(sorted(set(ids)))
                if cut_col:
                    rest.append(cut(t, all_runs[-1]))
        return [pa.array(n_words, pa.int64()), pa.array(all_runs, pa.list_(pa.int64())), pa.array(all_items, pa.list_(pa.string())), *[pa.array(rest, pa.string())] * bool(cut_col)]

    return arrow_map(docs, fields, run, rows=512 if len(sent) == 1 else 1 << 14)


def cut(text: str | None, runs: list[int]) -> str | None:
    """text without the words in runs; what stands between two cut words goes too."""
    if not text or not runs:
        return text
    spans = [m.span() for m in WORD.finditer(ascii_lower(text))]
    out, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        out.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join(out) + text[at:]


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with contaminated spans removed; documents of which over max_coverage of the words are hit are dropped.

    Same columns as docs. Clean documents are left exactly as they are.
    """
    hit = find_hits(with_row(docs, text_col), items, text_col, window=window, block_words=block_words, cut_col="hit_cut")
    ok = hit.where(f"size(hit_runs) = 0 or 2 * aggregate(transform(sequence(1, int(size(hit_runs) / 2)), i -> hit_runs[2 * i - 1] - hit_runs[2 * i - 2]), 0L, (a, x) -> a + x) <= {2 * max_coverage} * n_words")
    return ok.select(*[F.col("hit_cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def digest(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The contract's row for each document."""
    hit = find_hits(docs.select("doc_id", "text"), items, **kw)
    return hit.selectExpr(
        "doc_id", "n_words",
        "if(size(hit_runs) = 0, 0L, aggregate(transform(sequence(1, int(size(hit_runs) / 2)), i -> hit_runs[2 * i - 1] - hit_runs[2 * i - 2]), 0L, (a, x) -> a + x)) as n_hit",
        "cast(size(hit_items) as bigint) as n_items", "sha2(array_join(hit_items, ','), 256) as items_sha256", "size(hit_runs) > 0 as contaminated",
    )


def brute(text: str | None, items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[int, int, list[str]]:
    """Reference for tests: words, hit words and item ids by trying every window."""
    words = WORD.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for key, t in items:
        w = WORD.findall(ascii_lower(t or ""))
        for j in range(max(1, len(w) - window + 1) if w else 0):
            x = w[j : j + window]
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(str(key))
    return len(words), len(hit), sorted(found)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null),
iw as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from iw),
dw as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
m as (select dw.r, dw.i, dw.n, iw.item_id from dw join iw using (n, g)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from m)) group by r),
its as (select r, count(*) as n_items, string_agg(k, ',' order by k) as ks from (select distinct r, cast(item_id as varchar) as k from m) group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ks, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join its using (r)
"""
