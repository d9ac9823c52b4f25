"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, exact confirmation, components.

Texts become sets of hashed 5-word shingles; equal sets are one class from the start, so exact copies cost one
row each. At a Jaccard similarity of 0.85 a class has a signature of 133 MinHash values of 8 bits, in 19 chunks of 7. Two
signatures that differ in at most 37 values differ in at most one value of some chunk (pigeonhole: 19 chunks with two
differences are 38), so classes are joined on each chunk with each one of its values left out: 133 keys a class find all
pairs within that distance. The mean distance is 20, and about 1 pair in 24,000 lies beyond 37. For another similarity
`Plan` takes as many chunks, of fewer values if need be, as make that share as small.

Pairs of a group are not enumerated. First each member is compared with two representatives of its group (the
first, and the one that shares most keys overall); confirmed links are turned into components. Only pairs of
different components that share a key are compared then, each once, at its first common key, with a second, finer
signature too, and their links joined in. Distances prune before links are confirmed on the full shingle sets, which are made only for the
classes that need it. What is lost against comparing all pairs is only what the signature distance misses.

Hot groups: copies are combined before the shuffle; keyed rows are joined, not gathered, so that adaptive
execution can split a hot key. Nothing is collected. Texts that share a key but stay under the similarity are compared
one by one, which is quadratic in a group of them.

Classes are numbered, so ids may be of any type that has an order, and different texts may share one: each is linked by
itself. Tables on the way are deleted at the end.

Defined results: null, empty and word-less texts have no shingles, are linked with nothing and kept; shorter
texts than five words are one shingle; rows with equal texts and doc_id are all returned with the same result; a
null doc_id is never linked, has a null component and is kept; an empty table gives no rows; other columns are
ignored, and keep_first() returns them unchanged, whatever their names. Long texts are shingled whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import Temporary, column, give_back, materialise, mix, read, release, with_row

SHINGLE = 5
SIMILARITY = 85  # percent, of op10's contract
MISSED = 1 / 23_000
MAX_VALUES = 256

#: A second signature, of 1-bit values, only for classes whose key groups hold several components. Two texts at the
#: similarity of 0.85 differ in 7.5 % of its bits on average; 4.2 standard deviations more are allowed.
BITS = 1536


class Plan:
    """What follows from the similarity (in percent): values in chunks, allowed distances, and the SQL of their checks."""

    def __init__(self, similarity: int):
        self.similarity = similarity
        # a chunk's key has per - 1 values; with fewer than five of them too many unlike texts would share keys
        sizes = ((per, chunks) for per in (7, 6) for chunks in range(19, 190 // per + 1))
        found = next(((per, chunks) for per, chunks in sizes if _beyond(per * chunks, 2 * chunks - 1, similarity) <= MISSED), None)
        if found is None:
            raise ValueError(f"similarity of {similarity} %: too low for signatures")
        self.per, self.chunks = found
        self.values, self.distance = self.per * self.chunks, 2 * self.chunks - 1
        p = (100 - similarity) / 200
        self.bit_distance = int(BITS * p + 4.2 * (BITS * p * (1 - p)) ** 0.5)
        self.near = f"least(a.n, b.n) * 100 >= {similarity} * greatest(a.n, b.n) and " + " + ".join(_differing(f"a.sig[{k}] ^ b.sig[{k}]") for k in range(self.chunks)) + f" <= {self.distance}"
        self.same_bits = " + ".join(f"bit_count(a.bits[{k}] ^ b.bits[{k}])" for k in range(BITS // 64)) + f" <= {self.bit_distance}"
        # a pair counts at its first common key only: the first chunk with at most one difference, left out there or, with none, at its first value
        at = f"(a.sig[a.slot div {self.per}] ^ b.sig[a.slot div {self.per}])"
        self.first = f"array_position(transform(a.sig, (v, k) -> {_differing('v ^ b.sig[k]')} <= 1), true) = a.slot div {self.per} + 1 and (((shiftright({at}, 8 * (a.slot % {self.per})) & 255L) <> 0) or ({at} = 0 and a.slot % {self.per} = 0))"


def _beyond(values: int, distance: int, similarity: int) -> float:
    """The probability that two texts at the similarity differ in more than `distance` of so many values of 8 bits."""
    p = (100 - similarity) / 100 * 255 / 256
    return sum(math.comb(values, k) * p**k * (1 - p) ** (values - k) for k in range(distance + 1, values + 1))


def _differing(x: str) -> str:
    """SQL for the number of bytes of x that are not zero; the top byte always is, so nothing overflows."""
    low, high = 0x7F7F7F7F7F7F7F, 0x80808080808080
    return f"bit_count((((({x}) & {low}L) + {low}L) | ({x})) & {high}L)"


#: Keys of at most so many documents (about 100 bytes each) go to every executor, to pick their texts; of more, the texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: SQL for what tells texts of one doc_id apart; texts are fetched by doc_id and it.
MARK = "xxhash64(coalesce(text, ''))"

_A = mix(np.arange(1, MAX_VALUES + 1, dtype=np.uint64)) | np.uint64(1)
_C = mix(np.arange(1001, MAX_VALUES + 1001, dtype=np.uint64))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; one for a shorter text, none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def signature(s: np.ndarray, values: int) -> np.ndarray:
    """So many MinHash values of 8 bits."""
    least = np.full(values, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 1024):
            least = np.minimum(least, (s[at : at + 1024, None] * _A[:values] + _C[:values]).min(0))
        return (mix(least) & np.uint64(0xFF)).astype(np.uint8)


_A1 = mix(np.arange(2001, BITS + 2001, dtype=np.uint64)) | np.uint64(1)
_C1 = mix(np.arange(9001, BITS + 9001, dtype=np.uint64))


def bit_signature(s: np.ndarray) -> np.ndarray:
    """1536 one-bit MinHash values as 24 longs."""
    least = np.full(BITS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 128):
            least = np.minimum(least, (s[at : at + 128, None] * _A1 + _C1).min(0))
        return np.packbits((mix(least) & np.uint64(1)).astype(np.uint8)).view("<i8")


def _pack(sigs: np.ndarray, chunks: int, per: int) -> np.ndarray:
    """[n, values] bytes to [n, chunks] longs, at most seven values in each."""
    wide = np.zeros((len(sigs), chunks, 8), np.uint8)
    wide[:, :, :per] = sigs.reshape(len(sigs), chunks, per)
    return wide.reshape(len(sigs), chunks * 8).view("<i8")


def sketch(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, mark, n_shingles, d1, d2 (128-bit digest of the set), sig (19 longs or so) for each of docs (doc_id, text)."""
    values, chunks, per = plan.values, plan.chunks, plan.per

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 512) for i in range(0, big.num_rows, 512)):
                sets = [shingles(t) for t in column(b, "text")]
                sigs = _pack(np.array([signature(s, values) for s in sets], np.uint8).reshape(len(sets), values), chunks, per)
                dig = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8") for s in sets]).reshape(len(sets), 2)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * chunks), pa.array(sigs.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("mark")), pa.array([len(s) for s in sets], pa.int64()), pa.array(dig[:, 0].copy()), pa.array(dig[:, 1].copy()), flat], names=["doc_id", "mark", "n_shingles", "d1", "d2", "sig"])
        _words.clear()
        give_back()

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("mark", "n_shingles", "d1", "d2")), T.StructField("sig", T.ArrayType(T.LongType()))])
    return docs.selectExpr("doc_id", f"{MARK} as mark", "text").mapInArrow(run, schema)


def keyed(classes: DataFrame, plan: Plan) -> DataFrame:
    """(node, key, slot): the keys of each class, as many as values; slot is the value left out."""
    values, chunks, per = plan.values, plan.chunks, plan.per

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.arange(values, dtype=np.uint64)
        with np.errstate(over="ignore"):
            table = mix(slots[:, None] * np.uint64(256) + np.arange(256, dtype=np.uint64) + np.uint64(1 << 32))
        for big in batches:
            for b in (big.slice(i, 256) for i in range(0, big.num_rows, 256)):
                n = b.num_rows
                sig = b.column(b.schema.get_field_index("sig")).flatten().to_numpy().reshape(n, chunks).copy().view(np.uint8).reshape(n, chunks, 8)[:, :, :per].reshape(n, values)
                node = b.column(b.schema.get_field_index("node")).to_numpy()
                with np.errstate(over="ignore"):
                    term = table[np.arange(values), sig]
                    whole = np.add.reduceat(term, np.arange(0, values, per), axis=1)
                    keys = mix(np.repeat(whole, per, axis=1) - term + mix(slots))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, values)), pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(np.arange(values, dtype=np.int16), n))], names=["node", "key", "slot"])

    return classes.select("node", "sig").mapInArrow(run, "node long, key long, slot short")


def _of_texts(nodes: DataFrame, docs: DataFrame, name: str, fn) -> DataFrame:
    """(node, name): fn of the shingle set, as array of longs, of the texts that nodes (node, first_id, mark) stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in (big.slice(i, 512) for i in range(0, big.num_rows, 512)):
                got = [fn(shingles(t)) for t in column(b, "text")]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in got])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *got])))
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("node")), flat], names=["node", name])
        _words.clear()
        give_back()

    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = docs.selectExpr("doc_id as first_id", f"{MARK} as mark", "text").join(F.broadcast(nodes) if few else nodes, ["first_id", "mark"]).select("node", "text")
    return texts.mapInArrow(run, f"node long, {name} array<long>")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similarity: int, temp: Temporary) -> DataFrame:
    """Those of pairs (a, b) whose full shingle sets have the similarity. Sets are made for the texts in pairs only."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    nodes = temp.keep(reps.select("node", "first_id", "mark").join(ends, "node", "left_semi"), "nodes")
    # rows with equal id and text are several rows of one node
    sets = temp.keep(_of_texts(nodes, docs, "s", lambda s: s.view(np.int64)).dropDuplicates(["node"]), "sets")
    both = pairs.join(sets.selectExpr("node as a", "s as sa"), "a").join(sets.selectExpr("node as b", "s as sb"), "b")
    return both.withColumn("i", F.expr("size(array_intersect(sa, sb))")).where(f"100 * i >= {similarity} * (size(sa) + size(sb) - i)").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, for the nodes of edges (a, b). Least labels spread over edges and along labels."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as node", "least(a, m) as comp", "true as moved"), "labels")
    while True:
        near = both.join(labels.selectExpr("node as b", "comp"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").selectExpr("node", "comp as old", "least(comp, m) as comp")
        jump = step.join(labels.selectExpr("node as comp", "comp as up"), "comp").selectExpr("node", "least(comp, up) as comp", "least(comp, up) < old as moved")
        before, labels = labels, materialise(jump, "labels")
        release(before)
        if labels.where("moved").isEmpty():
            release(both)
            out = labels.select("node", "comp")
            out.stored_at = labels.stored_at
            return out


def heavy(classes: DataFrame, plan: Plan) -> DataFrame:
    """Keys that at least 1 in 200 of a 64th of the classes (and two of them) have: by that, at most 200 keys for each value of a signature.

    They only say which keys are dealt out in parts; results are the same without them.
    """
    some = classes.where("pmod(xxhash64(node), 64) = 0")
    least = max(2, some.count() / 200)
    return keyed(some, plan).groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") >= least).selectExpr("key", "true as heavy")


def several(keys: DataFrame, often: DataFrame) -> DataFrame:
    """Rows of keys whose key is there more than once, by one shuffle and one pass over sorted rows.

    A key of `often` certainly is, so its rows are dealt out by node too; of others, a row goes if neither neighbour has its key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = last = None  # the newest row, if it isn't sent yet, and the newest key
        for b in batches:
            if not b.num_rows:
                continue
            key, salt = (b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("key", "salt"))
            same = key[1:] == key[:-1]
            kept = np.concatenate([[key[0] == last], same]) | np.concatenate([same, [False]]) | (salt > 0)
            out = b.select(["node", "key", "slot"])
            if held is not None and key[0] == last:
                yield held
            yield out.filter(pa.array(kept))
            held, last = None if kept[-1] else out.slice(b.num_rows - 1), key[-1]

    salted = keys.join(F.broadcast(often), "key", "left").selectExpr("node", "key", "slot", "if(heavy, pmod(xxhash64(node), 4096) + 1, 0) as salt")
    return salted.repartition("key", "salt").sortWithinPartitions("key").mapInArrow(run, "node long, key long, slot short")


def links(reps: DataFrame, docs: DataFrame, plan: Plan, temp: Temporary) -> DataFrame:
    """Confirmed edges (a, b), enough to connect all classes of reps (node, first_id, mark, n, sig) that links connect."""
    shared = temp.keep(several(keyed(reps, plan), heavy(reps, plan)), "shared", batch=10_000)  # rows of three numbers
    groups = shared.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("rep"))
    members = temp.keep(shared.join(groups, "key"), "members")
    weight = members.groupBy("node").agg(F.sum("size").alias("w"))
    second = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("w", F.expr("-node").alias("m"))).alias("x")).selectExpr("key", "-x.m as rep2")
    star = members.selectExpr("node as a", "rep as b").where("a <> b").distinct().union(members.join(second, "key").selectExpr("node as a", "rep2 as b").where("a <> b").distinct())
    star = star.selectExpr("least(a, b) as x", "greatest(a, b) as y").distinct()
    facts = reps.selectExpr("node", "n", "sig")
    near = star.join(facts.selectExpr("node as x", "struct(n, sig) as a"), "x").join(facts.selectExpr("node as y", "struct(n, sig) as b"), "y").where(plan.near).selectExpr("x as a", "y as b")
    first = temp.keep(confirm(temp.keep(near, "near"), reps, docs, plan.similarity, temp), "links")
    known = components(first)
    temp.tables.append(known)
    labelled = temp.keep(members.select("key", "node", "slot").join(known, "node", "left").selectExpr("key", "slot", "node", "coalesce(comp, node) as comp"), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = temp.keep(labelled.join(mixed, "key", "left_semi").join(facts, "node"), "rest")
    some = temp.keep(reps.select("node", "first_id", "mark").join(rest.select("node").distinct(), "node", "left_semi"), "nodes")
    bits = temp.keep(_of_texts(some, docs, "bits", bit_signature).dropDuplicates(["node"]), "bits")
    rest = rest.join(bits, "node")
    pairs = rest.alias("a").join(rest.alias("b"), F.expr(f"a.key = b.key and a.node < b.node and a.comp <> b.comp and {plan.near} and {plan.same_bits} and {plan.first}")).selectExpr("a.node as a", "b.node as b").distinct()
    return first.union(confirm(temp.keep(pairs, "pairs"), reps, docs, plan.similarity, temp))


def link_documents(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each of docs (doc_id, text); texts of that Jaccard similarity (percent) or more are linked."""
    return _link(docs, similarity).select("doc_id", "n_shingles", "component_id", "kept")


def _link(docs: DataFrame, similarity: int) -> DataFrame:
    """The columns of link_documents(), and for each row mark and first: whether it is the one to keep of its component (with rows equal to it)."""
    plan, temp = Plan(similarity), Temporary()
    docs = docs.select("doc_id", "text")
    sketched = temp.keep(sketch(docs, plan), "sketch")
    # of each class the smallest doc_id, and the mark of one text of it; written, so that the numbers stay
    classes = sketched.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "mark")).alias("x"))
    classed = temp.keep(classes.select("d1", "d2", F.col("x.doc_id").alias("first_id"), F.col("x.mark").alias("mark")).withColumn("node", F.monotonically_increasing_id()), "classes")
    one = sketched.alias("s").join(classed.alias("c"), F.expr("s.doc_id = c.first_id and s.mark = c.mark and s.d1 = c.d1 and s.d2 = c.d2"))
    reps = temp.keep(one.selectExpr("c.node", "c.first_id", "c.mark", "s.n_shingles as n", "s.sig").dropDuplicates(["node"]), "reps")
    found = components(links(reps, docs, plan, temp))
    temp.tables.append(found)
    of = temp.keep(classed.join(found, "node", "left").selectExpr("d1", "d2", "first_id", "mark", "node", "coalesce(comp, node) as comp"), "of")
    # the least (doc_id, mark) of each component of more than one class
    least = of.join(found.select("comp").distinct(), "comp", "left_semi").groupBy("comp").agg(F.min(F.struct("first_id", "mark")).alias("x"))
    named = of.join(least, "comp", "left").selectExpr("d1", "d2", "coalesce(x.first_id, first_id) as least_id", "coalesce(x.mark, mark) as least_mark")
    rows = sketched.select("doc_id", "mark", "n_shingles", "d1", "d2").join(named, ["d1", "d2"], "left")
    alone = "n_shingles = 0 or doc_id is null"
    out = rows.selectExpr("doc_id", "mark", "n_shingles", f"if({alone}, doc_id, least_id) as component_id", f"{alone} or (doc_id = least_id and mark = least_mark) as first")
    out = materialise(out.withColumn("kept", F.expr("component_id <=> doc_id")), "linked")
    temp.drop()
    return out


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_first(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; of equal rows one. Columns of docs. Rows without doc_id or words stay."""
    first = _link(docs, similarity).where("first and n_shingles > 0 and doc_id is not null").select("doc_id", "mark").distinct()
    rows = with_row(docs, "doc_id", "text").selectExpr("row", "doc_id", f"{MARK} as mark")
    named = rows.join(first, ["doc_id", "mark"], "left_semi").dropDuplicates(["doc_id", "mark"])
    rest = with_row(docs, "doc_id", "text").where("doc_id is null or not coalesce(text, '') rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return named.select("row").union(rest.select("row")).select("row.*")


ORACLE = r"""
with recursive d as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, md5(array_to_string(w[i:i + 4], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b using (g) where a.doc_id <> b.doc_id group by 1, 2),
e as (select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * i >= 85 * (nx.n + ny.n - i)),
c as (select doc_id, doc_id as m from d union select c.doc_id, e.y from c join e on e.x = c.m)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(c.m) as component_id, min(c.m) = d.doc_id as kept
from d left join n using (doc_id) join c using (doc_id) group by d.r, d.doc_id, n.n
"""
