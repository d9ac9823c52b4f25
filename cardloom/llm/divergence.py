"""How far the sources of a language diverge in the words that they use.

Terms are runs of letters (ASCII ones in lower case). A language keeps the terms of at least MIN_DOCS of its documents. In
each source of a language, and in the language as a whole, a kept term with n occurrences has the integer share
p = 1 + floor(10^9 (n + 1) / (N + V)), N being all occurrences of kept terms there and V the number of kept terms. The
divergence of share p from share q is f = floor((p - q)^2 / q); `pair` sums it over all kept terms for each ordered pair of
sources, `term` lists the terms that a source uses more than its language does.

Tasks count the terms of their own documents first, so that the first shuffle carries one row for each term, source and
batch. Each kept term is then one row with an array of (source number, occurrences): a wide vector, without its zeros.
Pairs of sources that both use a term give a contribution each, by higher-order functions, summed map-side. What the
zeros give isn't computed term by term: for a pair, terms that only one side uses contribute by their number of
occurrences alone, so the counts of counts of each source are enough, and terms that neither uses all contribute the same:

    sum f(p, q) = sum over both [f(p, q) - f(p, z) - f(y, q) + f(y, z)] + sum over left [f(p, z) - f(y, z)]
                + sum over right [f(y, q) - f(y, z)] + V f(y, z)          with y, z: the shares of no occurrence

The work thus follows the occupied cells and the pairs of sources that share a term. All is exact in 64 bits while
N + V is under 9 * 10^15 and V under 10^9.

Defined results: null text, lang and source count as empty strings; texts are read whole, in slices, of any length; a
repeated row is a document of its own; a source without terms has no `term` rows, and the shares of no occurrence in `pair`;
a language without kept terms has pairs of value 0; equal values are ranked by item, in the order of UTF-8 bytes; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardloom.llm.common import Temporary, ascii_lower, column, give_back, materialise, read, small_batches

MIN_DOCS = 3
TOP = 200
SCALE = 10**9
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SLICE_CHARS = 1_000_000
#: Terms that a task counts before it passes them on.
HELD_TERMS = 400_000
#: The table of sources (a row a language) is broadcast up to so many sources; beyond that it is shuffled, each row to SALTS places.
BROADCAST_SOURCES = 200_000
SALTS = 64


def slices(text: str) -> Iterator[str]:
    """The text in slices that end between terms."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = at + SLICE_CHARS
        m = re.compile(r"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, end)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), d (documents that have it), partly added up; a row with a null term for each source."""
    small_batches(docs.sparkSession)
    cols = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            values = [pa.array([None, *terms], pa.string()), pa.array([0, *(n[t] for t in terms)], pa.int64()), pa.array([0, *(d[t] for t in terms)], pa.int64())]
            size = len(terms) + 1
            whole = pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), *values], names=["lang", "source", "term", "n", "d"])
            for at in range(0, size, 50_000):
                yield whole.slice(at, 50_000)
        held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for b in batches:
            for lang, source, text in zip(column(b, "lang"), column(b, "source"), column(b, "text"), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[str] = set()
                for part in slices(text):
                    words = TERM.findall(ascii_lower(part))
                    n.update(words)
                    seen.update(words)
                d.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from flush(held)
        yield from flush(held)
        give_back()

    return cols.mapInArrow(run, "lang string, source string, term string, n long, d long")


def share(n: str, size: str) -> str:
    """SQL for 1 + floor(10^9 * (n + 1) / size): at once where that fits 64 bits, else by long division in three digits of base 1000."""
    digit = f"struct(got.q * 1000 + (got.r * 1000) div {size} as q, (got.r * 1000) % {size} as r)"
    # n + 1 <= size, so that the first digit is at most 1000
    slow = f"aggregate(array(1, 2, 3), struct(0L as q, cast({n} + 1 as bigint) as r), (got, step) -> {digit}, got -> got.q)"
    return f"(1 + if({n} < 9000000000, cast({n} + 1 as bigint) * 1000000000 div {size}, {slow}))"


def f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value and rank."""
    spark, tmp = docs.sparkSession, Temporary()
    counts = tmp.keep(term_counts(docs, lang_col, source_col, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "term-counts", "zstd")
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = tmp.keep(counts.where("term is null").select("lang", "source", (F.row_number().over(by_source) - 1).alias("i")), "sources", files=4)
    few = groups.count() <= broadcast_sources

    def beside(df: DataFrame, small: DataFrame, keys: list[str], spread: str) -> DataFrame:
        """df joined with a table that has a row, or one array element, for each source; `spread`: column by which rows of one language are dealt out."""
        if few:
            return df.join(F.broadcast(small), keys)
        dealt = df.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
        return dealt.join(small.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [*keys, "salt"]).drop("salt")

    cells = beside(counts.where("term is not null"), groups, ["lang", "source"], "term")
    # a row for each kept term; as many array elements as sources have it
    kept = tmp.keep(cells.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("at"), F.sum("n").alias("n"), F.sum("d").alias("d")).where(F.col("d") >= min_docs).drop("d"), "kept-terms", "zstd")
    sizes = kept.select("lang", F.inline("at")).groupBy("lang", "i").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("whole"))
    full = groups.join(sizes, ["lang", "i"], "left").join(langs, "lang", "left").select("lang", "i", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("whole", F.lit(0)).alias("whole"))
    # one row a language: arrays indexed by source number of names, sizes (N + V) and shares of no occurrence
    one = full.select("*", F.expr(f"if(v = 0, 0L, {share('0L', '(total + v)')})").alias("z")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "source", (F.col("total") + F.col("v")).alias("size"), "z"))).alias("s"), F.first("v").alias("v"), F.first("whole").alias("whole"))
    table = tmp.keep(one.selectExpr("lang", "v", "whole + v as whole", "s.source as names", "s.size as sizes", "s.z as zs"), "by-source", files=4)

    shares = beside(kept, table, ["lang"], "term").selectExpr("lang", "term", "n", "whole", f"transform(at, x -> struct(x.i as i, {share('x.n', 'sizes[x.i]')} as p, zs[x.i] as z)) as ps")
    # rows of pairs stay within one compiled stage, up to the sums; _outer, as plain ones make plans look at the arrays twice
    lefts = shares.where("size(ps) > 1").selectExpr("lang", "ps", "explode_outer(ps) as a")
    both = lefts.selectExpr("lang", "a", "explode_outer(ps) as b").where("a.i <> b.i").selectExpr("lang", "a.i as i", "b.i as j", f"{f('a.p', 'b.p')} - {f('a.p', 'b.z')} - {f('a.z', 'b.p')} + {f('a.z', 'b.z')} as value")
    counted = kept.select("lang", F.inline("at")).groupBy("lang", "i", "n").agg(F.count("*").alias("c"))
    alone = beside(counted, table, ["lang"], "n").selectExpr("lang", "i", "c", "zs", f"{share('n', 'sizes[i]')} as p")
    others = alone.selectExpr("lang", "i", "c", "p", "zs[i] as y", "posexplode(zs) as (j, z)").where("i <> j")
    left = others.selectExpr("lang", "i", "j", f"c * ({f('p', 'z')} - {f('y', 'z')}) as value")
    right = others.selectExpr("lang", "j as i", "i as j", f"c * ({f('z', 'p')} - {f('z', 'y')}) as value")
    sums = both.unionByName(left).unionByName(right).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    grid = table.selectExpr("lang", "v", "names", "zs", "posexplode(zs) as (i, y)").selectExpr("lang", "v", "names[i] as source", "names", "i", "y", "posexplode(zs) as (j, z)").where("i <> j")
    pairs = grid.selectExpr("lang", "i", "j", "source", "names[j] as item", f"if(v = 0, 0L, v * {f('y', 'z')}) as base").join(sums, ["lang", "i", "j"], "left").selectExpr("lang", "source", "'pair' as part", "item", "base + coalesce(value, 0L) as value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    over = shares.selectExpr("lang", "term", f"{share('n', 'whole')} as q", "ps").selectExpr("lang", "term", "q", "inline_outer(ps)").where("p > q").selectExpr("lang", "i", "term as item", f"{f('p', 'q')} as value")
    best = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "item")
    ranked = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    terms = beside(ranked, groups, ["lang", "i"], "item").selectExpr("lang", "source", "'term' as part", "item", "value", "rank")
    out = materialise(pairs.unionByName(terms), "divergence", files=32)
    tmp.drop()
    return out


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
with docs as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
words as (select r, lang, source, unnest(terms) as term from docs),
kept as (select lang, term, count(*) as n from words group by all having count(distinct r) >= 3),
groups as (select distinct lang, source from docs),
v as (select g.lang, count(k.term) as v, coalesce(sum(k.n), 0)::bigint as whole from (select distinct lang from docs) g left join kept k using (lang) group by all),
cells as (select lang, source, term, count(*) as n from words semi join kept using (lang, term) group by all),
sizes as (select g.lang, g.source, coalesce(sum(n), 0)::bigint as total from groups g left join cells using (lang, source) group by all),
wide as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (s.total + v.v) as p, 1 + (1000000000::hugeint * (k.n + 1)) // (v.whole + v.v) as q
    from sizes s join v using (lang) join kept k using (lang) left join cells c using (lang, source, term)),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from wide a join wide b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
over as (select lang, source, term as item, ((p - q) * (p - q) // q)::bigint as value, row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term)::int as rank from wide where n > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
union all select lang, source, 'term', item, value, rank from over where rank <= 200
"""
