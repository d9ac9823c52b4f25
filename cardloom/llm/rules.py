"""Quality rules in SQL: fixed limits, then robust multivariate outliers.

Eight statistics of each text become a vector: word length, capitals, punctuation and short words (logarithms of shares,
drawn to a usual value for short texts), and words said twice in a row, symbols, repeated lines and words in repeated
windows, of which most texts have none. For every (language, source) the minimum covariance determinant is estimated: the COVER share of rows whose
covariance matrix has the least determinant. From each of four starts (medians and quartile ranges of all coordinates, or
of a few only) concentration steps take mean and covariance of the rows with the smallest Mahalanobis distances. After
two steps the start of least determinant goes on alone, until nothing changes; of all that was reached, the estimate of
least determinant counts. It is then drawn, to its language: by the weight of PRIOR rows to the median of the means of the
sources, which odd sources don't move, and by that of PRIOR_SPREAD rows to the covariance within sources, pooled from the rows that the estimates chose
and drawn to that of the corpus in turn. So a source of a few rows, or of one, is judged much like the rest of its
language, and a large one by itself. A document is rejected if its distance, made
consistent for normal data, exceeds CUTOFF.

As in the regularised form of the estimator, covariances are mixed with the diagonal of the starts, worth PULL rows, so
that small groups don't fit their own noise; and a deviation has a floor: a few hundredths for what varies in any text,
more for what most texts have none of, or a single repeated line would be an outlier.

Vectors are integers in 1/1024, so all sums are exact and do not depend on how rows are dealt out. A step is one
aggregation by (language, source, start, distance class), so a hot source is combined before the shuffle; the classes
are 24 to a factor e of 1 + squared distance, 332 in all. Estimates are tables, a row for a group and start; nothing is
collected.

Defined results: null and empty texts have no words and fail the fixed limits; null lang or source are groups
like others, of any size; repeated rows count as often as they occur and all come back; ties of determinants go to the first start; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import Temporary, materialise, read, release

WINDOW = 5
COVER = 0.75
#: Steps from every start, and in all at most.
TRIALS = 2
STEPS = 12
#: Rows that the language's mean counts for in a source's; and its covariance, which has more numbers to estimate, also the corpus's in a language's.
PRIOR, PRIOR_SPREAD = 20, 500
#: Squared distance: beyond the 0.999999 quantile of chi-square with eight degrees of freedom, since short texts have heavier tails.
CUTOFF = 45.0
#: 0.75 divided by the chi-square(10) probability of the 0.75 quantile of chi-square(8).
CONSISTENCY = 1.297
PULL = 10
DIMS = 8
#: Least standard deviation of each statistic, in 1/1024.
FLOORS = (30, 80, 80, 50, 600, 600, 600, 600)
#: The coordinates that each start looks at.
STARTS = ((1, 2, 3, 4, 5, 6, 7, 8), (1, 4), (2, 3), (5, 6, 7, 8))
#: Tables of estimates have a row for a group and start: they go into few files.
FILES = 16
#: Distance classes: 24 to a factor e of 1 + squared distance, up to a million.
CLASSES, FARTHEST = 24, 1_000_000

SPACE = r"[\\x20\\x09-\\x0D]"
WORD = r"[^\\x20\\x09-\\x0D]"
P = range(1, DIMS + 1)
PAIRS = [(i, j) for i in P for j in range(1, i + 1)]


def let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words() -> str:
    """SQL for the number of words in windows of WINDOW words that occur twice or more in the words of which `wh` has the hashes.

    Windows are compared by 64-bit hashes. Only texts with a repeated one sort them, to see which positions are hit and
    how many words these cover.
    """
    window = "xxhash64(" + ", ".join(f"get(wh, i + {k})" for k in range(WINDOW)) + ")"
    covered = let("t", "array_sort(transform(h, (x, i) -> struct(x as x, i as i)))", let("p", "sort_array(transform(filter(t, (e, k) -> (k > 0 and get(t, k - 1).x <=> e.x) or (get(t, k + 1).x <=> e.x)), e -> e.i))", f"aggregate(transform(p, (x, k) -> cast(coalesce(least({WINDOW}, get(p, k + 1) - x), {WINDOW}) as bigint)), 0L, (a, x) -> a + x)"))
    found = let("h", f"transform(sequence(0, size(wh) - {WINDOW}), i -> {window})", f"if(size(array_distinct(h)) < size(h), {covered}, 0L)")
    return f"if(size(wh) < {WINDOW}, 0L, {found})"


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_short, n_again, n_upper, n_punct, base_failed."""
    whole = docs.selectExpr("doc_id", "cast(lang as string) as lang", "cast(source as string) as source", "coalesce(text, '') as text")
    lines = f"filter(split(text, '\\n', -1), l -> l rlike '{WORD}')"
    among = lambda chars, name: f"cast(regexp_count(text, '{chars}') as bigint) as {name}"
    of_words = f"struct(cast(size(ws) as bigint) as n_words, cast(char_length(array_join(ws, '')) as bigint) as word_chars, {repeated_words()} as n_repeat_words, cast(size(filter(ws, w -> char_length(w) <= 3)) as bigint) as n_short, cast(size(filter(wh, (w, i) -> i > 0 and w = get(wh, i - 1))) as bigint) as n_again)"
    counted = whole.selectExpr(
        "doc_id", "lang", "source",
        let("ws", f"array_remove(split(text, '{SPACE}+', -1), '')", let("wh", "transform(ws, w -> xxhash64(w))", of_words)) + " as a",
        among("[#*$%&|<>]", "n_symbols"), among("[A-Z]", "n_upper"), among("[.,;:!?]", "n_punct"),
        let("ls", lines, "struct(cast(size(ls) as bigint) as n_lines, cast(size(ls) - size(array_distinct(ls)) as bigint) as n_dup_lines)") + " as b",
    )
    return counted.selectExpr("doc_id", "lang", "source", "a.n_words", "a.word_chars", "n_symbols", "b.n_dup_lines", "a.n_repeat_words", "b.n_lines", "a.n_short", "a.n_again", "n_upper", "n_punct").selectExpr("*", "n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed")


#: The coordinates before scaling. The first four are logarithms of shares that any text has; the others are 0 where there is nothing to count.
VECTOR = (
    "ln((word_chars + 200e0) / (n_words + 40))",
    "ln((n_upper + 10e0) / (word_chars + 400))",
    "ln((n_punct + 8e0) / (n_words + 40))",
    "ln((n_short + 14e0) / (n_words + 40))",
    "ln(1 + 100e0 * n_again / (n_words + 20))",
    "ln(1 + 100e0 * n_symbols / (n_words + 20))",
    "ln(1 + 100e0 * n_dup_lines / (n_lines + 10))",
    "ln(1 + 100e0 * n_repeat_words / (n_words + 20))",
)


def vectors(stats: DataFrame) -> DataFrame:
    """stats plus x1 to x8, integers."""
    return stats.selectExpr("*", *[f"cast(round(1024 * {e}) as bigint) as x{i}" for i, e in zip(P, VECTOR, strict=True)])


def distance() -> str:
    """SQL for the squared Mahalanobis distance of v to the estimate s, by its precision matrix."""
    return " + ".join(f"(v.x{i} - s.m{i}) * (v.x{i} - s.m{i}) * s.w{i}_{i}" if i == j else f"2e0 * (v.x{i} - s.m{i}) * (v.x{j} - s.m{j}) * s.w{i}_{j}" for i, j in PAIRS)


def starts(vec: DataFrame) -> DataFrame:
    """(lang, source, start, total, t1 to t8: variances of the starts, m, w): one row for each group and start."""
    spread = [f"percentile(x{i}, 0.5) as m{i}" for i in P] + [f"pow((percentile(x{i}, 0.75) - percentile(x{i}, 0.25)) / 1.349e0 + {f}, 2) as t{i}" for i, f in zip(P, FLOORS, strict=True)]
    groups = vec.groupBy("lang", "source").agg(F.count("*").alias("total"), *map(F.expr, spread))
    one = groups.withColumn("start", F.explode(F.array(*map(F.lit, range(len(STARTS))))))
    looks = {i: ", ".join(str(k) for k, s in enumerate(STARTS) if i in s) for i in P}
    return one.selectExpr("lang", "source", "start", "total", *[f"t{i}" for i in P], *[f"m{i}" for i in P], *[f"if(start in ({looks[i]}), 1e0 / t{i}, 0e0) as w{i}_{i}" if i == j else f"0e0 as w{i}_{j}" for i, j in PAIRS])


ON = "v.lang <=> s.lang and v.source <=> s.source"


def concentrate(vec: DataFrame, est: DataFrame) -> DataFrame:
    """One step from est: (lang, source, start, total, t, n, sums s of the rows chosen, m, w, ld: logarithm of the determinant)."""
    keys = ["lang", "source", "start"]
    sums = [f"s{i}" for i in P] + [f"s{i}_{j}" for i, j in PAIRS]
    chosen = vec.alias("v").join(est.alias("s"), F.expr(ON)).selectExpr("v.lang", "v.source", "s.start", *[f"v.x{i}" for i in P], f"cast(floor({CLASSES} * ln(1 + least(greatest({distance()}, 0e0), {FARTHEST}e0))) as int) as c")
    classes = chosen.groupBy(*keys, "c").agg(F.count("*").alias("n"), *[F.expr(f"sum(x{i})").alias(f"s{i}") for i in P], *[F.expr(f"sum(x{i} * x{j})").alias(f"s{i}_{j}") for i, j in PAIRS])
    whole = classes.selectExpr("*", "sum(n) over (partition by lang, source, start order by c) - n as before", "sum(n) over (partition by lang, source, start) as of")
    subset = whole.where(f"before < {COVER}e0 * of").groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in sums])
    known = est.selectExpr(*[f"{k} as {k}0" for k in keys], "total", *[f"t{i}" for i in P])
    out = subset.join(known, F.expr(" and ".join(f"{k} <=> {k}0" for k in keys))).drop(*[f"{k}0" for k in keys])
    mixed = lambda i, j: f"({CONSISTENCY}e0 * (s{i}_{j} - cast(s{i} as double) * s{j} / n)" + (f" + {PULL}e0 * t{i}" if i == j else "") + f") / (n + {PULL})" + (f" + {FLOORS[i - 1] ** 2}e0" if i == j else "")
    out = out.selectExpr("*", *[f"cast(s{i} as double) / n as m{i}" for i in P], *[f"{mixed(i, j)} as w{i}_{j}" for i, j in PAIRS], "0e0 as ld")
    return invert(out)


def invert(out: DataFrame) -> DataFrame:
    """out with the covariances w turned into their inverse; the logarithm of the determinant is added to ld."""
    for k in P:  # sweeping every pivot turns the matrix into minus its inverse
        at = lambda i, j: f"w{max(i, j)}_{min(i, j)}"
        pivot = f"w{k}_{k}"
        swept = {f"w{i}_{j}": f"-1e0 / {pivot}" if i == j == k else f"{at(i, j)} / {pivot}" if k in (i, j) else f"w{i}_{j} - {at(i, k)} * {at(j, k)} / {pivot}" for i, j in PAIRS}
        out = out.withColumns({name: F.expr(e) for name, e in swept.items()} | {"ld": F.expr(f"ld + ln({pivot})")})
    return out.withColumns({f"w{i}_{j}": F.expr(f"-w{i}_{j}") for i, j in PAIRS})


def estimate(vec: DataFrame, steps: int = STEPS) -> DataFrame:
    """(lang, source, total, m, w, n and sums s of the rows chosen) of least determinant for each group, over all starts and steps."""
    sums = ["n", *[f"s{i}" for i in P], *[f"s{i}_{j}" for i, j in PAIRS]]
    now, temp = materialise(starts(vec), "starts", files=FILES), Temporary()
    temp.tables.append(now)
    seen = []
    for k in range(steps):
        before, now = now, temp.keep(concentrate(vec, now).withColumn("step", F.lit(k)), "estimate", files=FILES)
        seen.append(now)
        if k == TRIALS - 1:
            first = now.groupBy("lang", "source").agg(F.min(F.struct("ld", "start")).alias("b")).select(F.col("lang").alias("lang0"), F.col("source").alias("source0"), "b.start")
            now = temp.keep(now.join(first, F.expr("lang <=> lang0 and source <=> source0") & (now["start"] == first["start"]), "left_semi"), "first", files=FILES)
        # settled: the same rows were chosen again everywhere
        elif k >= TRIALS and now.alias("v").join(before.alias("s"), F.expr(f"{ON} and " + " and ".join(f"v.{x} = s.{x}" for x in sums)), "left_anti").isEmpty():
            break
    fields = ["ld", "start", "step", "total", *[f"m{i}" for i in P], *[f"w{i}_{j}" for i, j in PAIRS], *sums]
    every = seen[0].select("lang", "source", *fields)
    for x in seen[1:]:
        every = every.union(x.select("lang", "source", *fields))
    best = materialise(every.groupBy("lang", "source").agg(F.min(F.struct(*fields)).alias("b")).select("lang", "source", "b.*"), "best", files=FILES)
    temp.drop()
    return best


def drawn(best: DataFrame) -> DataFrame:
    """(lang, source, m, w) of estimate(), drawn to the estimate of the language. Means are rounded for the median, so that there are few different ones."""
    cells = [f"c{i}_{j}" for i, j in PAIRS]
    groups = best.selectExpr("lang", "source", "n", *[f"s{i}" for i in P], *[f"{CONSISTENCY}e0 * (s{i}_{j} - cast(s{i} as double) * s{j} / n) as c{i}_{j}" for i, j in PAIRS])
    pooled = [F.sum(x).alias(x) for x in ["n", *cells]]
    corpus = groups.agg(*pooled).selectExpr("struct(" + ", ".join(f"{c} / n as {c}" for c in cells) + ") as up")
    langs = groups.groupBy("lang").agg(*pooled, *[F.expr(f"percentile(cast(round(s{i} / n) as bigint), 0.5)").alias(f"m{i}") for i in P]).withColumn("up", corpus.scalar())
    towards = lambda c: f"({c} + {PRIOR_SPREAD}e0 * up.{c}) / (n + {PRIOR_SPREAD})"
    langs = langs.selectExpr("lang as lang0", "struct(" + ", ".join([*[f"m{i}" for i in P], *[f"{towards(c)} as {c}" for c in cells]]) + ") as up")
    out = groups.join(langs, F.expr("lang <=> lang0"))
    return invert(out.selectExpr("lang", "source", *[f"(s{i} + {PRIOR}e0 * up.m{i}) / (n + {PRIOR}) as m{i}" for i in P], *[towards(f"c{i}_{j}") + (f" + {FLOORS[i - 1] ** 2}e0" if i == j else "") + f" as w{i}_{j}" for i, j in PAIRS], "0e0 as ld"))


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The contract's row for each of docs (doc_id, text, lang, source), and d2, its squared distance (null if the limits fail)."""
    stats = materialise(statistics(docs), "rules")
    vec = vectors(stats.where("not base_failed"))
    best = estimate(vec)
    known = materialise(drawn(best), "drawn", files=FILES)
    release(best)
    contract = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    passed = vec.alias("v").join(known.alias("s"), F.expr(ON)).selectExpr(*[f"v.{c}" for c in contract], f"{distance()} as d2")
    return passed.union(stats.where("base_failed").selectExpr(*contract, "cast(null as double)")).selectExpr(*contract, f"coalesce(d2 <= {cutoff}e0, false) as kept", "d2")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents")).drop("d2")


ORACLE_STATS = r"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, array_to_string(ws[i:i + 4], ' ') as g from (select r, ws, unnest(range(1, len(ws) - 3)) as i from w where len(ws) >= 5)),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from (select r, i, count(*) over (partition by r, g) as k from g) where k > 1) group by r)
select r, doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words, cast(len(ls) as bigint) as n_lines, cast(len(list_filter(ws, lambda x: length(x) <= 3)) as bigint) as n_short,
    cast(length(regexp_replace(text, '[^A-Z]+', '', 'g')) as bigint) as n_upper, cast(length(regexp_replace(text, '[^.,;:!?]+', '', 'g')) as bigint) as n_punct, cast(len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as bigint) as n_again,
    len(ws) < 10 or 100 * coalesce(rep.n, 0) > 20 * len(ws) as base_failed
from w left join rep using (r)
"""


def oracle() -> str:
    """DuckDB SQL of its own make: lists and matrices of lists, sums by coordinate pair, inversion by Gauss-Jordan steps."""
    n = DIMS
    same = lambda a, b: f"{a}.lang is not distinct from {b}.lang and {a}.source is not distinct from {b}.source"
    x = ", ".join(f"round(1024 * {e})" for e in VECTOR)
    swept = lambda p: f"case when i = {p} and j = {p} then 1e0 / a[{p}][{p}] when i = {p} then a[{p}][j] / a[{p}][{p}] when j = {p} then -a[i][{p}] / a[{p}][{p}] else a[i][j] - a[i][{p}] * a[{p}][j] / a[{p}][{p}] end"
    floors = "[" + ", ".join(f"{f}.0" for f in FLOORS) + "]"
    d2 = f"list_sum(list_transform(range(1, {n + 1}), lambda i: (v.x[i] - s.m[i]) * list_dot_product(s.w[i], list_transform(range(1, {n + 1}), lambda j: v.x[j] - s.m[j]))))"
    looks = ", ".join(f"({k}, {list(s)})" for k, s in enumerate(STARTS))
    parts = [f"st as ({ORACLE_STATS})", f"vec as materialized (select *, [{x}]::double[] as x from st where not base_failed)", f"lk(start, looks) as (values {looks})"]
    parts.append(f"coord as (select lang, source, i, count(*) as total, quantile_cont(x[i], 0.5) as m, ((quantile_cont(x[i], 0.75) - quantile_cont(x[i], 0.25)) / 1.349e0 + {floors}[i]) ** 2 as t from vec, range(1, {n + 1}) r(i) group by 1, 2, 3)")
    parts.append("diag as materialized (select lang, source, any_value(total) as total, list(m order by i) as m, list(t order by i) as t from coord group by 1, 2)")
    parts.append(f"est0 as materialized (select lang, source, total, t, start, m, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: case when i = j and list_contains(looks, i) then 1e0 / t[i] else 0e0 end)) as w from diag, lk)")
    for k in range(1, STEPS + 1):
        parts.append(f"cl{k} as materialized (select v.r, s.lang, s.source, s.start, v.x, floor({CLASSES} * ln(1 + least(greatest({d2}, 0e0), {FARTHEST}e0))) as c from vec v join {'first' if k == TRIALS + 1 else f'est{k - 1}'} s on {same('v', 's')})")
        parts.append(f"in{k} as (select * from (select *, count(*) over (partition by lang, source, start order by c groups between unbounded preceding and 1 preceding) as before, count(*) over (partition by lang, source, start) as total from cl{k}) where before < {COVER}e0 * total)")
        parts.append(f"sum{k} as materialized (select lang, source, start, i, j, count(*) as n, sum(x[i])::double as si, sum(x[j])::double as sj, sum(x[i] * x[j])::double as sij from in{k}, range(1, {n + 1}) a(i), range(1, {n + 1}) b(j) group by all)")
        parts.append(f"cov{k} as (select u.lang, u.source, u.start, u.i, any_value(d.total) as total, any_value(d.t) as t, any_value(si / n) as m, list(({CONSISTENCY}e0 * (sij - si * sj / n) + case when u.i = j then {PULL}e0 * d.t[u.i] else 0 end) / (n + {PULL}) + case when u.i = j then {floors}[u.i] ** 2 else 0 end order by j) as row_ from sum{k} u join diag d on {same('u', 'd')} group by 1, 2, 3, 4)")
        parts.append(f"g{k}_0 as (select lang, source, start, any_value(total) as total, any_value(t) as t, list(m order by i) as m, list(row_ order by i) as a, 0e0 as ld from cov{k} group by 1, 2, 3)")
        for p in P:
            cell = swept(p)
            parts.append(f"g{k}_{p} as (select lang, source, start, total, t, m, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: {cell})) as a, ld + ln(a[{p}][{p}]) as ld from g{k}_{p - 1})")
        parts.append(f"est{k} as materialized (select lang, source, total, t, start, m, a as w, ld, {k} as step from g{k}_{n})")
        if k == TRIALS:
            parts.append(f"first as materialized (select * from est{k} qualify row_number() over (partition by lang, source order by ld, start) = 1)")
    every = " union all ".join(f"select * from est{k}" for k in range(1, STEPS + 1))
    parts.append(f"best as (select * from (select *, row_number() over (partition by lang, source order by ld, start, step) as k from ({every})) where k = 1)")
    # scatters are pooled by language and in all, and each estimate is drawn to the next wider one
    every = " union all ".join(f"select *, {k} as step from sum{k}" for k in range(1, STEPS + 1))
    parts.append(f"u0 as materialized (select u.*, {CONSISTENCY}e0 * (sij - si * sj / n) as sc from ({every}) u join best b on {same('u', 'b')} and u.start = b.start and u.step = b.step)")
    parts.append("corpus as materialized (select i, j, sum(sc) / sum(n) as c from u0 group by i, j)")
    parts.append(f"langs as materialized (select u.lang, u.i, u.j, quantile_cont(round(u.si / u.n), 0.5) as m, (sum(u.sc) + {PRIOR_SPREAD}e0 * any_value(p.c)) / (sum(u.n) + {PRIOR_SPREAD}) as c from u0 u join corpus p on u.i = p.i and u.j = p.j group by 1, 2, 3)")
    parts.append(f"cells as (select u.lang, u.source, u.i, u.j, (u.si + {PRIOR}e0 * p.m) / (u.n + {PRIOR}) as m, (u.sc + {PRIOR_SPREAD}e0 * p.c) / (u.n + {PRIOR_SPREAD}) + case when u.i = u.j then {floors}[u.i] ** 2 else 0 end as c from u0 u join langs p on u.i = p.i and u.j = p.j and u.lang is not distinct from p.lang)")
    parts.append("d0 as (select lang, source, list(m order by i) as m, list(row_ order by i) as a from (select lang, source, i, any_value(m) as m, list(c order by j) as row_ from cells group by 1, 2, 3) group by 1, 2)")
    for p in P:
        parts.append(f"d{p} as (select lang, source, m, list_transform(range(1, {n + 1}), lambda i: list_transform(range(1, {n + 1}), lambda j: {swept(p)})) as a from d{p - 1})")
    parts.append(f"known as materialized (select lang, source, m, a as w from d{n})")
    return f"""with {", ".join(parts)}
select v.doc_id, v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed, {d2} <= {CUTOFF}e0 as kept from vec v join known s on {same('v', 's')}
union all select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, false from st where base_failed"""


ORACLE = oracle()
