"""Scalar functions on cards, as Spark SQL expressions (strings), so that they stay inside the JVM."""

from __future__ import annotations

import math

VITALITY_LAMBDA = math.log(2) / (30 * 86400)


def dot(a: str, b: str) -> str:
    """Dot product over the common prefix of two float arrays, in double."""
    return f"aggregate(zip_with(slice({a}, 1, least(size({a}), size({b}))), slice({b}, 1, least(size({a}), size({b}))), (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"


def norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + cast(x as double) * cast(x as double)))"


def cosine(a: str, b: str) -> str:
    """Cosine over the common prefix; 0 if either side is zero."""
    return f"coalesce(try_divide({dot(a, b)}, {norm(a)} * {norm(b)}), 0D)"


def dequantise(a: str, scale: str) -> str:
    """8-bit values back to doubles."""
    return f"transform({a}, x -> cast(x as double) * {scale})"


def int_dot(a: str, b: str) -> str:
    """Integer dot product of two 8-bit vectors."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as bigint) * cast(y as bigint)), 0L, (s, v) -> s + v)"


def normalise(a: str) -> str:
    """Unit length; a zero vector stays as it is."""
    return f"transform(array({norm(a)}), n -> if(n = 0, transform({a}, x -> cast(x as double)), transform({a}, x -> cast(x as double) / n)))[0]"


def truncate(a: str, dims: int) -> str:
    """The first dims values, padded with zeros, of unit length again."""
    cut = f"slice(concat(transform({a}, x -> cast(x as double)), array_repeat(0D, {dims})), 1, {dims})"
    return f"transform(array({cut}), c -> {normalise('c')})[0]"


def sq8_scale(a: str) -> str:
    return f"array_max(transform({a}, x -> abs(cast(x as double)))) / 127"


def sq8(a: str) -> str:
    """8-bit values: x / scale, rounded half to even, within -128..127; zeros for a zero vector."""
    return f"transform(array({sq8_scale(a)}), c -> transform({a}, x -> cast(if(c = 0, 0D, greatest(-128D, least(127D, rint(cast(x as double) / c)))) as tinyint)))[0]"


def sign_words(a: str, dims: int) -> str:
    """Sign bits packed into bigints of 32 bits."""
    words = [f"aggregate(transform(sequence(0, 31), i -> if(get({a}, {w} + i) > 0, shiftleft(1L, i), 0L)), 0L, (s, x) -> s | x)" for w in range(0, dims, 32)]
    return f"array({', '.join(words)})"


def hamming(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"


def retention(ts: str, now: str, stability: str, half_life_hours: float) -> str:
    """exp(-age / (stability * half_life)) within 0..1; cards without a time or from the future count as fresh."""
    return f"case when {ts} <= 0 or {now} - {ts} <= 0 or {stability} * {half_life_hours}D <= 0 then 1D else least(1D, greatest(0D, exp(-(({now} - {ts}) / 3600D) / ({stability} * {half_life_hours}D)))) end"


def hybrid_score(cos: str, ret: str, alpha: float) -> str:
    return f"least(1D, greatest(0D, {alpha}D * greatest(0D, least(1D, {cos})) + {1 - alpha}D * {ret}))"


def stability_fold(s0: str, a0: str, importance: str, n: str) -> str:
    """Stability after n touches: each multiplies by 1 + ln(1 + accesses) / 2 + 0.3 * importance; never beyond 10."""
    return f"least(10D, greatest(1D, aggregate(if({n} > 0, sequence(1, cast({n} as int)), array()), cast({s0} as double), (s, i) -> least(10D, greatest(1D, s * (1D + 0.5D * ln(1D + {a0} + i) + 0.3D * {importance}))))))"


def stability_after(s0: float, a0: int, importance: float, n: int) -> float:
    """stability_fold() of one card in Python, for states of streams; it stops where the product has reached its limit for good."""
    s = s0
    for i in range(1, n + 1):
        s = min(10.0, max(1.0, s * (1 + 0.5 * math.log(1 + a0 + i) + 0.3 * importance)))
        if s == 10.0 and importance >= 0:
            break
    return min(10.0, max(1.0, s))


def vitality(last: str, ts: str, accesses: str, now: str) -> str:
    return f"0.7D * exp(-{VITALITY_LAMBDA!r}D * greatest(0D, {now} - if({last} = 0, {ts}, {last}))) + 0.3D * ln(1D + greatest(0, {accesses}))"


def tokens(text: str) -> str:
    """Estimated tokens: the mean of the runs of (non-)white space and a quarter of the characters, rounded down, 1 at least; 0 if empty."""
    return f"case when coalesce({text}, '') = '' then 0L else cast(greatest(1, (size(regexp_extract_all({text}, '\\\\S+|\\\\s+', 0)) + greatest(1, char_length({text}) div 4)) div 2) as bigint) end"


def jaccard(a: str, b: str) -> str:
    """Of two arrays; 0 if both are empty."""
    return f"if(size(array_union({a}, {b})) = 0, 0D, size(array_intersect({a}, {b})) / cast(size(array_union({a}, {b})) as double))"


def fingerprint(fact: str, tags: str) -> str:
    """SHA-256 of the fact and the sorted tags."""
    return f"sha2(if(coalesce(size({tags}), 0) = 0, {fact}, concat({fact}, '||', array_join(sort_array({tags}), ','))), 256)"


def scope_build(m: str) -> str:
    """Canonical scope string of a map: non-empty values, keys sorted; 'default' if nothing is left."""
    parts = f"array_sort(transform(filter(map_entries({m}), e -> e.value is not null and e.value <> ''), e -> concat(e.key, '=', e.value)))"
    return f"transform(array({parts}), p -> if(size(p) = 0, 'default', array_join(p, '&')))[0]"


def scope_parse(s: str) -> str:
    """Map of a scope string; parts without = and repeated keys (the last counts) are tolerated."""
    pairs = f"filter(transform(split(coalesce({s}, ''), '&'), p -> split(p, '=', 2)), p -> size(p) = 2 and trim(p[0]) <> '' and trim(p[1]) <> '')"
    last = f"transform(array({pairs}), ps -> filter(ps, (p, i) -> not exists(slice(ps, i + 2, size(ps)), q -> trim(q[0]) = trim(p[0]))))[0]"
    return f"map_from_entries(transform({last}, p -> struct(trim(p[0]) as k, trim(p[1]) as v)))"


def scope_visible(query: str, card: str) -> str:
    """Hierarchical match of two scope maps: an empty side matches all, else every key of the query must match."""
    return f"(cardinality({query}) = 0 or cardinality({card}) = 0 or forall(map_entries({query}), e -> coalesce({card}[e.key] = e.value, false)))"


def ttl_seconds(tags: str) -> str:
    """Of the first tag ttl:<seconds>; null without one."""
    return f"cast(get(filter(transform({tags}, t -> regexp_extract(t, '^ttl:([0-9]+(?:[.][0-9]+)?)$', 1)), x -> x <> ''), 0) as double)"


def tag_metadata(tags: str) -> str:
    """Map of the k=v tags; the last of repeated keys counts."""
    return scope_parse(f"array_join(filter({tags}, t -> instr(t, '=') > 1), '&')")


def merge_evidence(parts: str, most: int = 3) -> str:
    return f"array_join(slice(array_distinct(filter(transform({parts}, p -> trim(p)), p -> p <> '')), 1, {most}), ' | ')"


def merge_facts(facts: str) -> str:
    joined = f"array_join({facts}, '; ')"
    return f"if(char_length({joined}) > 200, concat(left({joined}, 197), '...'), {joined})"


def age_days(ts: str, now: str) -> str:
    """Days since ts with one decimal; 0 for times to come."""
    return f"round(greatest(0D, {now} - {ts}) / 86400D, 1)"


def iso(ts: str) -> str:
    """A time in seconds as ISO 8601 in UTC."""
    return f"date_format(timestamp_seconds({ts}), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def truncated(text: str, n: int) -> str:
    return f"left({text}, {n})"


def human_size(n: str) -> str:
    """Bytes as B, KB, MB, GB, TB or PB with two significant figures; 0 B for null and negative numbers."""
    unit = f"least(5, cast(floor(log(1024, greatest(1D, {n}))) as int))"
    value = f"({n} / pow(1024D, u))"
    figures = f"case when {value} >= 100 then replace(format_string('%.1e', {value}), '.0e', 'e') when {value} >= 10 then cast(cast(rint({value}) as int) as string) else regexp_replace(format_string('%.1f', rint({value} * 10) / 10), '[.]0$', '') end"
    # 100 and more have an exponent, as in 1e+02
    return f"case when coalesce({n}, -1) < 0 then '0 B' when {n} < 1024 then concat(cast({n} as bigint), ' B') else transform(array({unit}), u -> concat({figures}, ' ', element_at(array('KB', 'MB', 'GB', 'TB', 'PB'), u)))[0] end"


def bar(part: str, width: int = 20) -> str:
    """A share from 0 to 1 as a bar."""
    full = f"cast(rint({width} * greatest(0D, least(1D, {part}))) as int)"
    return f"concat(repeat('#', {full}), repeat('.', {width} - {full}))"
