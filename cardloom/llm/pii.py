"""Personal data by weak supervision, with Spark expressions only.

Base spans (email, ip, card, phone) are found by pattern and checked by rule; they always stay. Beyond them, candidate
spans are proposed widely: digit chains, local phone numbers, values after words such as "token" and bare runs that look
like keys, and capitalised words in a row, with a title, from a known given name on, or two and more of any kind; what
overlaps a base span isn't proposed. Five labelers vote on each candidate, for, against or not at all: its shape, a
gazetteer, the words before it, the way it is written, and its place. They know different things and contradict each
other. Expectation-maximisation on the counts of vote patterns estimates how often each labeler is right for each kind,
and how likely a candidate of each kind and pattern is personal data; on these soft labels a naive Bayes span classifier
over kind, votes, length class and the characters around the span is trained, and candidates that it scores at THRESHOLD
or more become spans. What is fitted are a few hundred counts (kinds x patterns x features), whatever the size of the
corpus; the driver sees no document.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; very long texts are
searched whole, in linear time (patterns start only where a longer match couldn't have begun earlier, context comes from
the pieces between matches, overlaps by binary search over the farthest ends so far); equal rows get equal spans; an empty table gives no rows and fits
nothing; other columns pass through redact() unchanged, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import chunks, materialise, piece, read
from cardloom.llm.rules import let

THRESHOLD = 0.8
EM_STEPS = 40

# The base patterns. They match what the plain ones do: a look-behind (or \G, the end of the last match) skips starts
# inside a run whose own start would have matched, and possessive loops never give back what can't help.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

# Candidate patterns beyond the base ones, and the words that labelers know.
_KEY = r"(?i:token|secret|password|passwd|pwd|passwort|api[_-]?key|access[_-]?key|key)"
#: A value after such a word, or a bare run of 20 characters and more.
SECRET = rf"\b{_KEY}\b[\x22']?\s{{0,3}}[=:]\s{{0,3}}[\x22']?[A-Za-z0-9+/_.=-]{{12,}}+[\x22']?|(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{{20,}}+=*+"
SECRET_GUARD = r"[=:]|[A-Za-z0-9+/_-]{20}"
NUMBER = r"[0-9](?:[ -]?[0-9])++"
LOCAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ -][0-9]{3}[ -][0-9]{4}(?![0-9])"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Steven Emma Paul Emily Andrew Laura Kevin Rebecca Brian Helen George Alice "
    "Hans Petra Klaus Sabine Jürgen Ursula Peter Monika Wolfgang Anna Stefan Julia Andreas Katharina Markus Claudia Uwe Heike Dieter Birgit Karl Ingrid "
    "Pierre Marie Jean Nathalie Philippe Isabelle Michel Sylvie Alain Catherine Nicolas Valérie Christophe Sophie Laurent Camille Antoine Chloé "
    "Carlos Carmen José María Antonio Ana Manuel Isabel Francisco Pilar Juan Dolores Javier Teresa Miguel Lucía Pedro Elena Luis Rosa Maria Marta Diego Paula"
).split()
#: Words that begin sentences in these languages, not names.
FUNCTION = "The A An And Or Of To In On At By For With That This It Is Was Are He She They We I But Not From As Be Der Die Das Den Dem Ein Eine Und Oder Mit Von Zu Im Am Auf Für Ist Sind Er Sie Es Wir Nicht Le La Les Un Une Des Du De Et Ou En Dans Pour Par Sur Est Sont Il Elle Nous Que Qui El Los Las Una Y O Con Por Para Del Al Se Su No Lo".split()
#: A capitalised word, also O'Brien and Müller-Groß; and up to three more, with initials and particles between.
_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:['’-]?\p{Lu}\p{Ll}++)*+"
_MORE = rf"(?: (?:\p{{Lu}}\. )?(?:(?:de|da|di|du|la|del|van|von|der|den) ){{0,2}}{_WORD})"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:(?:{TITLES})\.? )++{_WORD}{_MORE}{{0,3}}|(?:{'|'.join(GIVEN)})(?:['’-]\p{{Lu}}\p{{Ll}}++)*+(?!\p{{L}}){_MORE}{{0,3}}|{_WORD}{_MORE}{{1,3}})(?!\p{{L}})"
NAME_GUARD = rf"(?<!\p{{L}})(?:{TITLES}|{'|'.join(GIVEN)})(?!\p{{L}})|\p{{Ll}} (?:\p{{Lu}}\. )?\p{{Lu}}\p{{Ll}}+ \p{{Lu}}|\p{{Lu}}\p{{Ll}}+ \p{{Lu}}[.\p{{Ll}}]"
#: Words before a candidate that speak for and against it.
CONTEXT = {
    "number": (r"\b(?:card|credit|visa|account|iban|karte|konto|carte|compte|tarjeta|cuenta)", r"\b(?:order|invoice|isbn|item|page|serial|version|bestell|rechnung|commande|facture|pedido|factura)"),
    "secret": (r"\b(?:token|secret|password|passwd|pwd|key|bearer|passwort|clave)\b", r"\b(?:sha(?:1|256)?|md5|commit|hash|checksum|etag|uuid|build|version|file|path)\b|[/\\\\]$|https?:"),
    "local": (r"\b(?:phone|tel|call|fax|mobile|telefon|anruf|appel|llam)", r"\b(?:order|invoice|isbn|item|serial|version|ticket|ref)"),
    "name": (r"(?<!\p{L})(?:name|contact|author|by|von|par|por|signed|regards|dear|sincerely|autor|auteur|kontakt|gezeichnet)[\x22',\s:=]{0,5}$", r"(?<!\p{L})(?:the|der|die|das|la|le|el|les|los|las|in|at|near|of|de)\s$"),
}
EXTRA = ("number", "secret", "local", "name")
LABELERS = ("shape", "gazetteer", "context", "writing", "place")


def lit(s: str) -> str:
    """A SQL string literal of s, in Spark's escapes."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_of(pattern: str, guard: str, keep: str, kind: str) -> str:
    """SQL for array<struct<s, e, kind, m, b, a>> of the matches m of pattern in `text` for which `keep` holds, if guard holds at all.

    b is what stands before the match, 24 characters at most and not beyond the match before; a is the character after it.

    The n-th match starts after the first n pieces between matches and the first n - 1 matches; lengths are summed in
    two levels, so that a text with very many matches stays cheap.
    """
    # gap[i] + match[i] for each match; base[b]: sum of all before block b of 256
    within = "aggregate(slice(ls, 256 * (i div 256) + 1, i % 256), 0L, (a, x) -> a + x)"
    before = "if(i < 256, 0L, aggregate(slice(bs, 1, i div 256), 0L, (a, x) -> a + x))"
    start = f"{before} + if(i % 256 = 0, 0L, {within}) + char_length(ps[i])"
    body = let("ps", f"split(text, {lit(pattern)}, -1)", let("ls", "transform(ms, (m, i) -> cast(char_length(ps[i]) + char_length(m) as bigint))", let("bs", "transform(sequence(0, cast((size(ls) - 1) div 256 as int)), b -> aggregate(slice(ls, 256 * b + 1, 256), 0L, (a, x) -> a + x))", f"filter(transform(ms, (m, i) -> {let('s', start, f'struct(s as s, s + char_length(m) as e, {lit(kind)} as kind, m as m, right(ps[i], 24) as b, left(ps[i + 1], 1) as a)')}), c -> {keep})")))
    empty = "cast(array() as array<struct<s: bigint, e: bigint, kind: string, m: string, b: string, a: string>>)"
    found = let("ms", f"regexp_extract_all(text, {lit(pattern)}, 0)", f"if(size(ms) = 0, {empty}, {body})")
    return f"case when {guard} then {found} else {empty} end"


def digits(sql: str) -> str:
    return f"regexp_replace({sql}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """SQL for whether the digits d pass the Luhn check."""
    twice = "cast(x as int) * 2 - if(cast(x as int) > 4, 9, 0)"
    return f"aggregate(transform(split(reverse({d}), ''), (x, i) -> if(x = '', 0, if(i % 2 = 1, {twice}, cast(x as int)))), 0, (a, x) -> a + x) % 10 = 0"


def base_spans() -> str:
    """SQL for all base spans of `text`, kind by kind."""
    some_digit = "text rlike '[0-9]'"
    parts = [
        spans_of(EMAIL, "instr(text, '@') > 0", "true", "email"),
        spans_of(IP, some_digit, "forall(split(c.m, '[.]'), x -> length(ltrim('0', x)) <= 3 and cast(concat('0', right(x, 3)) as int) <= 255)", "ip"),
        spans_of(CARD, some_digit, let("d", digits("c.m"), f"length(d) between 14 and 19 and {luhn('d')}"), "card"),
        spans_of(PHONE, "instr(text, '+') > 0", f"length({digits('c.m')}) between 10 and 15", "phone"),
    ]
    return f"concat({', '.join(parts)})"


def extra_spans() -> dict[str, str]:
    """SQL for the candidates of `text` that labelers have to judge, by kind."""
    some_digit = "text rlike '[0-9]'"
    return {
        "number": spans_of(NUMBER, some_digit, f"length({digits('c.m')}) between 9 and 19", "number"),
        "secret": spans_of(SECRET, f"text rlike {lit(SECRET_GUARD)}", "c.m rlike '[=:]' or (c.m rlike '[0-9]' and c.m rlike '[A-Za-z]')", "secret"),
        "local": spans_of(LOCAL, some_digit, "true", "local"),
        "name": spans_of(NAME, f"text rlike {lit(NAME_GUARD)}", "true", "name"),
    }


def reaching(spans: str) -> str:
    """SQL for spans (s, e, kind), sorted by start, with r: the largest end of a span and all before it.

    Spans of several kinds nest, so the last one before a place needn't be the one that reaches farthest. Maxima are taken in blocks
    of 256 and over the blocks before.
    """
    own = "array_max(slice(es, 256 * (i div 256) + 1, i % 256 + 1))"
    blocks = "transform(sequence(0, cast((size(es) - 1) div 256 as int)), k -> array_max(slice(es, 256 * k + 1, 256)))"
    out = f"transform({spans}, (x, i) -> struct(x.s as s, x.e as e, x.kind as kind, if(i < 256, {own}, greatest({own}, array_max(slice(ms, 1, i div 256)))) as r))"
    return let("es", f"transform({spans}, x -> x.e)", let("ms", blocks, out))


def overlaps(spans: str, reach: str = "e", c: str = "c") -> str:
    """SQL for whether c overlaps one of spans, which are sorted by start: of those that begin before its end, by binary search, does any end after its start?

    reach: the field with the largest end so far, `r` of reaching(); where spans don't overlap each other their own end is.
    """
    middle = "(x.lo + x.hi) div 2"
    found = f"aggregate(sequence(1, 31), struct(0 as lo, size({spans}) as hi), (x, k) -> if(x.lo >= x.hi, x, if(get({spans}, cast({middle} as int)).s < {c}.e, struct(cast({middle} + 1 as int) as lo, x.hi as hi), struct(x.lo as lo, cast({middle} as int) as hi)))).lo"
    return f"if(size({spans}) = 0, false, coalesce(get({spans}, {found} - 1).{reach} > {c}.s, false))"


def votes() -> dict[str, str]:
    """SQL of each labeler's vote on candidate c: 1 for, 0 against, null for none."""
    before, d = "lower(c.b)", digits("c.m")
    value = f"regexp_replace(c.m, {lit('^[^=:]*[=:][\\s\\x22' + chr(39) + ']*|[\\x22' + chr(39) + ']$')}, '')"
    three = lambda yes, no: f"case when {yes} then 1 when {no} then 0 end"
    given, function = lit("^(?:" + "|".join(GIVEN) + r")(?!\p{L})"), lit("^(?:" + "|".join(FUNCTION) + ") ")
    title = f"c.m rlike {lit('^(?:' + TITLES + ')[. ]')}"
    kinds = {
        "shape": {
            "number": three(f"length({d}) in (13, 15, 16) and {luhn(d)}", f"length({d}) >= 13"),
            "secret": three(f"length({value}) >= 16 and {value} rlike '[0-9]' and {value} rlike '[A-Za-z]'", f"not ({value} rlike '[0-9]' and {value} rlike '[A-Za-z]')"),
            "local": three(f"substr({d}, 1, 1) > '1' and substr({d}, 4, 1) > '1'", f"substr({d}, 1, 1) <= '1' or substr({d}, 4, 1) = '0'"),
            "name": three(f"{title} or c.m rlike {lit(r' (?:\p{Lu}\. )?(?:de|da|di|du|del|van|von) | \p{Lu}\. ')}", "size(array_distinct(split(c.m, ' '))) < size(split(c.m, ' ')) or c.m rlike '\\\\p{L}{15}' or exists(split(c.m, ' '), w -> length(w) < 3)"),
        },
        "gazetteer": {
            "number": three(f"{d} rlike '^(4|5[1-5]|2[2-7]|3[47]|6011)' and length({d}) between 13 and 19", f"{d} rlike '^97[89]' or length({d}) < 13 or {d} rlike '^[01789]'"),
            "secret": three(f"{value} rlike '^(ghp_|gho_|sk-|pk-|AKIA|xox[abp]-|eyJ|AIza|glpat-)'", f"lower({value}) rlike '(example|placeholder|changeme|dummy|sample|xxxx|your[_-])'"),
            "local": three(f"substr({d}, 1, 3) rlike '^(20[1-9]|21[2-9]|30[1-9]|31[02-9]|40[1-9]|41[02-9]|50[1-9]|51[02-9]|60[1-9]|61[02-9]|70[1-8]|71[2-9]|80[1-8]|81[02-9]|90[1-9]|91[02-9])$'", f"{d} rlike '^(000|123|555|999)'"),
            "name": three(f"c.m rlike {given} or {title}", f"c.m rlike {function}"),
        },
        "context": {k: three(f"{before} rlike {lit(yes)}" + (f" or lower(c.m) rlike {lit('^' + _KEY[4:-1].join(('(?:', ')')))}" if k == "secret" else ""), f"{before} rlike {lit(no)}") for k, (yes, no) in CONTEXT.items()},
        "writing": {
            "number": three(f"c.m rlike '^[0-9]{{4}}([ -])[0-9]{{4}}\\\\1[0-9]{{4}}\\\\1[0-9]{{1,4}}$' or c.m rlike '^[0-9]{{4}}([ -])[0-9]{{6}}\\\\1[0-9]{{5}}$'", "c.m rlike '[ -]'"),
            "secret": three(f"c.m rlike '[=:]' and {value} rlike '^([0-9a-fA-F]{{32}}|[0-9a-fA-F]{{40}}|[0-9a-fA-F]{{64}})$' or ({value} rlike '[a-z]' and {value} rlike '[A-Z]' and {value} rlike '[0-9]')", f"{value} rlike '^([A-Za-z]+|[0-9]+)([-_./]([A-Za-z]+|[0-9]+))+$'"),
            "local": three("c.m rlike '[(-]'", "c.m rlike '^[0-9]{3} [0-9]{3} [0-9]{4}$'"),
            "name": three("c.m rlike '[\\x27’-]\\\\p{Lu}'", "not c.m rlike ' ' or exists(split(c.m, ' '), w -> length(w) > 12)"),
        },
        "place": {
            "number": three("c.b rlike '[:=(]\\\\s?$'", "c.b rlike '[\\\\p{L}_/.-]$' or c.a rlike '^[\\\\p{L}_/-]'"),
            "secret": three("c.m rlike '[=:]' and c.m rlike '[\\\\x22\\\\x27]' or c.b rlike '[=:]\\\\s?[\\\\x22\\\\x27]?$'", "not c.m rlike '[=:]' or c.a rlike '^[/.@:]'"),
            "local": three("c.b rlike '[:=]\\\\s?$'", "c.b rlike '[\\\\p{L}#/-]$'"),
            "name": three("c.b rlike '[:=]\\\\s?[\\\\x22\\\\x27]?$'", "c.b rlike '(^|[.!?]\\\\s|\\\\n)$' or c.b rlike '[.!?]$'"),
        },
    }
    return {labeler: "case c.kind " + " ".join(f"when '{k}' then {v}" for k, v in by.items()) + " end" for labeler, by in kinds.items()}


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row (struct of the columns `keep` of docs), base (spans, sorted) and extra (candidates with votes and features) of each text."""
    v, kinds = votes(), extra_spans()
    around = "concat(if(c.b = '' or c.b rlike '\\\\s$', 's', 'x'), if(c.a = '' or c.a rlike '^\\\\s', 's', 'x'))"
    judged = f"transform(extra0, c -> struct(c.s as s, c.e as e, c.kind as kind, {', '.join(f'cast({x} as int) as {k}' for k, x in v.items())}, cast(least((c.e - c.s) div 8, 6) as int) as size, {around} as around))"
    found = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = found.withColumn("base", F.expr(f"array_sort(transform({base_spans()}, b -> struct(b.s as s, b.e as e, b.kind as kind)))"))
    found = found.withColumn("reached", F.expr(reaching("base")))
    found = found.withColumn("secret0", F.expr(f"filter({kinds['secret']}, c -> not {overlaps('reached', 'r')})"))
    rest = "concat(" + ", ".join(kinds[k] for k in EXTRA if k not in ("secret", "local")) + ")"
    found = found.withColumn("local0", F.expr(f"filter({kinds['local']}, c -> not {overlaps('reached', 'r')} and not {overlaps('secret0')})"))
    found = found.withColumn("extra0", F.expr(f"concat(secret0, local0, filter({rest}, c -> not {overlaps('reached', 'r')} and not {overlaps('secret0')} and not {overlaps('local0')}))"))
    return found.withColumn("extra", F.expr(judged)).select("row", "base", "extra")


#: How labelers are taken to vote at first on true candidates and on others (for, against, not at all), and how many votes that is worth.
FIRST = {1: {1: 0.5, 0: 0.1, None: 0.4}, 0: {1: 0.1, 0: 0.4, None: 0.5}}
PRIOR = 10


def estimate(patterns: list[tuple], steps: int = EM_STEPS) -> dict[tuple, float]:
    """EM over (kind, votes..., count): the probability that a candidate of each kind and vote pattern is personal data.

    Labelers are taken as independent given the truth. For each kind the share of true candidates and each labeler's
    confusion matrix (abstentions included) are estimated, smoothed towards FIRST; a vote for never counts against, nor the other way round.
    """
    kinds = sorted({p[0] for p in patterns})
    share = dict.fromkeys(kinds, 0.5)
    says = {(k, j, t): dict(FIRST[t]) for k in kinds for j in range(len(LABELERS)) for t in (0, 1)}
    post: dict[tuple, float] = {}
    for _ in range(steps):
        for p in patterns:
            k, odds = p[0], math.log(share[p[0]] / (1 - share[p[0]]))
            for j, v in enumerate(p[1:-1]):
                one = math.log(says[k, j, 1][v] / says[k, j, 0][v])
                odds += one if v is None else max(one, 0.1) if v else min(one, -0.1)
            post[p[:-1]] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
        for k in kinds:
            own = [(p[1:-1], p[-1], post[p[:-1]]) for p in patterns if p[0] == k]
            share[k] = (2 + sum(n * q for _, n, q in own)) / (4 + sum(n for _, n, _ in own))
            for j in range(len(LABELERS)):
                for t in (0, 1):
                    cast = {v: PRIOR * FIRST[t][v] + sum(n * (q if t else 1 - q) for vs, n, q in own if vs[j] == v) for v in (1, 0, None)}
                    says[k, j, t] = {v: c / sum(cast.values()) for v, c in cast.items()}
    return post


FEATURES = (*LABELERS, "size", "around")


def fit(found: DataFrame) -> str:
    """SQL for the log odds that candidate c is personal data, trained on all candidates of `found`."""
    flat = found.selectExpr("inline(extra)")
    rows = [tuple(r) for r in flat.groupBy("kind", *FEATURES).count().collect()]  # bounded: kinds x votes x classes
    patterns: dict[tuple, int] = {}
    votes_ = 1 + len(LABELERS)
    for r in rows:
        patterns[r[:votes_]] = patterns.get(r[:votes_], 0) + r[-1]
    soft = estimate([(*k, n) for k, n in sorted(patterns.items(), key=str)])
    # naive Bayes on the soft labels, a class and kind at a time
    cases = []
    for kind in sorted({r[0] for r in rows}):
        own = [(r[1:-1], r[-1], soft[r[:votes_]]) for r in rows if r[0] == kind]
        yes, no = (1 + sum(n * q for _, n, q in own)), (1 + sum(n * (1 - q) for _, n, q in own))
        terms = [repr(math.log(yes / no))]
        for j, f in enumerate(FEATURES):
            values = sorted({r[0][j] for r in own}, key=str)
            when = []
            for v in values:
                a = (1 + sum(n * q for x, n, q in own if x[j] == v)) / (yes + len(values))
                b = (1 + sum(n * (1 - q) for x, n, q in own if x[j] == v)) / (no + len(values))
                when.append(f"when c.{f} <=> {'null' if v is None else lit(v) if isinstance(v, str) else v} then {math.log(a / b)!r}D")
            terms.append(f"case {' '.join(when)} else 0D end")
        terms[0] += "D"
        cases.append(f"when {lit(kind)} then {' + '.join(terms)}")
    return f"case c.kind {' '.join(cases)} else -99D end" if cases else "-99D"


def find(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """row (struct of the columns `keep` of docs), base and spans, arrays of (s, e, kind) by start; spans has the base ones and what the classifier adds."""
    found = materialise(candidates(docs, keep), "pii")
    odds = fit(found)
    more = f"transform(filter(extra, c -> {odds} >= {math.log(threshold / (1 - threshold))!r}D), c -> struct(c.s as s, c.e as e, c.kind as kind))"
    order = " ".join(f"when '{k}' then {i}" for i, k in enumerate((*BASE, *EXTRA)))
    by_start = lambda a: f"transform(array_sort(transform({a}, x -> struct(x.s as s, case x.kind {order} end as o, x.e as e, x.kind as kind))), x -> struct(x.s as s, x.e as e, x.kind as kind))"
    return found.selectExpr("row", f"{by_start('base')} as base", f"{by_start(f'concat(base, {more})')} as spans")


JOINED = "array_join(transform({0}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document."""
    counts = [f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint) as n_{k}" for k in BASE]
    return find(docs, ["doc_id"]).selectExpr("row.doc_id", *counts, f"sha2({JOINED.format('base')}, 256) as base_sha256", f"{JOINED.format('spans')} as spans")


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of `text` replaced by its kind in brackets, as [EMAIL]; same columns. Overlapping spans become one, named after the first.

    The text is taken in chunks, so that a piece is cut out without counting characters from its beginning.
    """
    # the end of all that is replaced before span i
    done = "if(i = 0, 0L, get(rs, i - 1).r)"
    cut = f"transform(rs, (x, i) -> {let('p', done, let('q', 'x.s', f"""if(q < p, '', concat({piece('p', 'q')}, '[', upper(x.kind), ']'))"""))})"
    tail = let("p", "get(rs, size(rs) - 1).r", let("q", "cast(char_length(row.text) as bigint)", piece("p", "q")))
    whole = f"concat(array_join({cut}, ''), {tail})"
    new = f"case when size(spans) = 0 then row.text else {let('ch', chunks("row.text"), let('rs', reaching('spans'), whole))} end"
    return find(docs, docs.columns).select(*[F.expr(new).alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents"))
