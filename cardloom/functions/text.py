"""Word lists and text rules of triage, negation and lexical matching, as Spark SQL expressions."""

from __future__ import annotations

import re
import unicodedata

# Fixed values, equal to the reference's for equal results.
NEGATIONS = ("not", "no longer", "doesn't", "does not", "don't", "do not", "never", "isn't", "is not", "wasn't", "was not", "won't", "will not", "cannot", "can't", "neither", "nor", "without", "lacks", "stopped", "quit", "no more")
DELETES = ("forget", "remove", "delete", "stop remembering", "clear my", "ignore that i said")
UPDATES = ("actually", "changed", "switched to", "now it's", "update", "correction", "i meant", "moved to", "i now prefer", "no longer use", "i no longer")
ADDS = ("my name is", "i am", "i'm", "i like", "i love", "i prefer", "i work at", "i work on", "i live in", "i use", "this is", "the project is", "my project")
LEX_STOPWORDS = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "this", "that", "with", "what", "who", "how", "why", "where", "when", "is", "are", "am", "my", "your", "user", "i", "you", "we", "do", "go", "use", "which", "should", "did", "does", "via", "it", "from")
SALIENT_STOPWORDS = ("the", "what", "who", "how", "why", "where", "when", "is", "are", "am", "my", "your", "user", "current", "and", "or", "for", "of", "to", "in", "on", "at", "this", "that", "with")
NUMERIC_WORDS = ("port", "number", "id", "version", "value", "count", "key", "pin", "code")
FILLERS = ("actually ", "so ", "well ", "ok ", "okay ", "um ", "i just want to say ", "just so you know ", "hey ", "hi ", "listen ")
STOPWORDS = """a an and are as at be by for from has have in is it its of on or that the to was were will with this these those i you he she they we us our your his her their my me him them not no but if then than so such too very can do does did done doing about above after again all also am any each few more most other some only own same s t don now into out up down off over under further once here there when where why how what which who whom whose""".split()
STRUCTURED = (r"\b(what(?:'s| is| are)\s+(?:the\s+)?(?:user's\s+)?(?:current|my)?)\b", r"\b(who\s+(?:is|am)\s+(?:i|the\s+user))\b", r"\b(current\s+(?:project|state|status|setting|role|location))\b", r"\b(what\s+(?:is|are)\s+my\s+\w+)\b", r"\b(my\s+(name|project|role|location|timezone|preference))\b")
TAG_RULES = (
    (r"\bmy name is\s+([A-Za-z][\w\-\.]*)", ("name",)),
    (r"\bi(?:'m| am)\s+([A-Za-z][\w\-\.]*)", ("name",)),
    (r"\bi (?:like|love|prefer)\s+([\w\s,]+?)(?:[.!]|$)", ("preference",)),
    (r"\bi now prefer\s+([\w\s,]+?)(?:[.!]|$)", ("preference",)),
    (r"\bi use\s+([A-Za-z0-9][\w.\-]*)", ("language", "tool")),
    (r"\bswitched to using\s+([A-Za-z0-9][\w.\-]*)", ("language", "tool")),
    (r"\bmy (?:backend\s+)?project(?:\s+is|\s+named)?\s+([A-Za-z0-9][\w.\-]*)", ("project",)),
    (r"\bi work (?:at|on)\s+([A-Za-z0-9][\w.&\-]*)", ("organization", "project")),
    (r"\bi live in\s+([A-Za-z][\w\s]+?)(?:[.!]|$)", ("location",)),
)


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array_of(words) -> str:
    return f"array({', '.join(map(lit, words))})"


def fold(word: str) -> str:
    """A word without diacritics."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _composed() -> tuple[str, str]:
    """Letters below U+2000 that are one plain letter with marks, and those letters; by Unicode's own decompositions."""
    pairs = [(chr(c), d) for c in range(0xC0, 0x2000) if len(d := fold(chr(c))) == 1 and d != chr(c) and d.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


COMPOSED = _composed()


def unaccented(text: str) -> str:
    """A word without diacritics, composed or combining; plain ASCII words are left alone."""
    return f"if({text} rlike '^[ -~]*$', {text}, regexp_replace(translate({text}, '{COMPOSED[0]}', '{COMPOSED[1]}'), '\\\\p{{Mn}}+', ''))"


def words_of(query: str) -> list[str]:
    """content_words() of a text on the driver."""
    return [w for w in dict.fromkeys(re.findall(r"[a-z][a-z0-9_]+", query.lower())) if w not in STOPWORDS]


def content_words(text: str) -> str:
    """Distinct lower-case words of two characters or more, from a letter on, without stopwords, in order."""
    return f"array_except(array_distinct(regexp_extract_all(lower(coalesce({text}, '')), '[a-z][a-z0-9_]+', 0)), {array_of(STOPWORDS)})"


def stripped(text: str) -> str:
    """Lower-case text without negation markers, longest first, blanks collapsed."""
    out = f"concat(' ', lower(trim({text})), ' ')"
    for m in sorted(NEGATIONS, key=len, reverse=True):
        out = f"replace({out}, {lit(f' {m} ')}, ' ')"
    return f"trim(regexp_replace({out}, '\\\\s+', ' '))"


def negated(text: str) -> str:
    """Whether the text has a negation marker as whole words."""
    padded = f"concat(' ', lower(trim({text})), ' ')"
    return "(" + " or ".join(f"contains({padded}, {lit(f' {m} ')})" for m in NEGATIONS) + ")"


def stems(text: str) -> str:
    """Distinct crude stems of the words of a text."""
    stem = "x"
    for suffix in ("s", "es", "ed", "ing"):
        stem = f"case when endswith(x, '{suffix}') and char_length(x) >= {3 + len(suffix)} then left(x, char_length(x) - {len(suffix)}) else {stem} end"
    return f"array_distinct(transform(filter(split({text}, ' '), x -> x <> ''), x -> {stem}))"


def are_negations(a: str, b: str) -> str:
    """Opposite polarity of the same statement: one side is negated, and the stems agree to 60 %."""
    sa, sb = stems(stripped(a)), stems(stripped(b))
    return f"coalesce({negated(a)} <> {negated(b)} and size(array_union({sa}, {sb})) > 0 and 5 * size(array_intersect({sa}, {sb})) >= 3 * size(array_union({sa}, {sb})), false)"


def hits(text: str, phrases) -> str:
    return f"size(filter({array_of(phrases)}, p -> contains(lower({text}), p)))"


def signal(n: str) -> str:
    """Score of n agreeing phrases: .65 for the first, .12 / (i + 1) for each further one, .95 at most."""
    return f"case when {n} = 0 then 0D else least(0.95D, 0.65D + aggregate(if({n} > 1, sequence(1, {n} - 1), array()), 0D, (s, i) -> s + 0.12D / (i + 1))) end"


def tags(text: str) -> str:
    parts = [f"if({text} rlike {lit('(?i)' + p)}, {array_of(t)}, cast(array() as array<string>))" for p, t in TAG_RULES]
    return f"array_distinct(flatten(array({', '.join(parts)})))"


def fact(text: str) -> str:
    """The statement without one leading filler, blanks collapsed, end marks trimmed."""
    cut = "case " + " ".join(f"when startswith(lower(ltrim({text})), {lit(f)}) then ltrim(substring(ltrim({text}), {len(f) + 1}))" for f in FILLERS) + f" else ltrim({text}) end"
    clean = f"trim(regexp_replace(regexp_replace(trim({cut}), '\\\\s+', ' '), '[.!?]+$', ''))"
    return f"if({clean} = '', trim({text}), {clean})"


def structured(text: str) -> str:
    return "(" + " or ".join(f"{text} rlike {lit('(?i)' + p)}" for p in STRUCTURED) + ")"


# Fixed values, equal to the reference's for equal results: words between a trigger phrase and what it points at.
BETWEEN = "that i to my the a an of and or said told use using prefer name is was me you we they he she it for in on at so now no longer".split()
AFTER = {"i no longer": ("use", "like", "prefer", "remember", "need"), "clear my": ("memory", "memories", "history"), "ignore that i said": ("that", "i", "said")}
FACTUAL = r"(?i)\b(?:is|are|am|like|love|prefer|use|live|work|named|called)\b"


def slug(text: str) -> str:
    """A stable id of a phrase: lower case, blanks as _, 64 characters of a-z, 0-9, _, - and . at most; null if nothing is left."""
    clean = f"regexp_replace(regexp_replace(lower(trim({text})), '\\\\s+', '_'), '[^a-z0-9_.-]', '')"
    return f"nullif(left({clean}, 64), '')"


def target_id(text: str, phrases) -> str:
    """What an update or deletion points at: a quoted phrase, else up to three words after the longest trigger phrase that has any."""
    quoted = f"get(filter(transform(regexp_extract_all({text}, {lit(chr(34) + '([^' + chr(34) + ']+)' + chr(34) + '|' + chr(39) + '([^' + chr(39) + ']+)' + chr(39))}, 0), q -> trim(substring(q, 2, length(q) - 2))), q -> q <> ''), 0)"
    tries = []
    for p in sorted(phrases, key=len, reverse=True):
        skip = array_of([*BETWEEN, *AFTER.get(p, ())])
        tail = f"regexp_extract_all(substring({text}, locate({lit(p)}, lower({text})) + {len(p)}), '[A-Za-z0-9][\\\\w.-]*', 0)"
        # from the first word that isn't skipped on, up to the next word that joins, three at most
        start = f"coalesce(array_position(transform(ws, w -> not array_contains({skip}, lower(w))), true), 0)"
        rest = "slice(ws, cast(at as int), 3)"
        stop = f"array_position(transform(rs, (w, i) -> i > 0 and array_contains({array_of(BETWEEN)}, lower(w))), true)"
        named = f"transform(array({tail}), ws -> transform(array({start}), at -> if(at = 0, null, transform(array({rest}), rs -> array_join(if({stop} > 0, slice(rs, 1, cast({stop} - 1 as int)), rs), ' '))[0]))[0])[0]"
        tries.append(f"if(locate({lit(p)}, lower({text})) > 0, {named}, null)")
    return slug(f"coalesce({', '.join([quoted, *tries])})")


def evidence(text: str) -> str:
    """The text itself up to 120 characters; of a longer one the clauses up to the first with a factual verb."""
    clauses = f"split(trim({text}), '\\\\s*,\\\\s*|\\\\s+and\\\\s+', -1)"
    upto = f"array_position(transform(cs, c -> c rlike {lit(FACTUAL)}), true)"
    return f"case when coalesce(trim({text}), '') = '' then '' when char_length(trim({text})) <= 120 then trim({text}) else transform(array({clauses}), cs -> if({upto} > 0, array_join(slice(cs, 1, cast({upto} as int)), ', '), trim({text})))[0] end"
