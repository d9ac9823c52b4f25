"""Many texts against many words: which of a table of patterns does each text contain, and which known name is each name most like.

Containment: patterns of PATTERN_CHARS characters in all at most are sent to every task, which finds them all in one pass
over a text by an Aho-Corasick automaton. Beyond that, patterns meet texts by their first GRAM characters, through a shuffle, and are looked at
in full; shorter ones still go by automata, in blocks. Neither forms pairs of texts and patterns that have nothing in common.

Likeness: `resolve` finds for each name the known name of the largest difflib ratio of at least a floor. A ratio bounds the number of
characters left over on both sides; so a known name cut into one piece more than that has a piece that stands unchanged in the name, near its
place. Both sides are joined by such pieces and lengths, and only pairs that share one are compared.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN_CHARS = 1 << 20
GRAM = 6


def containing(texts: DataFrame, patterns: DataFrame, most_chars: int = PATTERN_CHARS) -> DataFrame:
    """(id, pattern): for rows of texts (id, text) the patterns (pattern) that they contain, each once a row. Case counts; empty and null patterns are in no text."""
    wanted = patterns.select("pattern").where("pattern <> ''").distinct()
    size = wanted.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    if size <= most_chars:
        return _by_automaton(texts, [r[0] for r in wanted.collect()])
    short, out = wanted.where(F.length("pattern") < GRAM), _by_grams(texts, wanted.where(F.length("pattern") >= GRAM))
    block: list[str] = []
    for r in short.toLocalIterator():
        block.append(r[0])
        if sum(map(len, block)) >= most_chars:
            out, block = out.union(_by_automaton(texts, block)), []
    return out.union(_by_automaton(texts, block)) if block else out


def _by_automaton(texts: DataFrame, patterns: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(patterns)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for p in sent.value:
            automaton.add_word(p, p)
        automaton.make_automaton()
        for b in batches:
            found = [sorted({p for _, p in automaton.iter(t)}) if t and len(automaton) else [] for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "pattern": found}).explode("pattern").dropna(subset="pattern")

    return texts.select("id", "text").where("text is not null").mapInPandas(find, f"id {texts.schema['id'].dataType.simpleString()}, pattern string")


def _by_grams(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    rows = texts.select("id", "text", F.monotonically_increasing_id().alias("row"))
    grams = rows.select("id", "row", "text", F.explode(F.expr(f"array_distinct(regexp_extract_all(text, '(?s)(?=({'.' * GRAM}))', 1))")).alias("gram"))
    keyed = patterns.select("pattern", F.left("pattern", F.lit(GRAM)).alias("gram"))
    return grams.join(keyed, "gram").where(F.contains("text", F.col("pattern"))).select("id", "row", "pattern").distinct().select("id", "pattern")


# ---- likeness ----------------------------------------------------------------------------------------------------


def _most_left_over(length: str, floor: float) -> str:
    """SQL: how many characters may be left over, on both sides together, beside a known name of this length."""
    return f"cast(floor({2 * (1 - floor) / floor!r}D * {length} + 1e-9) as int)"


def resolve(names: DataFrame, known: DataFrame, floor: float = 0.88) -> DataFrame:
    """(name, entity) for the distinct names of names (name): the known one (entity) that equals it but for case (the least of several), else
    that of the largest ratio of floor or more (the largest of several), else the name itself."""
    own = names.select("name").where("name is not null").distinct().withColumn("low", F.lower("name"))
    kept = known.where("entity is not null").groupBy(F.lower("entity").alias("klow")).agg(F.min("entity").alias("entity"))
    same = own.join(kept, own["low"] == kept["klow"], "left").select("name", "low", "entity")
    rest = same.where("entity is null").select("low").distinct()
    left = _most_left_over("n", floor)
    # known names in d + 1 pieces, of which one stays whole
    cut = kept.selectExpr("klow", "entity", "char_length(klow) as n").where("n > 0").selectExpr("*", f"least({left}, n - 1) as d")
    piece = "struct(i as i, cast(i * n div (d + 1) as int) as p, cast((i + 1) * n div (d + 1) - i * n div (d + 1) as int) as l)"
    mine = cut.selectExpr("klow", "entity", "n", "d", f"inline(transform(sequence(0, d), i -> {piece}))").selectExpr("klow", "entity", "n", "i", "substring(klow, p + 1, l) as s")
    # names in all pieces that a known name of a length that the ratio allows may have near that place
    lengths = f"sequence(cast(greatest(1, ceil({floor / (2 - floor)!r}D * m - 1e-9)) as int), cast(greatest(1, floor({(2 - floor) / floor!r}D * m + 1e-9)) as int))"
    sized = rest.selectExpr("low", "char_length(low) as m").where("m > 0").selectExpr("low", "m", f"explode({lengths}) as n").selectExpr("low", "m", "n", f"least({left}, n - 1) as d")
    placed = sized.selectExpr("low", "m", "n", "d", f"inline(transform(sequence(0, d), i -> {piece}))")
    theirs = placed.selectExpr("low", "n", "i", "l", "explode(sequence(greatest(p - d, 0), greatest(least(p + d, m - l), greatest(p - d, 0)))) as q").selectExpr("low", "n", "i", "substring(low, q + 1, l) as s").distinct()
    pairs = theirs.join(mine, ["n", "i", "s"]).select("low", "klow", "entity").distinct()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            match, out = difflib.SequenceMatcher(None), []
            for low, klow, entity in b.itertuples(index=False):
                match.set_seqs(low, klow)
                if match.quick_ratio() >= floor and (ratio := match.ratio()) >= floor:
                    out.append((low, entity, ratio))
            yield pd.DataFrame(out, columns=["low", "near", "ratio"]).astype({"ratio": float})

    alike = pairs.mapInPandas(compare, "low string, near string, ratio double")
    best = alike.groupBy("low").agg(F.max_by("near", F.struct("ratio", "near")).alias("near"))
    return same.join(best, "low", "left").select("name", F.coalesce("entity", "near", "name").alias("entity"))

