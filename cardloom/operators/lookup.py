"""Exact, substring and tag lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardloom.operators.term_index import TermIndex

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def nocase(col) -> F.Column:
    """A-Z as a-z, nothing else: case doesn't count for ASCII letters only."""
    return F.translate(col, UPPER, LOWER)


def _lowered(value: str) -> F.Column:
    return F.lit(value.translate(str.maketrans(UPPER, LOWER)))


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy("timestamp", "id")


def exact(cards: DataFrame, value: str) -> DataFrame:
    """Facts equal to value, but for ASCII case."""
    return cards.where(nocase("fact") == _lowered(value))


def substring(cards: DataFrame, value: str, field: str = "fact", index: TermIndex | None = None) -> DataFrame:
    """Facts (or evidence) that contain value, whatever the case of ASCII letters; % and _ are ordinary characters.

    With an index of trigrams of that field only its candidates' texts are read, and cards are picked by id.
    """
    if index is not None:
        return cards.join(index.containing(value).select("id"), "id", "left_semi")
    return cards.where(F.contains(nocase(field), _lowered(value)))


def by_tag(cards: DataFrame, tag: str) -> DataFrame:
    return cards.where(F.array_contains("tags", tag))


def lookup(cards: DataFrame, field: str, value: str, index: TermIndex | None = None) -> DataFrame:
    """fact: exact matches, or else substrings; evidence: substrings; tags: membership. In order of time and id. index: trigrams of the field."""
    if field == "tags":
        return _ordered(by_tag(cards, value))
    if field == "evidence":
        return _ordered(substring(cards, value, "evidence", index))
    if field != "fact":
        raise ValueError(f"no lookup by {field}")
    # one pass: substrings count only where there is no exact match at all
    found = substring(cards, value, index=index).withColumn("_exact", nocase("fact") == _lowered(value))
    any_exact = found.agg(F.coalesce(F.bool_or("_exact"), F.lit(False)).alias("_any"))
    return _ordered(found.where(F.col("_exact") == any_exact.scalar()).drop("_exact"))


def get_many(cards: DataFrame, ids: list[str]) -> DataFrame:
    return _ordered(cards.where(F.col("id").isin(ids)))


def any_tag(cards: DataFrame, tags: list[str]) -> DataFrame:
    return cards.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))


def with_metadata(cards: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """Cards whose k=v tags have all wanted pairs."""
    for k, v in wanted.items():
        cards = cards.where(F.array_contains("tags", f"{k}={v}"))
    return cards
