"""The offline hash embedder and other functions that need Python: Arrow batches, never row by row."""

from __future__ import annotations

import difflib
import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMS = 384
_WORD = re.compile(r"[a-z0-9]+")


def hash_vector(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Words and character trigrams hashed with a sign into dims slots, of unit length."""
    out = np.zeros(dims, np.float32)
    words = _WORD.findall((text or "").lower())
    for f in [*words, *(f"#{w[i : i + 3]}" for w in words for i in range(len(w) - 2))]:
        h = hashlib.blake2b(f.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % dims] += 1.0 if h[4] & 1 else -1.0
    n = np.linalg.norm(out)
    return out / n if n else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hash_embed(text: pd.Series) -> pd.Series:
    return text.map(hash_vector)


def signed_vector(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Words hashed with a sign (blake2b), and eight signature values of the whole text; of unit length, zero without words."""
    out, words = np.zeros(dims), (text or "").lower().split()
    if not words:
        return out
    for w in words:
        h = hashlib.blake2b(w.encode(), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % dims] += -1.0 if h[4] & 1 else 1.0
    for i, b in enumerate(hashlib.blake2b(text.lower().encode(), digest_size=8).digest()[: min(8, dims)]):
        out[(b * 7 + i) % dims] += b / 127.5 - 1.0
    n = np.linalg.norm(out)
    return out / n if n else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def signed_embed(text: pd.Series) -> pd.Series:
    return text.map(signed_vector)


def trigram_vector(text: str | None, dims: int = DIMS) -> np.ndarray:
    """Words and character trigrams (blanks collapsed, one at either end) counted in slots by SHA-256; of unit length. What has none gets eight values of its own hash."""
    words = (text or "").lower().split()
    line = " " + " ".join(words) + " "
    out = np.zeros(dims)
    for f in [*words, *(line[i : i + 3] for i in range(len(line) - 2))]:
        out[int.from_bytes(hashlib.sha256(f.encode()).digest()[:4], "little") % dims] += 1.0
    if not out.any():
        out[0] = 1.0
        for i, b in enumerate(hashlib.sha256((text or "").encode()).digest()[: min(8, dims)]):
            out[i] += b % 7 - 3
    n = np.linalg.norm(out)
    return out / n if n else out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def trigram_embed(text: pd.Series) -> pd.Series:
    return text.map(trigram_vector)


def failover(*embedders, fallback=signed_vector):
    """A function of a column of texts: the vector of the first embedder (text to list of floats) that gives one that isn't zero; it never fails, as the last resort is the hash."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(text: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[float]:
            for e in embedders:
                try:
                    v = e(t or "")
                except Exception:  # noqa: BLE001  any embedder may be down in its own way
                    continue
                if v is not None and len(v) and any(v):
                    return list(v)
            return list(fallback(t))

        return text.map(one)

    return embed


def resolver(known: list[str], floor: float = 0.88):
    """A function of a column of names: the known entity that equals each but for case, else the most similar of ratio floor or more, else the name itself.

    `known` is a driver-side list. Each distinct name of a batch is looked at once, and only with entities whose length and
    letters allow the ratio: it is at most twice the shorter length, or the letters in common, over both lengths.
    """
    lower = {k.lower(): k for k in sorted(known, reverse=True)}
    by_length: dict[int, list[tuple[str, str]]] = {}
    for k, v in lower.items():
        by_length.setdefault(len(k), []).append((k, v))

    def one(n: str | None) -> str | None:
        if n is None or n.lower() in lower:
            return n and lower[n.lower()]
        name, best = n.lower(), (floor, "")
        match = difflib.SequenceMatcher(None, "", name)
        for size, some in by_length.items():
            if 2 * min(size, len(name)) < floor * (size + len(name)):
                continue
            for k, v in some:
                match.set_seqs(name, k)
                if match.quick_ratio() >= floor:
                    best = max(best, (match.ratio(), v))
        return best[1] or n

    @F.pandas_udf(T.StringType())
    def resolve(names: pd.Series) -> pd.Series:
        return names.map({n: one(n) for n in names.dropna().unique()}).where(names.notna(), None)

    return resolve


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_facts(reply: pd.Series) -> pd.Series:
    """Facts in a model's reply: a JSON list or object with `facts`, fenced or bare, else its list lines."""

    def one(text: str | None) -> list[str]:
        text = text or ""
        found = _FENCE.search(text)
        body = (found[1] if found else text).strip()
        for part in (body, body[body.find("[") : body.rfind("]") + 1], body[body.find("{") : body.rfind("}") + 1]):
            try:
                value = json.loads(part)
            except ValueError:
                continue
            value = value.get("facts", []) if isinstance(value, dict) else value
            if isinstance(value, list):
                return [x for v in value if (x := str(v.get("fact", "") if isinstance(v, dict) else v).strip())]
        return [m[1].strip() for m in re.finditer(r"^\s*(?:[-*•]|\d+[.)])\s+(.+)$", text, re.M)]

    return reply.map(one)


_ARROW = re.compile(r"\(?\s*([^,()|>-]+?)\s*(?:,|\||->|-)\s*([^,()|>-]+?)\s*(?:,|\||->|-)\s*([^,()|>-]+?)\s*\)?\s*$", re.M)


def triplets_of(text: str | None) -> list[list[str]]:
    """(subject, predicate, object) triplets in a reply: JSON lists or objects, else lines of three parts."""
    text = text or ""
    try:
        value = json.loads(text[text.find("[") : text.rfind("]") + 1])
        rows = [[v.get("subject"), v.get("predicate"), v.get("object")] if isinstance(v, dict) else list(v) for v in value]
        return [[str(x).strip() for x in r] for r in rows if len(r) == 3 and all(x not in (None, "") for x in r)]
    except (ValueError, TypeError):
        return [[g.strip() for g in m.groups()] for m in _ARROW.finditer(text)]


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def parse_triplets(reply: pd.Series) -> pd.Series:
    """triplets_of() each reply."""
    return reply.map(triplets_of)


@F.pandas_udf(T.StringType())
def parse_action(reply: pd.Series) -> pd.Series:
    """ADD, UPDATE, DELETE or NOOP named in a reply; ADD if none is."""

    def one(text: str | None) -> str:
        found = re.search(r'"(?:action|event)"\s*:\s*"(\w+)"', text or "") or re.search(r"\b(ADD|UPDATE|DELETE|NOOP|NONE)\b", (text or "").upper())
        a = found[1].upper() if found else "ADD"
        return {"NONE": "NOOP"}.get(a, a) if a in ("ADD", "UPDATE", "DELETE", "NOOP", "NONE") else "ADD"

    return reply.map(one)
