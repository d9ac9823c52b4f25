"""Secrets in texts, told apart from copied examples by who else has them.

Base spans (assign, access, hex) are found by pattern and always stay. Beyond them, wider patterns propose candidates:
private key blocks, signed web tokens, keys with a vendor's prefix, passwords in addresses, bearer headers, values after
further words than the base ones, and bare mixed runs of characters. A candidate must look live: enough different characters, no word
of a placeholder, no row of the alphabet or of digits. Then the whole corpus decides. Each value is hashed, and for each
hash the owners, the repositories of an owner and the uses are counted over all documents: a value that belongs to at most
MAX_OWNERS owners, in at most MAX_REPOS repositories if there is more than one, is somebody's credential and becomes a
span; one that more share is an example that went round, and doesn't. Base spans get the same verdict (`live`), but
stay whatever it is. Values never leave the tasks that read the texts, only their hashes do.

Counting takes three map-side-combined steps (uses, then repositories, then owners), so no task holds the set of a common
value. Verdicts go back to the uses by a join on the hash; the hashes that have over 1/HOT of all uses, which can't be more
than HOT, are broadcast, the others are shuffled, so that a value in a third of all documents makes no large task.

Offsets are code points, end exclusive. Defined results: null and empty texts have no spans; texts are searched whole,
in linear time; null owners and repositories are an owner and a repository of their own; repeated rows count as uses of the same
repository and each get their spans; overlapping candidates become one span, that of the more specific pattern, and what overlaps a
base span is never added; an empty table gives no rows; columns beside those asked for are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardloom.llm.common import Temporary, arrow_map, column, materialise, read

MAX_OWNERS = 2
MAX_REPOS = 4
HOT = 1024

# The base patterns, and how long what they find must be. Failing matches are dropped, not tried again.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE = ("assign", "access", "hex")

#: Wider patterns, the more specific first; group 1 is the value, and the span is that of the value.
WIDER = {
    "pem": re.compile(r"(-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]{2,10} )?PRIVATE KEY-----)"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,})"),
    "prefixed": re.compile(r"(?<![A-Za-z0-9_-])((?:gh[opsur]_|github_pat_|glpat-|xox[abpr]-|sk-|pk_live_|sk_live_|rk_live_|AIza|hf_|npm_|SG\.)[A-Za-z0-9_.-]{16,})"),
    "url": re.compile(r"[a-z][a-z0-9+]{1,12}://[^\s:/@]{1,64}:([^\s:/@]{6,128})@"),
    "bearer": re.compile(r"(?i:\bbearer\x20+)([A-Za-z0-9+/_.=-]{16,})"),
    "keyed": re.compile(r"(?ai:(?:pwd|passphrase|credential|client_?id|access_?key|private_?key|auth|passwort|clave|mot_de_passe)s?)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?([A-Za-z0-9+/_.=-]{10,})"),
    "random": re.compile(r"(?<![A-Za-z0-9+/_=.-])([A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_-])"),
}
KINDS = (*BASE, *WIDER)
PLACEHOLDER = re.compile(r"(?i:example|sample|dummy|placeholder|change_?me|your[_-]|redacted|test[_-]?key|foo_?bar|lorem|x{4}|\*{3}|0{6}|1234567|abcdefg|qwerty)")
LOWER, UPPER, DIGIT = re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]")


def entropy(value: str) -> float:
    """Bits a character of the value's own distribution."""
    return -sum(c / len(value) * math.log2(c / len(value)) for c in Counter(value).values())


def looks_live(kind: str, value: str) -> bool:
    """Whether the value could be a credential, by itself."""
    if kind == "pem":
        return len(value) > 200
    value = value[:4096]
    if len(value) < LEAST.get(kind, 10) or PLACEHOLDER.search(value) or len(set(value)) < min(8, len(value) // 2 + 1) or entropy(value) < 2.5:
        return False
    if kind == "random":  # letters and digits mixed in, of two cases or of hexadecimal shape: not numbers, paths or compound words
        cases = bool(LOWER.search(value)) + bool(UPPER.search(value))
        return bool(DIGIT.search(value)) and cases > 0 and (cases == 2 or re.fullmatch("[0-9A-Fa-f]+", value) is not None) and len(re.findall(r"[0-9]+|[A-Za-z]+", value)) >= 4 and entropy(value) >= 3.0
    return True


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the base patterns, by start, then as the kinds are listed."""
    out = [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def wider_spans(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Live-looking (start, end, kind, value) of the wider patterns that overlap neither base spans nor each other."""
    taken, out = merged([x[:2] for x in base]), []
    for kind, pattern in WIDER.items():
        at, new = 0, []
        for m in pattern.finditer(text):
            s, e = m.span(1)
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            if (at == len(taken) or e <= taken[at][0]) and looks_live(kind, m[1]):
                new.append((s, e, kind, m[1]))
        if new:
            out += new
            taken = merged([*taken, *(x[:2] for x in new)])
    return out


USE = T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("o", T.IntegerType()), T.StructField("h", T.BinaryType()), T.StructField("live", T.BooleanType())])


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, plus `uses`: all base spans and candidates, with their values' hashes and whether these look live."""

    def run(batch: pa.RecordBatch) -> list:
        rows = []
        for text in column(batch, text_col):
            base = base_spans(text or "")
            found = base + wider_spans(text or "", base)
            rows.append([{"s": s, "e": e, "kind": k, "o": KINDS.index(k), "h": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()[:16], "live": looks_live(k, v)} for s, e, k, v in found])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string()), ("o", pa.int32()), ("h", pa.binary()), ("live", pa.bool_())]))
        return [pa.array(rows, kind)]

    return arrow_map(docs, [T.StructField("uses", T.ArrayType(USE))], run).drop(text_col)


def ownership(uses: DataFrame) -> DataFrame:
    """h, n_owners, n_repos, n_uses from rows of (h, owner, repo): distinct counts by steps that combine map-side."""
    by_repo = uses.groupBy("h", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("h", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_uses"))


def findings(docs: DataFrame, key: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, hot: int = HOT) -> DataFrame:
    """key and spans of every row: array of (s, e, kind, o, base, live, n_owners, n_repos), by start and kind.

    Base spans are all there; of the others those that ownership calls live. owner_col names who a document belongs to,
    repo_cols the repository within.
    """
    tmp = Temporary()
    repo = F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(repo_cols)])
    told = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.to_json(repo).alias("repo"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = tmp.keep(scan(told), "secret-uses", "zstd")
    each = rows.select("row", "owner", "repo", F.inline("uses"))
    known = tmp.keep(ownership(each.select("h", "owner", "repo")), "secret-owners", "zstd")
    total = known.agg(F.sum("n_uses")).first()[0] or 0
    # at most `hot` hashes have more than 1 / hot of all uses
    common = known.where(F.col("n_uses") * hot > total)
    at = each.select("row", "s", "e", "kind", "o", "h", "live")
    judged = at.join(F.broadcast(common), "h").unionByName(at.join(F.broadcast(common.select("h")), "h", "left_anti").join(known.where(F.col("n_uses") * hot <= total), "h"))
    own = (F.col("n_owners") == 1) | ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    live = F.col("live") & own
    base = F.col("o") < len(BASE)
    spans = judged.select("row", "s", "o", "e", "kind", base.alias("base"), live.alias("live"), "n_owners", "n_repos").where("base or live")
    by_row = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "o", "e", "kind", "base", "live", "n_owners", "n_repos"))).alias("spans"))
    none = F.expr("cast(array() as array<struct<s: bigint, o: int, e: bigint, kind: string, base: boolean, live: boolean, n_owners: bigint, n_repos: bigint>>)")
    with_some = rows.where("size(uses) > 0").select("row", "key").join(by_row, "row", "left").select("key", F.coalesce("spans", none).alias("spans"))
    out = materialise(with_some.unionByName(rows.where("size(uses) = 0").select("key", none.alias("spans"))), "secrets", "zstd")
    tmp.drop()
    return out


JOINED = "array_join(transform({0}, x -> concat(x.kind, ':', x.s, ':', x.e)), ',')"


def digest(docs: DataFrame, **options) -> DataFrame:
    """The contract's row for each document; n_live and n_examples count its values by the verdict of ownership."""
    counts = [f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint) as n_{k}" for k in BASE]
    verdicts = ["cast(size(filter(spans, x -> x.live)) as bigint) as n_live", "cast(size(filter(spans, x -> not x.live)) as bigint) as n_examples"]
    return findings(docs, **options).selectExpr("key as doc_id", *counts, f"sha2({JOINED.format('filter(spans, x -> x.base)')}, 256) as base_sha256", f"{JOINED.format('spans')} as spans", *verdicts)


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
