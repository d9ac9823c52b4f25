"""The pipeline against plain versions of its stages, each on its own input, on the smallest documents; and on odd tables."""

import math
import re

import numpy as np
import pytest
from test_llm import base

import corpus_pipeline
from cardloom.llm import decontaminate, langid, pieces
from cardloom.llm.common import materialise, read

DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def language_by_hand(docs):
    """Mixtures by the book: counts of trigrams in dicts, EM a document at a time, then one language less as long as the penalised likelihood allows."""
    grams = {}
    for k, r in docs.items():
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in (r.text or "").lower()).split()) + " "
        c = {}
        for i in range(1, len(s) - 1):
            if s[i] != " ":
                code = np.array([(ord(s[i - 1]) << 42) | (ord(s[i]) << 21) | ord(s[i + 1])], np.uint64)
                b = int(langid.mix(code)[0] & np.uint64(langid.BUCKETS - 1))
                c[b] = c.get(b, 0) + 1
        grams[k] = c
    langs = sorted({r.lang for r in docs.values() if r.lang is not None})
    total = {g: {} for g in langs}
    for k, r in docs.items():
        for b, n in grams[k].items() if r.lang is not None else ():
            total[r.lang][b] = total[r.lang].get(b, 0) + n
    sums = {g: max(1, sum(total[g].values())) for g in langs}
    mean = lambda b: sum(total[g].get(b, 0) / sums[g] for g in langs) / len(langs)
    kept = set()
    for k, c in grams.items():
        if not c:
            continue
        n = np.array(list(c.values()), float)
        like = np.array([[0.97 * total[g].get(b, 0) / sums[g] + 0.02 * mean(b) + 0.01 / langid.BUCKETS for g in langs] for b in c])

        def em(some, n=n, like=like):
            p = np.array([1 / len(some) if j in some else 0 for j in range(len(langs))])
            for _ in range(langid.EM_STEPS if len(some) > 1 else 1):
                w = like * p
                p = (w / w.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
            return p, float((n * np.log((like * p).sum(1))).sum())

        some = set(range(len(langs)))
        p, fit = em(some)
        while len(some) > 1:
            least = min(some, key=lambda j: (p[j], j))
            q, new = em(some - {least})
            if new + 0.5 * math.log(n.sum() + 1) < fit:
                break
            some, p, fit = some - {least}, q, new
        if p.max() >= 0.5:
            kept.add(k)
    return kept


def copies_by_hand(docs, percent=80):
    words = {k: (r.text or "").encode().lower().split() for k, r in docs.items()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for k, w in words.items()}
    comp = {k: k for k in docs}

    def top(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(k for k in docs if sets[k])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                comp[y] = x
    return {k for k in docs if top(k) == k}


def cut_by_hand(text, items):
    """(text without hit words, share hit), every window tried."""
    low = lambda t: (t or "").encode().lower().decode()  # noqa: E731  A-Z only
    spans = [m.span() for m in decontaminate.WORD.finditer(low(text))]
    words = [low(text)[a:b] for a, b in spans]
    hit = set()
    for _, t in items:
        w = decontaminate.WORD.findall(low(t))
        for x in {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else ():
            for i in range(len(words) - len(x) + 1):
                if tuple(words[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : spans[i][0]])
        at = spans[i][1]
    return (("".join(out) + text[at:]) if hit else text), len(hit) / max(1, len(words))


def redact_by_hand(text):
    spans = [(int(s), int(e), kind.upper()) for kind, s, e in (x.split(":") for x in base(text).split(",") if x)]
    spans += [(m.start(), m.end(), "SECRET") for m in re.finditer(r'(?i)\btoken = "[0-9a-f]{40}"', text or "")]
    out, at = [], 0
    for s, e, kind in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{kind}]"]
        at = max(at, e)
    return "".join(out) + text[at:] if spans else text


def test_pipeline_stage_by_stage(spark):
    docs = read(spark, DIR, "documents")
    stages = dict(corpus_pipeline.STAGES)
    items = [(r.item_id, r.text) for r in read(spark, DIR, "benchmark").collect()]
    m = pieces.load(pieces.MODEL)
    was, now = rows_of(docs), None
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, DIR), name)
        now = rows_of(after)
        assert after.count() == len(now) and (name == "encode" or after.columns == docs.columns)
        if name == "language":
            assert set(now) == language_by_hand(was)
        elif name == "near_copies":
            assert set(now) == copies_by_hand(was)
        elif name == "benchmark_passages":
            want = {k: cut_by_hand(r.text, items) for k, r in was.items()}
            assert {k: r.text for k, r in now.items()} == {k: t for k, (t, share) in want.items() if share <= 0.5}
        elif name == "personal_data":
            assert {k: r.text for k, r in now.items()} == {k: redact_by_hand(r.text) for k, r in was.items()}
        else:
            assert set(now) == set(was) and all(r.lossless and pieces.decode(np.array(r.piece_ids), m) == r.text for r in now.values() if r.text)
            assert all(r.piece_ids == pieces.brute(r.text, k, m) for k, r in now.items() if r.text and len(r.text) < 400)
        if name in ("language", "near_copies"):
            assert all(now[k] == was[k] for k in now)
        docs, was = after, now
    assert set(stages) == {"language", "near_copies", "benchmark_passages", "personal_data", "encode"}
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, DIR).collect()} == {k: r.text for k, r in now.items()}


ODD = [(1, "the cat and the dog went home", "en", None, 5), (1, "the cat and the dog went home", "en", None, 5), (1, "a wholly other text about the house and the garden", "en", "s", 5), (2, None, "en", "s", None), (3, "", None, None, 0), (None, "der hund und die katze gingen nach haus", "de", "s", 1), (4, "12 34", "de", "s", 1), (5, "der hund und die katze " * 30_000, "de", "s", 1)]
NAMES = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns with names that the stages use themselves.
MORE = "row string, score string, lang_pred int, lang_set string, n_words int, hit_runs string, hit_items int, hit_cut string, base string, spans int, extra int, mark int, first string, n_shingles int, component_id string, kept string, n_pieces_ string"


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_on_odd_tables(spark, rows):
    extra = MORE.split(", ")
    values = tuple("x" if c.endswith("string") else 7 for c in extra)
    docs = spark.createDataFrame([(*r, *values) for r in rows], f"{NAMES}, {MORE}")
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, DIR), name)
        assert name == "encode" or after.columns == docs.columns
        assert all(tuple(r)[5:22] == values for r in after.collect()), name
        docs = after
    left = sorted(((r.doc_id or 0, r.text[:20]) for r in docs.collect()), key=str)
    assert left == ([(0, "der hund und die kat"), (1, "a wholly other text "), (1, "the cat and the dog "), (5, "der hund und die kat")] if rows else [])
