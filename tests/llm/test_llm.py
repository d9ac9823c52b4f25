"""Training-data operators: odd inputs and brute force."""

import hashlib
import re

import numpy as np
import pytest

from cardloom.llm import chat, decontaminate, html_extract, langid, neardup, pieces, pii, quality, rules, shards
from cardloom.llm.common import new_path, read

ODD = [(1, "Hello  world ▁ \n\n x"), (2, None), (3, ""), (4, "   "), (5, "日本語 😀 " * 40), (6, "a" * 30000), (7, "same words here are five and more"), (8, "same words here are five and more"), (None, "no id here at all my friend"), (8, "same words here are five and more")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en" if i != 3 else None, None, 5, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, n_words long, score string")


def test_pieces(spark, odd):
    m = pieces.load(pieces.MODEL)
    rows = pieces.digest_column(pieces.encode_column(odd)).collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert sorted(pieces.encode_digest_column(odd).collect(), key=str) == sorted(rows, key=str)
    for i, t in [(1, "Hello  world ▁ \n\n x"), (2, "some other words, to sample")]:
        assert pieces.encode([t], [i], m)[0].tolist() == pieces.brute(t, i, m)
    assert [r.decoded for r in pieces.decode_column(pieces.encode_column(odd)).collect()] == [t for _, t in ODD]
    assert pieces.encode_column(odd.limit(0)).count() == 0


def test_pieces_against_the_whole_lattice(monkeypatch):
    """In parts, in windows and at once: the same draws give the same pieces as the sampler over the unsplit lattice."""
    m, rng = pieces.load(pieces.MODEL), np.random.default_rng(9)
    texts = ["some words, here é日本 ▁▁ and  more \n x", " " * 30 + "a", "aaaaaaaabbbbab" * 20, "日本語" * 9, "the 😀😀 end " * 12]
    texts += ["".join("abcde ▁é日."[x] for x in rng.integers(0, 10, int(n))) for n in rng.integers(1, 300, 12)]
    want = [pieces.brute(t, k, m) for k, t in enumerate(texts)]
    assert [x.tolist() for x in pieces.encode(texts, list(range(len(texts))), m)] == want
    monkeypatch.setattr(pieces, "LONG_BLOCK", 7)
    for long, part in ((3, 1 << 20), (20_000, 25), (5, 40), (2, 3)):
        monkeypatch.setattr(pieces, "LONG", long)
        monkeypatch.setattr(pieces, "SLICE_CHARS", part)
        assert [x.tolist() for x in pieces.encode(texts, list(range(len(texts))), m)] == want, (long, part)


def test_pieces_draw_in_proportion():
    """Whole segmentations of a word come as often as their weights say."""
    m, n = pieces.load(pieces.MODEL), 6000
    ways: dict[tuple, float] = {}

    def split(rest, ids, weight):
        if not rest:
            ways[ids] = weight
        for k in range(1, len(rest) + 1):
            if (i := m.by_text.get(rest[:k])) is not None:
                split(rest[k:], (*ids, i), weight * np.exp(pieces.ALPHA * m.weight[i]))

    split("▁the", (), 1.0)
    got: dict[tuple, int] = {}
    for ids in pieces.encode(["the"] * n, list(range(n)), m):
        got[tuple(ids.tolist())] = got.get(tuple(ids.tolist()), 0) + 1
    total = sum(ways.values())
    assert set(got) <= set(ways) and all(abs(got.get(k, 0) / n - w / total) < 5 * (w / total / n) ** 0.5 + 1e-3 for k, w in ways.items())


def test_pieces_memory_of_a_long_word():
    import resource
    import subprocess
    import sys

    code = "import resource\nfrom cardloom.llm import pieces\nm = pieces.load(pieces.MODEL)\na = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nx = pieces.encode(['aB3/' * 250_000 + ' x ' + 'word ' * 400_000], [1], m)\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - a) // 1024, len(x[0]))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(out[0]) < 400 and int(out[1]) > 400_000 and resource


def test_html():
    e = html_extract.extract
    assert e(None) == "" and e("") == "" and e("<p>a<p>b") == "a\nb" and e("x &amp;  &lt;y") == "x & <y"
    page = "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One, two, three.</p><aside>side</aside><section class=comments><p>hm</p></section><p>b</article><footer>f"
    assert e(page) == "T\nOne, two, three.\nb"
    assert e("<div " * 2000) == "" and len(e("<p>" + "word " * 50000)) > 200000


def test_html_keeps_the_same_blocks_on_long_pages():
    for n in (1, 3, 7, 40):
        paras = ["One, two, three, " + "word " * 56 + str(i) for i in range(n)]
        body = "<div class=article-body>" + "".join(f"<p>{p}</p>" for p in paras) + "</div>"
        beside = "<ul><li>item</ul><ol><li>first</ol><dl><dt>term<dd>sense</dl><table><tr><td>cell</table><pre>code</pre><blockquote>said</blockquote><figure>fig</figure>bare <b>text</b>"
        want = "\n".join(["T", *paras, "item", "first", "term", "sense", "cell", "code", "said", "fig", "bare text"])
        links = "<div><a href=x>one other page</a> <a href=y>and another</a></div>"
        for page in (f"<article><header><h1>T</h1></header>{body}{beside}</article>{links}", f"<main><h1>T</h1>{body}{beside}</main>{links}", f"<div role=main><h1>T</h1>{body}{beside}</div>{links}", f"<main><h1>T</h1><div><article>{body}</article>{beside}</div></main>{links}"):
            assert html_extract.extract(f"<nav>menu</nav>{page}<footer>f</footer>") == want, (n, page[:40])
        if n > 1:  # without either element, what is beside the best container
            assert html_extract.extract(f"<div><h1>T</h1>{body}{beside}</div>{links}") == want


def test_html_loses_and_leaks_nothing():
    e = html_extract.extract
    assert e("<p>one</p><p data-x=it's>two</p><p>three</p>") == "one\ntwo\nthree"
    assert e("<p title='a>b' x=\"c>d\">one</p>") == "one"
    for tag in ("svg", "canvas", "object", "template", "noscript"):
        assert e(f"<p>one</p><{tag}><p>two</p><p>three</p>") == "one\ntwo\nthree", tag
        if tag != "svg":  # a block ends a drawing
            assert e(f"<p>one</p><{tag}><p>two</p><{tag}>x</{tag}></{tag}><p>three</p>") == "one\nthree", tag
    assert e("<p>a <svg><title>t</title><g><text>x</text></g></svg> b</p><svg><p>c</p></svg><svg/><p>d") == "a b\nc\nd"
    assert e("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> then</p>") == "if x=1 then"
    for name in ("contact-lens", "side-effects", "related-work", "tools", "tool-list", "share-price", "banner-year"):
        assert e(f'<article><p>one</p><p class="{name}">two</p><div id="{name}">three</div></article>') == "one\ntwo\nthree", name
    for name in ("ad", "ads", "site-footer", "sidebar", "left-sidebar", "comments", "commentList", "comment-form", "cookie-banner", "share-buttons", "related-posts", "main_nav", "x breadcrumbs y", "newsletter-box"):
        assert e(f'<article><p>one</p><p>two</p><div class="{name}">three</div></article>') == "one\ntwo", name
    for raw in ("<script src=a.js/>alert(1)</script>", "<style/>p{}</style>", "<SCRIPT>if (a</b) x</SCRIPT >"):
        assert e(f"<p>one{raw} two</p>") == "one two"
    assert e("<p>x<table><tr><td>a</div></p>b<td>c</table>d") == "x\na\nb\nc\nd"


def test_html_in_linear_time():
    import time

    n = 60_000
    pages = ["<div>" * n + "<li>" * n, "<p><table><tr><td>" + "<div>" * n + "</span>" * n, "<table><td>" * (n // 4) + "</tr>" * n, "<main>" + "<div><header><h1>t</h1></header>" * (n // 4) + "<article><p>" + "word " * 50, "<svg>" * n + "<p>" * n, "<p x=" * n, "<canvas>" * n + "x" + "</canvas>" * n, "<ul>" + "<li><ul>" * n + "x", "<a b='" + "<i c=d'" * n]
    for page in pages:
        began = time.perf_counter()
        html_extract.extract(page)
        assert time.perf_counter() - began < 6, page[:60]


def test_html_against_known_blocks():
    """Generated pages: what stands in the article, block by block, and nothing of what stands around it."""
    rng = np.random.default_rng(7)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    noise = [lambda: f"<nav><ul><li><a href=/a>{words(2)}</a><li><a href=/b>{words(1)}</a></ul></nav>", lambda: f"<aside><p>{words(30)}, {words(9)}</p></aside>", lambda: f"<div class='sidebar x'><p>{words(40)}</p></div>", lambda: f"<footer>{words(20)}</footer>", lambda: f"<form><label>{words(2)}</label><input name=q></form>", lambda: f"<script>var a = '<p>{words(5)}</p>';</script>", lambda: f"<div id=cookie-notice>{words(15)}</div>", lambda: f"<section id=comments><article><p>{words(25)}, {words(5)}</p></article></section>", lambda: f"<style>p {{ {words(3)} }}</style><!-- {words(4)} -->"]
    for page in range(150):
        want, body = [], []
        for _ in range(int(rng.integers(1, 25))):
            kind, text = int(rng.integers(0, 8)), words(int(rng.integers(1, 70)))
            parts = [text]
            if kind < 4:
                body.append(f"<p>{text}" + "</p>" * int(rng.integers(0, 2)))
            elif kind == 4:
                body.append(f"<h2>{text} &amp; <em>x</em></h2>")
                parts = [f"{text} & x"]
            elif kind == 5:
                parts = [words(3) for _ in range(4)]
                body.append("<ul>" + "".join(f"<li>{x}" for x in parts) + "</ul>")
            elif kind == 6:
                parts = [words(2) for _ in range(4)]
                body.append(f"<table><tr><td>{parts[0]}<td>{parts[1]}<tr><td>{parts[2]}<td>{parts[3]}</table>")
            else:
                body.append(f"<blockquote><p>{text}  \n</p></blockquote>")
            want += parts
            if rng.random() < 0.3:
                body.append(noise[int(rng.integers(0, len(noise)))]())
        around = [noise[int(rng.integers(0, len(noise)))]() for _ in range(6)]
        tag = ("article", "main", "div class=post-content")[page % 3]
        if tag[0] == "d":  # without either element the container must be the best one
            body.insert(0, f"<p>{(big := words(80))}, {big}, {big}</p>")
            want.insert(0, f"{big}, {big}, {big}")
        got = html_extract.extract("<html><head><title>t</title></head><body>" + "".join(around[:3]) + f"<{tag}>" + "".join(body) + f"</{tag.split()[0]}>" + "".join(around[3:]) + "</body>")
        assert got == "\n".join(want), (page, tag)


def test_shards(spark, odd):
    path = new_path(spark, "test")
    rows = shards.write_shards(odd.repartition(3), path, seq_len=8, shard_rows=16).collect()
    m, got = shards.manifest(path), dict(shards.read_sequences(path))
    assert sorted(got) == list(range(m["sequences"])) and len(rows) == len(ODD)
    bpe = shards.tokenizer(shards.VOCABULARY).bpe
    back = []
    for r in rows:
        ids = shards.read_document(path, r.first_seq, r.start, r.n_tokens)
        assert len(ids) == r.n_tokens and shards.zlib.crc32(ids.tobytes()) == r.tokens_crc32 and ids[-1] == shards.END
        assert r.slot == r.shard * 16 + r.byte_offset // 16 and got[r.slot][r.start] == ids[0]
        back.append((r.doc_id, bpe.decode(ids[:-1].tolist())))
    assert sorted(back, key=str) == sorted(((i, t or "") for i, t in ODD), key=str)
    # documents lie back to back: of the tokens only what ends a task's stream is padding
    assert sum(r.n_tokens for r in rows) > (m["sequences"] - 3) * 8
    for start in (1, 15, 16, 20, m["sequences"] - 1):  # resumed within and across shards
        assert [(s, x.tolist()) for s, x in shards.read_sequences(path, start)] == [(s, got[s].tolist()) for s in range(start, m["sequences"])]
    assert shards.write_shards(odd.limit(0), none := new_path(spark, "none")).count() == 0 and list(shards.read_sequences(none)) == []
    for n in (1, 2, 3, 1000):
        y = shards.feistel(np.arange(n), n)
        assert sorted(y) == list(range(n)) and (shards.unfeistel(y, n) == np.arange(n)).all()
    ids = np.arange(3000, dtype="<u2")
    assert (shards.unpack(shards.pack(ids), 3000) == ids).all()


def test_shards_written_twice(tmp_path):
    """A second attempt, also where a rename fails on an existing name, leaves the first one's shard."""
    from pyarrow import fs

    class Strict:  # a store that doesn't overwrite, and on which the other attempt comes between look and rename
        def __init__(self, late):
            self.fs, self.late = fs.LocalFileSystem(), late

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def move(self, a, b):
            if self.late:
                (tmp_path / "shard").write_bytes(b"first")
            if (tmp_path / "shard").exists():
                raise OSError("exists")
            self.fs.move(a, b)

    for late, there, want in ((False, True, b"first"), (True, False, b"first"), (False, False, b"second")):
        (tmp_path / "shard").unlink(missing_ok=True)
        if there:
            (tmp_path / "shard").write_bytes(b"first")
        (tmp_path / "new").write_bytes(b"second")
        shards.publish(Strict(late), str(tmp_path / "new"), str(tmp_path / "shard"))
        assert (tmp_path / "shard").read_bytes() == want and not (tmp_path / "new").exists()


def test_tokenizer_cache_is_exact():
    t = shards.tokenizer(shards.VOCABULARY)
    for s in ("don't  stop\n\n x²y ½ a_b __ \x1c 12ab é̀ 日本 \t\n", "  ", "'s 'S  we've"):
        assert np.frombuffer(t.encode(s), "<u2").tolist() == t.bpe.encode_ordinary(s), s


def test_rules(spark, odd):
    rows = rules.judge(odd).collect()
    assert len(rows) == len(ODD) and all(r.kept is False for r in rows if r.base_failed)
    line = "one two three four five six seven"
    s = rules.statistics(spark.createDataFrame([(1, line + "\n" + line + "\n#$ x", "a", "b")], "doc_id long, text string, lang string, source string")).first()
    assert (s.n_words, s.n_repeat_words, s.n_dup_lines, s.n_symbols, s.word_chars) == (16, 14, 1, 2, 2 * len(line.replace(" ", "")) + 3)
    assert rules.judge(odd.limit(0)).count() == 0


def mcd_by_trial(x, rng, trials=300):
    """The regularised minimum covariance determinant by many random starts, with exact halves: mean, covariance, log determinant."""
    floors = np.array(rules.FLOORS, float)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    target, h = np.diag(((q[2] - q[0]) / 1.349 + floors) ** 2), int(np.ceil(rules.COVER * len(x)))

    def fit(rows):
        c = np.cov(x[rows].T, bias=True)
        c = (rules.CONSISTENCY * c * len(rows) + rules.PULL * target) / (len(rows) + rules.PULL) + np.diag(floors**2)
        return x[rows].mean(0), c, np.linalg.slogdet(c)[1]

    best = None
    for _ in range(trials):
        m, c, ld = fit(rng.choice(len(x), 12, replace=False))
        for _ in range(30):
            d = np.einsum("ri,ij,rj->r", x - m, np.linalg.inv(c), x - m)
            m, c, new = fit(np.argsort(d, kind="stable")[:h])
            if new >= ld - 1e-12:
                break
            ld = new
        if best is None or new < best[2]:
            best = m, c, new
    return best


def test_covariance_of_least_determinant(spark):
    """Against many random starts in numpy; and the covariance decides: what it rejects lies well within every single coordinate's range."""
    rng, groups = np.random.default_rng(11), {}
    for name, n in (("a", 400), ("b", 200)):
        base = rng.normal(size=(n, 8)) * np.array([90, 110, 110, 90, 700, 800, 700, 900]) + rng.normal(size=(n, 1)) * np.array([500, 500, -400, 500, 0, 0, 300, 300])
        odd = rng.random(n) < 0.12  # within every single range, but the first two against their correlation
        base[odd, :2] = np.array([1200, -1200]) + rng.normal(size=(odd.sum(), 2)) * 30
        groups[name] = np.round(base + 2000).astype(int), odd
    rows = [(g, None, *map(int, r)) for g, (x, _) in groups.items() for r in x]
    vec = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"x{i} long" for i in rules.P))
    for r in rules.estimate(vec).collect():
        x, odd = groups[r.lang]
        m, c, ld = mcd_by_trial(x.astype(float), rng)
        w = np.array([[r[f"w{max(i, j)}_{min(i, j)}"] for j in rules.P] for i in rules.P])
        centre = np.array([r[f"m{i}"] for i in rules.P])
        assert abs(r.ld - ld) < 0.15 and abs(r.ld + np.linalg.slogdet(w)[1]) < 1e-6
        mine = np.einsum("ri,ij,rj->r", x - centre, w, x - centre) > rules.CUTOFF
        theirs = np.einsum("ri,ij,rj->r", x - m, np.linalg.inv(c), x - m) > rules.CUTOFF
        assert (mine == theirs).mean() > 0.98 and mine[odd].mean() > 0.95 and mine[~odd].mean() < 0.05
        alone = (((x - centre) ** 2) / np.diag(np.linalg.inv(w))).sum(1) > rules.CUTOFF  # without covariances
        assert (mine & ~alone).sum() > 0.5 * mine.sum()


def test_rules_against_the_quality_labels(spark):
    """Labels serve to measure only: what fails the distance is junk, and hardly a clean document does."""
    d = "/root/testdata/sf0.1"
    rows = rules.judge(read(spark, d, "documents")).where("not base_failed").join(read(spark, d, "labels"), "doc_id").groupBy("quality").agg(rules.F.avg(rules.F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in rows}
    assert kept[1] > 0.995 and kept[0] < 0.2, kept


def test_rules_judge_small_sources_by_their_language(spark):
    """Junk rows go that are the only rows of their sources; clean rows stay in sources of nineteen and of one."""
    d = "/root/testdata/sf0.01"
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    known = docs.join(read(spark, d, "labels"), "doc_id").join(rules.statistics(docs).where("not base_failed").select("doc_id"), "doc_id").where("lang = 'en'").orderBy("doc_id")
    junk, clean = (known.where(f"quality = {q}").limit(n).collect() for q, n in ((0, 19), (1, 20)))
    assert len(clean) == 20 and len(junk) >= 5
    extra = [(-1 - i, r.text, "en", f"lone{i}") for i, r in enumerate(junk)] + [(-101 - i, r.text, "en", "one" if i == 19 else "few") for i, r in enumerate(clean)]
    every = docs.union(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id: r.kept for r in rules.judge(every).where("doc_id < 0").collect()}
    assert sum(kept[-1 - i] for i in range(len(junk))) <= 1, kept
    assert all(kept[-101 - i] for i in range(20)), kept


def test_decontaminate(spark, odd):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "beta gamma"), (4, "beta gamma")]
    texts = [(1, "x Alpha beta gamma delta epsilon zeta eta theta iota kappa; lambda y short  item z"), (2, None), (3, "beta beta gamma alpha"), (4, "nothing")]
    i = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for block in (1_000_000, 3):
        for r in decontaminate.digest(d, i, block_words=block).collect():
            n, h, ids = decontaminate.brute(dict(texts)[r.doc_id], items)
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, h, len(ids), decontaminate.sha(ids))
    assert decontaminate.digest(odd, i.limit(0)).where("contaminated").count() == 0
    assert [r.text for r in decontaminate.decontaminate(d, i, max_coverage=1.0).orderBy("doc_id").collect()][2:] == ["beta  alpha", "nothing"]


def test_automaton_against_brute_force(spark):
    """Items that repeat, contain and overlap each other, long and short, in one block and in six; one worker a task."""
    rng = np.random.default_rng(2)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 6, n))
    items = [(i, words(int(rng.integers(0, 30)))) for i in range(60)] + [(900, None), (901, "w1 w2 w3 w4 w1 w2 w3 w4 w1 w2 w3"), (901, "w1 w2 w3 w4 w1 w2 w3 w4 w1 w2 w3"), (902, "odd zz")]
    items += [(950 + k, items[0][1] + " tail") for k in range(5)]
    texts = [(i, words(int(rng.integers(0, 60))) + (" " + items[i % 60][1] + " x ") * (i % 3)) for i in range(80)] + [(80, None), (81, ""), (82, "x" * 9), (83, (items[3][1] + " ") * 500)]
    d, i = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    total = sum(len((t or "").split()) for _, t in items)
    want = {k: decontaminate.brute(t, items) for k, t in texts}
    for block in (1_000_000, total // 6):
        got = decontaminate.digest(d, i, block_words=block)
        assert got._jdf.queryExecution().toString().count("MapInArrow") == 4  # once in each of four plans: blocks aren't stacked
        for r in got.collect():
            n, h, ids = want[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, h, len(ids), decontaminate.sha(ids)), (block, r.doc_id)
    assert decontaminate.digest(d.limit(0), i).count() == 0


def test_automaton_memory():
    import pickle

    rng = np.random.default_rng(4)
    items = [(k, [f"w{x}" for x in (rng.zipf(1.3, 200) % 20000).tolist()]) for k in range(1000)]
    auto = decontaminate.SuffixAutomaton(items, 10)
    assert len(pickle.dumps(auto)) < 100 * 200_000 and auto.nbytes() < 80 * 200_000
    runs, found = auto.match(["x", *items[5][1], "y"])
    assert runs == [(1, 201)] and 5 in found


def test_decontaminate_keeps_columns(spark):
    d = spark.createDataFrame([(1, "no words of items", "a", 7, [1]), (2, "x alpha beta y z z z", "b", 8, [2])], "doc_id long, text string, hit_cut string, n_words int, hit_runs array<int>")
    i = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(d, i).orderBy("doc_id").collect()] == [(1, "no words of items", "a", 7, [1]), (2, "x  y z z z", "b", 8, [2])]


def base(t):
    out = []

    def add(order, kind, pattern, ok):
        out.extend((m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if ok(m[0]))

    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0
    add(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True)
    add(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split(".")))
    add(2, "card", r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(digits(s)) <= 19 and luhn(digits(s)))
    add(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(digits(s)) <= 15)
    return ",".join(x for _, _, x in sorted(out))


def test_pii(spark, odd):
    texts = [t for _, t in ODD[:6]] + ["a@b.c_d@e.f é😀 1.2.3.4.5 256.1.1.1", "4111 1111 1111 1111 x +1 (974) 555-3436, +49 30 1234567.", "1 " * 3000 + "a@b.cc " * 600, "+1+12345678901 ++4420 7946 0958 0001.2.3.4"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest(d).collect():
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id]
    assert pii.redact(d).where("doc_id = 6").first()["text"] == "[EMAIL][EMAIL] é😀 [IP].5 256.1.1.1"
    assert pii.digest(odd.limit(0)).count() == 0 and pii.redact(odd).columns == odd.columns


def test_secrets_are_found_whole(spark):
    key = "aB3dE5gH7jK9"
    texts = [f"token={key * 20} end", f"token: {key * 20000}", f'{{"api_key": "{key}", "n": 1}}', f"{{'password' : '{key * 30}'}} z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.digest(d).collect()}
    assert spans == {0: "secret:0:246", 1: "secret:0:240007", 2: f"secret:2:{len(texts[2]) - 9}", 3: f"secret:2:{len(texts[3]) - 3}"}
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()] == ["[SECRET] end", "[SECRET]", '{"[SECRET], "n": 1}', "{'[SECRET]} z"]


def test_names_without_a_title(spark):
    found = {"contact: Maria Lopez, x": "[NAME]", "by John Smith.": "[NAME]", "then John F. O'Brien said": "[NAME]", "author Carmen de la Cruz-Vega y": "[NAME]", "contact: Xavier Ortiz": "[NAME]", '"name": "Aino Virtanen"': "[NAME]", "met Dr. Weber there": "[NAME]", "Herr Prof. Hans-Peter Groß kam": "[NAME]"}
    clean = ["Johnson and Marietta", "by the Sea", "port Lima", "surname Lopez Ortiz", "the Great Wall"]
    texts = [*found, *clean] * 20
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in pii.redact(d).orderBy("doc_id").collect()][: len(found) + len(clean)]
    assert got[: len(found)] == ["contact: [NAME], x", "by [NAME].", "then [NAME] said", "author [NAME] y", "contact: [NAME]", '"name": "[NAME]"', "met [NAME] there", "[NAME] kam"]
    assert got[len(found) :] == clean


def planted_texts(rng, n):
    """Texts with one planted thing each, its kind and where it is; and as many that only look so."""
    from cardloom.llm.pii import GIVEN

    filler = "oned the onerntat was there and thing into stable then going over under some more few other long short text words".split()
    words = lambda k: " ".join(filler[x] for x in rng.integers(0, len(filler), k))
    hexa = lambda k: "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, k))
    mixed = lambda k: "aZ3" + "".join("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"[x] for x in rng.integers(0, 56, k))
    last = lambda: "".join("BCDFGLMNPRSTV"[rng.integers(13)] + "".join("aeiou"[rng.integers(5)] + "lmnrst"[rng.integers(6)] for _ in range(2)))
    given = lambda: GIVEN[rng.integers(len(GIVEN))]
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    good = [
        ("secret", lambda: f'token = "{hexa(40)}"', None), ("secret", lambda: f"password: {mixed(14)}", None), ("secret", lambda: f"api_key='ghp_{mixed(24)}'", None), ("secret", lambda: f"bearer key {mixed(30)}", 11),
        ("name", lambda: f"contact: {given()} {last()}", 9), ("name", lambda: f"met Dr. {last()}", 4), ("name", lambda: f"by {given()} {last()}", 3), ("name", lambda: f"Frau {given()} van der {last()}", 0), ("name", lambda: f"dear {given()} {last()}-{last()}", 5),
        ("local", lambda: f"phone ({rng.integers(201, 209)}) {rng.integers(201, 555)}-{digits(4)}", 6), ("local", lambda: f"call {rng.integers(212, 219)}-{rng.integers(201, 555)}-{digits(4)}", 5), ("local", lambda: f"tel {rng.integers(401, 409)} {rng.integers(201, 555)} {digits(4)}", 4),
        ("number", lambda: f"card {(x := '4' + digits(11))}{next(c for c in '0123456789' if luhn(x + c))}", 5), ("number", lambda: f"visa number: {(x := '4' + digits(11))}{next(c for c in '0123456789' if luhn(x + c))}", 13),
    ]
    luhn = lambda d: sum(sum(divmod(int(x) * 2, 10)) if i % 2 else int(x) for i, x in enumerate(reversed(d))) % 10 == 0
    bad = [lambda: f"item 555 123 {digits(4)}", lambda: f"serial-{digits(3)}-{digits(3)}-{digits(4)}x", lambda: f"serial 12-{digits(4)}-{digits(5)}", lambda: f"{words(1)} {digits(9)}", lambda: f"commit {hexa(40)}", lambda: f"file path/{words(1)}-version-2024-{words(1)}-list.txt", lambda: f"sha256 {hexa(64)}", lambda: f"the {last()} {last()}", lambda: f"thing. The {last()}", lambda: f"over. {last()} {last()} {words(2)}", lambda: f"{(x := last())} {x} {x}", lambda: f"order 000 000 {digits(4)}", lambda: f"isbn 978{digits(9)}", lambda: "key: placeholder_value_here", lambda: f"Johnson and {last()}"]
    rows, clean = [], []
    for i in range(n):
        kind, make, at = good[i % len(good)]
        before, thing = words(int(rng.integers(3, 30))), make()
        rows.append((f"{before} {thing} {words(int(rng.integers(1, 30)))}", kind, len(before) + 1 + (at or 0), len(before) + 1 + len(thing)))
        clean.append(f"{words(int(rng.integers(3, 30)))} {bad[i % len(bad)]()} {words(int(rng.integers(1, 30)))}")
    return rows, clean


def test_labelers_find_what_is_planted_and_leave_the_rest(spark):
    """The classifier learns from votes alone; what was planted serves only to measure, also on texts that it wasn't fitted on."""
    rng = np.random.default_rng(3)
    rows, clean = planted_texts(rng, 840)
    texts = [r[0] for r in rows] + clean
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.materialise(pii.candidates(d, ["doc_id"]), "x")
    patterns = {}
    for r in found.selectExpr("inline(extra)").select("kind", *pii.LABELERS).distinct().collect():
        patterns.setdefault(r.kind, set()).add(tuple(r)[1:])
    assert all(len(v) >= 4 for v in patterns.values()) and set(patterns) == set(pii.EXTRA)
    half = found.where("(row.doc_id div 14) % 2 = 0")
    odds = pii.fit(half)
    more = found.where("(row.doc_id div 14) % 2 = 1").selectExpr("row.doc_id", f"transform(filter(extra, c -> {odds} >= {pii.math.log(4)}D), c -> struct(c.s, c.e, c.kind)) as spans")
    caught = total = left = 0
    for r in more.collect():
        if r.doc_id < len(rows):
            _, kind, s, e = rows[r.doc_id]
            total += 1
            caught += any(x.kind == kind and x.s <= s and x.e >= e for x in r.spans)
        else:
            left += not r.spans
    assert caught >= 0.9 * total and left >= 0.97 * total, (caught, left, total)


def test_estimate_finds_reliabilities():
    """EM on votes drawn with known reliabilities gives back the share of true ones and sorts them right."""
    rng = np.random.default_rng(5)
    right = (0.95, 0.8, 0.7, 0.9, 0.6)
    truth = rng.random(20000) < 0.3
    cast = [np.where(rng.random(20000) < 0.3, -1, np.where(rng.random(20000) < q, truth, ~truth)) for q in right]
    count = {}
    for v in zip(*cast, strict=True):
        count[v] = count.get(v, 0) + 1
    post = pii.estimate([("name", *(None if x < 0 else int(x) for x in v), n) for v, n in count.items()])
    got = np.array([post["name", *(None if x < 0 else int(x) for x in v)] for v in zip(*cast, strict=True)])
    odds = np.log(3 / 7) + sum(np.where(x < 0, 0.0, np.where(x == 1, 1, -1) * np.log(q / (1 - q))) for x, q in zip(cast, right, strict=True))
    best = ((odds > 0) == truth).mean()  # with the true reliabilities
    assert abs(got.mean() - 0.3) < 0.03 and ((got > 0.5) == truth).mean() > best - 0.01


def test_redact_keeps_columns_and_time(spark):
    import time

    d = spark.createDataFrame([(1, "mail a@b.cc now", "x", 1, 2, 3, 4), (2, None, "y", 1, 2, 3, 4)], "doc_id long, text string, base string, spans int, extra int, extra0 int, text_was int")
    assert [tuple(r) for r in pii.redact(d).orderBy("doc_id").collect()] == [(1, "mail [EMAIL] now", "x", 1, 2, 3, 4), (2, None, "y", 1, 2, 3, 4)]
    n = 40_000
    long = [("a@b.cc x " * n, "[EMAIL] x " * n), ("+1+12345678901 é\n" * n, "[PHONE] é\n".replace("[PHONE]", "+1[PHONE]") * n), ("A" * 9000 + " 1.2.3.4", "A" * 9000 + " [IP]"), ("x" * 4096 + "@b.cc" + "y" * 4091, "[EMAIL]"), ("é" * 4096 + "1.2.3.4", "é" * 4096 + "[IP]")]
    began = time.perf_counter()
    got = pii.redact(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(long)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == [w for _, w in long] and time.perf_counter() - began < 60


def test_language(spark, odd):
    rows = [(i, "the cat and the dog went to the house " * 3, "en") for i in range(20)] + [(i, "der hund und die katze gingen nach haus " * 3, "de") for i in range(20, 40)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = langid.infer(["the dog and the cat went", None, "12 34", "der hund und die katze gingen nach haus the cat and the dog went to the house"], *model)
    assert [g[0] for g in got[:3]] == ["en", "und", "und"] and got[3][2] == ["de", "en"]
    none = langid.train(odd.where("lang = 'zz'"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_counts_and_blocks(spark, monkeypatch):
    """Trigrams against plain counting; long texts in parts and likelihoods in blocks give the same."""
    texts = ["Straße и Ёлка!", None, "", "a  bb\x00c", "x" * 50 + " yz " * 40, "日本語 text 12 \U00032000\U000323af"]

    def plain(t):
        out: dict[int, int] = {}
        s = "".join(c if c.isalpha() else " " for c in t.lower())
        s = " " + " ".join(s.split()) + " "
        for i in range(1, len(s) - 1):
            if s[i] != " ":
                code = langid.mix(np.array([(ord(s[i - 1]) << 42) | (ord(s[i]) << 21) | ord(s[i + 1])], np.uint64))[0]
                b = int(code & np.uint64(langid.BUCKETS - 1))
                out[b] = out.get(b, 0) + 1
        return out

    def got():
        found: list[dict] = [{} for _ in texts]
        for r, b, n in zip(*langid.counts(texts), strict=True):
            found[r][int(b)] = int(n)
        return found

    assert got() == [plain(t or "") for t in texts]
    rows = [("the cat and the dog went to the house " * 3, "en"), ("der hund und die katze gingen nach haus " * 3, "de"), ("el perro y el gato fueron a la casa " * 3, "es")]
    model = langid.train(spark.createDataFrame([r for r in rows for _ in range(5)], "text string, lang string"))
    asked = [rows[0][0] + rows[1][0], rows[2][0], "", rows[1][0] * 30]
    want, letter = langid.infer(asked, *model), chr(0x32000)
    assert letter.isalpha() and langid.infer([letter * 5], *model)[0][0] != "und"
    monkeypatch.setattr(langid, "CHUNK_CHARS", 20)
    monkeypatch.setattr(langid, "BLOCK_CELLS", 24)
    assert got() == [plain(t or "") for t in texts]
    for a, b in zip(langid.infer(asked, *model), want, strict=True):
        assert a[0] == b[0] and a[2] == b[2] and abs(a[1] - b[1]) < 1e-9
    # mixtures: the proportions against grid search over the likelihood
    langs, logs = model
    _, bucket, n = langid.counts([asked[0]])
    grid = [(sum(n * np.log(p * np.exp(logs[bucket, 0]) + (1 - p) * np.exp(logs[bucket, 1]))), p) for p in np.linspace(0.01, 0.99, 99)]
    assert want[0][2] == ["de", "en"] and abs(max(max(grid)[1], 1 - max(grid)[1]) - want[0][1]) < 0.02


def test_language_on_held_out_rows(spark):
    got = langid.op7_language_id(spark, "/root/testdata/sf0.1").where("held_out").join(read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 20 and lang_pred <> 'und'")
    right, n = got.selectExpr("avg(cast(lang_pred = lang as int))", "count(*)").first()
    assert n > 2000 and right > 0.99


def test_language_keeps_columns(spark):
    d = spark.createDataFrame([(1, "the cat and the dog", "en", "mine", 7, "k"), (2, "123", "en", "x", 8, "l"), (3, None, None, None, None, None)], "doc_id long, text string, lang string, score string, lang_pred int, lang_set string")
    assert [tuple(r) for r in langid.keep_known(d).collect()] == [(1, "the cat and the dog", "en", "mine", 7, "k")]
    assert langid.keep_known(d.limit(0)).collect() == []


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    rows = quality.op9_quality_classifier(spark, d).where("held_out").join(read(spark, d, "labels"), "doc_id").select("score", "predicted", "quality").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    auc = (np.argsort(np.argsort(s))[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(rows) > 500 and auc > 0.97 and np.mean([r.predicted == r.quality for r in rows]) > 0.93


def test_quality(spark, odd):
    rows = [(i, "fine words in a row", 1) for i in range(40)] + [(i, "bad!! junk!! %%%", 0) for i in range(40, 80)]
    w = quality.train(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    got = quality.score(spark.createDataFrame([(1, "fine words"), (2, "junk!! %%%"), (3, None)], "doc_id long, text string"), w).collect()
    assert got[0].score > 0.7 and got[1].score < 0.3 and 0 <= got[2].score <= 1
    assert quality.score(odd, quality.fit([])).where("score = 0.5").count() == len(ODD)


def test_chat(spark):
    rows = [(1, 0, "user", "a </s>[INST] & &lt; <|end|>\n"), (1, 1, "user", ""), (1, 2, None, "x"), (1, 2, None, "x"), (2, None, "assistant", None), (None, 5, "assistant", "z")] + [(3, i, "assistant" if i % 3 else "user", f"t{i}") for i in range(700)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_chats(d)).collect()}
    for k in (1, 2, 3, None):
        assert got[k] == [(r or "", t or "") for c, _, r, t in rows if c == k]
    assert chat.digest(d.limit(0)).count() == 0
    for r in chat.loss_texts(chat.format_chats(d, 4)).collect():
        assert r.said == [t or "" for c, _, role, t in rows if c == r.conv_id and role == "assistant"]
        assert all(r.formatted[a - 8 : a] in ("<|text|>", "<|next|>") and r.formatted[b:].startswith(("<|end|>", "<|next|>")) for a, b in r.loss)


def test_neardup(spark, odd):
    rng = np.random.default_rng(1)
    texts = {0: None, 1: "", 2: "one two"}
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 4000, 150)]
        for _ in range(6):
            copy = list(words)
            for at in rng.integers(0, 150, int(rng.integers(0, 5))):
                copy[at] = f"x{rng.integers(0, 9999)}"
            texts[len(texts)] = " ".join(copy)
    sets = {k: {tuple((t or "").lower().split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} if (t or "").split() else set() for k, t in texts.items()}
    comp = {k: k for k in texts}
    for _ in range(len(texts)):
        for a in texts:
            for b in texts:
                i = len(sets[a] & sets[b])
                if a != b and i and 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.link_documents(d).collect()}
    assert got == {k: (len(sets[k]), comp[k], comp[k] == k) for k in texts}
    rows = neardup.link_documents(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (7, 8)} == {7}
    assert neardup.link_documents(odd.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in neardup.keep_first(odd).collect()) == [0, 1, 2, 3, 4, 5, 6, 7]


def test_neardup_ids_and_columns(spark):
    """Texts that share an id, ids of other types, columns of the operator's own names."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "p", 1, 5), (1, b, "q", 2, 6), (1, b, "q", 2, 6), (2, a.upper() + " ", "r", 3, 7), (3, b + " end", "s", 4, 8), (4, c, "t", 5, 9), (None, a, "u", 6, 1), (5, None, "v", 7, 2), (5, None, "v", 7, 2)]
    names = "text string, row string, mark int, first int"
    for kind, key in (("long", lambda i: i), ("string", lambda i: None if i is None else f"id{i}"), ("int", lambda i: i)):
        d = spark.createDataFrame([(key(r[0]), *r[1:]) for r in rows], f"doc_id {kind}, {names}")
        got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.link_documents(d).collect()}
        assert got == {(key(i), n, key(m), i == m) for i, n, m in ((1, 56, 1), (2, 56, 1), (3, 57, 1), (4, 56, 4), (None, 56, None), (5, 0, 5))}
        left = sorted(((tuple(r)) for r in neardup.keep_first(d).collect()), key=str)
        want = [(1, a, "p", 1, 5), (1, b, "q", 2, 6), (4, c, "t", 5, 9), (None, a, "u", 6, 1), (5, None, "v", 7, 2), (5, None, "v", 7, 2)]
        assert left == sorted(((key(r[0]), *r[1:]) for r in want), key=str)
        assert neardup.keep_first(d).columns == d.columns


def test_neardup_leaves_one_table(spark):
    import os

    folder = neardup.materialise(spark.range(1), "x").stored_at.removeprefix("file://").rpartition("/")[0]
    before = set(os.listdir(folder))
    d = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "x y z")], "doc_id long, text string")
    assert neardup.link_documents(d).count() == 3
    assert [x.partition("-")[0] for x in set(os.listdir(folder)) - before] == ["linked"]


def test_neardup_takes_the_similarity(spark):
    assert (lambda p: (p.chunks, p.per, p.distance, p.bit_distance))(neardup.Plan(85)) == (19, 7, 37, 158)
    words = [[f"{g}w{x}" for x in range(104)] for g in range(200)]  # 100 shingles; a word changed near the end costs k of them: (100 - k) / (100 + k)
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-10], "new", *w[-9:-5], "also", *w[-4:]]) for w in words]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(neardup.shingles(t).tolist()) for t in (texts[0], texts[200])]
    assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.85
    assert sorted(r.doc_id for r in neardup.keep_first(d, 80).collect()) == list(range(200))
    assert neardup.keep_first(d, 85).count() == 400


def test_neardup_shared_keys(spark):
    rows = [(n, k, 0) for n in range(400) for k in ({1, n % 150 + 2, 1000 + n})]  # key 1: all, 2-151: two or three, the rest: one
    keys = spark.createDataFrame(rows, "node long, key long, slot short")
    often = spark.createDataFrame([(1, True)], "key long, heavy boolean")
    count = {}
    for _, k, _ in rows:
        count[k] = count.get(k, 0) + 1
    want = sorted((n, k) for n, k, _ in rows if count[k] > 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for chosen in (often, often.limit(0)):
            assert sorted((r.node, r.key) for r in neardup.several(keys, chosen).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cut_counts_capitals_as_letters():
    assert decontaminate.cut("ABC The Long passage, Here XY end", [1, 3]) == "ABC  passage, Here XY end"
    assert decontaminate.cut("ALL CAPS", [0, 2]) == ""
