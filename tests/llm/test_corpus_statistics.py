"""Token alignment, source divergence and secrets against plain versions, on odd rows; nested personal data, used folders, equal rows."""

import collections
import hashlib
import random
import re
import time

import duckdb
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cardloom.llm import align, chat, divergence, neardup, pii, secrets, shards
from cardloom.llm.common import new_path

DIR = "/root/testdata/sf0.001"


def plain_alignment(rows):
    """The contract of the alignment by its words, token by token."""
    bpe = Tokenizer.from_file(align.VOCABULARY_A)
    bpe.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=align.MODEL_B)
    byte = {c: b for b, c in align.byte_characters().items()}
    count, out = collections.Counter(), []
    for key, text in rows:
        groups = []
        if text:
            a = bpe.encode(" " + text, add_special_tokens=False)
            b = sp.encode(text)
            sa = [bytes(byte[c] for c in t) for t in a.tokens]
            sb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(sa) == b"".join(sb) == (" " + text).encode():
                i = j = x = y = 0
                ga, gb = [], []
                while i < len(sa) or j < len(sb):
                    if x <= y:
                        x, i = x + len(sa[i]), i + 1
                        ga.append(a.ids[i - 1])
                    else:
                        y, j = y + len(sb[j]), j + 1
                        gb.append(b[j - 1])
                    if x == y:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = collections.Counter((p, q) for ga, gb in groups for p in ga for q in gb)
        count.update(set(links))
        out.append((key, groups, links))
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    told = []
    for key, groups, links in out:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        told.append((key, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(links.values()), sum(m for p, m in links.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(told, key=str)


ODD_TEXTS = [None, "", " ", "  two  spaces ", "a▁b", "▁", "<s> <|endoftext|> <unk> </s>", "日本語のテキスト", "é😀\x00\t\n\r\x1c x", "x² 1⁄2 ½ Ⅷ", "١٢٣ ǅ ꞌ 𞤀", "don't we'll I'd 'S", "same text", "same text", "word " * 3000, "a" * 5000, "0123456789" * 50, " \n \n  x", "ﬁ ﬂ ﷺ", " \u0085​", "tab\tand  　wide"]


def test_alignment_of_odd_texts(spark, monkeypatch):
    rows = [(i % 17, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "same text")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, a string, row int")
    want = plain_alignment(rows)
    for run in (align.RUN, 3):
        got = sorted((tuple(r) for r in align.weigh(docs.repartition(3), run=run).collect()), key=str)
        assert got == want
    monkeypatch.setattr(align, "SLICE_CHARS", 40)  # long texts in parts
    a, b = align.sides(align.VOCABULARY_A, align.MODEL_B)[:2]
    for t in ("one two three four five " * 20, "a1 b2 c d e f ggg hhh " * 9, "no" * 99):
        assert len(list(align.parts(" " + t))) > ("no" not in t) and align.tokens(t, a, b) == (a.bpe.encode(" " + t, add_special_tokens=False).ids, b.sp.encode(t))
    assert align.weigh(docs.limit(0)).count() == 0


def test_alignment_of_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in align.op11_token_alignment(spark, DIR).collect()), key=str)
    assert got == plain_alignment([tuple(r) for r in docs.collect()])


def test_links_in_blocks():
    import numpy as np

    rng = np.random.default_rng(3)
    sa, sb = rng.integers(1, 6, 50), rng.integers(1, 6, 50)
    a, b = rng.integers(0, 9, sa.sum()), rng.integers(0, 9, sb.sum())
    want = collections.Counter()
    i = j = 0
    for m, n in zip(sa, sb, strict=True):
        want.update((int(x), int(y)) for x in a[i : i + m] for y in b[j : j + n])
        i, j = i + m, j + n
    for at_once in (1, 7, 1 << 22):
        p, c = align.linked(a, b, sa, sb, at_once)
        assert {(int(x) >> 32, int(x) & 0xFFFFFFFF): int(k) for x, k in zip(p, c, strict=True)} == want


WORDS = "alpha beta gamma delta Épsilon zeta eta theta iota kappa".split()


@pytest.mark.parametrize("broadcast", [divergence.BROADCAST_SOURCES, 0])
def test_divergence_against_sql(spark, broadcast):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for _ in range(120)]
    rows += [("xx", "only", "a b c"), ("xx", "none", None), ("yy", "one", "word word"), ("en", "empty", ""), ("en", "digits", "1 2 [3]"), ("zz", "a", "q q"), ("zz", "a", "Q r"), ("zz", "b", "q"), ("en", "s1", "ALPHA É é " * 4000)]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "lang string, source string, text string, n int, term string")
    c = duckdb.connect()
    c.execute("create table documents(lang varchar, source varchar, text varchar)")
    c.executemany("insert into documents values (?, ?, ?)", rows)
    cols = "lang, source, part, item, value, rank"
    got = sorted(tuple(r) for r in divergence.divergence(docs.repartition(4), broadcast_sources=broadcast).selectExpr(*cols.split(", ")).collect())
    assert got == sorted(c.execute(f"select {cols} from ({divergence.ORACLE})").fetchall()) and len(got) > 100
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_divergence_keeps_the_best_only(spark):
    docs = spark.createDataFrame([("en", f"s{i % 2}", " ".join("abcdefgh"[: i % 8 + 1])) for i in range(64)], "lang string, source string, text string")
    got = divergence.divergence(docs, top=2).where("part = 'term'").groupBy("source").count().collect()
    assert got and all(r["count"] <= 2 for r in got)


def test_terms_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_CHARS", 7)
    text = "one twotwo threethreethree é ñandú 4 five"
    assert [w for s in divergence.slices(text) for w in divergence.TERM.findall(s)] == divergence.TERM.findall(text)


def plain_base(text):
    """Base spans by the contract's own patterns."""
    out = [(m.start(), m.end(), 0, "assign") for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), 1, "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2, "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def digest_of(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, _, k in spans).encode()).hexdigest()


def random_text(rng):
    bits = ["password", "PASSWD", "secret", "token", "Api_Key", "apikey", "ſecret", "toKen", ":", "=", " ", '"', "'", "é😀", "AKIA", "AKIA" + "Q7" * 8, "0a" * 12, "abcdef", "x", "=", "z9_", "\n", "deadbeef" * 3]
    return "".join(rng.choices(bits, k=rng.randint(0, 40)))


def test_base_secrets(spark):
    rng = random.Random(11)
    rows = [(i, random_text(rng)) for i in range(400)] + [(400, None), (401, ""), (402, "token" + " " * 100_000), (403, "AKIA" * 50_000 + " " + "f" * 300_000), (404, "password=" * 30_000)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", "en", "z") for i, t in rows], "doc_id long, text string, source string, lang string, kind string")
    got = {r.doc_id: r for r in secrets.digest(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want = plain_base(t or "")
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == (*(sum(x[2] == k for x in want) for k in range(3)), digest_of(want)), t
        spans = [x.split(":") for x in got[i].spans.split(",") if x]
        assert {(int(s), int(e), k) for k, s, e in spans} >= {(s, e, k) for s, e, _, k in want}
        assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans)


def test_ownership_tells_secrets_from_examples(spark):
    rng = random.Random(2)
    value = lambda n: "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=n)) + "7aB3cD"
    own, copied, forked = value(30), value(30), value(30)
    rows = [(1, f"run with {own} now", "o1", "a"), (2, f"again {own}", "o1", "b"), (3, "nothing here", "o2", "a"), (4, "ghp_" + value(20), None, None), (5, "https://u:hunter22xyzK@h/p", "o9", "a"), (6, "pwd = your_password_example1", "o9", "a")]
    rows += [(100 + i, f"see {copied} there", f"o{i}", "a") for i in range(40)]  # an example that many owners have
    rows += [(200 + i, f"see {forked} there", f"p{i % 2}", f"r{i}") for i in range(40)]  # two owners, very many repositories
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    for hot in (secrets.HOT, 2, 10**6):  # common hashes broadcast, or none, or all
        got = {r.doc_id: r.spans for r in secrets.digest(docs, hot=hot).collect()}
        assert got[1] == f"random:9:{9 + len(own)}" and got[2] == f"random:6:{6 + len(own)}" and got[3] == "" == got[6]
        assert got[4].startswith("prefixed:0:") and got[5] == "url:10:22"
        assert {got[k] for k in got if k >= 100} == {""}
    alone = secrets.findings(docs.where("doc_id < 3")).orderBy("key").first()["spans"][0]
    assert (alone.n_owners, alone.n_repos, alone.live, alone.base) == (1, 2, True, False)
    assert secrets.digest(docs.limit(0)).count() == 0


def test_nested_personal_data(spark):
    texts = [f"write to {'-'.join(['10.1.1.1'] * n)}-john.doe@example.com please" for n in (1, 2, 9, 12, 1000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.text for r in pii.redact(d).orderBy("doc_id").collect()] == ["write to [EMAIL] please"] * len(texts)


def test_nothing_left_after_redaction(spark):
    rng = random.Random(8)
    bits = ["a.b@c.de", "10.1.1.1", "-", ".", "+49 (0) 170 1234567", "4111 1111 1111 1111", " ", "x", "+", "@", "9", "1.2.3.4.5"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 60))) for _ in range(300)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [(int(s), int(e)) for _, s, e in (x.split(":") for x in r.spans.split(",") if x)] for r in pii.digest(d).collect()}
    for r in pii.redact(d).collect():
        cut, at = [], 0
        for s, e in sorted(spans[r.doc_id]):  # what lies outside all spans is what may stay
            if s >= at:
                cut.append(texts[r.doc_id][at:s])
            at = max(at, e)
        cut.append(texts[r.doc_id][at:])
        assert re.sub(r"\[[A-Z]+\]", "", r.text) == "".join(cut)


def test_used_folder(spark):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(40)], "doc_id long, text string")
    path = new_path(spark, "corpus")
    first = {r.doc_id: r for r in shards.write_shards(docs, path, seq_len=8, shard_rows=4).collect()}
    with pytest.raises(FileExistsError):
        shards.write_shards(docs.where("doc_id > 3"), path, seq_len=8, shard_rows=4)
    bpe = shards.tokenizer(shards.VOCABULARY)
    for i, r in first.items():
        assert shards.read_document(path, r.first_seq, r.start, r.n_tokens)[:-1].tobytes() == bpe.encode(f"text number {i}")


def test_shards_of_a_dead_run_go(spark):
    from pyarrow import fs

    path = new_path(spark, "corpus")
    store, folder = fs.FileSystem.from_uri(path)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/shard-dead-00000000.bin") as f:
        f.write(b"old")
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = shards.write_shards(docs, path, seq_len=4, shard_rows=4).first()
    assert len(shards.read_document(path, r.first_seq, r.start, r.n_tokens)) == r.n_tokens
    assert not [f for f in store.get_file_info(fs.FileSelector(folder)) if "dead" in f.base_name]


def test_equal_rows_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    near = " ".join([*words[:399], "other"])
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").union(spark.createDataFrame([(2, near)], "doc_id long, text string"))
    many = docs.withColumn("k", __import__("pyspark.sql.functions", fromlist=["x"]).expr("explode(sequence(1, 3000))")).drop("k")
    began = time.time()
    got = neardup.link_documents(many).groupBy("doc_id", "component_id", "kept").count().orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, True, 3000), (2, 1, False, 3000)] and time.time() - began < 90


def test_many_equal_turns(spark):
    rows = [(1, None, "assistant" if i % 3 else "user", f"t{i % 5}") for i in range(16_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    r = chat.digest(d).first()
    assert r.n_turns == 16_000 and r.loss_chars == sum(2 for x in rows if x[2] == "assistant") and time.time() - began < 30


def test_articles_spread_over_containers():
    from cardloom.llm.html_extract import extract

    body = "<body><div><div><div><p>Alpha one, two.</p></div></div><div><div><p>Beta words.</p></div></div></div><div><p>Delta.</p></div><div><a href=x>one</a> <a href=y>two</a></div></body>"
    assert extract(body) == "Alpha one, two.\nBeta words.\nDelta."
    long = "Long words, many. " * 200
    assert extract(f"<div><div><p>{long}</p></div></div><div><p>Short end.</p></div>") == f"{long.strip()}\nShort end."
    for name in ("ad-slot", "user-comment", "reader-responses"):
        assert extract(f"<div><p>Text, of it.</p><div class={name}><p>Not this, no.</p></div></div>") == "Text, of it."
