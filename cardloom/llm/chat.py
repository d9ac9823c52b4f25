"""Chat formatting with Spark expressions only.

The rows of a conversation are first gathered in blocks of `block` turns (so that sorting and formatting a long
conversation is spread over many tasks), then the formatted blocks are joined in order. Adjacent turns of one
role are merged into one block of the template; a separator keeps their boundary.

    <|start|>role<|text|>first text<|next|>second text<|end|>\\n

Beside the text stands the loss mask: the spans (code points, end exclusive) of it that assistants said, one for each
turn in order; lengths are summed within blocks and then over blocks, so that no text is measured from its beginning.

Inside roles and texts `&`, `<` and `[` are written as `&amp;`, `&lt;` and `&#91;`, so no control string, of this
template or of others with `<s>`, `[INST]` or `<|...|>`, can occur there; unescaping is exact.

Defined results: null texts and roles count as empty; null conv_id is a conversation of its own and null turns
come first; rows with the same turn are put in order of role and text, and repeated rows are all kept; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.common import chunks, piece, read
from cardloom.llm.rules import let

BLOCK = 256
START, TEXT, NEXT, END = "<|start|>", "<|text|>", "<|next|>", "<|end|>\n"


def escape(sql: str) -> str:
    return f"replace(replace(replace({sql}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"


def unescape(sql: str) -> str:
    return f"replace(replace(replace({sql}, '&#91;', '['), '&lt;', '<'), '&amp;', '&')"


def format_chats(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, formatted and loss (array of (s, e)) for each conversation of rows (conv_id, turn, role, text)."""
    turns = rows.selectExpr("conv_id", "turn", f"floor(turn / {block}) as part", "struct(turn, " + escape("coalesce(role, '')") + " as role, " + escape("coalesce(text, '')") + " as text) as t")
    # the first turn of a block is left without an opening: it depends on the block before
    opening = f"case when i = 0 then '' when t.role = ts[i - 1].role then '{NEXT}' else concat('{END}{START}', t.role, '{TEXT}') end"
    parts = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list("t")).alias("ts")).selectExpr(
        "conv_id", "part", "ts[0].role as first_role", "element_at(ts, -1).role as last_role",
        f"array_join(transform(ts, (t, i) -> concat({opening}, t.text)), '') as body",
        f"transform(ts, (t, i) -> struct(cast(char_length({opening}) as bigint) as o, cast(char_length(t.text) as bigint) as n, t.role = 'assistant' as said)) as ls",
    )
    # sums of lengths before turn i: within its 256 turns, and over the 256s before, so that a block of many equal turns stays cheap
    add = "0L, (a, x) -> a + x)"
    before = f"if(i < 256, 0L, aggregate(slice(bs, 1, i div 256), {add}) + if(i % 256 = 0, 0L, aggregate(slice(ws, 256 * (i div 256) + 1, i % 256), {add})"
    each = f"filter(transform(ls, (l, i) -> struct(l.said as said, {before} + l.o as s, l.n as n)), l -> l.said)"
    spans = let("ws", "transform(ls, l -> l.o + l.n)", let("bs", f"transform(sequence(0, cast((size(ws) - 1) div 256 as int)), k -> aggregate(slice(ws, 256 * k + 1, 256), {add})", each))
    parts = parts.selectExpr("conv_id", "part", "first_role", "last_role", "body", "aggregate(ls, 0L, (a, x) -> a + x.o + x.n) as size", f"{spans} as spans")
    whole = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "first_role", "last_role", "body", "size", "spans"))).alias("ps"))
    head = f"case when i > 0 and p.first_role = ps[i - 1].last_role then '{NEXT}' else concat(if(i = 0, '', '{END}'), '{START}', p.first_role, '{TEXT}') end"
    headed = whole.selectExpr("conv_id", f"transform(ps, (p, i) -> struct({head} as head, p.body as body, p.size as size, p.spans as spans)) as ps")
    at = "aggregate(slice(ps, 1, i), 0L, (a, x) -> a + char_length(x.head) + x.size) + char_length(p.head)"
    return headed.selectExpr(
        "conv_id", f"concat(array_join(transform(ps, p -> concat(p.head, p.body)), ''), '{END}') as formatted",
        f"flatten(transform(ps, (p, i) -> {let('at', at, 'transform(p.spans, x -> struct(at + x.s as s, at + x.s + x.n as e))')})) as loss",
    )


def read_back(chats: DataFrame) -> DataFrame:
    """chats plus turns, array of (role, text), parsed from `formatted` alone."""
    # every block is START role TEXT text [NEXT text ...]; split at END leaves an empty piece at the end
    blocks = f"transform(filter(split(formatted, '<\\\\|end\\\\|>\\\\n', -1), b -> b <> ''), b -> split(substr(b, {len(START) + 1}), '<\\\\|text\\\\|>', 2))"
    return chats.withColumn("turns", F.expr(f"flatten(transform({blocks}, b -> transform(split(b[1], '<\\\\|next\\\\|>', -1), x -> struct({unescape('b[0]')} as role, {unescape('x')} as text))))"))


def loss_texts(chats: DataFrame) -> DataFrame:
    """chats plus said: the texts under the loss mask, unescaped."""
    one = let("p", "x.s", let("q", "x.e", piece("p", "q")))
    return chats.withColumn("said", F.expr(let("ch", chunks("formatted"), f"transform(loss, x -> {unescape(one)})")))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's row for each conversation, read back from the formatted text and its mask."""
    return loss_texts(read_back(format_chats(rows))).selectExpr(
        "conv_id", "cast(size(turns) as bigint) as n_turns",
        "sha2(array_join(transform(turns, t -> concat(t.role, '\\n', t.text, '\\n')), ''), 256) as turns_sha256",
        "cast(char_length(array_join(said, '')) as bigint) as loss_chars", "sha2(array_join(said, ''), 256) as loss_sha256", "cast(char_length(formatted) as bigint) as formatted_chars",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) as conv_id", "cast(turn as bigint) as turn", "role", "text")
    extra = spark.sql("select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    return digest(rows.unionByName(extra))


ORACLE = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) as x(conv_id, turn, role, text)),
l as (select *, lag(role) over (partition by conv_id order by turn, role, text) is not distinct from role as same,
    length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as n, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) as r from t)
select cast(conv_id as bigint) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
    sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
    cast(sum(n + case when same then 8 else 25 + r end) as bigint) as formatted_chars
from l group by conv_id
"""
