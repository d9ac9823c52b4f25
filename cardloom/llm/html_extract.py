"""Main-text extraction from HTML by tree scoring.

A tolerant tokenizer builds a light tree of elements and text. Every paragraph-like block passes points for its
length and commas to its ancestors, less with each level; a container's points are discounted by its link
density, and its tag, class and id count for or against it. If the best container lies in an article, that article is
kept whole, else the main element around it; if in neither, the container itself. Beside it, level by level up to the main element
or else the body, blocks and bare text of any kind and length are kept unless most of their text is links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
inside the kept part are left out; all other blocks are kept, in page order, however short they are.

Parsing and choosing take time linear in the page. Defined results: null and empty html, and pages without any text,
give an empty text; unclosed, crossed and cut tags are repaired as a browser would, roughly; a drawing, canvas or object
that is never closed hides nothing; repeated rows are each extracted; an empty table gives no rows; the output column
replaces one of its name, others pass through.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cardloom.llm.common import arrow_map, column, read

#: A comment, declaration or tag. A quote opens a value only right after the equals sign, as in browsers; loops are possessive, so that it stays linear.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))|=)*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:@][^\s=/>]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")

# Tag names of HTML, by their part in the page.
RAW = {"script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
#: Elements whose content isn't shown as text. Without a closing tag they are taken for empty; an HTML block ends a drawing.
UNSEEN = {"svg", "canvas", "object", "template", "noscript", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILER = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "input", "label", "fieldset", "legend", "head"}
CLOSES_P = BLOCK - {"html", "head", "body"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A new element of the first kinds closes the outermost open one of the second, unless one of the third stands between.
IMPLIED = (
    (CLOSES_P, {"p"}, {"td", "th", "caption", "button", "table"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu", "dir"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr", "tbody", "thead", "tfoot"}, {"tr", "td", "th"}, {"table"}),
    ({"td", "th"}, {"td", "th"}, {"tr", "table"}),
    ({"option"}, {"option"}, {"select"}),
)
#: What an end tag inside one of these can't close beyond it, but for the end tags of tables.
SCOPING = {"td", "th", "caption", "table", "button", "object", "template"}
TABLE_ENDS = {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "html", "body", "object", "template", "button"}

# Words of classes and ids. A name marks a block as something beside the article if it is one of ALONE or LAST, ends in one of LAST,
# or begins with one of FIRST (or of ALONE) and has only PLAIN words after; so that "side-effects", "contact-lens" or "related-work" do not.
ALONE = set("ad ads advert advertisement advertising adsense adslot banner breadcrumb breadcrumbs comments commentlist cookie cookies consent disqus disclaimer footer gdpr masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications outbrain pagination pager popup promo promos promotion replies respond rss share sharing shoutbox sidebar signup social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar widget widgets".split())
LAST = set("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments footer masthead menu modal nav navbar navigation newsletter pagination popup responses sidebar signup toolbar topbar widget widgets".split())
FIRST = set("comment related contact feedback header site skip tag tags reply".split())
PLAIN = set("area bar bars block blocks body bottom box button buttons container content footer form group header holder icons inner item items left link links list main nav outer overlay page panel posts articles stories primary right secondary section slot text top us wrap wrapper".split())
GOOD_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|hentry|main|page|post|story|text|blog)(?:$|[\s_-])", re.I)
KEPT_NAME = re.compile(r"(?:^|[_-])(?:article|entry|post|story)[-_](?:body|content|text)$", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BAD_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "status", "toolbar"}


def beside_name(name: str) -> bool:
    """Whether one class or id stands for something beside the article."""
    parts = [x for x in re.split(r"[-_:]+", CAMEL.sub("-", name).lower()) if x]
    if not parts or KEPT_NAME.search(name):
        return False
    if len(parts) == 1:
        return parts[0] in ALONE
    return parts[-1] in LAST or ((parts[0] in ALONE or parts[0] in FIRST) and all(x in PLAIN or x in ALONE or x.isdigit() for x in parts[1:]))


class Node:
    __slots__ = ("tag", "kids", "parent", "bad", "name", "main", "score", "chars", "links", "inside", "opened", "shut")

    def __init__(self, tag: str, parent: Node | None, bad: bool = False, name: str = "", main: bool = False):
        self.tag, self.kids, self.parent, self.bad, self.name, self.main = tag, [], parent, bad, name, main
        self.score, self.chars, self.links = 0.0, 0, 0
        self.inside = False  # an article or the main element, or in one
        # tags that are open within the nearest scoping element, with their number; and for each rule of IMPLIED the element that it would close
        self.opened: dict[str, int] = {} if parent is None or tag in SCOPING else parent.opened
        shut = (None,) * len(IMPLIED) if parent is None else parent.shut
        if any(tag in kinds or tag in stops for _, kinds, stops in IMPLIED):
            shut = tuple((None if tag in stops else x) or (self if tag in kinds else None) for x, (_, kinds, stops) in zip(shut, IMPLIED, strict=True))
        self.shut = shut


def _boilerplate(tag: str, attrs: str) -> tuple[bool, str, bool]:
    """Whether tag and attributes mark an element as something beside the article; its class and id; whether it is the main element."""
    if not attrs.strip(" /"):
        return tag in BOILER, "", tag == "main"
    found = {}
    for k, v in ATTR.findall(attrs):
        found.setdefault(k.lower(), html.unescape(v.strip("\"'")) if v else "")
    name = f"{found.get('class', '')} {found.get('id', '')}"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
    names = [] if tag in ("html", "body", "article", "main") else name.split()
    marked = any(map(beside_name, names)) and not any(map(KEPT_NAME.search, names))
    return bool(tag in BOILER or hidden or marked or found.get("role", "").lower() in BAD_ROLE), name, tag == "main" or found.get("role", "").lower() == "main"


def parse(page: str) -> Node:
    """A tree of elements, text and None for the end of a block; in time linear in the page."""
    root = Node("#root", None)
    at, pos, n = root, 0, len(page)
    open_tags: dict[str, int] = {}
    last_end = {m[1].lower(): m.start() for m in re.finditer(r"</([a-zA-Z][^\s/>]*)", page)}  # where each tag is closed last
    drawings = 0

    def close_to(node: Node, stop: Node) -> Node:
        nonlocal drawings
        while node is not stop:
            open_tags[node.tag] -= 1
            node.parent.opened[node.tag] -= 1
            drawings -= node.tag == "svg"
            node = node.parent
        return node

    while pos < n:
        m = TOKEN.search(page, pos)
        if m is None:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags.get(tag, 0) > 0 and (tag in TABLE_ENDS or at.opened.get(tag, 0) > 0):
                node = at
                while node.tag != tag:
                    node = node.parent
                at = close_to(at, node.parent)
            elif tag in ("p", "br"):
                at.kids.append(None if tag == "p" else " ")
            continue
        if tag in RAW:  # a slash at its end doesn't close it
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos) if last_end.get(tag, -1) >= pos else None
            pos = end.end() if end else n
            continue
        if tag == "br" or tag == "wbr":
            if tag == "br":
                at.kids.append(" ")
            continue
        if tag in UNSEEN and (last_end.get(tag, -1) < pos or m[3].endswith("/")):
            continue
        if drawings and tag in BLOCK:  # ends the drawings around it
            node = at
            while drawings:
                while node.tag != "svg":
                    node = node.parent
                at = node = close_to(at, node.parent)
        for (opens, _, _), shut in zip(IMPLIED, at.shut, strict=True):
            if shut is not None and tag in opens:
                at = close_to(at, shut.parent)
                break
        if tag in VOID:
            if tag in BLOCK:
                at.kids.append(None)
            continue
        bad, name, main = _boilerplate(tag, m[3])
        node = Node(tag, at, bad or tag in UNSEEN, name, main)
        at.kids.append(node)
        at.opened[tag] = at.opened.get(tag, 0) + 1
        at = node
        open_tags[tag] = open_tags.get(tag, 0) + 1
        drawings += tag == "svg"
    return root


def _around(node: Node) -> tuple[Node | None, Node | None]:
    """The outermost article and the outermost main element that node is or lies in."""
    article = main = None
    while node:
        if node.tag == "article":
            article = node
        if node.main:
            main = node
        node = node.parent
    return article, main


def _measure(root: Node) -> list[Node]:
    """All elements in page order; chars and links (characters of text, and of it in links) are set on each."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.inside = node.tag == "article" or node.main or bool(node.parent and node.parent.inside)
        for k in reversed(node.kids):
            if isinstance(k, Node):
                # a header in the article may hold its title; elsewhere it is the site's
                k.bad = k.bad or node.bad or (k.tag == "header" and not (node.inside and any(isinstance(x, Node) and x.tag in HEADINGS for x in k.kids)))
                stack.append(k)
    for node in reversed(order):
        if not node.bad:
            own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
            node.chars += own
            if node.tag == "a":
                node.links = node.chars
            if node.parent:
                node.parent.chars += node.chars
                node.parent.links += node.links
    return order


def _weight(node: Node) -> float:
    # What tag and name add to a container's points.
    points = {"article": 40.0, "main": 30.0, "section": 3.0, "div": 3.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "address": -3.0, "th": -5.0}.get(node.tag, 0.0)
    return points + (15.0 if node.name and GOOD_NAME.search(node.name) else 0.0)


def _own_text(node: Node) -> str:
    """The text of a block with its inline elements, but not of blocks inside it."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k is not None and not k.bad and k.tag not in BLOCK:
            stack.extend(reversed(k.kids))
    return "".join(out)


def choose(root: Node) -> list:
    """The best container, or the article or main element around it, and what is kept with it, in page order."""
    order = _measure(root)
    for node in order:
        if node.bad or node.tag not in BLOCK or node.tag in HEADINGS:
            continue
        text = _own_text(node).strip()
        if not text:
            continue
        points = 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)
        up, share = node if node.tag not in ("p", "li", "dd", "dt", "td", "pre", "blockquote") else node.parent, 1.0
        while up is not None and share > 0.05:
            up.score += points * share
            up, share = up.parent, share * 0.5
    best, top = None, 0.0
    for node in order:
        if node.bad or node.tag in ("#root", "html", "p", "li", "tr") or (node.tag not in BLOCK):
            continue
        if node.score <= 0:
            node.score = 0.0
            if node.tag not in ("article", "main") or not node.chars:
                continue
        node.score = (node.score + _weight(node)) * (1 - node.links / max(node.chars, 1))
        if node.score > top:
            best, top = node, node.score
    if best is None:
        return [root]
    if best.parent is None:
        return [best]
    article, main = _around(best)
    whole = article or main or best
    before, after = [], []  # what is kept beside, level by level
    # up to the main element, or, without it, to the body: an article may be spread over containers at any depth
    while whole.parent is not None and whole is not main and whole.tag not in ("body", "html"):
        left, right = _beside(whole)
        before.append(left)
        after.append(right)
        whole = whole.parent
    return [x for part in reversed(before) for x in part] + [article or main or best] + [x for part in after for x in part]


def _beside(node: Node) -> tuple[list, list]:
    """What stands before node and after it and isn't mostly links; inline runs count as one."""
    sides: tuple[list, list] = ([], [])
    out, run = sides[0], []

    def end() -> None:
        chars = sum(len(k.strip()) if isinstance(k, str) else k.chars for k in run)
        if chars and sum(k.links for k in run if isinstance(k, Node)) < 0.5 * chars:
            out.extend(run)
        run.clear()

    for k in node.parent.kids:
        if isinstance(k, str) or (k is not None and k is not node and k.tag not in BLOCK and not k.bad):
            run.append(k)
            continue
        end()
        if k is node:
            out = sides[1]
        elif k is None:
            out.append(k)
        elif not k.bad and k.links < 0.5 * k.chars:
            out.append(k)
    end()
    return sides


def blocks(nodes: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            run.append(k)
        elif k is None:
            end()
        elif k.bad:
            if k.tag in BLOCK:
                end()
        elif k.tag in BLOCK or k.tag == "#root":
            end()
            stack.append(None)
            stack.extend(reversed(k.kids))
        else:
            stack.extend(reversed(k.kids))
    end()
    return out


def extract(page: str | None) -> str:
    return "\n".join(blocks(choose(parse(page)))) if page else ""


def extract_text(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages plus the main text."""

    def run(batch: pa.RecordBatch) -> list:
        return [pa.array(map(extract, column(batch, html_col)), pa.string())]

    return arrow_map(pages, [T.StructField(out_col, T.StringType())], run, rows=256)


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.selectExpr("page_id", "url", "text", "cast(char_length(text) as bigint) as n_chars")
