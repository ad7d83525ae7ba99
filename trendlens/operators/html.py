"""Article body extraction from raw HTML by ordered rules (first match wins).

Runs over Arrow batches of the ``pages`` table, a slice of pages at a time; the per-page
work is a stdlib ``html.parser`` pass that builds a lenient tree (an unclosed <p>
keeps later elements nested inside it, as a lenient tree builder does), then
the rules are evaluated on it. Spark partitions the pages; nothing is collected.
"""
from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_if_narrow

# Elements that never hold children.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
        "source", "track", "wbr"}

# Rule names in the reference's order; ``article_p`` is the test-profile rule for
# pages whose body is <article><p>...</p></article>.
DEFAULT_RULES = ("itemprop_body", "nyt_text", "mod_a_body", "story_body_text")
TEST_PROFILE_RULES = DEFAULT_RULES + ("article_p",)


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def text(self) -> str:
        out = []
        stack = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)

    def iter(self):
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, _Node):
                yield n
                stack.extend(reversed(n.children))


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("[document]", {}, None)
        self.cur = self.root

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs}, self.cur)
        self.cur.children.append(node)
        if tag not in VOID:
            self.cur = node

    def handle_startendtag(self, tag, attrs):
        self.cur.children.append(_Node(tag, {k: (v or "") for k, v in attrs}, self.cur))

    def handle_endtag(self, tag):
        n = self.cur
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.cur = n.parent

    def handle_data(self, data):
        self.cur.children.append(data)


def parse_html(html: str) -> _Node:
    b = _TreeBuilder()
    b.feed(html)
    b.close()
    for n in list(b.root.iter()):       # only the building needs parents; without them a
        n.parent = None                 # tree is freed as soon as it is read
    return b.root


def _rule(root: _Node, name: str) -> str | None:
    """Text for rule ``name`` or None when the rule does not match."""
    if name == "itemprop_body":
        ps = [n for n in root.iter() if n.tag == "p" and n.attrs.get("itemprop") == "articleBody"]
        return " ".join(p.text() for p in ps) if ps else None
    if name == "nyt_text":
        for n in root.iter():
            if n.tag == "nyt_text":
                return n.text()
        return None
    if name == "mod_a_body":
        first = after = None
        for n in root.iter():
            if n.tag == "div" and n.attrs.get("id") == "mod-a-body-first-para" and first is None:
                first = n
            if n.tag == "div" and n.attrs.get("id") == "mod-a-body-after-first-para" and after is None:
                after = n
        if first is None:
            return None
        return first.text() + (after.text() if after is not None else "")
    if name == "story_body_text":
        ps = [n for n in root.iter()
              if n.tag == "p" and "story-body-text" in n.attrs.get("class", "").split()]
        return " ".join(p.text() for p in ps) if ps else None
    if name == "article_p":
        ps = [p for a in root.iter() if a.tag == "article" for p in a.iter() if p.tag == "p"]
        return " ".join(p.text() for p in ps) if ps else None
    raise ValueError(f"unknown rule {name}")


def extract_one(html: str | None, rules=DEFAULT_RULES) -> tuple[str, str | None]:
    """(body, rule) — body '' and rule None when no rule matches."""
    if not html:
        return "", None
    root = parse_html(html)
    for name in rules:
        got = _rule(root, name)
        if got is not None:
            return got, name
    return "", None


SLICE_ROWS = 128               # pages that are Python strings at a time


def bodies_in(rules=DEFAULT_RULES):
    """(web_url, body, rule) of Arrow batches (web_url, html), a slice at a time."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = [extract_one(h.as_py(), rules) for h in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.string()) for c in zip(*got))], names=["web_url", "body", "rule"])
    return run


def extract_body(pages: DataFrame, rules=DEFAULT_RULES, url_col: str = "web_url") -> DataFrame:
    """(web_url, body, rule) for every page; body '' when no rule matches."""
    src = spread_if_narrow(pages.select(F.col(url_col).alias("web_url"), "html"))
    return src.select(F.col("web_url").cast("string"), "html").mapInArrow(bodies_in(rules), "web_url string, body string, rule string")
