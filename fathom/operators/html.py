"""HTML to text.

Flat pages take a chain of native expressions; pages with tables (which may nest) go through
one Arrow stage on the standard library's parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_space

#: Elements that are dropped with their content.
DROPPED = ("script", "style", "nav", "footer", "noscript")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# Entities that flat pages use, the ampersand last.
ENTITIES = {"&middot;": "·", "&copy;": "©", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&nbsp;": " ", "&#x27;": "'", "&amp;": "&"}


def strip_inline_xbrl(html: Column) -> Column:
    """Drop the inline-XBRL header with its content and every namespaced tag, keeping inner text."""
    out = F.regexp_replace(html, r"(?is)<ix:header[^>]*>.*?</ix:header>", "")
    return F.regexp_replace(out, r"</?[a-zA-Z][a-zA-Z0-9]*:[a-zA-Z][^>]*>", "")


def flat_text(html: Column) -> Column:
    """Text of a page without tables, in native expressions: every tag breaks the line."""
    out = F.regexp_replace(strip_inline_xbrl(html), r"(?is)<!--.*?-->", "")
    for tag in DROPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?is)<!doctype[^>]*>", ""), r"(?s)<[^>]*>", "\n")
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return normalize_space(out)


class _Tree(HTMLParser):
    """A small element tree: nodes are [tag, children]; children are strings or nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", []]
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node: list = [tag, []]
        self.open[-1][1].append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1][1].append(data)


def _texts(node: list | str) -> Iterator[str]:
    stack = [node]
    while stack:
        here = stack.pop()
        if isinstance(here, str):
            yield here
        elif here[0] not in DROPPED:
            stack.extend(reversed(here[1]))


def _find(node: list, tags: tuple[str, ...]) -> Iterator[list]:
    stack = [c for c in reversed(node[1]) if not isinstance(c, str)]
    while stack:
        here = stack.pop()
        if here[0] in tags:
            yield here
        stack.extend(c for c in reversed(here[1]) if not isinstance(c, str))


def _linearise(node: list) -> None:
    """Replace tables by lines of cells, innermost first."""
    order, stack = [], [node]
    while stack:
        here = stack.pop()
        order.append(here)
        stack.extend(c for c in here[1] if not isinstance(c, str))
    for parent in reversed(order):  # children before parents
        for i, child in enumerate(parent[1]):
            if isinstance(child, str) or child[0] != "table":
                continue
            lines = []
            for row in _find(child, ("tr",)):
                cells = [" ".join(t for t in (x.strip() for x in _texts(cell)) if t) for cell in _find(row, ("td", "th"))]
                line = " | ".join(c for c in cells if c.strip())
                if line:
                    lines.append(line)
            parent[1][i] = "\n" + "\n".join(lines) + "\n" if lines else ""


def page_text(html: str) -> str:
    """Text of one page: headers of inline XBRL and dropped elements go, tables become lines."""
    html = re.sub(r"<ix:header[^>]*>.*?</ix:header>", "", html, flags=re.I | re.S)
    tree = _Tree()
    tree.feed(re.sub(r"</?[a-zA-Z][a-zA-Z0-9]*:[a-zA-Z][^>]*>", "", html))
    tree.close()
    _linearise(tree.root)
    text = "\n".join(t for t in _texts(tree.root) if t)
    text = re.sub(r"[ \t]+", " ", re.sub(r"\r\n|\r", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def parse_pages(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, text and error: a page that can't be parsed gives a null text and its error, never a failure."""
    names = [*keep, html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for html in batch[html_col].to_pylist():
                try:
                    texts.append(None if html is None else page_text(html))
                    errors.append(None)
                except Exception as error:  # noqa: BLE001 - one bad page must not stop the job
                    texts.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keep), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[*keep, "text", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return df.select(*names).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "text string, error string"]))
