"""Captured pages as the blocks that staff extraction reads: cards, rows and lists, mail links, and the page's text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose text isn't shown, elements that stand on lines of their own, and elements without an end.
HIDDEN = frozenset(["script", "style", "noscript", "template", "head"])
LINES = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CARD = re.compile("staff|person|card")
PART = re.compile("staff|faculty|employee|person|card")
MESSAGE = re.compile(r"send\s+a?\s*message|contact\s+me|email\s+me|message\s+me", re.IGNORECASE)
#: An element of its kind ends these, if they are open just above it.
ENDS = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "p": ("p",)}


class Node:
    __slots__ = ("tag", "attrs", "up", "first", "last")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None, first: int) -> None:
        self.tag, self.attrs, self.up, self.first, self.last = tag, attrs, up, first, first


class Page(HTMLParser):
    """Texts in order, and elements with the range of texts that they hold."""

    def __init__(self) -> None:
        super().__init__()
        self.texts: list[str] = []
        self.nodes: list[Node] = []
        self.at = Node("", {}, None, 0)
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.at.tag in ENDS.get(tag, ()):
            self.leave(self.at)
            if tag == "tr" and self.at.tag == "tr":
                self.leave(self.at)
        if tag in LINES:
            self.texts.append("\n")
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, len(self.texts))
        self.nodes.append(node)
        if tag in VOID:
            return
        self.at = node
        self.hidden += tag in HIDDEN

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is None:
            return
        while self.at is not node:
            self.leave(self.at)
        self.leave(node)

    def leave(self, node: Node) -> None:
        self.hidden -= node.tag in HIDDEN
        if node.tag in ("td", "th"):
            self.texts.append("\t")
        if node.tag in LINES:
            self.texts.append("\n")
        node.last = len(self.texts)
        self.at = node.up

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.texts.append(re.sub(r"\s+", " ", data))

    def text(self, first: int, last: int) -> str:
        lines = (re.sub(r" *\t *", "\t", re.sub(" +", " ", x)).strip() for x in "".join(self.texts[first:last]).split("\n"))
        return "\n".join(x for x in lines if x)


def blocks_of(html: str | None) -> list[dict]:
    """``pos``, ``kind``, ``lines``, ``emails``, ``cfemail``, ``link`` of each block of a page."""
    page = Page()
    page.feed(html or "")
    page.close()
    while page.at.up is not None:
        page.leave(page.at)
    out: list[dict] = []
    style = lambda n: n.attrs.get("class", "")

    def block(kind: str, node: Node, lines: list[str]) -> dict:
        inside = page.nodes[order[id(node)] : ends(node)]
        links = [n for n in inside if n.tag == "a" and "href" in n.attrs]
        mails = [n.attrs["href"].removeprefix("mailto:") for n in links if n.attrs["href"].startswith("mailto:")]
        codes = [n.attrs["data-cfemail"] for n in inside if "data-cfemail" in n.attrs]
        link = next((n.attrs["href"] for n in links if MESSAGE.search(page.text(n.first, n.last))), None)
        return {"kind": kind, "lines": lines, "emails": mails, "cfemail": codes[0] if codes else None, "link": link}

    order = {id(n): i for i, n in enumerate(page.nodes)}

    def ends(node: Node) -> int:
        i = order[id(node)] + 1
        while i < len(page.nodes) and page.nodes[i].first < node.last:
            i += 1
        return i

    for n in page.nodes:
        if "name" in style(n) and n.up is not None and n.up.up is not None:
            below = page.nodes[order[id(n.up)] + 1 : ends(n.up)]
            title = next((x for x in below if "title" in style(x)), None)
            if title is not None:
                card = n.up
                while card.up is not None and not CARD.search(style(card)):
                    card = card.up
                card = card if card.up is not None else n.up
                out.append(block("card", card, [page.text(n.first, n.last).replace("\n", " "), page.text(title.first, title.last).replace("\n", " ")]))
    for n in page.nodes:
        if n.tag in ("tr", "li") or PART.search(style(n)):
            lines = page.text(n.first, n.last).split("\n")
            if lines != [""]:
                out.append(block("block", n, lines))
    for n in page.nodes:
        if n.tag == "a" and n.attrs.get("href", "").startswith("mailto:"):
            around = n.up
            while around.up is not None and around.tag not in ("tr", "li", "div", "p"):
                around = around.up
            around = around if around.up is not None else n.up
            out.append({"kind": "mailto", "lines": page.text(around.first, max(around.last, n.last)).split("\n"), "emails": [n.attrs["href"].removeprefix("mailto:")], "cfemail": None, "link": None})
    whole = page.text(0, len(page.texts))
    if whole:
        out.append({"kind": "body", "lines": whole.split("\n"), "emails": [], "cfemail": None, "link": None})
    return [{"pos": i, **b} for i, b in enumerate(out)]


BLOCK = "array<struct<pos:int,kind:string,lines:array<string>,emails:array<string>,cfemail:string,link:string>>"


def pieces(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (``page_id``, ``url``, ``html``) of up to ``most`` bytes of pages, and a page at least."""
    size, first = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist(), 0
    held = 0
    for i, n in enumerate(size):
        if i > first and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < len(size):
        yield batch.slice(first)


def page_blocks(pages: DataFrame) -> DataFrame:
    """The blocks of ``pages`` (``page_id``, ``url``, ``html``) as :func:`quillon.operators.crawl.extract_staff` reads them."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("lines", pa.list_(pa.string())), ("emails", pa.list_(pa.string())), ("cfemail", pa.string()), ("link", pa.string())]))

    def run(batches):
        # A page's blocks are several times its text, so they are given on by a few pages.
        for whole in batches:
            for b in pieces(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([blocks_of(x.as_py()) for x in b.column(2)], kind)], ["page_id", "evidence_url", "b"])

    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"page_id long, evidence_url string, b {BLOCK}")
    return found.select("page_id", "evidence_url", F.explode("b").alias("b")).select("page_id", "evidence_url", "b.*")
