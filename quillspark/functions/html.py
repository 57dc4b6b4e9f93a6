"""Documents from HTML, with the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ids, text
from .text import quality_level

# Fixed values.
DROPPED = frozenset("script style noscript template aside footer nav".split())
MARKERS = tuple("breadcrumb cookie consent footer header menu modal navigation popup sidebar social subscribe advert banner call-to-action cta marketing promotion quick-links whatsapp".split())
PUBLISHED_KEYS = ("article:published_time", "date", "publish-date", "datepublished")
DENSE_CHARS, DENSE_LINKS, DENSE_RATIO = 40, 3, 0.65

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("p div section article main header ul ol li table tr td th h1 h2 h3 h4 h5 h6 br blockquote pre form dl dt dd title".split())
CLOSES = {"p": frozenset("p div section article ul ol table h1 h2 h3 h4 h5 h6 blockquote pre form".split()), "li": frozenset(["li"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        """Text in document order; blocks stand on lines of their own."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            edge = "\n" if x.tag in BLOCKS else ""
            out.append(edge)
            todo.append(edge)
            todo.extend(reversed(x.children))
        lines = (re.sub(r"\s+", " ", line).strip() for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line)


class TreeBuilder(HTMLParser):
    """A forgiving tree: unknown ends are ignored, open elements close with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        last = self.open[-1].tag
        if tag in CLOSES.get(last, ()):
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < 500:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _is_boilerplate(node: Node) -> bool:
    if node.tag in DROPPED or node.attrs.get("aria-hidden", "").lower() == "true":
        return True
    if node.tag not in ("html", "body", "main", "article"):
        named = " ".join(node.attrs.get(k, "") for k in ("id", "class", "role")).lower()
        if any(m in named for m in MARKERS):
            return True
    if node.tag in ("div", "section", "ul", "ol"):
        text = node.text()
        if len(text) >= DENSE_CHARS:
            links = [n.text() for n in node.walk() if n.tag == "a"]
            return len(links) >= DENSE_LINKS and sum(map(len, links)) / len(text) >= DENSE_RATIO
    return False


def _prune(root: Node) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _is_boilerplate(c)]
        todo.extend(c for c in node.children if isinstance(c, Node))


def extract(html: str | None, url: str | None, default_title: str = "Untitled") -> dict:
    """title, body_text, links, metadata (sorted pairs, repeats allowed) and published (text) of a page."""
    parser = TreeBuilder()
    parser.feed(html or "")
    parser.close()
    root = parser.root
    meta = sorted((n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop"), n.attrs["content"]) for n in root.walk() if n.tag == "meta" and "content" in n.attrs and (n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("itemprop")))
    page_title = root.find("title")
    _prune(root)
    body = root.find("main") or root.find("article") or root.find("body") or root
    heading = next((n.text() for n in body.walk() if n.tag in ("h1", "h2")), "")
    links = []
    for n in body.walk():
        if n.tag == "a" and n.attrs.get("href"):
            try:
                link = urldefrag(urljoin(url or "", n.attrs["href"].strip()))[0]
                if urlparse(link).scheme in ("http", "https") and link not in links:
                    links.append(link)
            except ValueError:
                pass
    published = next((v for key in PUBLISHED_KEYS for k, v in meta if k.lower() == key and v.strip()), None)
    return {"title": heading or (page_title.text() if page_title else "") or default_title, "body_text": body.text(), "links": links, "metadata": [{"key": k, "value": v} for k, v in meta], "published": published}


FIELDS = "title string, body_text string, links array<string>, metadata array<struct<key:string,value:string>>, published string"


def html_documents(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", carry: tuple[Column, ...] = ()) -> DataFrame:
    """(key, title, body_text, links, metadata, published_at, quality, extraction_kind), then the named columns ``carry`` of
    the pages. Null pages are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"title": pa.string(), "body_text": pa.string(), "links": pa.list_(pa.string()), "metadata": pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])), "published": pa.string()}
        for b in batches:
            got = [extract(h, u) for u, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([g[n] for g in got], k) for n, k in kinds.items()), b.column(3)], ["key", *kinds, "carried"])

    narrow = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html"), F.struct(*(carry or (F.lit(None).cast("string").alias("none"),))).alias("carried"))
    out = narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, {FIELDS}, carried {narrow.schema['carried'].dataType.simpleString()}")
    found = [F.col("key").alias(key), "title", "body_text", "links", "metadata", F.try_to_timestamp("published").alias("published_at"), quality_level(F.length("body_text")).alias("quality"), F.lit("html").alias("extraction_kind")]
    return out.select(*found, *(["carried.*"] if carry else []))


def assembled(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", source: str = "source_id", parser_version: str = "1") -> DataFrame:
    """html_documents() as whole documents: with their identities, and with the dates, deadlines, events, calendar lines and
    category that their text names. Metadata go by key; a page that changes a byte is another document."""
    raw = F.sha2(F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")), 256)
    docs = html_documents(pages, key, url, html, (F.col(source).alias("source_id"), F.col(url).alias("canonical_url"), raw.alias("raw_hash")))
    body = F.col("body_text")
    named = {
        "id": ids.document_id(F.col("source_id"), F.col("canonical_url"), F.col("raw_hash"), F.lit(parser_version)),
        "evidence_id": ids.evidence_id(F.col("source_id"), F.col("raw_hash")),
        "source_relative_id": ids.source_relative_id(F.col("source_id"), F.col("canonical_url"), F.col("raw_hash")),
        "metadata": F.array_sort("metadata"), "dates": text.extract_dates(body), "deadlines": text.extract_deadlines(body), "events": text.extract_events(body),
        "calendar": text.calendar_lines(body), "notice_category": text.classify_notice(body, F.col("title")),
    }
    return docs.withColumns(named)
