"""Books as tables: EPUB archives to elements.

One row for each element; a book is parsed once, in the task that reads it.
Paragraphs that aren't closed contain what follows them, as tolerant HTML parsers
have it; text of scripts, styles, templates and ruby annotations isn't text of
the element around it.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import book_slug
from ..operators.structure import ELEMENT_TAGS
from ..schemas import ELEMENTS

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style template rt rp".split())
_MARKUP = "application/xhtml+xml"


class _Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        stack = list(reversed([c for c in self.children if isinstance(c, _Node)]))
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed([c for c in node.children if isinstance(c, _Node)]))

    def text(self) -> str:
        out: list[str] = []
        stack: list[_Node | str] = [self]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                out.append(item)
            elif item is self or item.tag not in _SILENT:
                stack.extend(reversed(item.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].children.append(_Node(tag, dict(attrs)))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_markup(markup: str) -> _Node:
    tree = _Tree()
    tree.feed(markup)
    tree.close()
    return tree.root


def markup_elements(markup: str) -> Iterator[tuple[str, int | None, int, str | None, str | None]]:
    """kind, section, ordinal, tag and raw text of a document's headings and paragraphs: those below its body, then those of each chapter section."""
    root = parse_markup(markup)
    body = next((n for n in root.walk() if n.tag == "body"), None)
    if body:
        for k, node in enumerate(n for n in body.walk() if n.tag in ELEMENT_TAGS):
            yield "body", None, k, node.tag, node.text()
    sections = [n for n in root.walk() if n.tag == "section" and n.attrs.get("epub:type") == "chapter"]
    for s, section in enumerate(sections):
        yield "section", s, -1, None, None
        for k, node in enumerate(n for n in section.walk() if n.tag in ELEMENT_TAGS):
            yield "section", s, k, node.tag, node.text()


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def book_documents(archive: bytes) -> Iterator[tuple[int | None, int, str]]:
    """Place in the spine (None: not in it), place in the manifest and markup of each of a book's documents but its navigation."""
    with zipfile.ZipFile(io.BytesIO(archive)) as book:
        container = ElementTree.fromstring(book.read("META-INF/container.xml"))
        package = next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")
        opf = ElementTree.fromstring(book.read(package))
        items = [e for e in opf.iter() if _local(e.tag) == "item"]
        spine = [e.get("idref") for e in opf.iter() if _local(e.tag) == "itemref"]
        names = set(book.namelist())
        for place, item in enumerate(items):
            if item.get("media-type") != _MARKUP or "nav" in (item.get("properties") or "").split():
                continue
            path = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(item.get("href") or "")))
            if path in names:
                yield (spine.index(item.get("id")) if item.get("id") in spine else None), place, book.read(path).decode("utf-8-sig", "replace")


def book_elements(books: DataFrame) -> DataFrame:
    """books has book_id and content (an EPUB archive)."""
    columns = [f.name for f in ELEMENTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(ELEMENTS)
        for batch in batches:
            for book, content in zip(batch.column("book_id"), batch.column("content"), strict=True):
                rows = [
                    (book.as_py(), kind, spine, place, section, k, tag, text)
                    for spine, place, markup in book_documents(content.as_py())
                    for kind, section, k, tag, text in markup_elements(markup)
                    if kind == "body" or spine is not None
                ]
                yield pa.RecordBatch.from_pylist([dict(zip(columns, r, strict=True)) for r in rows], schema=schema)

    return books.select(F.col("book_id").cast("string"), "content").mapInArrow(run, ELEMENTS)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Elements of every EPUB below a path; a book's id is the slug of its file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path)
    return book_elements(files.select(book_slug("path").alias("book_id"), "content"))


def page_elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, el_idx, tag and raw_text of the headings and paragraphs below each page's body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(i, k, tag, text) for i, page in enumerate(part.column("__html").to_pylist()) for kind, _, k, tag, text in markup_elements(page or "") if kind == "body"]
                rows = list(zip(*found, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([part.column("__key").take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], names=["k", "el_idx", "tag", "raw_text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("__key"), F.col(html).alias("__html")).mapInArrow(run, f"k {kind}, el_idx int, tag string, raw_text string").withColumnRenamed("k", key)


def pack_book(title: str, documents: list[tuple[str, str]], navigation: str | None = None) -> bytes:
    """An EPUB archive of (name, markup) documents in reading order."""
    out = io.BytesIO()
    items = [f'<item id="d{i}" href="{n}" media-type="{_MARKUP}"/>' for i, (n, _) in enumerate(documents)]
    if navigation is not None:
        items.append(f'<item id="nav" href="nav.xhtml" media-type="{_MARKUP}" properties="nav"/>')
    spine = [f'<itemref idref="d{i}"/>' for i in range(len(documents))]
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("mimetype", "application/epub+zip")
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
        book.writestr("OPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>{"".join(items)}</manifest><spine>{"".join(spine)}</spine></package>')
        for name, markup in documents:
            book.writestr(f"OPS/{name}", markup)
        if navigation is not None:
            book.writestr("OPS/nav.xhtml", navigation)
    return out.getvalue()
