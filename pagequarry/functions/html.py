"""HTML to typed columns: a tolerant tree on html.parser, walked once for each page."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from html.entities import html5
from html.parser import HTMLParser
from itertools import chain
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.shingles import pieces
from pagequarry.schemas import PARSED, STRUCTURED, StructType

NOISE = frozenset("aside button footer form header iframe img nav noscript script style svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: What an opening tag ends, and where the search for it stops.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_TABLE_ENDS = frozenset("body html table tbody td tfoot th thead tr".split())
_HIDDEN = frozenset(("script", "style", "template"))
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                yield n
            elif n is self or n.tag not in _HIDDEN:
                todo += reversed(n.children)

    def joined(self) -> str:
        """All strings, stripped, without separator."""
        return "".join(s.strip() for s in self.strings())

    def only_string(self) -> str | None:
        if len(self.children) != 1:
            return None
        c = self.children[0]
        return c if isinstance(c, str) else c.only_string()

    def above(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags: set[str], stop: set[str]) -> None:
        n, last = self.at, None
        while n.parent is not None and n.tag not in stop:
            if n.tag in tags:
                last = n
            n = n.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and (have := self.root.find(tag)):
            for k, v in attrs:
                have.attrs.setdefault(k, v or "")
            return
        if tag in _BLOCK:
            self._close({"p"}, {"td", "th", "li", "table", "body", "button", "div", "section", "article"} if tag != "p" else {"td", "th", "table", "body", "button"})
        if tag in _ENDS:
            self._close(*_ENDS[tag])
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Node(tag, own, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and not (n.tag in ("table", "td", "th") and tag not in _TABLE_ENDS):
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent
        if tag == "p":  # an end without a beginning stands for an empty paragraph
            self.at.children.append(Node("p", {}, self.at))

    def handle_data(self, data: str) -> None:
        kids = self.at.children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


#: A reference by name as the reference's parser reads it: a name it doesn't know or that no semicolon ends stays as text.
_REFERENCE = re.compile(r"&([A-Za-z_:][\w:.-]*);?")


class _Literal(_Builder):
    """Reads html in which ``mark`` stands for each & that begins no reference."""

    def __init__(self, mark: str) -> None:
        super().__init__()
        self.mark = mark

    def _back(self, s: str | None) -> str | None:
        return s and s.replace(self.mark, "&")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(self._back(tag), [(self._back(k), self._back(v)) for k, v in attrs])

    def handle_endtag(self, tag: str) -> None:
        super().handle_endtag(self._back(tag))

    def handle_data(self, data: str) -> None:
        super().handle_data(self._back(data))


def _builder(html: str) -> tuple[_Builder, str]:
    if all(m[0][1:] in html5 and m[0][-1] == ";" for m in _REFERENCE.finditer(html)):
        return _Builder(), html
    mark = next((c for c in map(chr, chain(range(0xFDD0, 0xFDF0), range(0xE000, 0xF900))) if c not in html), None)
    if mark is None:
        return _Builder(), html
    return _Literal(mark), _REFERENCE.sub(lambda m: m[0] if m[0][-1] == ";" and m[0][1:] in html5 else mark + m[0][1:], html)


def tree(html: str) -> Node:
    b, html = _builder(html)
    b.feed(html)
    b.close()
    return b.root


def _without_noise(root: Node) -> None:
    todo = [root]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c.tag not in NOISE]
        todo += [c for c in n.children if isinstance(c, Node)]


def title(root: Node) -> str | None:
    t = root.find("title")
    if t is not None and (s := t.only_string()):
        return s.strip()
    og = next((n for n in root.walk() if n.tag == "meta" and n.attrs.get("property") == "og:title"), None)
    if og is not None and og.attrs.get("content"):
        return og.attrs["content"].strip()
    h1 = root.find("h1")
    return None if h1 is None else h1.joined()


_MAIN = (
    lambda n: n.tag == "main",
    lambda n: n.tag == "article",
    lambda n: n.attrs.get("role") == "main",
    lambda n: n.attrs.get("id") == "content",
    lambda n: "content" in n.attrs.get("class", "").split(),
)


def main_text(root: Node) -> str:
    """Text of the first kind of main container that occurs, else of the whole page."""
    box = next((n for test in _MAIN for n in root.walk() if test(n)), root)
    return _SPACE.sub(" ", " ".join(box.strings())).strip()


def links(root: Node, url: str) -> list[str]:
    out: dict[str, None] = {}
    for n in root.walk():
        if n.tag != "a" or "href" not in n.attrs:
            continue
        href = n.attrs["href"].strip()
        if href and not href.startswith(("#", "mailto:", "javascript:")):
            try:
                target = urljoin(url, href)
                ok = urlparse(target).scheme in ("http", "https")
            except ValueError:
                continue
            if ok:
                out.setdefault(target)
    return list(out)


def meta(root: Node) -> dict[str, str]:
    out = {}
    for n in root.walk():
        if n.tag == "meta":
            key = n.attrs.get("name") or n.attrs.get("property") or n.attrs.get("http-equiv")
            value = n.attrs.get("content", "").strip()
            if key and value:
                out[key.lower()] = value
    return out


def language(root: Node) -> str | None:
    n = root.find("html")
    lang = n.attrs.get("lang") if n is not None else None
    return lang.partition("-")[0].lower() if lang else None


def _prefixed(root: Node, attribute: str, prefix: str) -> dict[str, str]:
    out = {}
    for n in root.walk():
        name = n.attrs.get(attribute, "")
        if n.tag == "meta" and name.startswith(prefix):
            value = n.attrs.get("content", "").strip()
            if value and name != prefix:
                out[name[len(prefix) :]] = value
    return out


def json_ld(root: Node) -> list[str]:
    """Each JSON-LD object as JSON text; arrays are opened one level."""
    out = []
    for n in root.walk():
        if n.tag == "script" and n.attrs.get("type") == "application/ld+json" and (raw := n.only_string()):
            try:
                data = json.loads(raw.strip())
            except ValueError:
                continue
            out += [json.dumps(x, ensure_ascii=False) for x in (data if isinstance(data, list) else [data])]
    return out


def tables(root: Node) -> list[list[dict[str, str]]]:
    """Rows by header; rows that don't fit the header get numbered columns."""
    out = []
    for t in root.walk():
        if t.tag != "table":
            continue
        names: list[str] = []
        head = t.find("thead")
        if head is not None and (tr := head.find("tr")) is not None:
            names = [c.joined() for c in tr.walk() if c.tag in ("td", "th")]
        if not names and (tr := t.find("tr")) is not None:
            names = [c.joined() for c in tr.walk() if c.tag == "th"]
        rows = []
        for tr in (t.find("tbody") or t).walk():
            if tr.tag != "tr":
                continue
            cells = [c.joined() for c in tr.walk() if c.tag in ("td", "th")]
            if any(cells):
                fit = names and len(names) == len(cells)
                rows.append(dict(zip(names, cells)) if fit else {f"col_{i}": c for i, c in enumerate(cells)})
        if rows:
            out.append(rows)
    return out


def lists(root: Node) -> list[list[str]]:
    out = []
    for n in root.walk():
        if n.tag in ("ol", "ul") and not any(a.tag in ("aside", "footer", "header", "nav") for a in n.above()):
            items = [s for c in n.children if isinstance(c, Node) and c.tag == "li" and (s := c.joined())]
            if len(items) > 1:
                out.append(items)
    return out


def _link_of(root: Node, *kinds: str) -> str | None:
    for kind in kinds:
        for n in root.walk():
            rel = n.attrs.get("rel", "")
            if n.tag == "link" and (kind in rel.split() or kind == rel):
                if n.attrs.get("href"):
                    return n.attrs["href"].strip()
                break
    return None


def structured(root: Node) -> dict:
    return {
        "open_graph": _prefixed(root, "property", "og:"),
        "twitter_card": _prefixed(root, "name", "twitter:"),
        "json_ld": json_ld(root),
        "tables": tables(root),
        "lists": lists(root),
        "canonical": _link_of(root, "canonical"),
        "favicon": _link_of(root, "icon", "shortcut icon", "apple-touch-icon"),
    }


_EMPTY_STRUCTURE = {"open_graph": {}, "twitter_card": {}, "json_ld": [], "tables": [], "lists": [], "canonical": None, "favicon": None}


@contextmanager
def _unlinked(root: Node) -> Iterator[Node]:
    """Afterwards the elements don't know their parents, so they go at once and don't wait for the cycle collector."""
    nodes = list(root.walk())
    try:
        yield root
    finally:
        for n in nodes:
            n.parent = None


def parse_page(html: str | None, url: str | None, min_text: int = 0) -> dict:
    """All parsed columns of a page; empty for no html or too short a text."""
    none = {"title": None, "text": "", "links": [], "meta": {}, "language": None, "structured": None}
    if not html:
        return none
    with _unlinked(tree(html)) as root:
        found = structured(root)  # from the page as it is, noise included
        _without_noise(root)
        text = main_text(root)
        if min_text and len(text) < min_text:
            return none
        return {"title": title(root), "text": text, "links": links(root, url or ""), "meta": meta(root), "language": language(root), "structured": found}


def _pairs(x):
    """Dicts as lists of pairs where Arrow wants maps."""
    return list(x.items())


def _arrow_structure(s: dict | None) -> dict | None:
    if s is None:
        return None
    return s | {"open_graph": _pairs(s["open_graph"]), "twitter_card": _pairs(s["twitter_card"]), "tables": [[_pairs(r) for r in t] for t in s["tables"]]}


_TEXTS = pa.list_(pa.string())
_MAP = pa.map_(pa.string(), pa.string())
_ARROW_STRUCTURE = pa.struct([("open_graph", _MAP), ("twitter_card", _MAP), ("json_ld", _TEXTS), ("tables", pa.list_(pa.list_(_MAP))), ("lists", pa.list_(_TEXTS)), ("canonical", pa.string()), ("favicon", pa.string())])
_ARROW_PARSED = pa.struct([("title", pa.string()), ("text", pa.string()), ("links", _TEXTS), ("meta", _MAP), ("language", pa.string()), ("structured", _ARROW_STRUCTURE)])


def _structure_of(html: str | None) -> dict:
    if not html:
        return _arrow_structure(_EMPTY_STRUCTURE)
    with _unlinked(tree(html)) as root:
        return _arrow_structure(structured(root))


@F.arrow_udf(STRUCTURED)
def extract_structured(html: pa.Array) -> pa.Array:
    each = pieces([pa.RecordBatch.from_arrays([html], ["html"])], "html")
    return pa.concat_arrays([pa.array([], _ARROW_STRUCTURE), *(pa.array(map(_structure_of, b.column(0).to_pylist()), _ARROW_STRUCTURE) for b in each)])


def parsed_batches(batches: Iterator[pa.RecordBatch], rest: list[str], min_text_length: int) -> Iterator[pa.RecordBatch]:
    """The columns ``rest`` and the parsed ones, in pieces of about 1 MB of html, so memory doesn't grow with the rows of a batch."""
    for b in pieces(batches, "html"):
        rows = []
        for h, u in zip(b.column("html").to_pylist(), b.column("url").to_pylist()):
            p = parse_page(h, u, min_text_length)
            rows.append(p | {"meta": _pairs(p["meta"]), "structured": _arrow_structure(p["structured"])})
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *pa.array(rows, _ARROW_PARSED).flatten()], [*rest, *PARSED.names])


def parse(pages: DataFrame, min_text_length: int = 0) -> DataFrame:
    """The pages' other columns with title, text, links, meta, language and structured."""
    rest = [c for c in pages.columns if c != "html" and c not in PARSED.names]
    schema = StructType([*(pages.schema[c] for c in rest), *PARSED.fields])
    return pages.select(*rest, "html").mapInArrow(lambda batches: parsed_batches(batches, rest, min_text_length), schema)


def parse_many(pages: DataFrame, min_text_length: int = 0) -> DataFrame:
    """Pages without error, parsed; pages without text go. The native filter runs before the parser."""
    sound = pages.where(F.coalesce("error", F.lit("")) == "") if "error" in pages.columns else pages
    return parse(sound, min_text_length).where(F.length("text") > 0)


def extract_and_merge(pages: DataFrame) -> DataFrame:
    """``structured`` from html, or from text where html is missing or empty."""
    have = [F.when(F.col(c) != "", F.col(c)) for c in ("html", "text") if c in pages.columns]
    return pages.withColumn("structured", extract_structured(F.coalesce(*have, F.lit(""))))
