"""URLs as Column expressions, and pagination."""

from __future__ import annotations

import re
from urllib.parse import parse_qs, urlencode, urlparse, urlunparse

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

PAGE_KEYS = "page|p|pg|paged|pagenum|start|offset"
_PAGE_KEY = re.compile(rf"(?:{PAGE_KEYS})", re.I)
_PAGE_TAIL = re.compile(r"(?P<stem>/page?/?)(?P<n>\d+)(?P<end>/?)\Z", re.I)
_NEXT = re.compile(r"\s*(?:next(?:\s*page)?|[›»→]|(?:load\s*)?more)\s*", re.I)
PAGE_TAIL_SQL = r"(?i)(/page?/?)(\d+)(/?)$"


def authority(url: Column) -> Column:
    """Host with port and user, lower-cased; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1), F.lit("")))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def normalize(url: Column) -> Column:
    """Without fragment; scheme and authority in lower case."""
    bare = F.regexp_replace(url, r"#.*$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def same_domain(a: Column, b: Column) -> Column:
    return authority(a) == authority(b)


def is_valid(url: Column) -> Column:
    return scheme(url).isin("http", "https")


def cache_key(url: Column) -> Column:
    return F.concat(F.lit("v1:"), F.sha2(url, 256))


def base(url: Column) -> Column:
    """Scheme and authority."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def inc_path(url: Column, page: Column) -> Column:
    """The url with its trailing page number, if it is ``page``, raised by one; else null."""
    path = F.regexp_extract(url, r"^([^?#]*)", 1)
    n = F.regexp_extract(path, PAGE_TAIL_SQL, 2)
    stem = F.regexp_extract(path, r"(?i)^(.*/page?/?)\d+/?$", 1)
    rest = F.substr(url, F.length(path) + 1)
    done = F.concat(stem, (page + 1).cast("string"), F.regexp_extract(path, PAGE_TAIL_SQL, 3), rest)
    return F.when((n != "") & (n.try_cast("decimal(38,0)") == page), done)


def inc_simple_param(url: Column, page: Column) -> Column:
    """The url whose ``page=`` parameter, if it is ``page``, is raised by one; else null. For plain queries without escapes."""
    n = F.regexp_extract(url, r"[?&]page=(\d+)(?:&|#|$)", 1)
    before = F.regexp_extract(url, r"^(.*[?&]page=)\d+", 1)
    after = F.regexp_extract(url, r"[?&]page=\d+(.*)$", 1)
    return F.when((n != "") & (n.try_cast("decimal(38,0)") == page), F.concat(before, (page + 1).cast("string"), after))


def detect_pagination(links: Column, base_url: Column) -> Column:
    """Links on the base's authority that end in a page path or carry a non-blank page parameter."""
    param = rf"(?i)[?&](?:{PAGE_KEYS})=[^&#]"
    return F.filter(links, lambda u: (authority(u) == authority(base_url)) & (u.rlike(r"(?i)/page?/?\d+/?$") | F.regexp_extract(u, r"^([^#]*)", 1).rlike(param)))


# exact forms, with the standard library's own parsing and encoding


def raise_param(url: str, page: int) -> str | None:
    parts = urlparse(url)
    fields = parse_qs(parts.query, keep_blank_values=True)
    for key, values in fields.items():
        if _PAGE_KEY.fullmatch(key):
            try:
                hit = int(values[0]) == page
            except ValueError:
                continue
            if hit:
                first = {k: v[0] for k, v in fields.items()} | {key: str(page + 1)}
                return urlunparse(parts._replace(query=urlencode(first)))
    return None


def raise_path(url: str, page: int) -> str | None:
    parts = urlparse(url)
    m = _PAGE_TAIL.search(parts.path)
    if m is None or int(m["n"]) != page:
        return None
    return urlunparse(parts._replace(path=f"{parts.path[: m.start()]}{m['stem']}{page + 1}{m['end']}"))


def next_page(url: str, links: list[str] | None, page: int) -> str | None:
    """A link whose fragment says next; else the raised parameter; else the raised path."""
    for link in links or ():
        mark = urlparse(link).fragment
        if mark and _NEXT.fullmatch(mark):
            return link
    return raise_param(url, page) or raise_path(url, page)


def page_urls(url: str, pages: int) -> list[str]:
    """The urls of pages 2 to ``pages``, up to where no number can be raised."""
    out: list[str] = []
    for n in range(1, pages):
        nxt = raise_param(url, n) or raise_path(url, n)
        if not nxt or nxt in out:
            break
        out.append(nxt)
        url = nxt
    return out


@F.arrow_udf(StringType())
def next_page_url(url: pa.Array, links: pa.Array, page: pa.Array) -> pa.Array:
    return pa.array([None if u is None else next_page(u, x, n) for u, x, n in zip(url.to_pylist(), links.to_pylist(), page.to_pylist())], pa.string())


@F.arrow_udf(StringType())
def inc_query_param(url: pa.Array, page: pa.Array) -> pa.Array:
    return pa.array([None if u is None else raise_param(u, n) for u, n in zip(url.to_pylist(), page.to_pylist())], pa.string())


@F.arrow_udf(ArrayType(StringType()))
def build_page_urls(url: pa.Array, pages: pa.Array) -> pa.Array:
    return pa.array([None if u is None else page_urls(u, n) for u, n in zip(url.to_pylist(), pages.to_pylist())], pa.list_(pa.string()))
