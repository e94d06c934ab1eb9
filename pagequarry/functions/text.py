"""Text as Column expressions: tokens, white space, tag stripping, shingles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP_WORDS = tuple("i a an as at be by he in is it of on or so to we and are but for she the was you from that they this with".split())
MIN_TOKEN = 2
MAX_STRIP_BYTES = 10 << 20
SHINGLE_WORDS = 8

#: Unicode white space as Python's str methods see it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def tokens(text: Column, min_len: int = MIN_TOKEN) -> Column:
    """Lower-case ASCII words of at least ``min_len`` letters or digits that are no stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= min_len) & ~t.isin(*STOP_WORDS))


def query_tokens(query: str, min_len: int = MIN_TOKEN) -> list[str]:
    """The same for one string on the driver."""
    return [t for t in re.findall("[a-z0-9]+", query.lower()) if len(t) >= min_len and t not in STOP_WORDS]


def clean_text(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def strip_html(html: Column, max_bytes: int = MAX_STRIP_BYTES) -> Column:
    """Tags become spaces; scripts' text stays. Input counts up to ``max_bytes``, whatever expression it is."""
    head = F.rtrim(F.make_valid_utf8(F.substring(html.cast("binary"), 1, max_bytes).cast("string")), F.lit("\ufffd"))
    cut = F.when(F.octet_length(html) > max_bytes, head).otherwise(html)
    bare = F.regexp_replace(F.regexp_replace(cut, "<[^>]+>", " "), r"\s+", " ")
    return F.regexp_replace(bare, r"^[ \x00]+|[ \x00]+$", "")


def words(text: Column) -> Column:
    """Lower-case words between white space."""
    body = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _EDGE, "")
    return F.filter(F.split(body, SPACE), lambda w: w != "")


def shingle_at(word_list: Column, i: Column, n: int = SHINGLE_WORDS) -> Column:
    return F.concat_ws(" ", F.slice(word_list, i + 1, n))


def shingle_hashes(word_list: Column, n: int = SHINGLE_WORDS) -> Column:
    """Sorted distinct 64-bit hashes of the n-word windows; a shorter text is one window, a blank one has none.

    ``word_list`` should be a column, as it is used twice: an expression would be repeated.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size(word_list) - n, F.lit(0)))
    all_ = F.array_sort(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice(word_list, i + 1, n)))))
    return F.when(F.size(word_list) > 0, all_).otherwise(F.array().cast("array<bigint>"))


def fingerprint(shingle: Column) -> Column:
    """The low 64 bits of a shingle's SHA-1, in hex."""
    return F.substring(F.sha1(shingle), -16, 16)


def chunks(word_list: Column, size: int = 256) -> Column:
    """Windows of ``size`` words at half-size strides, full strides only; a blank text is one empty chunk."""
    last = F.greatest(F.size(word_list) - size, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last, F.lit(size // 2)), lambda i: F.concat_ws(" ", F.slice(word_list, i + 1, size)))
