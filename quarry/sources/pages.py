"""Stored web pages -> paper rows and link lists.

Regex extraction over the ``pages(page_id, url, html)`` table; fetching is
not built. Comments, scripts and styles are removed first (a script may hold
"</p>" in a string), then the title is the <h1>, the block is the <article>,
the abstract is the block's 2nd paragraph (paragraphs are often unclosed, so
the block is split on opening tags), and the document link is the block's
first href.
"""

from __future__ import annotations

import html
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import explode_values, let, strip_crlf, url_second_last_segment

# Extraction patterns.
COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?s)<script[^>]*>.*?</script>"
STYLE = r"(?s)<style[^>]*>.*?</style>"
TITLE = r"(?s)<h1[^>]*>(.*?)</h1>"
BLOCK = r"(?s)<article[^>]*>(.*?)</article>"
PARA_OPEN = r"<p(?:\s[^>]*)?>"
PARA_REST = r"(?s)</p>.*$"
TAG = r"<[^>]+>"
HREF = r'href="([^"]*)"'
EDGE_SPACE = r"^[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+$"
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
MAX_CODE_POINT = 0x10FFFF
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"


def clean_html(c) -> Column:
    h = F.col(c) if isinstance(c, str) else c
    for pat in (COMMENT, SCRIPT, STYLE):
        h = F.regexp_replace(h, pat, "")
    return h


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference; numbers past any code point count as the first of them."""
    base16 = F.regexp_extract(ref, "^&#[xX]0*([0-9a-fA-F]+)", 1)
    base10 = F.regexp_extract(ref, "^&#0*([0-9]+)", 1)
    number = F.coalesce(F.when(ref.rlike("^&#[xX]"), F.when(F.length(base16) <= 8, F.conv(base16, 16, 10).try_cast("long")))
                        .otherwise(F.when(F.length(base10) <= 9, base10.try_cast("long"))), F.lit(MAX_CODE_POINT + 1))

    def char(n: Column) -> Column:
        return (F.when(n < 0xA0, F.get(F.array(*map(F.lit, _low_characters())), n.cast("int")))
                .when((n > MAX_CODE_POINT) | n.between(0xD800, 0xDFFF), "\ufffd")
                .when(n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
    return let(number, char)


def _named(ref: Column) -> Column:
    """The characters of a named reference; without its semicolon, the longest old name it begins with."""
    name = F.substr(ref, F.lit(2))
    pairs = "\x02".join(f"{k}\x01{v}" for k, v in html5.items())
    known = F.str_to_map(F.lit(pairs), F.lit("\x02"), F.lit("\x01"))       # one constant
    short = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
    rest = let(F.regexp_extract(ref, f"^&({short})", 1), lambda old: F.when(
        old != "", F.concat(F.try_element_at(known, old), F.substr(name, F.length(old) + 1))).otherwise(ref))
    return F.coalesce(F.try_element_at(known, name), rest)


@lru_cache(maxsize=1)
def _low_characters() -> list[str]:
    """What references to the numbers below 0xA0 mean (controls are read as Windows-1252)."""
    return [html.unescape(f"&#{n};") for n in range(0xA0)]


def unescape(c) -> Column:
    """Every named and numeric HTML character reference, once, each match on its own."""
    def decoded(ref: Column) -> Column:
        return F.when(F.startswith(ref, F.lit("&#")), _numbered(ref)).otherwise(_named(ref))

    def whole(text: Column) -> Column:
        between, refs = F.split(text, REFERENCE, -1), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
        return F.when(~text.contains("&"), text).otherwise(F.array_join(F.zip_with(
            between, refs, lambda s, r: F.concat(s, F.coalesce(decoded(r), F.lit("")))), ""))
    return let(F.col(c) if isinstance(c, str) else c, whole)


def text_of(c: Column) -> Column:
    """Drop tags, decode all character references, CRLF -> space."""
    return strip_crlf(unescape(F.regexp_replace(c, TAG, "")))


def strip_text(c: Column) -> Column:
    """Python-style strip (all Unicode whitespace at both ends)."""
    return F.regexp_replace(c, EDGE_SPACE, "")


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, abstract, webpage_url, document_url)."""
    h = clean_html("html")
    block = F.regexp_extract(h, BLOCK, 1)
    para = F.get(F.split(block, PARA_OPEN), 2)
    abstract = text_of(F.regexp_replace(para, PARA_REST, ""))
    link = F.nullif(F.regexp_extract(block, HREF, 1), F.lit(""))
    origin = F.regexp_extract(F.col("url"), ORIGIN, 1)
    return pages.select(
        "page_id",
        strip_text(text_of(F.regexp_extract(h, TITLE, 1))).alias("title"),
        abstract.alias("abstract"),
        F.concat(origin, F.lit("/"), F.col("page_id").cast("string"), F.lit("/")).alias("webpage_url"),
        link.alias("document_url"),
    )


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, target_id) for every link, 0-based pos."""
    hrefs = F.regexp_extract_all(clean_html("html"), F.lit(HREF), 1)
    links = explode_values(pages, hrefs, "href", keep=["page_id"], pos="pos")
    return links.select("page_id", "pos", "href", url_second_last_segment("href").alias("target_id"))
