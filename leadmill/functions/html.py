"""Markup and bytes of pages. Reading markup is the one place where rows go through Python, in Arrow batches.

A page is cut into tokens by one pattern and read once, in a single pass that gives its text, title, links
and icons together; ``page`` is that struct, and the other functions are its fields.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# Tags whose text isn't shown, and tags that break lines.
HIDDEN = frozenset("script style noscript svg head template".split())
BLOCKS = frozenset("p div br li tr td th section article h1 h2 h3 h4 h5 h6 blockquote pre hr".split())

#: Comments; raw elements with all that they hold; tags with any number of attributes; broken markup at the end; text.
#: A quote opens a value only behind "=", and only if it is closed somewhere; else the tag ends at its first ">".
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)
      | <(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<given>(?:[^>=]++|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)(?P<end>>|\Z)
      | <[!?/][^>]*>
      | <[a-z/!?][^>]*\Z
      | (?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: References that lead to no page.
NO_PAGE = ("#", "javascript:", "mailto:", "tel:")


def attributes(given: str) -> dict[str, str]:
    """Names and values of a tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(given):
        out.setdefault(name.lower(), entities.unescape("".join(values)).strip())
    return out


def read(markup: str) -> tuple[str, str, list[str], list[str]]:
    """Text, title, link references and icon references of a page, as they stand in it."""
    shown: list[str] = []
    title: list[str] = []
    links: list[str] = []
    touch: list[str] = []
    icons: list[str] = []
    depth, in_title = 0, False
    for token in TOKEN.finditer(markup):
        text, tag = token["text"], (token["tag"] or "").lower()
        if text is not None:
            plain = entities.unescape(text)
            if in_title:
                title.append(plain)
            if not depth:
                shown.append(plain)
        if not tag or not token["end"]:  # a tag that never ends is none
            continue
        closes, alone = bool(token["close"]), token["given"].endswith("/")
        if tag in BLOCKS:
            shown.append("\n")
        if tag == "title":
            in_title = not closes
        if tag in HIDDEN and not alone:
            depth = max(0, depth - 1) if closes else depth + 1
        if closes or tag not in ("a", "link", "meta"):
            continue
        given = attributes(token["given"])
        href = given.get("href")
        if tag == "a" and href:
            links.append(href)
        elif tag == "link" and href and "icon" in given.get("rel", "").lower():
            (touch if "apple-touch" in href.lower() else icons).append(href)
        elif tag == "meta" and given.get("property", "").lower() == "og:image" and given.get("content"):
            icons.append(given["content"])
    lines = filter(None, map(str.strip, "".join(shown).splitlines()))
    return "\n".join(lines), " ".join("".join(title).split()), links, [*reversed(touch), *icons, "favicon.ico"]


def addresses(base: str, references: list[str]) -> list[str]:
    """The web addresses that references of a page lead to, without fragments, each once, in order."""

    def resolved(reference: str) -> str:
        try:
            return urljoin(base, reference).partition("#")[0]
        except ValueError:  # no address
            return ""

    return [x for x in dict.fromkeys(map(resolved, references)) if re.match("https?://", x)]


_LIST = ArrayType(StringType())


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("title", StringType()), StructField("links", _LIST), StructField("icons", _LIST)]))
def _page(markup: pd.Series, base: pd.Series) -> pd.DataFrame:
    rows = []
    for source, at in zip(markup, base, strict=True):
        text, title, links, icons = read(source or "")
        rows.append((text, title, addresses(at or "", [x for x in links if not x.startswith(NO_PAGE)]), addresses(at or "", icons)))
    return pd.DataFrame(rows, columns=["text", "title", "links", "icons"])


def page(html: Column, base: Column) -> Column:
    """struct(text, title, links, icons) of a page at an address, read once however many fields are used.

    Text has a trimmed line per block; links are absolute, distinct and in order; icons are apple-touch ones, the last
    first, then other icons and share images, then the fixed place. Null markup is an empty page.
    """
    return _page(html, base)


def html_to_text(html: Column, most: int = 2_000_000) -> Column:
    """Visible text, one trimmed line per block, cut to ``most`` characters."""
    return F.substring(page(html, F.lit(""))["text"], 1, most)


def html_title(html: Column) -> Column:
    return page(html, F.lit(""))["title"]


def html_links(html: Column, base: Column, most: int = 60) -> Column:
    """Absolute addresses of the links, distinct in order, the first ``most``."""
    return F.slice(page(html, base)["links"], 1, most)


def html_icons(html: Column, base: Column) -> Column:
    """Icon candidates in the order of ``page``."""
    return page(html, base)["icons"]


def _text_of(body: bytes, charset: str) -> str | None:
    try:
        return body.decode(charset)
    except (UnicodeDecodeError, LookupError, ValueError):
        return None


@F.pandas_udf(StringType())
def _decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    out = []
    for raw, declared in zip(body, charset, strict=True):
        data = bytes(raw or b"")
        tried = (_text_of(data, c) for c in (declared or "utf-8", "utf-8", "gb18030"))
        out.append(next((t for t in tried if t is not None), data.decode("utf-8", "replace")))
    return pd.Series(out, dtype=object)


def decode_bytes(body: Column, charset: Column) -> Column:
    """Text of a body: the declared charset, UTF-8, GB18030, else UTF-8 with replacements."""
    return _decoded(body, charset)
