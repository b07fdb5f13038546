"""Markup from SQL: table functions for LATERAL use, registered by register().

    SELECT page_id, x.* FROM pages, LATERAL html_blocks(html) x
    SELECT page_id, x.* FROM pages, LATERAL nav_toc(html, 'text/page.xhtml') x

Spark takes no Arrow table functions on the right of a lateral join, so these are plain
ones; the rows are those of markup.html_blocks and markup.nav_toc.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folio.functions import chars as C
from folio.functions.text import HEADING_HAN, HEADING_LATIN, HEADING_MATTER
from folio.sources.markup import Node, blocks_of, nav_entries, parsed

#: The same pattern as the columns use, with code points spelt as characters.
HEADING = re.compile("|".join(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), p).replace("(?i)", "(?i:", 1) + (")" if p.startswith("(?i)") else "") for p in (HEADING_HAN, HEADING_MATTER, HEADING_LATIN)))


def is_heading(text: str) -> bool:
    t = text.strip(C.WS_CHARS)
    return 1 <= len(t) <= C.MAX_HEADING and HEADING.match(t) is not None


def percent_decoded(text: str) -> str:
    """The text as it was where its escapes are not UTF-8."""
    try:
        return unquote_to_bytes(text).decode("utf-8")
    except UnicodeDecodeError:
        return text


def resolved(base: str, rel: str) -> str:
    """`rel`, without a leading slash, seen from the folder `base`."""
    rel = rel.removeprefix("/")
    if not rel:
        return ""
    out = base.split("/") if base else []
    for step in rel.split("/"):
        if step == "..":
            del out[-1:]
        elif step not in ("", "."):
            out.append(step)
    return "/".join(out)


class HtmlBlocks:
    def eval(self, markup: str) -> Iterator[tuple]:
        root = parsed(markup or "")
        found: list[tuple[str, str, Node]] = []
        for body in root.find("body")[:1] or [root]:
            blocks_of(body, found)
        for b, (k, t, _) in enumerate(found):
            yield b, ("h" if is_heading(t) else "p") if k == "?" else k, t


class NavToc:
    def eval(self, markup: str, path: str) -> Iterator[tuple]:
        base = (path or "").rpartition("/")[0]
        for ti, (href, label, lv) in enumerate(nav_entries(parsed(markup or ""))):
            target, _, fragment = href.partition("#")
            if place := resolved(base, percent_decoded(target)):
                yield ti, place, percent_decoded(fragment), label, lv


def register(spark: SparkSession) -> None:
    spark.udtf.register("html_blocks", udtf(HtmlBlocks, returnType="b int, k string, t string"))
    spark.udtf.register("nav_toc", udtf(NavToc, returnType="ti int, path string, frag string, label string, lv int"))
