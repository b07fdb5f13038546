"""Scalar text functions: Column in, Column out, all inside code generation."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import chars as C

HEADING_HAN = f"^第[{C.WS}]*[{C.NUMERALS}]+[{C.WS}]*[{C.UNITS}]"
HEADING_LATIN = f"(?i)^(chapter|part|book|section)[{C.WS}]+([0-9]+|[ivxlcdm]+)(?![A-Za-z0-9_])"
HEADING_MATTER = f"^({'|'.join(C.MATTER)})$"


def text_of(c: Column) -> Column:
    """Missing counts as the empty text."""
    return F.coalesce(c, F.lit(""))


def once(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(C.WS_CHARS))


def normalize(c: Column) -> Column:
    """Byte order marks, NULs and zero-width characters go; line ends and spaces become one kind."""

    def changed(t: Column) -> Column:
        t = F.regexp_replace(F.replace(t, F.lit("\ufeff"), F.lit("")), r"\r\n?", "\n")
        t = F.regexp_replace(t, r"[\x{0}\x{200B}-\x{200D}\x{2060}]", "")
        return F.regexp_replace(F.translate(t, "\u00a0", " "), r"[ \t]+", " ")

    # one look tells most texts, which have nothing to change
    return once(text_of(c), lambda t: F.when(t.rlike(r"[\r\t\x{0}\x{A0}\x{200B}-\x{200D}\x{2060}\x{FEFF}]|  "), changed(t)).otherwise(t))


def clean_text(c: Column) -> Column:
    """Text taken out of markup: spaces and runs of line ends collapse, ends are trimmed."""
    c = F.translate(F.regexp_replace(text_of(c), r"\x{FEFF}", ""), "\u00a0", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\r]+", " "), r" *\n+ *", "\n")
    return trim(F.regexp_replace(c, r"\n{2,}", "\n"))


def clean_title(c: Column) -> Column:
    """The first line, trimmed, of MAX_TITLE characters at most."""
    return F.substring(trim(F.substring_index(text_of(c), "\n", 1)), 1, C.MAX_TITLE)


def looks_heading(c: Column) -> Column:
    return once(trim(text_of(c)), lambda t: F.char_length(t).between(1, C.MAX_HEADING) & t.rlike(f"{HEADING_HAN}|{HEADING_MATTER}|{HEADING_LATIN}"))


def _silent() -> str:
    """Runs of white space and of signs that a voice would read out, save single spaces; those signs inside words and numbers that stay are no part of one."""
    # most characters are told by a look at one table; the rest is decided by what is around them
    spoken = C.PLAIN + "$%&@"
    sign = rf"(?:(?<=['’-])(?:(?![{C.LATIN}])|(?<![{C.LATIN}].))|(?<=[.:,])(?:(?![0-9])|(?<![0-9].))|(?<=[^{C.LATIN}0-9{C.CJK}$%&@'’.:,-]))"
    more = rf"(?: |[^{spoken} ]{sign})"
    return rf"[^{spoken}](?:(?<= ){more}++|(?<! ){sign}{more}*+)"


_SILENT = _silent()


def strip_speech_punctuation(c: Column) -> Column:
    """Signs a voice would read out become spaces, and these one; those inside words and numbers stay."""
    return trim(F.regexp_replace(text_of(c), _SILENT, " "))


def script_weights(c: Column) -> tuple[Column, Column]:
    """Number of CJK and of Latin characters."""
    return F.regexp_count(c, F.lit(f"[{C.CJK}]")), F.regexp_count(c, F.lit(f"[{C.LATIN}]"))


def solid_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{C.CJK}{C.LATIN}0-9]"))


def radical_table() -> dict[str, str]:
    """Radical characters and the whole characters they stand for: the fixed ones, then what NFKC says."""
    found = {}
    for code in (*range(0x2E80, 0x2EF4), *range(0x2F00, 0x2FD6)):
        whole = unicodedata.normalize("NFKC", chr(code))
        if len(whole) == 1 and whole != chr(code):
            found[chr(code)] = whole
    return found | C.RADICALS


def fix_radicals(c: Column) -> Column:
    table = radical_table()
    return F.translate(text_of(c), "".join(table), "".join(table.values()))


def head_key(c: Column) -> Column:
    """What a running head has in common from page to page: numbers as #, no white space."""
    return F.regexp_replace(F.regexp_replace(text_of(c), "[0-9]+", "#"), f"[{C.WS}]+", "")


def lc_lang(c: Column) -> Column:
    return F.translate(F.lower(text_of(c)), "_", "-")


def norm_lang(c: Column) -> Column:
    """Language tags in their usual case: zh-Hant-TW, en-US."""

    def cased(p: Column, i: Column) -> Column:
        n = F.char_length(p)
        return F.when(i == 0, p).when(n == 4, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 3))).when(n.between(2, 3), F.upper(p)).otherwise(p)

    return F.array_join(F.transform(F.filter(F.split(lc_lang(c), "-"), lambda p: p != ""), cased), "-")


def format_of(name: Column) -> Column:
    n = F.lower(text_of(name))
    return F.when(n.endswith(".epub"), "epub").when(n.endswith(".pdf"), "pdf").otherwise("txt")


def base_name(name: Column, missing: str = "未命名") -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit(missing)), r"\.[^.]+$", "")


def bad_score(c: Column) -> Column:
    """How broken a decoded text looks: 3 per replacement character, 1 per control character."""
    return 3 * F.regexp_count(c, F.lit(r"\x{FFFD}")) + F.regexp_count(c, F.lit(r"[\x{00}-\x{08}\x{0E}-\x{1F}]"))


def percent_decoded(c: Column) -> Column:
    """Percent-decoded, or as it is where that is not possible."""
    decoded = F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    broken = F.contains(decoded, F.lit("\ufffd")) & ~F.contains(c, F.lit("\ufffd"))
    return F.when(decoded.isNull() | broken, c).otherwise(decoded)


def resolve_path(base: Column, rel: Column) -> Column:
    """`rel` (its fragment dropped) seen from the folder `base`; "" where there is nothing."""
    r = percent_decoded(F.substring_index(text_of(rel), "#", 1))
    r = F.regexp_replace(r, "^/", "")
    start = F.when(text_of(base) == "", F.array().cast("array<string>")).otherwise(F.split(base, "/"))
    step = lambda acc, seg: F.when(seg.isin("", "."), acc).when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, seg))
    return F.when(r == "", "").otherwise(F.array_join(F.aggregate(F.split(r, "/"), start, step), "/"))


def dir_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^[^/]*$", ""), "/[^/]*$", "")


def fragment_of(href: Column) -> Column:
    at = F.instr(href, "#")
    return F.when(at == 0, "").otherwise(percent_decoded(href.substr(at + 1, F.length(href))))


def pct(share: Column) -> Column:
    """Whole per cent, halves up, from 0 to 100."""
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.coalesce(share, F.lit(0.0)) * 100 + 0.5))).cast("int")


def size_label(n: Column) -> Column:
    """Bytes for people: KB, MB or GB; "" for none."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    big = F.when(n < gb, F.concat(F.format_string("%.1f", n / mb), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", n / gb), F.lit(" GB")))
    return F.when(n == 0, "").when(n < mb, F.concat(F.floor(n / kb + 0.5).cast("string"), F.lit(" KB"))).otherwise(big)


def date_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(""))


def falsy(c: Column, other: Column, zero) -> Column:
    """`c` unless it is missing or `zero` ("" or 0), else `other`."""
    return F.coalesce(F.nullif(c, F.lit(zero)), other)
