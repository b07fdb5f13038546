"""Sentences, clauses and script runs of a text as arrays of structs (t, o): piece and offset.

One regular expression takes a text apart, piece by piece up to the next boundary, so the
whole of it stays inside the JVM and every character is allowed in texts; only texts that
mix scripts go through a Python function (lang_runs).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folio.functions import chars as C
from folio.functions.text import once, solid_count, strip_speech_punctuation, text_of, trim

PIECES = "array<struct<t:string,o:int>>"
RUNS = "array<struct<t:string,lang:string,o:int>>"

_CLOSERS = re.escape(C.CJK_CLOSE + "\"')]")
_FOLLOWS = rf"(?=\z|[{C.WS}\"'”’)\]{C.CJK}{C.CJK_PUNCT}])"
#: A full stop, then the look back at what is before it: the rare check comes last.
_STOP = rf"\.{_FOLLOWS}(?<!(?<![A-Za-z])(?i:[A-Z]|{'|'.join(C.ABBREVIATIONS)})\.)"
SENTENCE_END = rf"(?:[{C.CJK_END}]|[!?]{_FOLLOWS}|{_STOP})[{C.CJK_END}.!?{_CLOSERS}]*"
#: Pieces of a text longer than MAX_SENTENCE: up to the last mark in reach, else as long as may be.
HARD_CUT = rf"(?s)\G(?=.{{{C.MAX_SENTENCE + 1}}})(?:.{{{C.SHORTEST_CUT},{C.MAX_SENTENCE}}}[{C.HARD_MARKS}]|.{{{C.MAX_SENTENCE}}})"
_SOLID = f"{C.LATIN}0-9{C.CJK}"
#: A look at one table passes over most characters.
MARKED = rf"[^{C.all_but(',:;')}](?<=[{C.CLAUSE_MARKS}])"
HAS_CJK = rf"[^{C.all_but('')}](?<=[{C.CJK}])"
CLAUSE_CUT = rf"(?:[，、；：;]|(?<![0-9])[,:]|[,:](?![0-9]))[{C.WS}]*"


def cut_at(c: Column, pattern: str, marks: str) -> Column:
    """The pieces of a text, each up to and with the next match, and what is left; of the usual characters only `marks` begin a match."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)(?=.)(?:[{C.all_but(marks)}]++|(?!{pattern}).)*+(?:{pattern})?"), F.lit(0))


#: A fold copies what it has so far at each step; longer arrays are folded in parts.
FOLDED = 64


def folded_places(sizes: Column, first: Column) -> Column:
    """Where each of a few pieces of these sizes begins, if the first one does at `first`."""
    state = F.struct(F.array().cast("array<int>").alias("out"), first.cast("int").alias("at"))
    step = lambda s, n: F.struct(F.array_append(s["out"], s["at"]).alias("out"), (s["at"] + n).alias("at"))
    return F.aggregate(sizes, state, step, lambda s: s["out"])


def places(sizes: Column, first: Column) -> Column:
    """Where each of any number of pieces begins: places of parts of as many pieces as there are parts, then in each part."""

    def in_parts(xs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(xs))).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(xs) / size).cast("int") - 1), lambda j: F.slice(xs, j * size + 1, size))
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)
        return once(parts, lambda ps: once(folded_places(F.transform(ps, total), first), lambda at: F.flatten(F.transform(ps, lambda part, j: folded_places(part, F.get(at, j))))))

    return once(sizes, lambda xs: F.when(F.size(xs) <= FOLDED, folded_places(xs, first)).otherwise(in_parts(xs)))


def placed(pieces: Column, start: Column | None = None) -> Column:
    """Strings that follow each other, as (t, o)."""
    first = F.lit(0) if start is None else start
    begins = lambda ps: places(F.transform(ps, F.char_length), first)
    return once(pieces, lambda ps: once(begins(ps), lambda at: F.transform(ps, lambda t, i: F.struct(t.alias("t"), F.get(at, i).alias("o")))))


def blank(t: Column) -> Column:
    return ~t.rlike(f"[^{C.WS}]")


def hard_split(sentences: Column) -> Column:
    """Sentences longer than MAX_SENTENCE in pieces; a blank rest is dropped."""

    def without_blank_rest(parts: Column) -> Column:
        return F.when((F.size(parts) > 1) & blank(F.element_at(parts, -1)["t"]), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)

    one = lambda s: once(placed(F.regexp_extract_all(s["t"], F.lit(rf"{HARD_CUT}|.+\z"), F.lit(0)), s["o"]), without_blank_rest)
    long = lambda s: F.char_length(s["t"]) > C.MAX_SENTENCE
    return once(sentences, lambda x: F.when(F.exists(x, long), F.flatten(F.transform(x, lambda s: F.when(long(s), one(s)).otherwise(F.array(s))))).otherwise(x))


def merge_short(pieces: Column) -> Column:
    """A piece of under MIN_SENTENCE characters goes to the front of the next one; a last one stays."""
    short = lambda t: F.char_length(trim(t)) < C.MIN_SENTENCE
    none = F.lit(None).cast("struct<t:string,o:int>")
    state = F.struct(F.array().cast(PIECES).alias("out"), none.alias("held"))

    def step(s: Column, p: Column) -> Column:
        whole = F.when(s["held"].isNull(), p).otherwise(F.struct(F.concat(s["held"]["t"], p["t"]).alias("t"), s["held"]["o"].alias("o")))
        return F.when(short(whole["t"]), F.struct(s["out"].alias("out"), whole.alias("held"))).otherwise(F.struct(F.array_append(s["out"], whole).alias("out"), none.alias("held")))

    fold = lambda x: F.aggregate(x, state, step, lambda s: F.when(s["held"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["held"])))

    def by_runs(x: Column) -> Column:
        # nothing is held after a piece that is not short, so each such piece ends a run that is merged by itself
        ends = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == F.size(x)) | ~short(F.get(x, i - 1)["t"]))

        def run(es: Column) -> Column:
            since = lambda k: F.when(k == 0, 0).otherwise(F.get(es, k - 1))
            one = lambda e, k: F.slice(x, since(k) + 1, e - since(k))
            return F.flatten(F.transform(es, lambda e, k: F.when(e - since(k) == 1, one(e, k)).otherwise(fold(one(e, k)))))

        return once(ends, run)

    return once(pieces, lambda x: F.when(F.exists(x, lambda p: short(p["t"])), by_runs(x)).otherwise(x))


def sentences(c: Column) -> Column:
    """Sentences with their end marks; spaces before a sentence belong to it."""
    pieces = F.filter(placed(cut_at(text_of(c), SENTENCE_END, ".!?")), lambda p: ~blank(p["t"]))
    return merge_short(hard_split(pieces))


def clauses(c: Column) -> Column:
    """Cut after clause marks (and the white space behind them) with MIN_CLAUSE solid characters on both sides."""

    def folded(parts: Column) -> Column:
        # of solid characters no more than MIN_CLAUSE are ever asked for
        counted = F.transform(parts, lambda p: F.struct(p.alias("t"), F.when(enough(p), C.MIN_CLAUSE).otherwise(solid_count(p)).alias("n")))
        state = lambda xs: F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"), F.aggregate(xs, F.lit(0), lambda a, x: a + x["n"]).alias("left"))

        def step(s: Column, p: Column) -> Column:
            cur, n, left = F.concat(s["cur"], p["t"]), s["n"] + p["n"], s["left"] - p["n"]
            cut = (n >= C.MIN_CLAUSE) & (left >= C.MIN_CLAUSE)
            return F.struct(F.when(cut, F.array_append(s["out"], cur)).otherwise(s["out"]).alias("out"), F.when(cut, "").otherwise(cur).alias("cur"), F.when(cut, 0).otherwise(n).alias("n"), left.alias("left"))

        return once(counted, lambda xs: F.aggregate(xs, state(xs), step, lambda s: F.when(s["cur"] == "", s["out"]).otherwise(F.array_append(s["out"], s["cur"]))))

    enough = lambda p: p.rlike(rf"^(?:[^{_SOLID}]*+[{_SOLID}]){{{C.MIN_CLAUSE}}}")
    # where all have enough, each is a clause
    joined = lambda parts: F.when(F.forall(parts, enough), parts).otherwise(folded(parts))
    whole = lambda t: F.when(t == "", F.array().cast(PIECES)).otherwise(F.array(F.struct(t.alias("t"), F.lit(0).alias("o"))))
    return once(text_of(c), lambda t: F.when(t.rlike(MARKED), placed(once(cut_at(t, CLAUSE_CUT, ",:;"), joined))).otherwise(whole(t)))


def _python_class(body: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), body)


_HAN, _LATIN = re.compile(f"[{_python_class(C.CJK)}]"), re.compile(f"[{_python_class(C.LATIN)}]")
_SIDE = re.compile(f"[{_python_class(C.CJK)}{_python_class(C.CJK_PUNCT)}]")


def runs_of(text: str, min_en: int = C.MIN_FOREIGN_EN, min_zh: int = C.MIN_FOREIGN_ZH) -> list[tuple[str, str, int]]:
    """(t, lang, o) of a text with both scripts.

    Each character is on one side (Z, E) or neutral (N).  Stretches of the side that is not
    the sentence's own, heavy enough, are runs of their own without their neutral tails.
    """
    han, latin = len(_HAN.findall(text)), len(_LATIN.findall(text))
    sides = "".join("Z" if _SIDE.match(ch) else "E" if _LATIN.match(ch) else "N" for ch in text)
    own, other, need = ("Z", "E", min_en) if 4 * han >= latin else ("E", "Z", min_zh)
    edges = [0]
    for m in re.finditer(f"{other}[{other}N]*", sides):
        stretch = m[0].rstrip("N")
        if stretch.count(other) >= need:
            edges += [m.start(), m.start() + len(stretch)]
    edges.append(len(text))
    names = {"Z": "zh", "E": "en"}
    found = [(text[a:b], names[(own, other)[k % 2]], a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if text[a:b].strip(C.WS_CHARS)]
    return found or [(text, names[own], 0)]


def lang_runs_of_pieces(pieces: Column, min_en: int = C.MIN_FOREIGN_EN, min_zh: int = C.MIN_FOREIGN_ZH, fallback: str = "zh") -> Column:
    """lang_runs() of each of an array of pieces (t, o), as an array of arrays."""
    min_en, min_zh = min_en or C.MIN_FOREIGN_EN, min_zh or C.MIN_FOREIGN_ZH

    @F.pandas_udf(f"array<{RUNS}>")
    def mixed(lists: pd.Series) -> pd.Series:
        def of_text(t: str) -> list[dict]:
            both = _HAN.search(t) and _LATIN.search(t)
            found = runs_of(t, min_en, min_zh) if both else [(t, "en" if _LATIN.search(t) else "zh" if _HAN.search(t) else fallback, 0)]
            return [{"t": a, "lang": lang, "o": o} for a, lang, o in found if t]

        return lists.map(lambda ts: [] if ts is None else [of_text(t) for t in ts])

    texts = F.transform(pieces, lambda p: p["t"])
    han, latin = (lambda t: t.rlike(HAS_CJK)), (lambda t: t.rlike(f"[{C.LATIN}]"))
    both = F.exists(texts, lambda t: han(t) & latin(t))
    whole = lambda t: F.when(t == "", F.array().cast(RUNS)).otherwise(F.array(F.struct(t.alias("t"), F.when(latin(t), "en").when(han(t), "zh").otherwise(fallback).alias("lang"), F.lit(0).alias("o"))))
    return F.when(both, mixed(F.when(both, texts))).otherwise(F.transform(texts, whole))


def lang_runs(c: Column, min_en: int = C.MIN_FOREIGN_EN, min_zh: int = C.MIN_FOREIGN_ZH, fallback: str = "zh") -> Column:
    """Runs (t, lang, o) to be read by one voice each; texts of one script never leave the JVM."""
    min_en, min_zh = min_en or C.MIN_FOREIGN_EN, min_zh or C.MIN_FOREIGN_ZH

    @F.pandas_udf(RUNS)
    def mixed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else [{"t": a, "lang": lang, "o": o} for a, lang, o in runs_of(t, min_en, min_zh)])

    t = text_of(c)
    han, latin = t.rlike(HAS_CJK), t.rlike(f"[{C.LATIN}]")
    whole = lambda lang: F.array(F.struct(t.alias("t"), F.lit(lang).alias("lang"), F.lit(0).alias("o")))
    both = han & latin
    return F.when(t == "", F.array().cast(RUNS)).when(both, mixed(F.when(both, t))).when(latin, whole("en")).when(han, whole("zh")).otherwise(whole(fallback))


def parts_of_runs(runs: Column) -> Column:
    """What a voice says, (say, lang, o, brk), for an array of runs; brk asks for a short pause."""

    def of_run(r: Column) -> Column:
        return F.transform(clauses(r["t"]), lambda p: F.struct(strip_speech_punctuation(p["t"]).alias("say"), r["lang"].alias("lang"), (r["o"] + p["o"]).alias("o"), p["t"].rlike(rf"{MARKED}[{C.WS}{_CLOSERS}]*\z").alias("brk")))

    said = F.filter(F.flatten(F.transform(runs, of_run)), lambda p: p["say"] != "")
    return once(said, lambda x: F.transform(x, lambda p, i: F.struct(p["say"].alias("say"), p["lang"].alias("lang"), p["o"].alias("o"), (p["brk"] & (i < F.size(x) - 1)).alias("brk"))))
