"""Quality rules, line first: failing lines go, then documents that lost too much text.

Everything is a column expression over one row; nothing is shuffled and no Python runs.

Line rules (a line that holds no word is neither kept nor lost):
* navigation: at least two of the separators ``| > » ·``, and one to every five words; or a
  menu, MENU_LINES fragments or more in a row, lines without a word between them aside.  A
  fragment is a short line of one to three words that has no end mark, does not start in
  lower case and fails by no other rule;
* boilerplate: a short line with a sign of copyright, or with a phrase of BOILERPLATE as
  whole words;
* punctuation: a short line of four words or more without an end mark that is no part of
  a wrapped passage, a short line of which more than half are ASCII signs, a line with a
  long run of signs, a line with a symbol (one of ``# * $ % & | < >``) to every ten
  characters, or one with two doubled marks such as ``!!`` or more, and one to every four
  words.

A line reads on in the next one if both hold words, neither fails by another rule, and the
next is of similar width (the line, with the next one's first word, has over three quarters
of its characters) or starts in lower case.  Lines that read on form a passage; if a
sentence ends anywhere in it, its lines need no end marks of their own.

A document stays if its base counts pass and the words of its kept lines hold at least
half of the characters in words.

Edge cases: a null or empty text has no words, so its base counts fail; repeated rows
give a row each; an empty table gives an empty table; a text of any length is judged whole;
other columns are not read, and those with the name of a column that quality() adds are
replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACES, WORD, named, set_aside, text_or_empty

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MIN_KEPT = 50  # per cent of the characters in words
#: Lines of at least this many characters are prose whatever they end in.
SHORT_LINE = 80
#: So many fragments in a row make a menu.
MENU_LINES = 4
COPYRIGHT = r"[\x{A9}\x{2117}]"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "lorem ipsum",
    "sign up",
    "log in",
    "subscribe to",
    "click here",
    "read more",
    "share this",
    "skip to content",
    "powered by",
)
#: Unicode's sentence terminals (STerm, ATerm) beyond ASCII.
TERMINALS = (
    r"\x{589}\x{61D}-\x{61F}\x{6D4}\x{700}-\x{702}\x{7F9}\x{837}\x{839}\x{83D}-\x{83E}"
    r"\x{964}-\x{965}\x{104A}-\x{104B}\x{1362}\x{1367}-\x{1368}\x{166E}\x{1735}-\x{1736}\x{17D4}-\x{17D5}\x{1803}"
    r"\x{1809}\x{1944}-\x{1945}\x{1AA8}-\x{1AAB}\x{1B4E}-\x{1B4F}\x{1B5A}-\x{1B5B}\x{1B5E}-\x{1B5F}\x{1B7D}-\x{1B7F}\x{1C3B}-\x{1C3C}"
    r"\x{1C7E}-\x{1C7F}\x{2024}\x{203C}-\x{203D}\x{2047}-\x{2049}\x{2CF9}-\x{2CFB}\x{2E2E}\x{2E3C}\x{2E53}-\x{2E54}"
    r"\x{2E60}-\x{2E61}\x{3002}\x{A4FF}\x{A60E}-\x{A60F}\x{A6F3}\x{A6F7}\x{A876}-\x{A877}\x{A8CE}-\x{A8CF}"
    r"\x{A92F}\x{A9C8}-\x{A9C9}\x{AA5D}-\x{AA5F}\x{AAF0}-\x{AAF1}\x{ABEB}\x{FE12}\x{FE15}-\x{FE16}\x{FE52}"
    r"\x{FE56}-\x{FE57}\x{FF01}\x{FF0E}\x{FF1F}\x{FF61}\x{10A56}-\x{10A57}\x{10F55}-\x{10F59}\x{10F86}-\x{10F89}"
    r"\x{11047}-\x{11048}\x{110BE}-\x{110C1}\x{11141}-\x{11143}\x{111C5}-\x{111C6}\x{111CD}\x{111DE}-\x{111DF}\x{11238}-\x{11239}\x{1123B}-\x{1123C}"
    r"\x{112A9}\x{113D4}-\x{113D5}\x{1144B}-\x{1144C}\x{115C2}-\x{115C3}\x{115C9}-\x{115D7}\x{11641}-\x{11642}\x{1173C}-\x{1173E}\x{11944}"
    r"\x{11946}\x{11A42}-\x{11A43}\x{11A9B}-\x{11A9C}\x{11C41}-\x{11C42}\x{11EF7}-\x{11EF8}\x{11F43}-\x{11F44}\x{16A6E}-\x{16A6F}\x{16AF5}"
    r"\x{16B37}-\x{16B38}\x{16B44}\x{16D6E}-\x{16D6F}\x{16E98}\x{1BC9F}\x{1DA88}"
)
#: Full stops and the like, with ellipses and the shad; then further marks that may end a line:
#: colons and semicolons, Latin, Greek, Arabic and full width.
STOPS = rf".!?\x{{2026}}\x{{F0D}}-\x{{F0E}}{TERMINALS}"
CLOSERS = r"[\"'\p{Pe}\p{Pf}\p{Pi}»]*"
SENTENCE_END = rf"[{STOPS}:;\x{{37E}}\x{{61B}}\x{{FF1A}}\x{{FF1B}}]{CLOSERS}[{SPACES}]*\z"
#: A sentence that ends anywhere in a line.
SENTENCE = rf"[{STOPS}]{CLOSERS}([{SPACES}]|\z)|[\x{{3002}}\x{{FF01}}\x{{FF1F}}]|{SENTENCE_END}"
#: Runs without ASCII signs: white space, letters, digits, anything beyond ASCII.
UNSIGNED = rf"[{SPACES}A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+"
#: So many ASCII signs in a row are no prose.
SIGN_RUN = r"[!-/:-@\[-`{-~]{12}"
SEPARATOR, DOUBLED = "[|>»·]", "[!?]{2,}"
FOUR_WORDS = rf"{WORD}[{SPACES}]+{WORD}[{SPACES}]+{WORD}[{SPACES}]+{WORD}"
LOWER_START = rf"^[{SPACES}]*\p{{Ll}}"
#: Bits of a position inside the packed (hash, position) numbers that find repeated windows:
#: for texts of at most 2 ** POSITION_BITS words, and for longer ones (an array index has 31).
POSITION_BITS, ANY_POSITION_BITS = 24, 31


def bound(value: Column, use) -> Column:
    """`use(value)` with the value worked out once, however often `use` names it.

    A plain column would be copied into every place, and into lambdas once an element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def repeated_window_words(words: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the text.

    Window hashes share a long with their positions, so one sort of plain numbers finds
    the few windows whose leading hash bits repeat; only those are compared in full, so
    that the bits left to the hash decide the work and not the result.
    """
    packed = [packed_window_words(words, bits) for bits in (POSITION_BITS, ANY_POSITION_BITS)]
    return F.when(F.size(words) <= 1 << POSITION_BITS, packed[0]).otherwise(packed[1])


def packed_window_words(words: Column, bits: int) -> Column:
    """repeated_window_words for at most 2 ** bits words."""
    step = 1 << bits
    position = lambda x: x.bitwiseAND(step - 1).cast("int")
    top = F.lit(((1 << 63) - 1) & ~(step - 1))
    packed = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(top).bitwiseOR(i.cast("long")))
    near = lambda s, i: F.get(s, i + 1) - F.get(s, i) < step
    doubtful = bound(F.sort_array(packed), lambda s: F.when(F.size(F.filter(s, lambda x, i: F.get(s, i + 1) - x < step)) > 0, F.filter(s, lambda x, i: near(s, i) | ((i > 0) & near(s, i - 1)))).otherwise(F.array().cast("array<bigint>")))
    # full windows of the doubtful positions, sorted so that equal ones are neighbours
    full = F.array_sort(F.transform(doubtful, lambda x: F.struct(F.concat_ws(" ", F.slice(words, position(x) + 1, F.lit(3))).alias("w"), position(x).alias("p"))))
    same = bound(full, lambda d: F.filter(d, lambda x, i: (x["w"] == F.get(d, i + 1)["w"]) | ((i > 0) & (x["w"] == F.get(d, i - 1)["w"]))))
    starts = F.sort_array(F.transform(same, lambda x: x["p"]))
    return bound(starts, lambda s: F.aggregate(F.transform(s, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))


def with_base_counts(docs: DataFrame, text: str = "__text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for the text column."""
    t = F.col(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    return docs.withColumns(
        {
            "__words": bound(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.coalesce(repeated_window_words(w), F.lit(0)).cast("long").alias("repeated"))),
            "word_chars": F.length(F.regexp_replace(t, f"[{SPACES}]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, NOT_SYMBOLS, "")).cast("long"),
            "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    ).withColumns({"n_words": F.col("__words.n"), "n_repeat_words": F.col("__words.repeated")}).drop("__words")


#: Of a line: passes, fails only for want of an end mark, fails by another rule, is a fragment, holds no word.
PASSES, UNENDED, FAILS, FRAGMENT, BLANK = range(5)


def line_kind(line: Column) -> Column:
    """PASSES, UNENDED, FAILS, FRAGMENT or BLANK, from the line alone."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    navigation = (count(SEPARATOR) >= 2) & (5 * count(SEPARATOR) >= count(WORD))
    phrase = "|".join(BOILERPLATE)
    # the plain phrases come first: few lines hold one
    boilerplate = line.rlike(COPYRIGHT) | F.lower(line).rlike(phrase) & F.lower(line).rlike(rf"(?<![\p{{L}}\p{{M}}\p{{N}}_])({phrase})(?![\p{{L}}\p{{M}}\p{{N}}_])")
    unended = F.when(line.rlike(SENTENCE_END), PASSES).when(line.rlike(FOUR_WORDS), UNENDED).when(line.rlike(LOWER_START), PASSES).otherwise(FRAGMENT)
    signs = 2 * F.length(F.regexp_replace(line, UNSIGNED, "")) > F.length(line)
    symbols = line.rlike("[#*$%&|<>]") & (10 * F.length(F.regexp_replace(line, NOT_SYMBOLS, "")) >= F.length(line))
    shouting = line.rlike(DOUBLED) & (count(DOUBLED) >= 2) & (4 * count(DOUBLED) >= count(WORD))
    # the cheap look for a sign comes first: most lines of prose end there
    odd = line.rlike("[|>»·#*$%&<!?]") & (navigation | symbols | shouting)
    fails = odd | F.when(F.length(line) < SHORT_LINE, boilerplate | signs).otherwise(line.rlike(SIGN_RUN))
    return F.when(~line.rlike(WORD), BLANK).when(fails, FAILS).when(F.length(line) < SHORT_LINE, unended).otherwise(PASSES)


def line_passes(line: Column) -> Column:
    """Whether a line that holds a word passes all line rules on its own."""
    return ~line_kind(line).isin(UNENDED, FAILS)


def with_menus(kinds: Column) -> Column:
    """The kinds of lines as PASSES, UNENDED or FAILS: fragments fail where they make a menu, and pass elsewhere.

    One digit a line, cut where menus may start and end: linear in the lines.
    """
    menu = f"[{FRAGMENT}{BLANK}]"
    pieces = F.split(F.array_join(kinds, ""), f"(?<={menu})(?!{menu})|(?<!{menu})(?={menu})")
    alone, together = (f"{x}{PASSES}" for x in (PASSES, FAILS))
    many = lambda p: F.length(F.translate(p, str(BLANK), "")) >= MENU_LINES
    judged = F.transform(pieces, lambda p: F.when(p.rlike(f"^{menu}") & many(p), F.translate(p, f"{FRAGMENT}{BLANK}", together)).otherwise(F.translate(p, f"{FRAGMENT}{BLANK}", alone)))
    return F.transform(F.split(F.array_join(judged, ""), ""), lambda k: k.cast("int"))


def in_passages(lines: Column, kinds: Column) -> Column:
    """"1" for each line of a passage of two lines or more in which a sentence ends, else "0".

    One letter a line (b and d read on in the next, c and d hold the end of a sentence), cut
    into passages after each line that does not read on: linear in the lines.
    """

    def letter(x: Column, i: Column) -> Column:
        after = F.get(lines, i + 1)
        words = x.rlike(WORD) & after.rlike(WORD) & (F.get(kinds, i) != FAILS) & (F.get(kinds, i + 1) != FAILS)
        similar = 4 * (F.length(x) + 1 + F.length(F.regexp_extract(after, WORD, 0))) > 3 * F.length(after)
        on = F.coalesce(words & (similar | after.rlike(LOWER_START)), F.lit(False))
        ends = x.rlike(SENTENCE)
        return F.when(on, F.when(ends, "d").otherwise("b")).otherwise(F.when(ends, "c").otherwise("a"))

    passages = F.split(F.array_join(F.transform(lines, letter), ""), "(?<=[ac])")
    flags = F.transform(passages, lambda p: F.when((F.length(p) > 1) & p.rlike("[cd]"), F.translate(p, "abcd", "1111")).otherwise(F.translate(p, "abcd", "0000")))
    return F.split(F.array_join(flags, ""), "")


def failing(lines: Column) -> Column:
    """Of each of the (bound) lines, whether it fails."""

    def judged(kinds: Column) -> Column:
        alone = F.transform(kinds, lambda k: (k == UNENDED) | (k == FAILS))
        passages = bound(in_passages(lines, kinds), lambda p: F.transform(kinds, lambda k, i: (k == FAILS) | ((k == UNENDED) & (F.get(p, i) == "0"))))
        return F.when(F.array_contains(kinds, UNENDED), passages).otherwise(alone)

    menus = lambda kinds: F.when(F.size(F.filter(kinds, lambda k: k == FRAGMENT)) >= MENU_LINES, with_menus(kinds)).otherwise(kinds)
    return bound(bound(F.transform(lines, line_kind), menus), judged)


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of `docs`, then the base counts, base_failed, kept and clean_text.

    `clean_text` is the text without its failing lines (lines without a word stay).  Columns
    of `docs` with the names of these are replaced by them; all others stay, whatever their names.
    """
    rows, names = set_aside(docs)
    base = with_base_counts(rows.withColumn("__text", text_or_empty(names[text_col])))
    lines = F.split(F.col("__text"), "\n", -1)
    base = base.withColumn("__fails", bound(lines, failing))
    chars = lambda x: F.length(F.regexp_replace(x, f"[{SPACES}]+", ""))
    fails = lambda i: F.get(F.col("__fails"), i)
    lost = F.when(~F.array_contains("__fails", True), 0).otherwise(F.aggregate(F.filter(lines, lambda x, i: fails(i)), F.lit(0), lambda a, x: a + chars(x)))
    judged = base.withColumns({"base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")), "__lost": lost})
    kept = ~F.col("base_failed") & (100 * (F.col("word_chars") - F.col("__lost")) >= MIN_KEPT * F.col("word_chars"))
    clean = F.when(F.col("__lost") == 0, F.col("__text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~fails(i)), "\n"))
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text"]
    judged = judged.withColumns({"kept": kept, "clean_text": clean})
    return judged.select(*[F.col(new).alias(old) for old, new in names.items() if old not in added], *added)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, the base counts, base_failed, kept."""
    narrow = docs.select(named(id_col).alias(id_col), named(text_col).alias(text_col))
    return quality(narrow, text_col).select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
