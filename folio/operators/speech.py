"""Reading aloud: the queue of what is said and of pauses, voices, and fenced events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import chars as C
from folio.functions.segment import lang_runs_of_pieces, parts_of_runs, sentences
from folio.functions.text import lc_lang, once
from folio.operators.library import noted
from folio.operators.position import chapter_of

# Voices that sound best, and the regions to prefer.
PREFERRED_ZH = r"(?i)Google|Siri|Meijia|美佳|Microsoft|Ting-Ting|Hsiao|曉|台|Taiwan"
PREFERRED_EN = r"(?i)Google|Siri|Samantha|Microsoft|Aria|Daniel|Karen|Alex|Ava"
REGION_ZH, REGION_EN = "(^|-)tw(-|$)", "(^|-)(us|gb)(-|$)"
GUARD_MS, GUARD_MS_PER_CHAR = 8000, 800

_ITEM = "struct<say:string,lang:string,o:int,pause_ms:int>"


def block_sentences(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, b, i, t, o): the sentences of each block; a block without any is one."""
    whole = once(sentences(F.col("t")), lambda s: F.when(F.size(s) == 0, F.array(F.struct(F.col("t").alias("t"), F.lit(0).alias("o")))).otherwise(s))
    return blocks.select(id_col, "b", F.posexplode(whole).alias("i", "s")).select(id_col, "b", "i", "s.t", "s.o")


def rendered(blocks: DataFrame, units: DataFrame, notes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ci, b, k, i, t, o, noted): every unit as the sentences of its blocks, with those that carry a note."""
    inside = chapter_of(blocks.select(id_col, "b", "k", "t"), units, id_col)
    spans = block_sentences(inside, id_col).join(inside.select(id_col, "b", "k", "ci"), [id_col, "b"])
    return noted(spans.select(id_col, "ci", "b", "k", "i", "t", "o"), notes, id_col)


def speech_queue(blocks: DataFrame, start: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, b, o, say, lang, pause_ms): either something to say or a pause, in order.

    start: (id, from_b, from_o), where to begin in each document; sentences that end
    before it are left out.
    """
    whole = once(sentences(F.col("t")), lambda s: F.when(F.size(s) == 0, F.array(F.struct(F.col("t").alias("t"), F.lit(0).alias("o")))).otherwise(s))
    rows = blocks.select(id_col, "b", whole.alias("pieces"))
    if start is not None:
        rows = rows.join(start.select(id_col, "from_b", "from_o"), id_col, "left").where("from_b IS NULL OR b >= from_b")
        begun = F.filter("pieces", lambda p: p["o"] + F.char_length(p["t"]) > F.col("from_o"))
        rows = rows.select(id_col, "b", F.when(F.col("b") == F.col("from_b"), begun).otherwise(F.col("pieces")).alias("pieces")).where(F.size("pieces") > 0)
    rows = rows.select(id_col, "b", F.transform("pieces", lambda p: p["o"]).alias("os"), F.transform(lang_runs_of_pieces(F.col("pieces")), parts_of_runs).alias("parts"))
    pause = lambda ms: F.array(F.struct(F.lit(None).cast("string").alias("say"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("o"), F.lit(ms).alias("pause_ms")))
    none = F.array().cast(f"array<{_ITEM}>")

    def spoken(parts: Column) -> Column:
        def of_sentence(ps: Column, i: Column, first: Column) -> Column:
            say = lambda p: F.array(F.struct(p["say"].alias("say"), p["lang"].alias("lang"), F.get("os", i).alias("o"), F.lit(None).cast("int").alias("pause_ms")))
            said = F.flatten(F.transform(ps, lambda p: F.concat(say(p), F.when(p["brk"], pause(C.CLAUSE_PAUSE_MS)).otherwise(none))))
            return F.when((first >= 0) & (i > first), F.concat(pause(C.SENTENCE_PAUSE_MS), said)).otherwise(said)

        # sentences after the first one that says something begin with a pause; it is looked for once a block
        first = F.array_position(F.transform(parts, lambda ps: F.size(ps) > 0), True) - 1
        return F.concat(F.flatten(once(first, lambda f: F.transform(parts, lambda ps, i: of_sentence(ps, i, f)))), pause(C.BLOCK_PAUSE_MS))

    items = rows.select(id_col, "b", once(F.col("parts"), spoken).alias("items"))
    # places come from the blocks' lengths, not from a sort of all items
    before = F.sum(F.size("items")).over(Window.partitionBy(id_col).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    placed = items.withColumn("base", F.coalesce(before, F.lit(0)).cast("int")).select(id_col, "b", "base", F.posexplode("items").alias("j", "x"))
    return placed.select(id_col, (F.col("base") + F.col("j")).alias("seq"), "b", "x.o", "x.say", "x.lang", "x.pause_ms")


def speaks(lang: Column, which: str) -> Column:
    return lc_lang(lang).rlike("^(zh|cmn|yue)" if which == "zh" else "^en")


def ranked_voices(voices: DataFrame, which: str, collation: str = "UNICODE") -> DataFrame:
    """Voices (name, lang, uri) of a language with their `place` from 1, best first; names in the order of a collation, such as that of a locale."""
    region, preferred = (REGION_ZH, PREFERRED_ZH) if which == "zh" else (REGION_EN, PREFERRED_EN)
    order = [lc_lang(F.col("lang")).rlike(region).desc(), F.coalesce("name", F.lit("")).rlike(preferred).desc(), F.collate(F.coalesce("name", F.lit("")), collation), "uri"]
    return voices.where(speaks(F.col("lang"), which)).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a device's voices: few


def pick_voice(voices: DataFrame, which: str, wanted: str | None = None, collation: str = "UNICODE") -> DataFrame:
    """The wanted voice if it is there, else the best; no row without any."""
    return ranked_voices(voices, which, collation).orderBy((F.col("uri").eqNullSafe(F.lit(wanted or None)) & F.lit(bool(wanted))).desc(), "place").limit(1)


def guard_ms(say: Column, rate: Column) -> Column:
    """How long to wait for the end of what is being said."""
    return GUARD_MS + F.floor(F.char_length(say) * GUARD_MS_PER_CHAR / rate + 0.5)


def rate_for(lang: Column, settings: Column) -> Column:
    """How fast a voice of a language speaks."""
    return F.when(lang == "en", settings["rate_en"]).otherwise(settings["rate"])


def replay_from(place: Column) -> Column:
    """Where a queue goes on after it was interrupted while an item before `place` was said: with that item again."""
    return F.greatest(place - 1, F.lit(0))


def epoch_fence(events: DataFrame, key: str, epoch: str, order: list[str]) -> DataFrame:
    """`events` without those of an epoch older than one already seen for their key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("__top", F.max(epoch).over(w)).where(F.col(epoch) >= F.col("__top")).drop("__top")
