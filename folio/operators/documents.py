"""The document model: texts to blocks, blocks to chapters and reading units.

Blocks are rows (doc, b, k, t): ordinal, kind (h heading, p paragraph, q quote), text.
Units are rows (doc, ci, title, start, end) over half-open block intervals.  Steps that
look at neighbours are windows; the two greedy ones (merging, cutting) are folds over one
document's chapter list.  Null and blank texts become one placeholder block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import chars as C
from folio.functions.rows import stacked
from folio.functions.text import clean_title, looks_heading, normalize, once, trim

UNITS = "array<struct<start:int,end:int,title:string,body:bigint,chars:bigint>>"


def text_parts(text: Column) -> Column:
    """Paragraphs of a plain text: cut at blank lines if it has any, else at every line end."""
    gap = rf"\n[{C.WS}]*\n+"
    parts = once(normalize(text), lambda t: F.when(t.rlike(rf"\n[{C.WS}]*\n"), F.split(t, gap, -1)).otherwise(F.split(t, "\n", -1)))
    return F.filter(F.transform(parts, trim), lambda p: p != "")


def block_texts(text: Column) -> Column:
    """The texts of the blocks of a plain text: its paragraphs, or the placeholder."""
    return once(text_parts(text), lambda parts: F.when(F.size(parts) == 0, F.array(F.lit(C.EMPTY_FILE))).otherwise(parts))


def txt_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain texts to blocks (id, b, k, t)."""
    rows = docs.select(F.col(id_col), F.posexplode(block_texts(F.col(text_col))).alias("b", "t"))
    return rows.select(id_col, "b", F.when(looks_heading(F.col("t")), "h").otherwise("p").alias("k"), "t")


def heading_chapters(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, title, body, chars): every heading opens a chapter; before the first lies the front."""
    w = Window.partitionBy(id_col).orderBy("b")
    size = F.char_length("t").cast("long")
    head = F.col("k") == "h"
    numbered = blocks.withColumn("part", F.count_if(head).over(w))
    chapters = numbered.groupBy(id_col, "part").agg(
        F.min("b").alias("start"), (F.max("b") + 1).alias("end"), F.min_by("t", "b").alias("first"), F.sum(F.when(head, 0).otherwise(size)).alias("body"), F.sum(size).alias("chars")
    )
    only = F.count("*").over(Window.partitionBy(id_col)) == 1
    title = F.when(F.col("part") > 0, F.col("first")).when(only, C.WHOLE_TEXT).otherwise(C.FRONT)
    return chapters.select(id_col, "start", "end", title.alias("title"), "body", "chars")


def with_sizes(chapters: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add body and chars to chapters (id, start, end, title) made elsewhere, such as from an outline."""
    size = F.char_length("t").cast("long")
    inside = chapters.join(blocks.select(id_col, "b", "k", size.alias("n")), id_col).where("b >= start AND b < end")
    return inside.groupBy(id_col, "start", "end").agg(F.first("title").alias("title"), F.sum(F.when(F.col("k") == "h", 0).otherwise(F.col("n"))).alias("body"), F.sum("n").alias("chars"))


def merge_tiny(chapters: Column) -> Column:
    """Chapters of almost no body take in the following one and its title; a last one goes to its predecessor."""
    merged = lambda a, c: F.struct(a["start"].alias("start"), c["end"].alias("end"), F.coalesce(F.nullif(clean_title(c["title"]), F.lit("")), a["title"]).alias("title"), (a["body"] + c["body"]).alias("body"), (a["chars"] + c["chars"]).alias("chars"))
    fresh = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), clean_title(c["title"]).alias("title"), c["body"].alias("body"), c["chars"].alias("chars"))

    def step(out: Column, c: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        open_ = (F.size(out) > 0) & (last["body"] < C.MIN_BODY)
        return F.when(open_, F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), merged(last, c))).otherwise(F.array_append(out, fresh(c)))

    def finish(out: Column) -> Column:
        last, prev = F.get(out, F.size(out) - 1), F.get(out, F.size(out) - 2)
        joined = F.struct(prev["start"].alias("start"), last["end"].alias("end"), prev["title"].alias("title"), (prev["body"] + last["body"]).alias("body"), (prev["chars"] + last["chars"]).alias("chars"))
        return F.when((F.size(out) > 1) & (last["body"] < C.MIN_BODY), F.array_append(F.slice(out, 1, F.size(out) - 2), joined)).otherwise(out)

    return F.aggregate(chapters, F.array().cast(UNITS), step, finish)


def split_points(sizes: Column) -> Column:
    """Ends (as counts of blocks) of the parts of a too long unit: after the block that reaches MAX_UNIT, and at the end."""
    state = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).cast("long").alias("acc"), F.lit(0).alias("i"))

    def step(s: Column, n: Column) -> Column:
        full = s["acc"] + n >= C.MAX_UNIT
        return F.struct(F.when(full, F.array_append(s["cuts"], s["i"] + 1)).otherwise(s["cuts"]).alias("cuts"), F.when(full, F.lit(0).cast("long")).otherwise(s["acc"] + n).alias("acc"), (s["i"] + 1).alias("i"))

    return F.aggregate(sizes, state, step, lambda s: F.when(F.element_at(s["cuts"], -1) == s["i"], s["cuts"]).otherwise(F.array_append(s["cuts"], s["i"])))


def reading_units(chapters: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Merge and cut chapters (id, start, end, title, body, chars) to units (id, ci, title, start, end, body, chars)."""
    listed = chapters.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("start", "end", "title", "body", "chars"))).alias("list"))
    merged = listed.select(id_col, F.inline(merge_tiny(F.col("list")))).where("end > start")
    long = merged.where(F.col("chars") > C.MAX_UNIT)
    size = F.char_length("t").cast("long")
    inside = blocks.select(F.col(id_col).alias("doc_"), "b", F.struct("b", size.alias("n"), F.when(F.col("k") == "h", F.lit(0)).otherwise(size).alias("body")).alias("x"))
    sized = long.join(inside, (F.col(id_col) == F.col("doc_")) & (F.col("b") >= F.col("start")) & (F.col("b") < F.col("end")))
    sized = sized.groupBy(id_col, "start", "title").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    parts = sized.select(id_col, "start", "title", "xs", F.posexplode(split_points(F.transform("xs", lambda x: x["n"]))).alias("p", "to"), split_points(F.transform("xs", lambda x: x["n"])).alias("cuts"))
    since = F.when(F.col("p") == 0, 0).otherwise(F.get("cuts", F.col("p") - 1))
    part = F.slice("xs", since + 1, F.col("to") - since)
    total = lambda f: F.aggregate(F.transform(part, lambda x: x[f].cast("long")), F.lit(0).cast("long"), lambda a, n: a + n)
    name = F.when(F.col("p") == 0, F.col("title")).otherwise(F.concat("title", F.lit(C.CONTINUED.split("{}")[0]), (F.col("p") + 1).cast("string"), F.lit(C.CONTINUED.split("{}")[1])))
    cut = parts.select(id_col, (F.col("start") + since).alias("start"), (F.col("start") + F.col("to")).alias("end"), name.alias("title"), total("body").alias("body"), total("n").alias("chars"))
    units = merged.where(F.col("chars") <= C.MAX_UNIT).transform(stacked, cut)
    return units.select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("start")) - 1).alias("ci"), "title", "start", "end", "body", "chars")


def document_units(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return reading_units(heading_chapters(blocks, id_col), blocks, id_col)


def doc_stats(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    size = F.char_length("t")
    return blocks.groupBy(id_col).agg(F.count("*").alias("n_blocks"), F.sum(size).alias("total_chars"), F.sum(F.when(F.col("k") == "h", 0).otherwise(size)).cast("long").alias("body_chars"), F.count_if(F.col("k") == "h").alias("n_headings"))


def needs_upgrade(books: DataFrame, docs: DataFrame, parser_version: int, page_version: int, id_col: str = "id") -> DataFrame:
    """`books` with `stale`: no parsed document, or one of an older parser.

    Version 3 of the parser changed zipped books alone, so others stay at version 2; page
    documents also follow the version of the page layout.
    """
    d = docs.select(F.col(id_col).alias("id_"), "n_blocks", "parser_version", "page_version")
    j = books.join(d, F.col(id_col) == F.col("id_"), "left")
    missing = F.coalesce(F.col("n_blocks"), F.lit(0)) == 0
    old = ~F.col("parser_version").eqNullSafe(F.lit(parser_version))
    spared = ~missing & (F.col("format") != "epub") & F.col("parser_version").eqNullSafe(F.lit(2))
    pages = (F.col("format") == "pdf") & (F.coalesce(F.col("page_version"), F.lit(0)) != page_version)
    return j.select(*books.columns, (((missing | old) & ~spared) | pages).alias("stale"))
