"""Positioned page text: items to lines, running heads, lines to blocks, outlines to chapters.

Lines are rows (doc, page, i, t, x, y, h), pages from 0, y growing upwards.  What depends
on neighbours is a window over one document or page; only the joining of items to lines,
whose threshold follows the line so far, is a fold, over one page's items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions import chars as C
from folio.functions.rows import stacked
from folio.functions.text import fix_radicals, head_key, trim
from folio.operators.documents import heading_chapters, reading_units, with_sizes
from folio.operators.order import upper_median_over

# Fixed values of the layout rules.
LINE_STEP, LINE_SHARE = 1.5, 0.6
DEFAULT_HEIGHT, DEFAULT_GAP = 12.0, 1.4
HEADING_RISE, INDENT, WIDE_GAP = 1.22, 1.1, 1.55
HEAD_PAGES, HEAD_SHARE, HEAD_LEAST = 3, 0.6, 2
SCANNED_BELOW = 25
PAGE_NUMBER = rf"(?i)^[{C.WS}\-—–()［\[【]*([0-9]{{1,4}}|[ivxlcdm]{{1,7}}|第?[{C.WS}]*[0-9０-９]{{1,4}}[{C.WS}]*頁)[{C.WS}\-—–()］\]】]*$"
ENDED = rf"[。！？!?：:；;」』）】\]”\"][{C.WS}]*$"

_LINE = "struct<t:string,x:double,y:double,h:double>"


def items_to_lines(items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Items (id, page, seq, str, transform, height, has_eol) to lines (id, page, i, t, x, y, h)."""
    none = F.lit(None).cast(_LINE)
    tr = F.coalesce("transform", F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)]))
    height = F.coalesce(F.nullif(F.abs(F.get(tr, 3)), F.lit(0.0)), F.nullif("height", F.lit(0.0)), F.lit(0.0))
    item = F.struct("seq", F.col("str").alias("t"), F.get(tr, 4).alias("x"), F.get(tr, 5).alias("y"), height.alias("h"), F.coalesce("has_eol", F.lit(False)).alias("eol"))
    pages = items.where("str IS NOT NULL").groupBy(id_col, "page").agg(F.array_sort(F.collect_list(item)).alias("items"))
    state = F.struct(F.array().cast(f"array<{_LINE}>").alias("out"), none.alias("cur"))

    def step(s: Column, n: Column) -> Column:
        cur = s["cur"]
        away = cur.isNotNull() & (F.abs(n["y"] - cur["y"]) > F.greatest(F.lit(LINE_STEP), cur["h"] * LINE_SHARE))
        fresh = cur.isNull() | away
        line = F.struct(
            F.when(fresh, n["t"]).otherwise(F.concat(cur["t"], n["t"])).alias("t"), F.when(fresh, n["x"]).otherwise(F.least(cur["x"], n["x"])).alias("x"),
            F.when(fresh, n["y"]).otherwise(cur["y"]).alias("y"), F.when(fresh, n["h"]).otherwise(F.greatest(cur["h"], n["h"])).alias("h"),
        )
        out = F.when(away, F.array_append(s["out"], cur)).otherwise(s["out"])
        return F.struct(F.when(n["eol"], F.array_append(out, line)).otherwise(out).alias("out"), F.when(n["eol"], none).otherwise(line).alias("cur"))

    lines = F.aggregate("items", state, step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(F.array_append(s["out"], s["cur"])))
    rows = pages.select(id_col, "page", F.posexplode(lines).alias("pos", "l"))
    text = trim(F.regexp_replace(fix_radicals(F.col("l.t")), f"[{C.WS}]+", " "))
    rows = rows.select(id_col, "page", "pos", text.alias("t"), "l.x", "l.y", "l.h").where("t <> ''")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(id_col, "page").orderBy("pos")) - 1).select(id_col, "page", "i", "t", "x", "y", "h")


def page_counts(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_pages) where the last page is not empty."""
    return lines.groupBy(id_col).agg((F.max("page") + 1).alias("n_pages"))


def strip_running_heads(lines: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id", bare: str | None = None) -> DataFrame:
    """`lines` without page numbers, and without first and last lines that most pages share.

    bare: a column to add; of a document that would lose all its lines one stays, and is marked there.
    """
    page = Window.partitionBy(id_col, "page")
    if pages is None:
        counted = lines.withColumn("n_pages", F.max("page").over(Window.partitionBy(id_col)) + 1)
    else:
        counted = lines.join(pages.select(id_col, "n_pages"), id_col)
    marked = counted.withColumns({"__first": F.row_number().over(page.orderBy("i")) == 1, "__last": F.row_number().over(page.orderBy(F.col("i").desc())) == 1})
    # lines inside a page are never compared, so they need no key
    marked = marked.withColumn("__key", F.when(F.col("__first") | F.col("__last"), head_key(trim(F.col("t")))))
    same = Window.partitionBy(id_col, "__key")
    need = F.greatest(F.lit(HEAD_LEAST), F.ceil(F.col("n_pages") * HEAD_SHARE))
    often = lambda flag: (F.col("n_pages") >= HEAD_PAGES) & (F.col("__key") != "") & F.col(flag) & (F.count_if(F.col(flag)).over(same) >= need)
    # a line that went as a head is no foot any more, and what then comes last on its page is its last line
    cut = marked.withColumns({"__head": often("__first"), "__foot": often("__last")})
    stays = ~F.col("__head") & ~F.col("__foot") & ~F.col("t").rlike(PAGE_NUMBER)
    if bare is None:
        return cut.where(stays).select(*lines.columns)
    doc = Window.partitionBy(id_col)
    cut = cut.withColumn("__stays", F.coalesce(stays, F.lit(False)))
    # the first of its lines in the order of the window before, whichever that is: only the document counts
    cut = cut.withColumns({bare: ~F.max("__stays").over(doc), "__one": F.row_number().over(doc.orderBy("__key")) == 1})
    return cut.where(F.col("__stays") | (F.col(bare) & F.col("__one"))).select(*lines.columns, bare)


def ended_blocks(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`lines` with `new` (the line opens a block), `heading` and `block`, its block's ordinal.

    Everything is laid out by document once; medians are ranks in windows, not lists.
    """
    doc, page = Window.partitionBy(id_col), Window.partitionBy(id_col, "page")
    order, inside = doc.orderBy("page", "i"), page.orderBy("i")
    rows = lines.withColumn("__high", F.when(F.col("h") > 0, F.col("h")))
    rank, median = upper_median_over(F.col("__high"), doc, "__rank")
    rows = rows.withColumn("__rank", rank).withColumn("__h", F.coalesce(median("__high"), F.lit(DEFAULT_HEIGHT)))
    rows = rows.withColumns({"__up": F.lag("y").over(inside) - F.col("y"), "__start": F.row_number().over(inside) == 1})
    rows = rows.withColumn("__rise", F.when(F.col("__up") > 0, F.col("__up")))
    rank, median = upper_median_over(F.col("__rise"), page, "__rank")
    rows = rows.withColumn("__rank", rank).withColumns({"__gap": F.coalesce(median("__rise"), F.col("__h") * DEFAULT_GAP), "__min": F.min("x").over(page)})
    rows = rows.withColumn("heading", (F.col("h") > F.col("__h") * HEADING_RISE) & (F.char_length("t") <= C.MAX_HEADING))
    none_open = F.coalesce(F.lag("heading").over(order), F.lit(True))
    indented = F.col("x") - F.col("__min") > F.col("__h") * INDENT
    ended = ~none_open & F.coalesce(F.lag("t").over(order).rlike(ENDED), F.lit(False))
    wide = F.coalesce(F.col("__up") > F.col("__gap") * WIDE_GAP, F.lit(False))
    rows = rows.withColumn("new", none_open | F.col("heading") | wide | (indented & (ended | F.col("__start"))))
    return rows.withColumn("block", F.sum(F.col("new").cast("int")).over(order) - 1).select(*lines.columns, "heading", "new", "block")


def lines_to_blocks(lines: DataFrame, id_col: str = "doc_id", pages: DataFrame | None = None, bare: str | None = None) -> DataFrame:
    """Lines to blocks (id, b, k, t); hyphens at line ends go, CJK lines join without a space.

    pages: documents (id), of which those without lines get a block that says so; so do
    those whose one line is marked in the column `bare`.
    """
    rows = ended_blocks(lines, id_col)
    within = Window.partitionBy(id_col, "block").orderBy("page", "i")
    after = F.lead("t").over(within)
    wide = f"[{C.CJK_WIDE}]"
    # one character, and a line end of two at most
    tail = F.right(F.col("t"), F.lit(3))
    hyphen = tail.rlike(r"[-\x{2010}\x{00AD}]$") & after.rlike("^[A-Za-z]")
    tight = tail.rlike(f"{wide}$") | after.rlike(f"^{wide}") | tail.rlike(f"[{C.WS}]$")
    piece = F.when(after.isNull(), F.col("t")).when(hyphen, F.expr("left(t, char_length(t) - 1)")).when(tight, F.col("t")).otherwise(F.concat("t", F.lit(" ")))
    none = F.lit(False) if bare is None else F.col(bare)
    pieces = rows.select(id_col, "block", (F.col("heading") & ~none).alias("heading"), none.alias("__none"), F.struct("page", "i", piece.alias("s")).alias("x"))
    blocks = pieces.groupBy(id_col, "block").agg(F.array_sort(F.collect_list("x")).alias("xs"), F.max("heading").alias("head"), F.max("__none").alias("none"))
    text = F.when(F.col("none"), C.EMPTY_PAGES).otherwise(trim(F.array_join(F.transform("xs", lambda x: x["s"]), "")))
    blocks = blocks.select(id_col, F.col("block").cast("int").alias("b"), F.when(F.col("head"), "h").otherwise("p").alias("k"), text.alias("t"))
    if pages is None:
        return blocks
    empty = pages.select(id_col).distinct().join(lines.select(id_col).distinct(), id_col, "left_anti")
    return blocks.transform(stacked, empty.select(id_col, F.lit(0).alias("b"), F.lit("p").alias("k"), F.lit(C.EMPTY_PAGES).alias("t")))


def page_starts(lines: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, starts, n_blocks): for each page the number of blocks opened before it, i.e. its first block or the one that goes on."""
    by_page = Window.partitionBy(id_col).orderBy("page")
    opened = ended_blocks(lines, id_col).groupBy(id_col, "page").agg(F.sum(F.col("new").cast("int")).alias("n"))
    before = F.coalesce(F.sum("n").over(by_page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    # pages without lines begin where the next one with lines does
    since = F.col("page") - F.coalesce(F.lag("page").over(by_page), F.lit(-1))
    opened = opened.select(id_col, "page", "n", before.alias("before"), since.alias("since"))
    runs = F.array_sort(F.collect_list(F.struct("page", "before", "since")))
    listed = opened.groupBy(id_col).agg(F.flatten(F.transform(runs, lambda r: F.array_repeat(r["before"], r["since"]))).alias("starts"), F.sum("n").cast("int").alias("n_blocks"))
    if pages is None:
        return listed
    listed = pages.select(id_col, "n_pages").join(listed, id_col, "left").withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0)))
    some = F.coalesce("starts", F.array().cast("array<int>"))
    rest = F.array_repeat("n_blocks", F.greatest(F.lit(0), F.col("n_pages") - F.size(some)))
    return listed.select(id_col, F.slice(F.concat(some, rest), F.lit(1), F.greatest(F.lit(0), F.col("n_pages"))).alias("starts"), "n_blocks")


def page_documents(lines: DataFrame, outline: DataFrame, id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Lines and outline entries (id, seq, title, page) to tables: scanned (id, n_pages), blocks, units, starts.

    Documents with too little text for their pages are scanned and have no blocks; chapters
    come from the outline where there is a usable one, else from headings.
    """
    tested, doc = scan_test(lines, id_col=id_col), Window.partitionBy(id_col)
    counted = lines.withColumns({"__pages": F.max("page").over(doc) + 1, "__chars": F.coalesce(F.sum(F.char_length("t")).over(doc), F.lit(0))})
    read = counted.where(F.col(id_col).isNotNull() & ~too_little(F.col("__pages"), F.col("__chars"))).select(*lines.columns)
    clean, pages = strip_running_heads(read, id_col=id_col), tested.where("NOT scanned").select(id_col, "n_pages")
    # documents without a line left go along in the one pass over all lines
    blocks = lines_to_blocks(strip_running_heads(read, id_col=id_col, bare="__bare"), id_col, bare="__bare")
    starts = page_starts(clean, pages, id_col)
    n_blocks = blocks.groupBy(id_col).agg(F.count("*").cast("int").alias("n_blocks"))
    outlined = with_sizes(outline_chapters(entries=outline, starts=starts.select(id_col, "starts"), n_blocks=n_blocks, id_col=id_col), blocks, id_col)
    headed = heading_chapters(blocks.join(outlined.select(id_col).distinct(), id_col, "left_anti"), id_col)
    units = reading_units(outlined.transform(stacked, headed.select(*outlined.columns)), blocks, id_col)
    return {"scanned": tested.where("scanned").select(id_col, "n_pages"), "blocks": blocks, "units": units, "starts": starts}


def scan_test(lines: DataFrame, pages: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, n_pages, n_chars, scanned): too little text for its pages."""
    chars = F.sum(F.char_length("t")).alias("n_chars")
    if pages is None:
        j = lines.groupBy(id_col).agg((F.max("page") + 1).alias("n_pages"), chars)
    else:
        j = pages.join(lines.groupBy(id_col).agg(chars), id_col, "left")
    n_chars = F.coalesce("n_chars", F.lit(0))
    return j.select(id_col, "n_pages", n_chars.alias("n_chars"), too_little(F.col("n_pages"), n_chars).alias("scanned"))


def too_little(n_pages: Column, n_chars: Column) -> Column:
    return (n_pages <= 0) | (n_chars < SCANNED_BELOW * n_pages)


def flat_entries(outline: DataFrame, id_col: str = "doc_id", *further: Column | str) -> DataFrame:
    """flat_outline() with (seq, sub) as seq, and with further columns of the outline's rows: no window, so that what is asked of these is asked before rows are sorted."""
    entry = lambda e: F.struct(e["title"].cast("string").alias("title"), e["page"].cast("int").alias("page"))
    below = F.transform("children", entry)
    both = F.concat(F.array(F.struct("title", F.col("page").cast("int").alias("page"))), F.coalesce(below, F.array().cast("array<struct<title:string,page:int>>")))
    rows = outline.select(id_col, "seq", *further, F.posexplode(both).alias("sub", "e"))
    return rows.select(id_col, F.struct("seq", "sub").alias("seq"), "e.title", "e.page", *further).where("page IS NOT NULL")


def flat_outline(outline: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entries (id, seq, title, page, children: array<struct<title,page>>) of two levels in reading order, unresolved ones gone."""
    return flat_entries(outline, id_col).select(id_col, (F.row_number().over(Window.partitionBy(id_col).orderBy("seq")) - 1).alias("seq"), "title", "page")


def outline_chapters(entries: DataFrame, starts: DataFrame, n_blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, title): outline entries (id, seq, title, page from 1) as chapters over blocks."""
    return chapters_of_entries(entries.where("coalesce(title, '') <> ''").join(starts, id_col).join(n_blocks.select(id_col, "n_blocks"), id_col), id_col)


def chapters_of_entries(entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """outline_chapters() of entries that carry their document's `starts` and `n_blocks`."""
    doc = Window.partitionBy(id_col)
    page = F.greatest(F.lit(1), F.least(F.size("starts"), F.coalesce(F.nullif("page", F.lit(0)), F.lit(1))))
    rows = entries.where("coalesce(title, '') <> ''").select(id_col, "seq", "title", "n_blocks", F.get("starts", page - 1).alias("start")).where("start IS NOT NULL")
    rows = rows.withColumn("__prev", F.lag("start").over(doc.orderBy("seq"))).where("__prev IS NULL OR __prev <> start")
    rows = rows.select(id_col, "seq", trim(F.col("title")).alias("title"), "start", "n_blocks")
    order = doc.orderBy("start", "seq")
    rows = rows.withColumns({"__end": F.coalesce(F.lead("start").over(order), F.col("n_blocks")).cast("int"), "__first": F.row_number().over(order) == 1})
    chapter = lambda title, start, end: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), title.alias("title"))
    own = F.array(chapter(F.col("title"), F.col("start"), F.col("__end")))
    front = F.array(chapter(F.lit(C.FRONT), F.lit(0), F.col("start")))
    found = F.explode(F.when(F.col("__first") & (F.col("start") > 0), F.concat(front, own)).otherwise(own))
    return rows.select(id_col, found.alias("c")).select(id_col, "c.*").where("end > start")
