"""Zipped XHTML books: members, package file, reading order, chapters and contents.

The archive and the markup are read in Arrow batches; what belongs together (reading order
with manifest, members with reading order, contents with blocks) is joined by Spark.
A book that cannot be opened is a row of `rejected` with the reason; a member that cannot
be read becomes one block that says so and does not stop the others.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions.rows import in_small_batches, stacked
from folio.functions.text import dir_of, fragment_of, resolve_path
from folio.operators.documents import reading_units, with_sizes
from folio.operators.toc import first_labels, resolve_toc
from folio.sources import zipped
from folio.sources.markup import cleaned, parse_pages, parsed

# Fixed values.
CONTAINER, ENCRYPTION = "META-INF/container.xml", "META-INF/encryption.xml"
NCX_TYPE = "application/x-dtbncx+xml"
UNREADABLE, NTH, NTH_FAILED = "（此章無法解析：{}）", "第 {} 篇", "第 {} 篇（解析失敗）"


def archive_members(files: DataFrame, member_bytes: int | None = None) -> DataFrame:
    """(id, name, content, error): the members of each archive (id, content), or one row with the error of a broken one.

    member_bytes: members larger than this are reported as unreadable; by default none are.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for book, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        for m in z.infolist():
                            if m.is_dir():
                                continue
                            try:
                                if member_bytes is not None and m.file_size > member_bytes:
                                    raise ValueError(f"{m.file_size} bytes")
                                rows.append({"id": book, "name": m.filename, "content": z.read(m), "error": None})
                                if len(rows[-1]["content"]) > 1 << 20:  # large members go on by themselves
                                    yield pa.RecordBatch.from_pylist(rows, schema)
                                    rows = []
                            except Exception as e:  # one member's fault is not the book's
                                rows.append({"id": book, "name": m.filename, "content": None, "error": str(e) or type(e).__name__})
                except zipfile.BadZipFile as e:
                    rows.append({"id": book, "name": None, "content": None, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return in_small_batches(files).select("id", "content").mapInArrow(read, "id string, name string, content binary, error string")


def packages(members: DataFrame) -> DataFrame:
    """One row per book: id, opf_path, title, author, lang, items, refs, toc_id, or the reason it is rejected in `error`."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    flags = members.groupBy("id").agg(
        F.max(F.when(F.col("name").isNull(), F.col("error"))).alias("broken"), F.max(F.col("name") == ENCRYPTION).alias("locked"), F.max(F.when(F.col("name") == CONTAINER, text)).alias("container")
    )
    root = F.regexp_extract("container", r"(?s)<(?:\w+:)?rootfile\b[^>]*?full-path\s*=\s*[\"']([^\"']*)[\"']", 1)
    flags = flags.withColumn("opf_path", resolve_path(F.lit(""), F.coalesce(root, F.lit(""))))
    error = F.when(F.col("broken").isNotNull(), F.col("broken")).when(F.col("locked"), "protected").when(F.col("container").isNull(), "no container").when(F.col("opf_path") == "", "no package file")
    flags = flags.select("id", "opf_path", error.alias("error"))
    schema = "id string, title string, author string, lang string, items array<struct<iid:string,href:string,type:string,props:string>>, refs array<struct<idref:string,linear:string>>, toc_id string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        item, ref = pa.struct([(k, text) for k in ("iid", "href", "type", "props")]), pa.struct([("idref", text), ("linear", text)])
        arrow = pa.schema([("id", text), ("title", text), ("author", text), ("lang", text), ("items", pa.list_(item)), ("refs", pa.list_(ref)), ("toc_id", text)])
        for batch in batches:
            rows = []
            for book, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parsed(xml or "")
                first = lambda tag: next((t for n in root.find(tag) if (t := cleaned(n.text()))), "")  # noqa: B023, E731
                items = [{"iid": n.attrs.get("id"), "href": n.attrs.get("href"), "type": n.attrs.get("media-type", ""), "props": n.attrs.get("properties", "")} for n in root.find("item") if n.attrs.get("id") and n.attrs.get("href")]
                refs = [{"idref": n.attrs.get("idref"), "linear": n.attrs.get("linear", "")} for n in root.find("itemref")]
                toc = next((n.attrs.get("toc", "") for n in root.find("spine")), "")
                rows.append({"id": book, "title": first("title"), "author": first("creator"), "lang": first("language"), "items": items, "refs": refs, "toc_id": toc})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    opf = in_small_batches(members).withColumnRenamed("name", "opf_path").join(flags.where("error IS NULL"), ["id", "opf_path"]).select("id", text.alias("xml")).mapInArrow(read, schema)
    j = flags.join(opf, "id", "left")
    return j.withColumn("error", F.coalesce("error", F.when(F.col("items").isNull(), "no package file")))


def manifest(books: DataFrame) -> DataFrame:
    """(id, iid, path, type, props, pos) of the package's items, the last of equal ids."""
    rows = books.where("error IS NULL").select("id", "opf_path", F.posexplode("items").alias("pos", "i"))
    rows = rows.select("id", "pos", "i.iid", resolve_path(dir_of(F.col("opf_path")), F.col("i.href")).alias("path"), "i.type", "i.props")
    return rows.groupBy("id", "iid").agg(F.max_by(F.struct("path", "type", "props", "pos"), "pos").alias("m")).select("id", "iid", "m.*")


def reading_order(books: DataFrame, items: DataFrame) -> DataFrame:
    """(id, idx, path): what is read, in order; auxiliary and unreadable kinds are left out."""
    refs = books.where("error IS NULL").select("id", F.posexplode("refs").alias("pos", "r")).select("id", "pos", F.col("r.idref").alias("iid"), "r.linear")
    readable = F.col("type").rlike("html|xml") | F.col("path").rlike(r"(?i)\.x?html?$")
    rows = refs.where("linear <> 'no'").join(items.select("id", "iid", "path", "type"), ["id", "iid"]).where(readable)
    return rows.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("pos")) - 1).alias("idx"), "path")


def contents(books: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """(id, ti, path, frag, label, lv) from the navigation document, or from the NCX where there is none."""
    have = members.where("content IS NOT NULL").select("id", F.col("name").alias("path"))
    nav = items.where(F.col("props").rlike(r"(^|\s)nav(\s|$)")).groupBy("id").agg(F.max_by("path", "pos").alias("path")).join(have, ["id", "path"], "left_semi").select("id", "path", F.lit(0).alias("rank"))
    named = books.where("toc_id <> ''").select("id", F.col("toc_id").alias("iid")).join(items, ["id", "iid"]).select("id", "path", F.lit(1).alias("rank"))
    typed = items.where(F.col("type") == NCX_TYPE).groupBy("id").agg(F.max_by("path", "pos").alias("path")).select("id", "path", F.lit(2).alias("rank"))
    source = nav.transform(stacked, named).transform(stacked, typed).groupBy("id").agg(F.min_by("path", "rank").alias("path"))
    pages = members.withColumnRenamed("name", "path").join(source, ["id", "path"]).withColumn("html", F.make_valid_utf8(F.col("content").cast("string")))
    rows = parse_pages(pages, ["id", "path"]).select("id", F.col("path").alias("from"), F.posexplode("nav").alias("ti", "x"))
    return rows.select("id", "ti", resolve_path(dir_of(F.col("from")), F.col("x.href")).alias("path"), fragment_of(F.col("x.href")).alias("frag"), "x.label", "x.lv").where("path <> ''")


def read_books(files: DataFrame) -> dict[str, DataFrame]:
    """Archives (id, content) to tables: books, blocks, units, toc, rejected."""
    return books_of_members(archive_members(files))


def load_books(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The same for the archives under `path`, by the source of zipped archives; their paths are their ids."""
    zipped.register(spark)
    return books_of_members(spark.read.format("folio_archive").load(path).select(F.col("path").alias("id"), "name", "content", "error"))


def books_of_members(members: DataFrame) -> dict[str, DataFrame]:
    """Members (id, name, content, error) to tables: books, blocks, units, toc, rejected."""
    books = packages(members)
    items = manifest(books)
    order = reading_order(books, items)
    read = order.join(members.withColumnRenamed("name", "path"), ["id", "path"], "left")
    failed = F.col("content").isNull()
    pages = parse_pages(read.withColumn("html", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("bad", F.when(failed, F.coalesce("error", F.lit("missing")))), ["id", "idx", "path", "bad"])
    note = lambda form, x: F.concat(F.lit(form.split("{}")[0]), x, F.lit(form.split("{}")[1]))
    one = F.array(F.struct(F.lit("p").alias("k"), note(UNREADABLE, F.col("bad")).alias("t")))
    pages = pages.withColumn("blocks", F.when(F.col("bad").isNotNull(), one).otherwise(F.col("blocks")))
    book = Window.partitionBy("id").orderBy("idx")
    pages = pages.withColumn("base", F.coalesce(F.sum(F.size("blocks")).over(book.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int"))
    blocks = pages.select("id", "base", F.posexplode("blocks").alias("i", "x")).select("id", (F.col("base") + F.col("i")).alias("b"), "x.k", "x.t")
    totals = blocks.groupBy("id").agg(F.count("*").alias("n_blocks"))
    toc = contents(books, items, members)
    chapters = with_sizes(chapter_starts(pages, toc, totals), blocks, "id")
    units = reading_units(chapters, blocks, "id")
    bases = pages.groupBy("id", "path").agg(F.max_by("base", "idx").alias("base"))
    fragments = pages.select("id", "path", "base", F.explode("ids").alias("frag", "at")).groupBy("id", "path", "frag").agg(F.max(F.col("base") + F.col("at")).alias("b"))
    resolved = resolve_toc(toc, bases, fragments, totals, "id")
    empty = books.where("error IS NULL").join(totals, "id", "left_anti").select("id", F.lit("nothing to read").alias("error"))
    rejected = books.where("error IS NOT NULL").select("id", "error").transform(stacked, empty)
    return {"books": books.where("error IS NULL").join(totals, "id", "left_semi").select("id", "title", "author", "lang"), "blocks": blocks, "units": units, "toc": resolved, "rejected": rejected}


def chapter_starts(pages: DataFrame, toc: DataFrame, totals: DataFrame) -> DataFrame:
    """(id, start, end, title): each file opens a chapter, and so does each contents entry that points into it.

    A file's title is its contents label, else a heading among its first blocks, else its number.
    """
    filled = pages.where(F.size("blocks") > 0)
    entries = first_labels(toc, "id").select("id", "path", "frag", "label", "ti")
    whole = entries.where("frag = ''").groupBy("id", "path").agg(F.min_by("label", "ti").alias("file_label"))
    nth = F.concat(F.lit(NTH.split("{}")[0]), (F.col("idx") + 1).cast("string"), F.lit(NTH.split("{}")[1]))
    heads = F.filter(F.slice("blocks", 1, 4), lambda b: b["k"] == "h")
    at = filled.select("id", "path", "idx", "base", F.explode("ids").alias("frag", "i"))
    points = entries.where("frag <> ''").join(at, ["id", "path", "frag"])
    zero = points.where("i = 0").groupBy("id", "idx").agg(F.max_by("label", "ti").alias("zero_label"))
    first = filled.join(whole, ["id", "path"], "left").join(zero, ["id", "idx"], "left")
    bad = F.when(F.col("bad").isNotNull(), F.concat(F.lit(NTH_FAILED.split("{}")[0]), (F.col("idx") + 1).cast("string"), F.lit(NTH_FAILED.split("{}")[1])))
    title = F.coalesce(bad, F.nullif("file_label", F.lit("")), F.nullif("zero_label", F.lit("")), F.get(heads, 0)["t"], nth)
    starts = first.select("id", F.col("base").alias("start"), title.alias("title"))
    inner = points.where("i > 0").withColumn("start", F.col("base") + F.col("i")).groupBy("id", "start").agg(F.min_by("label", "ti").alias("title"))
    every = starts.transform(stacked, inner).join(totals, "id")
    end = F.coalesce(F.lead("start").over(Window.partitionBy("id").orderBy("start")), F.col("n_blocks"))
    return every.select("id", "start", end.cast("int").alias("end"), "title")
