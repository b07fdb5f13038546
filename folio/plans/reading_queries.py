"""Registered queries over reading: ends of books, saves of pages, opened books, wanted voices, page documents, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import chars as C
from folio.operators import layout as L
from folio.operators import library as B
from folio.operators import position as P
from folio.operators import speech as S
from folio.plans.library_queries import picked
from folio.plans.tables import blocks_of, page_lines, spread, table

BLOCKS_A_PAGE, PAGES, BLOCKS_A_UNIT = 3, 5, 4
VOICES, LANGS, WANTED = ("Google ", "Karen ", "Meijia ", "Plain "), ("zh-TW", "zh-CN", "en-US", "en-GB", "fr-FR", "zh_TW"), ("3", "5", "none")


def ended_books(spark, sf_dir):
    """The save that going on from the last unit of each document makes."""
    ends = B.end_of_book(blocks_of(spark, sf_dir), F.lit(7).cast("long"))
    return ends.select("id", "anchor.b", "anchor.o", "percent", "ts")


def paged_saves(spark, sf_dir):
    """A page of each document saved, every other document being a scan."""
    p = P.prefix(blocks_of(spark, sf_dir))
    docs = p.groupBy(F.col("doc_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "before"))), lambda x: x["before"]).alias("before"), F.max("total").alias("total"))
    docs = docs.withColumn("starts", F.sequence(F.lit(0), F.size("before") - 1, F.lit(BLOCKS_A_PAGE)))
    books = docs.select("id", F.when(F.col("id") % 2 == 0, "pdf").otherwise("pdf-image").alias("format"))
    saves = docs.select("id", (F.col("id") % (PAGES + 3)).cast("int").alias("page"), F.when(F.col("id") % 11 == 0, 0).otherwise(PAGES).alias("n_pages"), F.col("id").alias("ts"))
    return B.page_saves(saves, books, docs).select("id", "anchor.b", "percent", "ts")


def opened_books(spark, sf_dir):
    """Books opened where they were left: the unit, and the notes in the order of the text."""
    sizes = blocks_of(spark, sf_dir).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").cast("int").alias("n"))
    units = sizes.select("id", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / BLOCKS_A_UNIT).cast("int") - 1)).alias("ci"))
    units = units.select("id", "ci", (F.col("ci") * BLOCKS_A_UNIT).alias("start"), F.least(F.col("ci") * BLOCKS_A_UNIT + BLOCKS_A_UNIT, F.col("n")).alias("end"))
    books = sizes.select("id", F.when(F.col("id") % 9 != 0, F.struct((F.col("id") % 13).cast("int").alias("b"), F.lit(0).alias("o"))).alias("anchor"))
    labels = table(spark, sf_dir, "labels")
    note = lambda k, b, o: labels.select(F.concat(F.lit(k), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("book_id"), b.cast("int").alias("b"), o.cast("int").alias("o"), F.lit("t").alias("text"))
    notes = note("n", F.col("quality"), F.col("toxic")).unionByName(note("m", F.lit(1) - F.col("quality"), F.lit(0)))
    opened = B.open_books(books, units, notes)
    return opened.select("id", "ci", F.array_join(F.transform("notes", lambda x: F.concat(x["b"].cast("string"), F.lit(":"), x["o"].cast("string"), F.lit(":"), x["note"])), " ").alias("notes"))


def wanted_voices(spark, sf_dir):
    """The voice that is used for each language when one is wanted that is there, speaks another language, or is gone."""
    k = F.col("s_suppkey")
    voices = table(spark, sf_dir, "supplier").select(F.concat(picked(VOICES, k % 4), F.col("s_name")).alias("name"), picked(LANGS, k % 6).alias("lang"), k.cast("string").alias("uri"))
    one = lambda which, wanted: S.pick_voice(voices, which, wanted).select(F.lit(which).alias("which"), F.lit(wanted).alias("wanted"), "uri")
    found = [one(which, wanted) for which in ("zh", "en") for wanted in WANTED]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def page_documents(spark, sf_dir) -> dict[str, DataFrame]:
    outline = spread(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").where("doc_id % 3 = 0").select("doc_id", F.lit(0).alias("seq"), F.lit("Whole").alias("title"), F.lit(1).alias("page"))
    return L.page_documents(page_lines(spark, sf_dir), outline)


def page_document_blocks(spark, sf_dir):
    """Blocks of the page documents that hold enough text."""
    return page_documents(spark, sf_dir)["blocks"]


def page_documents_scanned(spark, sf_dir):
    """Page documents that hold too little text for their pages."""
    return page_documents(spark, sf_dir)["scanned"]


QUERIES = {f.__name__: f for f in (ended_books, paged_saves, opened_books, wanted_voices, page_document_blocks, page_documents_scanned)}


def oracles(blocks: str, prefix: str, lines_to_blocks: str, scan_test: str) -> dict[str, str]:
    """SQL for QUERIES, given the common table expressions and the SQL of two queries of registry."""
    ranked = """v AS (SELECT ['Google ', 'Karen ', 'Meijia ', 'Plain '][s_suppkey % 4 + 1] || s_name AS name, s_suppkey % 4 AS n, s_suppkey % 6 AS l, CAST(s_suppkey AS VARCHAR) AS uri FROM supplier),
            r AS (SELECT 'zh' AS which, uri, row_number() OVER (ORDER BY CASE WHEN l <> 1 THEN 0 ELSE 1 END, CASE WHEN n IN (0, 2) THEN 0 ELSE 1 END, name, uri) AS place FROM v WHERE l IN (0, 1, 5)
                  UNION ALL SELECT 'en', uri, row_number() OVER (ORDER BY CASE WHEN n IN (0, 1) THEN 0 ELSE 1 END, name, uri) FROM v WHERE l IN (2, 3))"""
    return {
        "ended_books": f"WITH {blocks} SELECT doc_id AS id, max(b) AS b, CAST(arg_max(length(t), b) AS BIGINT) AS o, 1.0::DOUBLE AS percent, CAST(7 AS BIGINT) AS ts FROM blocks GROUP BY doc_id",
        "paged_saves": f"""WITH {blocks}, {prefix},
            d AS (SELECT doc_id AS id, CAST(count(*) AS BIGINT) AS n, max(total) AS total, doc_id % {PAGES + 3} AS page FROM p GROUP BY doc_id),
            a AS (SELECT *, (greatest(1, least((n - 1) // {BLOCKS_A_PAGE} + 1, CASE WHEN page = 0 THEN 1 ELSE page END)) - 1) * {BLOCKS_A_PAGE} AS first FROM d WHERE id % 11 <> 0)
            SELECT a.id, CASE WHEN a.id % 2 = 0 THEN first ELSE page - 1 END AS b, CASE WHEN a.id % 2 <> 0 THEN page / {PAGES} WHEN a.total = 0 THEN 0 ELSE p.before / a.total END AS percent, a.id AS ts FROM a JOIN p ON p.doc_id = a.id AND p.b = a.first""",
        "opened_books": f"""WITH {blocks}, s AS (SELECT doc_id AS id, count(*) AS n, CASE WHEN doc_id % 9 <> 0 THEN doc_id % 13 ELSE 0 END AS b FROM blocks GROUP BY doc_id),
            m AS (SELECT doc_id AS id, quality AS b, toxic AS o, 'n' || doc_id AS note FROM labels UNION ALL SELECT doc_id, 1 - quality, 0, 'm' || doc_id FROM labels),
            l AS (SELECT id, string_agg(b || ':' || o || ':' || note, ' ' ORDER BY b, o, note) AS notes FROM m GROUP BY id)
            SELECT s.id, CAST(CASE WHEN b < n THEN b // {BLOCKS_A_UNIT} ELSE 0 END AS BIGINT) AS ci, notes FROM s LEFT JOIN l USING (id)""",
        "wanted_voices": f"WITH {ranked} SELECT which, w.wanted, arg_min(uri, (CASE WHEN uri = w.wanted THEN 0 ELSE 1 END, place)) AS uri FROM r, (SELECT unnest({list(WANTED)}) AS wanted) w GROUP BY which, w.wanted",
        "page_document_blocks": f"""WITH found AS ({lines_to_blocks}), tested AS ({scan_test}), kept AS (SELECT doc_id FROM tested WHERE NOT scanned)
            SELECT doc_id, b, k, t FROM found WHERE doc_id IN (FROM kept) UNION ALL SELECT doc_id, 0, 'p', '{C.EMPTY_PAGES}' FROM kept WHERE doc_id NOT IN (SELECT doc_id FROM found)""",
        "page_documents_scanned": f"SELECT doc_id, n_pages FROM ({scan_test}) WHERE scanned",
    }
