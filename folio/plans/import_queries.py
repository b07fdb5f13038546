"""Registered queries over imports: mixed folders, books of several files, texts in foreign encodings, each with its SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.rows import in_small_batches, stacked
from folio.plans import sql
from folio.plans.tables import spread, table
from folio.sources import archive as A
from folio.sources import files as E
from folio.sources import importing as I

PAGES_A_BOOK = 4
END = '<p id="end">The end</p>'
CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/book.opf"/></rootfiles></container>'


def archived(members: dict[str, str]) -> bytes:
    """A zip of the same bytes whenever it is made."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def book_of(number: int, pages: list[dict]) -> bytes:
    """Pages (page_id, html) as the files of a book, in order; contents in a navigation document or, in odd books, in an NCX.

    Each file ends in a block that the contents point to by a fragment; some files are missing.
    """
    file = lambda p: f"text/p%20{p['page_id']}.xhtml"
    kind = 'media-type="application/xhtml+xml"'
    items = "".join(f'<item id="f{p["page_id"]}" href="{file(p)}" {kind}/>' for p in pages) + f'<item id="cover" href="cover.xhtml" {kind}/>'
    odd = number % 2 == 1
    items += f'<item id="ncx" href="toc.ncx" media-type="{A.NCX_TYPE}"/>' if odd else f'<item id="nav" href="nav.xhtml" properties="nav" {kind}/>'
    refs = '<itemref idref="cover" linear="no"/>' + "".join(f'<itemref idref="f{p["page_id"]}"/>' for p in pages)
    package = f'<package xmlns="http://www.idpf.org/2007/opf"><metadata><title>Book {number}</title></metadata><manifest>{items}</manifest><spine{" toc='ncx'" if odd else ""}>{refs}</spine></package>'
    point = lambda label, href, inner="": f'<navPoint><navLabel><text>{label}</text></navLabel><content src="{href}"/>{inner}</navPoint>'
    entry = lambda label, href, inner="": f'<li><a href="{href}">{label}</a>{inner and f"<ol>{inner}</ol>"}</li>'
    one = point if odd else entry
    listed = one("Cover", "cover.xhtml") + "".join(one(f"File {p['page_id']}", file(p), one(f"End {p['page_id']}", file(p) + "#end")) for p in pages)
    contents = {"o/toc.ncx": f"<ncx><navMap>{listed}</navMap></ncx>"} if odd else {"o/nav.xhtml": f'<html><body><nav epub:type="toc"><ol>{listed}</ol></nav></body></html>'}
    ended = lambda html: html.replace("</body>", f"{END}</body>") if "</body>" in html else html + END
    texts = {f"o/text/p {p['page_id']}.xhtml": ended(p["html"] or "") for p in pages if p["page_id"] % 9 != 4}
    return archived({"META-INF/container.xml": CONTAINER, "o/book.opf": package, "o/cover.xhtml": "<p>not read</p>", **contents, **texts})


def books_of_files(spark, sf_dir) -> DataFrame:
    """(id, content): books of PAGES_A_BOOK pages."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            books = [book_of(r["book"], r["pages"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["book"].cast(pa.string()), pa.array(books, pa.binary())], names=["id", "content"])

    grouped = table(spark, sf_dir, "pages").groupBy(F.floor(F.col("page_id") / PAGES_A_BOOK).alias("book")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("pages"))
    return in_small_batches(grouped).mapInArrow(pack, "id string, content binary")


def book_blocks(spark, sf_dir):
    return A.read_books(books_of_files(spark, sf_dir))["blocks"]


def book_contents(spark, sf_dir):
    return A.read_books(books_of_files(spark, sf_dir))["toc"]


def mixed_files(spark, sf_dir) -> DataFrame:
    """(name, content): documents as texts, some of them called PDF, and pages as books of one file, some of them cut off."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = '<package><metadata><title>T</title></metadata><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/></spine></package>'
        for batch in batches:
            books = [archived({"META-INF/container.xml": CONTAINER, "o/book.opf": package, "o/a.xhtml": html or ""}) for html in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(books, pa.binary())], names=["page_id", "content"])

    docs, pages = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), spread(table(spark, sf_dir, "pages").select("page_id", "html"), "page_id")
    ending = F.when(F.col("doc_id") % 7 == 0, ".pdf").otherwise(".txt")
    texts = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), ending).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".epub"))
    cut = F.when(F.col("page_id") % 10 == 0, F.concat(F.substring("content", 1, 20), name.cast("binary"))).otherwise(F.col("content"))
    return texts.transform(stacked, in_small_batches(pages).mapInArrow(pack, "page_id bigint, content binary").select(name.alias("name"), cut.alias("content")))


def imported_files(spark, sf_dir):
    """The catalogue of an import of mixed files."""
    tables, _ = I.imported(mixed_files(spark, sf_dir))
    return tables["catalogue"].select("name", "format", "title", "encoding", "n_blocks", "total_chars", F.col("error").isNotNull().alias("failed"))


def two_byte_letters() -> str:
    """Characters for a to z that are unlike in Big5 and GB18030: no Big5 text has the second byte that they have in GB18030."""

    def fits(c: str) -> bool:
        try:
            big5, gb = c.encode("big5"), c.encode("gb18030")
        except UnicodeEncodeError:
            return False
        return len(big5) == len(gb) == 2 and 0x80 <= gb[1] <= 0xA0 and big5.decode("big5hkscs") == c

    return "".join([c for c in map(chr, range(0x4E00, 0x5400)) if fits(c)][:26])


LETTERS = two_byte_letters()


def foreign_texts(spark, sf_dir):
    """Texts whose letters are Han, in Big5 and in GB18030, told apart and decoded."""

    @F.pandas_udf("binary")
    def encode(text: pd.Series, even: pd.Series) -> pd.Series:
        return pd.Series([t.encode("big5" if e else "gb18030") for t, e in zip(text, even, strict=True)], dtype=object)

    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x09\x0A\x0D\x20-\x7E]", "?")
    han = F.translate(plain, "abcdefghijklmnopqrstuvwxyz", LETTERS)
    docs = in_small_batches(spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))
    files = docs.select("doc_id", F.lit("txt").alias("format"), encode(han, F.col("doc_id") % 2 == 0).alias("content"))
    return E.decode_texts(files).select("doc_id", "encoding", F.sha2("text", 256).alias("sha"))


QUERIES = {f.__name__: f for f in (book_blocks, book_contents, imported_files, foreign_texts)}


def oracles(blocks: str) -> dict[str, str]:
    """SQL for QUERIES, given the common table expression of blocks of documents."""
    books = f"""{sql.PAGES},
        n AS (SELECT page_id, count(*) AS n FROM pb GROUP BY page_id),
        f AS (SELECT page_id, page_id // {PAGES_A_BOOK} AS book, page_id % 9 = 4 AS gone, CASE WHEN page_id % 9 = 4 THEN 1 ELSE coalesce(n, 0) + 1 END AS size FROM pages LEFT JOIN n USING (page_id)),
        fb AS (SELECT *, CAST(coalesce(sum(size) OVER w, 0) AS BIGINT) AS base, row_number() OVER (PARTITION BY book ORDER BY page_id) - 1 AS idx FROM f WINDOW w AS (PARTITION BY book ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    return {
        "book_blocks": f"""WITH {books} SELECT CAST(book AS VARCHAR) AS id, base + b AS b, k, t FROM pb JOIN fb USING (page_id) WHERE NOT gone
            UNION ALL SELECT CAST(book AS VARCHAR), base + size - 1, 'p', CASE WHEN gone THEN '{A.UNREADABLE.format("missing")}' ELSE 'The end' END FROM fb""",
        "book_contents": f"""WITH {books} SELECT CAST(book AS VARCHAR) AS id, 2 * idx AS ti, 'File ' || page_id AS t, CAST(0 AS BIGINT) AS lv, base AS b FROM fb
            UNION ALL SELECT CAST(book AS VARCHAR), 2 * idx + 1, 'End ' || page_id, 1, CASE WHEN gone THEN base ELSE base + size - 1 END FROM fb""",
        "imported_files": f"""WITH {blocks}, {sql.PAGES},
            dn AS (SELECT doc_id, coalesce(text, '') AS c, 'd' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '.pdf' ELSE '.txt' END AS name FROM documents),
            dg AS (SELECT min(name) AS name, arg_min(doc_id, name) AS doc_id FROM dn GROUP BY c),
            dx AS (SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM blocks GROUP BY doc_id),
            pn AS (SELECT page_id, page_id % 10 = 0 AS cut, 'p' || page_id || '.epub' AS name, coalesce(html, '') AS c FROM pages),
            pg AS (SELECT min(name) AS name, arg_min(page_id, name) AS page_id, cut FROM pn GROUP BY cut, CASE WHEN cut THEN name ELSE c END),
            px AS (SELECT page_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM pb GROUP BY page_id)
            SELECT name, right(name, 3) AS format, 'd' || doc_id AS title, CASE WHEN name LIKE '%.txt' THEN 'utf-8' END AS encoding, CASE WHEN name LIKE '%.txt' THEN n END AS n_blocks, CASE WHEN name LIKE '%.txt' THEN chars END AS total_chars, name LIKE '%.pdf' AS failed FROM dg JOIN dx USING (doc_id)
            UNION ALL SELECT name, 'epub', CASE WHEN cut OR n IS NULL THEN 'p' || page_id ELSE 'T' END, CASE WHEN NOT cut AND n > 0 THEN 'utf-8' END, CASE WHEN NOT cut THEN n END, CASE WHEN NOT cut THEN chars END, cut OR n IS NULL FROM pg LEFT JOIN px USING (page_id)""",
        "foreign_texts": f"""WITH h AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x09\\x0A\\x0D\\x20-\\x7E]', '?', 'g') AS t FROM documents)
            SELECT doc_id, CASE WHEN NOT regexp_matches(t, '[a-z]') THEN 'utf-8' WHEN doc_id % 2 = 0 THEN 'big5' ELSE 'gb18030' END AS encoding, sha256(translate(t, 'abcdefghijklmnopqrstuvwxyz', '{LETTERS}')) AS sha FROM h""",
    }
