"""Registered queries over the library's own operators, with equivalent SQL where SQL can express them.

Every query reads its whole tables.  The tables stand in for a library: documents are
plain texts, pages are the files of zipped books, conversations are chapters of turns,
events are saves of reading positions, benchmark items are quotes, labels are notes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.functions import chars as C
from folio.functions.segment import clauses, lang_runs
from folio.functions.text import base_name, format_of, pct, resolve_path, script_weights, size_label, solid_count, strip_speech_punctuation
from folio.operators import documents as D
from folio.operators import layout as L
from folio.operators import library as B
from folio.operators import position as P
from folio.operators import quotes as Q
from folio.operators import speech as S
from folio.operators import toc as O
from folio.plans import import_queries, library_queries, reading_queries, sql
from folio.plans.tables import LINES_A_PAGE, blocks_of, documents, page_lines, spread, table
from folio.sources import markup as M
from folio.streaming.progress import throttled_saves

def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as longs, as SQL counts them."""
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f.name) for f in df.schema])


def txt_blocks(spark, sf_dir):
    return blocks_of(spark, sf_dir)


def sentence_stats(spark, sf_dir):
    # the language goes along in the key
    docs = documents(spark, sf_dir, "lang").select(F.struct("doc_id", "lang").alias("doc_id"), "text")
    rows = S.block_sentences(D.txt_blocks(docs)).select(F.col("doc_id.lang").alias("lang"), F.char_length("t").alias("n"))
    return rows.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_chars"), F.max("n").alias("longest"))


def sentences(spark, sf_dir):
    return S.block_sentences(blocks_of(spark, sf_dir))


def clause_list(spark, sf_dir):
    rows = blocks_of(spark, sf_dir).select("doc_id", "b", F.posexplode(clauses(F.col("t"))).alias("c", "x"))
    return rows.select("doc_id", "b", "c", "x.t", "x.o", solid_count(F.col("x.t")).alias("solid"))


def speech_clean(spark, sf_dir):
    return blocks_of(spark, sf_dir).select("doc_id", "b", strip_speech_punctuation(F.col("t")).alias("say"))


def lang_weights(spark, sf_dir):
    han, latin = script_weights(F.col("t"))
    return blocks_of(spark, sf_dir).groupBy("doc_id").agg(F.sum(han).alias("cjk"), F.sum(latin).alias("latin"), F.sum(solid_count(F.col("t"))).alias("solid"))


def run_list(spark, sf_dir):
    rows = blocks_of(spark, sf_dir).withColumn("runs", lang_runs(F.col("t")))
    return rows.select("doc_id", "b", F.posexplode("runs").alias("r", "x")).select("doc_id", "b", "r", "x.t", "x.lang", "x.o")


def block_prefix_percent(spark, sf_dir):
    p = P.prefix(blocks_of(spark, sf_dir))
    share = P.share_of(F.col("before"), F.lit(0), F.col("total"))
    return p.select("doc_id", "b", "len", "before", "total", pct(share).alias("pct"))


def doc_stats(spark, sf_dir):
    return D.doc_stats(blocks_of(spark, sf_dir))


def chapter_units(spark, sf_dir):
    return D.document_units(blocks_of(spark, sf_dir))


def turns(spark, sf_dir):
    """Turns of conversations as blocks of one document; conversations are its units."""
    c = table(spark, sf_dir, "conversations")
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))
    return c, sizes


def block_chapter(spark, sf_dir):
    """For each turn the unit of four turns that holds it, in its own conversation."""
    c, sizes = turns(spark, sf_dir)
    units = sizes.select("conv_id", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / 4).cast("int") - 1)).alias("ci"), "n")
    units = units.select("conv_id", "ci", (F.col("ci") * 4).alias("start"), F.least(F.col("ci") * 4 + 4, F.col("n")).alias("end"))
    b = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return P.chapter_of(c.select("conv_id", "turn", b.alias("b")), units, "conv_id")


def conversation_prefix(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = P.prefix(c.select("conv_id", F.col("turn").alias("b"), F.col("text").alias("t")), "conv_id")
    return p.withColumnRenamed("b", "turn")


def anchor_at_percent(spark, sf_dir):
    targets = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("share"))
    return P.anchor_at_share(targets, blocks_of(spark, sf_dir))


def quote_locate(spark, sf_dir):
    return Q.locate_quotes(table(spark, sf_dir, "benchmark"), blocks_of(spark, sf_dir))


def remap_annotations(spark, sf_dir):
    """Documents parsed again without their first block: notes at the start of the middle block follow their quotes."""
    docs = documents(spark, sf_dir).select("doc_id", D.block_texts(F.col("text")).alias("ts"))
    n = F.size("ts")
    middle = F.floor(n / 2).cast("int")
    notes = docs.select("doc_id", middle.alias("b"), F.lit(0).alias("o"), F.substring(F.get("ts", middle), 1, 160).alias("quote"))
    again = docs.select("doc_id", F.posexplode(F.when(n > 1, F.slice("ts", F.lit(2), n)).otherwise(F.col("ts"))).alias("b", "t"))
    return P.remap_annotations(notes, blocks_of(spark, sf_dir), again).drop("quote")


def content_dedup(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("seq"))
    return B.import_files(files)


def shelf_order(spark, sf_dir):
    return B.shelf_order(table(spark, sf_dir, "events"), "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")))


def latest_progress(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    books = e.select(F.col("user_id").alias("id")).distinct().select("id", F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).alias("o")).alias("anchor"), F.lit(0.0).alias("percent"), F.lit(0).cast("long").alias("last_read_at"), F.lit(False).alias("finished"))
    # the tie of two saves at one time goes to the larger event id
    saves = e.select(F.col("user_id").alias("id"), F.struct(F.col("event_id").alias("b"), F.lit(0).alias("o")).alias("anchor"), (F.pmod(F.floor("value"), F.lit(100)) / 100).alias("percent"), F.struct(us.alias("us"), "event_id").alias("ts"))
    done = B.saved_progress(books.withColumn("last_read_at", F.lit(None).cast("struct<us:bigint,event_id:bigint>")), saves)
    return done.select("id", F.col("anchor.b").alias("event_id"), "percent", F.col("last_read_at.us").alias("last_read_at"), "finished")


def backup_merge(spark, sf_dir):
    """Progress of odd events brought into that of even ones."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    half = lambda r: e.where(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.max_by(F.struct(F.col("event_id").alias("b"), F.lit(0).alias("o")), F.struct(us, "event_id")).alias("anchor"), F.max(us).alias("last_read_at"), F.max_by(F.pmod(F.floor("value"), F.lit(3)) / 2, F.struct(us, "event_id")).alias("percent")).select(F.col("user_id").alias("id"), "anchor", "percent", "last_read_at", (F.col("percent") >= 1).alias("finished"))
    m = B.merge_backup(half(0), half(1))
    return m.select("id", F.col("anchor.b").alias("anchor_b"), "percent", "last_read_at", "finished", "updated")


def notes(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("book_id"), "quality", "toxic")


def export_semi(spark, sf_dir):
    books = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return B.exported_notes(notes(spark, sf_dir), books)


def cascade_delete(spark, sf_dir):
    ids = notes(spark, sf_dir).where("toxic = 1").select(F.col("book_id").alias("id"))
    left = B.delete_books({"documents": (table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id"), "notes": (notes(spark, sf_dir), "book_id")}, ids)
    return left["documents"].select("doc_id", F.lit("book").alias("kind")).unionByName(left["notes"].select(F.col("book_id").alias("doc_id"), F.lit("note").alias("kind")))


def noted_spans(spark, sf_dir):
    marks = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("b"), F.lit(0).alias("o"))
    return B.noted(blocks_of(spark, sf_dir).select("doc_id", "b", F.lit(0).alias("o")), marks)


def annot_counts(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(0).alias("annot_count"))
    return B.note_counts(books, notes(spark, sf_dir))


def running_heads(spark, sf_dir):
    return L.strip_running_heads(page_lines(spark, sf_dir)).select("doc_id", "page", "i", "t")


def lines_to_blocks(spark, sf_dir):
    return L.lines_to_blocks(L.strip_running_heads(page_lines(spark, sf_dir)))


def page_of_block(spark, sf_dir):
    starts = L.page_starts(L.strip_running_heads(page_lines(spark, sf_dir)))
    rows = starts.select("doc_id", "starts", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("b"))
    page = P.page_of_block(F.col("starts"), F.col("b"))
    return rows.select("doc_id", "b", page.alias("page"), P.block_of_page(F.col("starts"), page).alias("page_start"))


def scan_test(spark, sf_dir):
    return L.scan_test(page_lines(spark, sf_dir))


def pages_of(spark, sf_dir):
    return spread(table(spark, sf_dir, "pages"), "page_id")


def html_blocks(spark, sf_dir):
    return M.html_blocks(pages_of(spark, sf_dir))


def nav_toc(spark, sf_dir):
    return M.nav_toc(pages_of(spark, sf_dir))


def resolve_paths(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    rows = pages.select("page_id", "path", F.explode(F.array(*[F.lit(x) for x in ("a%20b/./c.html#top", "../up.html", "/root.html", "#only")])).alias("href"))
    base = F.regexp_replace("path", "/[^/]*$", "")
    return rows.select("page_id", "href", resolve_path(base, F.col("href")).alias("target"))


def toc_tree(spark, sf_dir):
    """Contents of each page over its own blocks: entries point at as many blocks from the start as their number."""
    parsed = M.parse_pages(pages_of(spark, sf_dir), ["page_id"])
    blocks = parsed.select("page_id", F.posexplode("blocks").alias("b", "x")).select("page_id", "b", "x.k", "x.t")
    entries = parsed.select("page_id", F.posexplode("nav").alias("ti", "x"), F.size("blocks").alias("n")).select("page_id", "ti", F.col("x.label").alias("t"), "x.lv", F.least("ti", F.col("n") - 1).alias("b"))
    return O.tree(entries, blocks, D.document_units(blocks, "page_id"), "page_id")


def speech_queue(spark, sf_dir):
    return S.speech_queue(blocks_of(spark, sf_dir))


def epoch_fence(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor("value").alias("epoch"))
    return S.epoch_fence(e, "user_id", "epoch", ["us", "event_id"])


def throttled(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("value").alias("pos"))
    return throttled_saves(e, "user_id", "ms", "pos", "event_id")


def file_labels(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("txt", "EPUB", "pdf", "md")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    return docs.select("doc_id", format_of(name).alias("format"), base_name(name).alias("title"), size_label(F.octet_length("text")).alias("size_label"))


QUERIES = {
    name: (lambda f: lambda spark, sf_dir: wide(f(spark, sf_dir)))(f)
    for name, f in {
        **library_queries.QUERIES,
        **import_queries.QUERIES,
        **reading_queries.QUERIES,
        "sentence_stats": sentence_stats, "txt_blocks": txt_blocks, "sentences": sentences, "clauses": clause_list, "speech_clean": speech_clean,
        "lang_weights": lang_weights, "lang_runs": run_list, "block_prefix_percent": block_prefix_percent, "doc_stats": doc_stats, "chapter_units": chapter_units,
        "block_chapter": block_chapter, "conversation_prefix": conversation_prefix, "anchor_at_percent": anchor_at_percent, "quote_locate": quote_locate,
        "remap_annotations": remap_annotations, "content_dedup": content_dedup, "shelf_order": shelf_order, "latest_progress": latest_progress,
        "backup_merge": backup_merge, "export_semi": export_semi, "cascade_delete": cascade_delete, "noted_spans": noted_spans, "annot_counts": annot_counts,
        "running_heads": running_heads, "lines_to_blocks": lines_to_blocks, "page_of_block": page_of_block, "scan_test": scan_test, "html_blocks": html_blocks,
        "nav_toc": nav_toc, "resolve_paths": resolve_paths, "toc_tree": toc_tree, "speech_queue": speech_queue, "epoch_fence": epoch_fence,
        "throttled_saves": throttled, "file_labels": file_labels,
    }.items()
}

_TRIM = sql.TRIM
_NL = "chr(10)"
#: CTE blocks(doc_id, b, k, t) over documents.
_BLOCKS = rf"""
    norm AS (SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(65279), ''), '\r\n?', {_NL}, 'g'), '[\x{{200B}}-\x{{200D}}\x{{2060}}]', '', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g') AS t FROM documents),
    cut AS (SELECT doc_id, list_filter(list_transform(CASE WHEN regexp_matches(t, '\n[{C.WS}]*\n') THEN regexp_split_to_array(t, '\n[{C.WS}]*\n+') ELSE string_split(t, {_NL}) END, lambda p: {_TRIM % 'p'}), lambda p: p <> '') AS ps FROM norm),
    filled AS (SELECT doc_id, CASE WHEN len(ps) = 0 THEN ['{C.EMPTY_FILE}'] ELSE ps END AS ps FROM cut),
    parts AS (SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS BIGINT) AS b, unnest(ps) AS t FROM filled),
    blocks AS (SELECT doc_id, b, CASE WHEN length(t) BETWEEN 1 AND {C.MAX_HEADING} AND (
        regexp_matches(t, '^第[{C.WS}]*[{C.NUMERALS}]+[{C.WS}]*[{C.UNITS}]') OR regexp_matches(t, '(?i)^(chapter|part|book|section)[{C.WS}]+([0-9]+|[ivxlcdm]+)\b') OR regexp_matches(t, '^({'|'.join(C.MATTER)})$')) THEN 'h' ELSE 'p' END AS k, t FROM parts)"""
_PREFIX = """
    p AS (SELECT doc_id, b, CAST(length(t) AS BIGINT) AS len, CAST(coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
          CAST(sum(length(t)) OVER (PARTITION BY doc_id) AS BIGINT) AS total FROM blocks)"""
_PCT = "CAST(least(100, greatest(0, floor({} * 100 + 0.5))) AS BIGINT)"
_COUNT = "CAST(sum(length(t) - length(regexp_replace(t, '[{}]', '', 'g'))) AS BIGINT)"
_US = "epoch_us(ts)"
_LINES = f"""
    tl AS (SELECT doc_id, source, list_filter(string_split(text, {_NL}), lambda x: trim(x) <> '') AS ls FROM documents),
    el AS (SELECT doc_id, source, unnest(ls) AS t, generate_subscripts(ls, 1) - 1 AS n FROM tl),
    bl AS (SELECT doc_id, source, n, n // {LINES_A_PAGE} AS page, n % {LINES_A_PAGE} + 1 AS i, trim(t) AS t FROM el),
    ed AS (SELECT doc_id, page, max(i) AS m, coalesce(any_value(source), 'nowhere') AS source FROM bl GROUP BY ALL),
    lines AS (
        SELECT doc_id, page, i, t, CASE WHEN n % 5 = 0 THEN 90.0::DOUBLE ELSE 72.0::DOUBLE END AS x, 800.0::DOUBLE - 14.0 * i - CASE WHEN i > 10 THEN 20.0 ELSE 0.0 END AS y, CASE WHEN n % 37 = 0 THEN 18.0::DOUBLE ELSE 12.0::DOUBLE END AS h FROM bl
        UNION ALL SELECT doc_id, page, 0, 'From ' || source || ', part ' || (page + 1), 72.0, 820.0, 12.0 FROM ed
        UNION ALL SELECT doc_id, page, m + 1, '– ' || (page + 1) || ' –', 72.0, 20.0, 12.0 FROM ed)"""
_HEADS = rf"""
    np AS (SELECT doc_id, max(page) + 1 AS n FROM lines GROUP BY doc_id),
    mk AS (SELECT lines.*, np.n, regexp_replace(regexp_replace(t, '[0-9]+', '#', 'g'), '[{C.WS}]+', '', 'g') AS key,
           i = min(i) OVER (PARTITION BY doc_id, page) AS f, i = max(i) OVER (PARTITION BY doc_id, page) AS g FROM lines JOIN np USING (doc_id)),
    ct AS (SELECT *, n >= 3 AND key <> '' AND f AND count_if(f) OVER w >= greatest(2, ceil(n * 0.6)) AS hd, n >= 3 AND key <> '' AND g AND count_if(g) OVER w >= greatest(2, ceil(n * 0.6)) AS ft FROM mk WINDOW w AS (PARTITION BY doc_id, key)),
    clean AS (SELECT doc_id, page, i, t, x, y, h FROM ct WHERE NOT hd AND NOT ft AND NOT regexp_matches(t, '{L.PAGE_NUMBER}'))"""
_OPENED = rf"""
    up AS (SELECT *, lag(y) OVER pg - y AS up, row_number() OVER pg = 1 AS st, min(x) OVER (PARTITION BY doc_id, page) AS mx FROM clean WINDOW pg AS (PARTITION BY doc_id, page ORDER BY i)),
    mh AS (SELECT doc_id, list_sort(list(h))[count(*) // 2 + 1] AS mh FROM clean WHERE h > 0 GROUP BY doc_id),
    mg AS (SELECT doc_id, page, list_sort(list(up))[count(*) // 2 + 1] AS mg FROM up WHERE up > 0 GROUP BY doc_id, page),
    hd AS (SELECT up.*, coalesce(mh, 12.0) AS mh, coalesce(mg, coalesce(mh, 12.0) * 1.4) AS mg, h > coalesce(mh, 12.0) * 1.22 AND length(t) <= 40 AS head FROM up LEFT JOIN mh USING (doc_id) LEFT JOIN mg USING (doc_id, page)),
    lg AS (SELECT *, coalesce(lag(head) OVER o, true) AS none, coalesce(regexp_matches(lag(t) OVER o, '{L.ENDED}'), false) AS ended FROM hd WINDOW o AS (PARTITION BY doc_id ORDER BY page, i)),
    nw AS (SELECT *, none OR head OR coalesce(up > mg * 1.55, false) OR (x - mx > mh * 1.1 AND ((NOT none AND ended) OR st)) AS new FROM lg),
    op AS (SELECT *, CAST(sum(new::INT) OVER (PARTITION BY doc_id ORDER BY page, i) - 1 AS BIGINT) AS block FROM nw)"""

ORACLES = {
    "txt_blocks": f"WITH {_BLOCKS} SELECT doc_id, b, k, t FROM blocks",
    "lang_weights": f"WITH {_BLOCKS} SELECT doc_id, {_COUNT.format(C.CJK)} AS cjk, {_COUNT.format(C.LATIN)} AS latin, {_COUNT.format(C.CJK + C.LATIN + '0-9')} AS solid FROM blocks GROUP BY doc_id",
    "block_prefix_percent": f"WITH {_BLOCKS}, {_PREFIX} SELECT *, {_PCT.format('(CASE WHEN total = 0 THEN 0.0 ELSE CAST(before AS DOUBLE) / total END)')} AS pct FROM p",
    "doc_stats": f"WITH {_BLOCKS} SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(t)) AS BIGINT) AS total_chars, CAST(sum(CASE WHEN k = 'h' THEN 0 ELSE length(t) END) AS BIGINT) AS body_chars, CAST(count_if(k = 'h') AS BIGINT) AS n_headings FROM blocks GROUP BY doc_id",
    "block_chapter": "SELECT conv_id, turn, CAST(row_number() OVER w - 1 AS BIGINT) AS b, CAST((row_number() OVER w - 1) // 4 AS BIGINT) AS ci FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "conversation_prefix": "SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(length(text)) OVER (PARTITION BY conv_id) AS BIGINT) AS total FROM conversations",
    "anchor_at_percent": f"""WITH {_BLOCKS}, {_PREFIX},
        tg AS (SELECT d.doc_id, s.share, s.share * d.total AS x, d.total, d.last FROM (SELECT doc_id, max(total) AS total, max(b) AS last FROM p GROUP BY doc_id) d, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS share) s),
        f AS (SELECT tg.doc_id, tg.share, any_value(tg.x) AS x, any_value(tg.last) AS last, min(p.b) AS b, arg_min(p.before, p.b) AS before FROM tg LEFT JOIN p ON p.doc_id = tg.doc_id AND p.before + p.len > tg.x GROUP BY tg.doc_id, tg.share)
        SELECT doc_id, share, coalesce(b, last) AS b, CAST(CASE WHEN b IS NULL THEN 0 ELSE floor(x - before) END AS BIGINT) AS o FROM f""",
    "quote_locate": f"""WITH {_BLOCKS},
        q AS (SELECT item_id, left(regexp_replace(text, '[{C.WS}]+', '', 'g'), {Q.QUOTE_CHARS}) AS q FROM benchmark),
        pl AS (SELECT doc_id, b, t, regexp_replace(t, '[{C.WS}]+', '', 'g') AS p FROM blocks),
        h AS (SELECT item_id, doc_id, min(b) AS b, arg_min(instr(p, q) - 1, b) AS pos, arg_min(t, b) AS t FROM q JOIN pl ON instr(p, q) > 0 WHERE length(q) >= {Q.QUOTE_LEAST} GROUP BY item_id, doc_id)
        SELECT item_id, doc_id, b, CAST((SELECT min(j) FROM range(0, length(h.t) + 1) r(j) WHERE length(regexp_replace(left(h.t, r.j), '[{C.WS}]+', '', 'g')) >= h.pos) AS BIGINT) AS o FROM h""",
    "content_dedup": "SELECT sha256(text) AS id, arg_max(source || '-' || doc_id || '.txt', doc_id) AS file_name, min(doc_id) AS added_seq, CAST(any_value(strlen(text)) AS BIGINT) AS size, count(*) AS n_imports FROM documents GROUP BY sha256(text)",
    "shelf_order": f"WITH l AS (SELECT user_id, event_type, max({_US}) AS us FROM events GROUP BY ALL) SELECT user_id, event_type, us AS \"at\", row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_type) AS place FROM l",
    "latest_progress": f"""WITH s AS (SELECT user_id AS id, event_id, ((CAST(floor(value) AS BIGINT) % 100 + 100) % 100)::DOUBLE / 100 AS percent, {_US} AS us FROM events)
        SELECT id, arg_max(event_id, (us, event_id)) AS event_id, arg_max(percent, (us, event_id)) AS percent, max(us) AS last_read_at, bool_or(percent >= {B.FINISHED_AT}) AS finished FROM s GROUP BY id""",
    "backup_merge": f"""WITH s AS (SELECT user_id, event_id, event_id % 2 AS half, {_US} AS us, ((CAST(floor(value) AS BIGINT) % 3 + 3) % 3)::DOUBLE / 2 AS percent FROM events),
        g AS (SELECT user_id AS id, half, arg_max(event_id, (us, event_id)) AS anchor_b, max(us) AS us, arg_max(percent, (us, event_id)) AS percent FROM s GROUP BY ALL),
        j AS (SELECT l.*, r.anchor_b AS rb, r.us AS rus, r.percent AS rp, coalesce(r.us > l.us, false) AS up FROM (SELECT * FROM g WHERE half = 0) l LEFT JOIN (SELECT * FROM g WHERE half = 1) r USING (id))
        SELECT id, CASE WHEN up THEN rb ELSE anchor_b END AS anchor_b, CASE WHEN up AND rp <> 0 THEN rp ELSE percent END AS percent, CASE WHEN up THEN rus ELSE us END AS last_read_at, CASE WHEN up THEN rp >= 1 ELSE percent >= 1 END AS finished, up AS updated FROM j""",
    "export_semi": "SELECT doc_id AS book_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "cascade_delete": "WITH x AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT doc_id, 'book' AS kind FROM documents WHERE doc_id NOT IN (FROM x) UNION ALL SELECT doc_id, 'note' FROM labels WHERE doc_id NOT IN (FROM x)",
    "noted_spans": f"WITH {_BLOCKS} SELECT doc_id, b, CAST(0 AS BIGINT) AS o, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = blocks.doc_id AND l.quality = blocks.b) AS noted FROM blocks",
    "annot_counts": "SELECT d.doc_id AS id, count(l.doc_id) AS annot_count FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.doc_id",
    "running_heads": f"WITH {_LINES}, {_HEADS} SELECT doc_id, page, i, t FROM clean",
    "lines_to_blocks": rf"""WITH {_LINES}, {_HEADS}, {_OPENED},
        ld AS (SELECT *, lead(t) OVER (PARTITION BY doc_id, block ORDER BY page, i) AS nx FROM op),
        gl AS (SELECT doc_id, block, page, i, head, CASE WHEN nx IS NULL THEN t WHEN regexp_matches(t, '[-\x{{2010}}\x{{00AD}}]$') AND regexp_matches(nx, '^[A-Za-z]') THEN left(t, length(t) - 1)
               WHEN regexp_matches(t, '[{C.CJK_WIDE}]$') OR regexp_matches(nx, '^[{C.CJK_WIDE}]') OR regexp_matches(t, '[{C.WS}]$') THEN t ELSE t || ' ' END AS s FROM ld)
        SELECT doc_id, block AS b, CASE WHEN bool_or(head) THEN 'h' ELSE 'p' END AS k, {_TRIM % "string_agg(s, '' ORDER BY page, i)"} AS t FROM gl GROUP BY doc_id, block""",
    "page_of_block": f"""WITH {_LINES}, {_HEADS}, {_OPENED},
        pn AS (SELECT doc_id, max(page) AS m FROM clean GROUP BY doc_id), ev AS (SELECT doc_id, unnest(range(0, m + 1)) AS page FROM pn),
        pc AS (SELECT doc_id, page, sum(new::INT) AS n FROM op GROUP BY ALL),
        ps AS (SELECT doc_id, page, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ev LEFT JOIN pc USING (doc_id, page)),
        bs AS (SELECT DISTINCT doc_id, block AS b FROM op)
        SELECT bs.doc_id, bs.b, CAST(greatest(1, max(ps.page) + 1) AS BIGINT) AS page, CAST(arg_max(ps.start, ps.page) AS BIGINT) AS page_start FROM bs JOIN ps ON ps.doc_id = bs.doc_id AND ps.start <= bs.b GROUP BY bs.doc_id, bs.b""",
    "scan_test": f"WITH {_LINES} SELECT doc_id, max(page) + 1 AS n_pages, CAST(sum(length(t)) AS BIGINT) AS n_chars, sum(length(t)) < {L.SCANNED_BELOW} * (max(page) + 1) AS scanned FROM lines GROUP BY doc_id",
    "resolve_paths": r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '/[^/]*$', '') AS base FROM pages)
        SELECT page_id, h.href, CASE h.href WHEN '#only' THEN '' WHEN '../up.html' THEN CASE WHEN contains(base, '/') THEN regexp_replace(base, '/[^/]*$', '') || '/up.html' ELSE 'up.html' END
        WHEN '/root.html' THEN base || '/root.html' ELSE base || '/a b/c.html' END AS target FROM p, (SELECT unnest(['a%20b/./c.html#top', '../up.html', '/root.html', '#only']) AS href) h""",
    "epoch_fence": f"WITH e AS (SELECT event_id, user_id, {_US} AS us, CAST(floor(value) AS BIGINT) AS epoch FROM events), m AS (SELECT *, max(epoch) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS top FROM e) SELECT event_id, user_id, us, epoch FROM m WHERE epoch >= top",
    "file_labels": """WITH n AS (SELECT doc_id, source || '.' || ['txt', 'EPUB', 'pdf', 'md'][doc_id % 4 + 1] AS name, strlen(text)::DOUBLE AS n FROM documents)
        SELECT doc_id, CASE WHEN lower(name) LIKE '%.epub' THEN 'epub' WHEN lower(name) LIKE '%.pdf' THEN 'pdf' ELSE 'txt' END AS format, regexp_replace(name, '\\.[^.]+$', '') AS title,
        CASE WHEN n = 0 THEN '' WHEN n < 1048576 THEN CAST(floor(n / 1024 + 0.5) AS BIGINT) || ' KB' ELSE printf('%.1f MB', n / 1048576) END AS size_label FROM n""",
    "sentences": f"WITH RECURSIVE {_BLOCKS}, {sql.SENTENCES} SELECT doc_id, b, i, t, o FROM sents",
    "sentence_stats": f"WITH RECURSIVE {_BLOCKS}, {sql.SENTENCES} SELECT lang, count(*) AS n_sentences, CAST(sum(length(t)) AS BIGINT) AS n_chars, max(length(t)) AS longest FROM sents JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang",
    "clauses": f"WITH {_BLOCKS}, {sql.clause_ctes('blocks', 'doc_id, b', 'cl')} SELECT doc_id, b, c, t, o, CAST({sql.solid('t')} AS BIGINT) AS solid FROM cl",
    "speech_clean": f"WITH {_BLOCKS} SELECT doc_id, b, {sql.spoken('t')} AS say FROM blocks",
    "lang_runs": f"WITH {_BLOCKS}, {sql.run_ctes('blocks', 'doc_id, b', 'lr')} SELECT doc_id, b, r, t, lang, o FROM lr",
    "chapter_units": f'WITH {_BLOCKS}, {sql.unit_ctes("blocks", "doc_id")} SELECT doc_id, ci, title, start, "end", body, chars FROM units',
    "remap_annotations": f"""WITH {_BLOCKS}, bn AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM blocks),
        nt AS (SELECT doc_id, b, left(regexp_replace(left(t, 160), '[{C.WS}]+', '', 'g'), {Q.QUOTE_CHARS}) AS q FROM bn WHERE b = n // 2),
        nw AS (SELECT doc_id, CASE WHEN n > 1 THEN b - 1 ELSE b END AS b, t, length(t) AS len, regexp_replace(t, '[{C.WS}]+', '', 'g') AS p FROM bn WHERE n = 1 OR b > 0),
        np AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY doc_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(len) OVER (PARTITION BY doc_id) AS total FROM nw),
        ol AS (SELECT bn.doc_id, sum(CASE WHEN bn.b < nt.b THEN length(bn.t) ELSE 0 END) AS before, sum(length(bn.t)) AS total FROM bn JOIN nt ON nt.doc_id = bn.doc_id GROUP BY bn.doc_id),
        hit AS (SELECT nt.doc_id, min(nw.b) AS hb, arg_min(instr(p, q) - 1, nw.b) AS at_, arg_min(t, nw.b) AS t FROM nt JOIN nw ON nw.doc_id = nt.doc_id AND length(q) >= {Q.QUOTE_LEAST} AND instr(p, q) > 0 GROUP BY nt.doc_id),
        ho AS (SELECT doc_id, hb, (SELECT min(j) FROM range(0, length(hit.t) + 1) r(j) WHERE length(regexp_replace(left(hit.t, r.j), '[{C.WS}]+', '', 'g')) >= hit.at_) AS o FROM hit),
        sh AS (SELECT doc_id, CASE WHEN ol.total = 0 THEN 0.0 ELSE CAST(ol.before AS DOUBLE) / ol.total END AS share FROM ol),
        go AS (SELECT sh.doc_id, any_value(share) * any_value(np.total) AS x, min(CASE WHEN np.before + np.len > share * np.total THEN np.b END) AS b, arg_min(np.before, np.b) FILTER (WHERE np.before + np.len > share * np.total) AS before, max(np.b) AS last FROM sh JOIN np USING (doc_id) GROUP BY sh.doc_id),
        pl AS (SELECT nt.doc_id, nt.b AS old_b, coalesce(ho.hb, go.b, go.last) AS b, CASE WHEN ho.hb IS NOT NULL THEN ho.o WHEN go.b IS NULL THEN 0 ELSE floor(x - go.before) END AS o FROM nt LEFT JOIN ho USING (doc_id) LEFT JOIN go USING (doc_id))
        SELECT doc_id, CAST(b AS BIGINT) AS b, CAST(o AS BIGINT) AS o, NOT (b = old_b AND o = 0) AS moved FROM pl""",
    "throttled_saves": f'WITH {sql.SAVES} SELECT user_id, "at", pos, timer FROM saves',
    "html_blocks": f"WITH {sql.PAGES} SELECT page_id, b, k, t FROM pb",
    "nav_toc": f"WITH {sql.PAGES} SELECT page_id, ti, regexp_replace(string_split(href, '#')[1], '^/', '') AS path, coalesce(string_split(href, '#')[2], '') AS frag, label, CAST(lv AS BIGINT) AS lv FROM nav WHERE label <> '' AND regexp_replace(string_split(href, '#')[1], '^/', '') <> ''",
    "toc_tree": f"""WITH {sql.PAGES}, {sql.unit_ctes("pb", "page_id")},
        pp AS (SELECT page_id, b, coalesce(sum(length(t)) OVER (PARTITION BY page_id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(t)) OVER (PARTITION BY page_id) AS total FROM pb),
        en AS (SELECT nav.page_id, ti, label AS t, lv, least(ti, n - 1) AS b FROM nav JOIN (SELECT page_id, count(*) AS n FROM pb GROUP BY page_id) USING (page_id) WHERE label <> ''),
        fo AS (SELECT *, max(lv) OVER (PARTITION BY page_id) AS deep, lead(lv) OVER (PARTITION BY page_id ORDER BY ti) AS nx FROM en)
        SELECT fo.page_id, ti, t, CAST(lv AS BIGINT) AS lv, CAST(least(lv, 4) AS BIGINT) AS level, fo.b, coalesce((SELECT max(ci) FROM units u WHERE u.page_id = fo.page_id AND u.start <= fo.b), 0) AS ci,
               coalesce(nx > lv AND deep > 0 AND nx >= least(deep, 2), false) AS has_kids, {_PCT.format("(CAST(coalesce(before, 0) AS DOUBLE) / greatest(coalesce(total, 1), 1))")} AS pct FROM fo LEFT JOIN pp ON pp.page_id = fo.page_id AND pp.b = fo.b""",
    "speech_queue": sql.queue_sql(_BLOCKS),
    **library_queries.oracles(_BLOCKS, _PREFIX, _LINES, _HEADS, _OPENED),
    **import_queries.oracles(_BLOCKS),
}
ORACLES |= reading_queries.oracles(_BLOCKS, _PREFIX, ORACLES["lines_to_blocks"], ORACLES["scan_test"])
