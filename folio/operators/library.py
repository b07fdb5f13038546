"""The library's tables: books, notes, progress, backups.

Upserts and merges are set operations over whole tables: the last write per key wins, a
backup updates a book only if it was read later there, deletes are anti joins.  A zero or
an empty text counts as missing where that is said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.rows import stacked
from folio.functions.text import base_name, date_label, falsy, format_of, once, pct, trim
from folio.operators.position import block_of_page, chapter_of, share_of

FINISHED_AT = 0.995
NEVER_READ = "尚未開始"
BACKUP_COLUMNS = ("id", "title", "author", "format", "file_name", "size", "total_chars", "added_at", "last_read_at", "finished", "anchor", "percent")


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """`table` after `changes` (its columns and `seq`): per key the row with the largest seq replaces what was there."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*table.columns), seq).alias("r")).select("r.*")
    return table.join(last.select(key), key, "left_anti").transform(stacked, last)


def import_files(files: DataFrame, seq: str = "seq") -> DataFrame:
    """Files (name, content, seq) to books: one per content hash, first seen keeps its place, the last name stays."""
    hashed = files.withColumn("id", F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256))
    return hashed.groupBy("id").agg(F.max_by("name", seq).alias("file_name"), F.min(seq).alias("added_seq"), F.first(F.octet_length("content")).alias("size"), F.count("*").alias("n_imports"))


def import_into(books: DataFrame, files: DataFrame, seq: str = "seq") -> DataFrame:
    """`books` after importing files (name, content, seq): known contents keep their row but for the name, new ones come in.

    added_at of a book that has none, and of a new one, is the file's seq.
    """
    found = import_files(files, seq)
    names = found.select("id", F.col("file_name").alias("name_"), F.col("added_seq").alias("seq_"))
    new = {"file_name": F.coalesce("name_", "file_name"), "added_at": F.when(F.col("seq_").isNotNull(), falsy(F.col("added_at"), F.col("seq_"), 0)).otherwise(F.col("added_at"))}
    known = books.join(names, "id", "left").select(*[new[c].alias(c) if c in new else F.col(c) for c in books.columns])
    fresh = {"id": F.col("id"), "title": base_name(F.col("file_name")), "author": F.lit(""), "format": format_of(F.col("file_name")), "file_name": F.col("file_name"), "size": F.col("size"), "added_at": F.col("added_seq"), "last_read_at": F.lit(0), "finished": F.lit(False), "anchor": F.struct(F.lit(0).alias("b"), F.lit(0).alias("o")), "percent": F.lit(0.0), "annot_count": F.lit(0)}
    rows = found.join(books.select("id"), "id", "left_anti")
    return known.transform(stacked, rows.select(*[fresh.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in books.schema]))


def import_summary(outcomes: DataFrame, error: str = "error") -> DataFrame:
    """One row: n_ok, n_failed of files with the reason they failed in `error`, or null."""
    return outcomes.agg(F.count_if(F.col(error).isNull()).alias("n_ok"), F.count_if(F.col(error).isNotNull()).alias("n_failed"))


def with_documents(books: DataFrame, docs: DataFrame, files: DataFrame) -> DataFrame:
    """`books` with `doc_version` (null: no document) and `reparse`: a stale one whose file is still there; others keep what they have."""
    d = docs.select("id", F.col("parser_version").alias("doc_version"))
    f = files.select("id").distinct().withColumn("file_", F.lit(True))
    return books.join(d, "id", "left").join(f, "id", "left").withColumn("reparse", F.col("stale") & F.coalesce("file_", F.lit(False))).drop("file_")


def last_opened(settings_rows: DataFrame, books: DataFrame, key: str = "last_book") -> DataFrame:
    """Settings rows whose last opened book still exists."""
    return settings_rows.join(books.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def delete_books(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table, {name: (rows, its book id column)}, without the rows of the books in `ids` (id)."""
    return {name: rows.join(ids.select(F.col("id").alias(key)).distinct(), key, "left_anti") for name, (rows, key) in tables.items()}


def saved_progress(books: DataFrame, saves: DataFrame, at: str = "ts") -> DataFrame:
    """`books` with the latest of `saves` (id, anchor, percent, at); finished never goes back to false here."""
    last = saves.groupBy("id").agg(F.max_by(F.struct("anchor", "percent", at), at).alias("s"), F.max(F.col("percent") >= FINISHED_AT).alias("done"))
    j = books.join(last, "id", "left")
    new = {"anchor": F.coalesce("s.anchor", "anchor"), "percent": F.coalesce("s.percent", "percent"), "last_read_at": F.coalesce(f"s.{at}", "last_read_at"), "finished": F.coalesce("finished", F.lit(False)) | F.coalesce("done", F.lit(False))}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in books.columns])


def page_saves(saves: DataFrame, books: DataFrame, docs: DataFrame, at: str = "ts") -> DataFrame:
    """Saves of a page (id, page from 1, n_pages, at) as saves of an anchor, for saved_progress().

    A scanned book counts its pages; one with text (docs: id, starts) is at the first block
    of the page, and its share is that of the text (docs also: before, by block, and total).
    """
    j = saves.join(books.select("id", "format"), "id").join(docs.select("id", "starts", "before", "total"), "id", "left")
    scanned = F.col("format") == "pdf-image"
    block = block_of_page(F.col("starts"), F.col("page"))
    b = F.when(scanned, F.col("page") - 1).otherwise(block)
    share = F.when(scanned, F.col("page") / F.col("n_pages")).otherwise(share_of(F.get("before", block), F.lit(0), F.col("total")))
    return j.where("coalesce(n_pages, 0) > 0").select("id", F.struct(b.cast("int").alias("b"), F.lit(0).alias("o")).alias("anchor"), share.alias("percent"), at)


def end_of_book(blocks: DataFrame, at: Column, id_col: str = "doc_id") -> DataFrame:
    """The save (id, anchor, percent, ts) of going on from the last unit: the end of the last block, all read."""
    last = blocks.groupBy(id_col).agg(F.max(F.struct("b", F.char_length("t").alias("o"))).alias("anchor"))
    return last.select(F.col(id_col).alias("id"), "anchor", F.lit(1.0).alias("percent"), at.alias("ts"))


def open_books(books: DataFrame, units: DataFrame, notes: DataFrame) -> DataFrame:
    """`books` with the unit `ci` of their anchor and their notes in order of position."""
    placed = chapter_of(books.select("id", F.coalesce("anchor.b", F.lit(0)).alias("b")).distinct(), units, "id").select("id", "ci")
    listed = notes.groupBy(F.col("book_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("b", "o", F.col("id").alias("note"), "text"))).alias("notes"))
    return books.join(placed, "id", "left").join(listed, "id", "left")


def restarted(books: DataFrame, first_block: Column | None = None) -> DataFrame:
    b = F.lit(0) if first_block is None else F.coalesce(first_block, F.lit(0))
    return books.withColumns({"anchor": F.struct(b.alias("b"), F.lit(0).alias("o")), "percent": F.lit(0.0), "finished": F.lit(False)})


def toggled_finished(books: DataFrame) -> DataFrame:
    return books.withColumn("finished", ~F.coalesce("finished", F.lit(False)))


def save_notes(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """`notes` after `edits` (same columns; updated_at is the time of the edit): blank texts are refused, created_at stays."""
    good = edits.withColumn("text", trim(F.col("text"))).where("text <> ''")
    last = good.groupBy("id").agg(F.max_by(F.struct(*notes.columns), "updated_at").alias("r"), F.min("updated_at").alias("began"))
    old = notes.select("id", F.col("created_at").alias("old_created"))
    rows = last.join(old, "id", "left").select(*[F.coalesce("old_created", "r.created_at", "began").alias(c) if c == "created_at" else F.col(f"r.{c}").alias(c) for c in notes.columns])
    return notes.join(rows.select("id"), "id", "left_anti").transform(stacked, rows)


def delete_notes(books: DataFrame, notes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(books, notes) without the notes in `ids` (id), the books counted again."""
    left = notes.join(ids.select("id").distinct(), "id", "left_anti")
    return note_counts(books, left), left


def note_counts(books: DataFrame, notes: DataFrame) -> DataFrame:
    counts = notes.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("n"))
    return books.drop("annot_count").join(counts, "id", "left").withColumn("annot_count", F.coalesce("n", F.lit(0))).drop("n")


def shelf(books: DataFrame, owner: str | None = None) -> DataFrame:
    """Rows as a shelf shows them, with their `place`: last read first, then last added.

    owner: a column that says whose shelf a book is on; without it all books are on one.
    """
    when = falsy(F.col("last_read_at"), falsy(F.col("added_at"), F.lit(0), 0), 0)
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("file_name", F.lit("")), F.lit("未命名"))
    read = F.when(F.coalesce("last_read_at", F.lit(0)) != 0, date_label(F.timestamp_millis(F.col("last_read_at")))).otherwise(NEVER_READ)
    keys = [owner] if owner else []
    rows = books.select(*keys, "id", title.alias("title"), F.when(F.col("format") == "epub", "epub").otherwise("txt").alias("tag"), F.coalesce("finished", F.lit(False)).alias("finished"), F.coalesce("author", F.lit("")).alias("author"), pct(F.col("percent")).alias("pct"), read.alias("read"), F.coalesce("annot_count", F.lit(0)).alias("notes"), when.alias("when"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("when").desc(), "id")))


def shelf_order(events: DataFrame, owner: str, book: str, at: Column) -> DataFrame:
    """(owner, book, at, place): each owner's books, last touched first."""
    last = events.groupBy(owner, book).agg(F.max(at).alias("at"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(owner).orderBy(F.col("at").desc(), book)))


def merge_backup(local: DataFrame, remote: DataFrame) -> DataFrame:
    """`local` books with the progress of `remote` ones that were read later, and `updated`.

    Missing or zero: an anchor or a percentage that is so there keeps what is here.  Where a
    backup has a book several times, its rows are taken one after another, by `seq` if there
    is such a column, else by the time they were read.
    """
    first = F.col("seq") if "seq" in remote.columns else F.coalesce("last_read_at", F.lit(0))
    given = F.struct(first.alias("k"), F.coalesce("last_read_at", F.lit(0)).alias("at"), "anchor", "percent", F.coalesce("finished", F.lit(False)).alias("finished"))
    r = remote.groupBy("id").agg(F.array_sort(F.collect_list(given)).alias("rs"))
    j = local.join(r, "id", "left")
    state = F.struct("anchor", "percent", "last_read_at", "finished", F.lit(False).alias("updated"))

    def step(s: Column, x: Column) -> Column:
        newer = x["at"] > F.coalesce(s["last_read_at"], F.lit(0))
        new = {"anchor": F.coalesce(x["anchor"], s["anchor"]), "percent": falsy(x["percent"], s["percent"], 0.0), "last_read_at": x["at"], "finished": x["finished"], "updated": F.lit(True)}
        return F.struct(*[F.when(newer, v).otherwise(s[c]).alias(c) for c, v in new.items()])

    done = j.withColumn("m_", F.aggregate(F.coalesce("rs", F.array().cast(r.schema["rs"].dataType)), state, step))
    new = ("anchor", "percent", "last_read_at", "finished")
    return done.select(*[F.col(f"m_.{c}").alias(c) if c in new else F.col(c) for c in local.columns], F.col("m_.updated").alias("updated"))


def merge_notes(notes: DataFrame, backup: DataFrame) -> DataFrame:
    """Notes of a backup replace those with their id; ones without id or book are left out.

    Of several with one id the last counts, by `seq` if there is such a column, else by the
    time of their change.
    """
    good = backup.where("coalesce(id, '') <> '' AND coalesce(book_id, '') <> ''")
    last = F.col("seq") if "seq" in backup.columns else F.struct(F.coalesce("updated_at", F.lit(0)), F.xxhash64(*notes.columns))
    good = good.groupBy("id").agg(F.max_by(F.struct(*notes.columns), last).alias("r")).select("r.*")
    return notes.join(good.select("id"), "id", "left_anti").transform(stacked, good)


def exported_notes(notes: DataFrame, books: DataFrame, key: str = "book_id") -> DataFrame:
    """Notes of books that exist."""
    return notes.join(books.select(F.col("id").alias(key)).distinct(), key, "left_semi")


def noted(spans: DataFrame, notes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`spans` (id, b, o, ...) with `noted`: a note sits exactly there."""
    marks = notes.select(F.col(id_col).alias("d_"), F.col("b").alias("b_"), F.col("o").alias("o_")).distinct().withColumn("m_", F.lit(True))
    j = spans.join(marks, (F.col(id_col) == F.col("d_")) & (F.col("b") == F.col("b_")) & (F.col("o") == F.col("o_")), "left")
    return j.select(*spans.columns, F.coalesce("m_", F.lit(False)).alias("noted"))


SETTINGS = "font int, line int, family string, theme string, rate double, rateEn double, voiceZh string, voiceEn string, keepAwake boolean, tapMode string, edgeTap boolean, lastBook string"


def settings(json: Column, fonts: int = 5, lines: int = 5) -> Column:
    """A settings text as a struct; what is out of range or unknown takes its default."""
    pick = lambda ok, v, default: F.when(ok, v).otherwise(F.lit(default))

    def read(s: Column) -> Column:
        tap = F.when(s["tapMode"].isin("off", "edge", "updown"), s["tapMode"]).when(s["edgeTap"].isNotNull(), F.when(s["edgeTap"], "edge").otherwise("off")).otherwise("edge")
        return F.struct(
            pick((s["font"] >= 0) & (s["font"] < fonts), s["font"], 2).alias("font"),
            pick((s["line"] >= 0) & (s["line"] < lines), s["line"], 2).alias("line"),
            pick(s["family"].isin("sans", "serif"), s["family"], "sans").alias("family"),
            pick(s["theme"].isin("paper", "light", "dark"), s["theme"], "paper").alias("theme"),
            pick(s["rate"].between(0.6, 1.6), s["rate"], 1.0).alias("rate"),
            pick(s["rateEn"].between(0.6, 1.6), s["rateEn"], 0.85).alias("rate_en"),
            F.coalesce(s["voiceZh"], F.lit("")).alias("voice_zh"),
            F.coalesce(s["voiceEn"], F.lit("")).alias("voice_en"),
            F.coalesce(s["keepAwake"], F.lit(True)).alias("keep_awake"),
            tap.alias("tap_mode"),
            F.coalesce(s["lastBook"], F.lit("")).alias("last_book"),
        )

    # a text is parsed once, whatever number of fields is asked of it
    return once(F.from_json(json, SETTINGS), read)


def settings_text(s: Column) -> Column:
    """A settings struct as the text that settings() reads."""
    names = {"font": "font", "line": "line", "family": "family", "theme": "theme", "rate": "rate", "rate_en": "rateEn", "voice_zh": "voiceZh", "voice_en": "voiceEn", "keep_awake": "keepAwake", "tap_mode": "tapMode", "last_book": "lastBook"}
    return once(s, lambda x: F.to_json(F.struct(*[x[k].alias(v) for k, v in names.items()])))


def tap_direction(mode: Column, x: Column, y: Column, edge: float = 0.25, band: float = 0.35) -> Column:
    """-1 back, 1 on, 0 neither, for a tap at (x, y) of a page of size 1."""
    at, share = F.when(mode == "edge", x).when(mode == "updown", y), F.when(mode == "edge", edge).otherwise(band)
    return F.when(at < share, -1).when(at > 1 - share, 1).otherwise(0)
