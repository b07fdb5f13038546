import json

import pytest
from pyspark.sql import functions as F

from folio.operators import library as B
from folio.sources import backup as K

BOOKS = "id string, title string, author string, format string, file_name string, size bigint, total_chars bigint, added_at bigint, last_read_at bigint, finished boolean, anchor struct<b:int,o:int>, percent double, annot_count int"
NOTES = "id string, book_id string, b int, o int, quote string, text string, chapter_title string, created_at bigint, updated_at bigint"


def book(i, **x):
    base = {"id": i, "title": f"T{i}", "author": "", "format": "txt", "file_name": f"{i}.txt", "size": 5, "total_chars": 9, "added_at": 10, "last_read_at": 0, "finished": False, "anchor": (0, 0), "percent": 0.0, "annot_count": 0}
    return tuple((base | x).values())


def books(spark, *rows):
    return spark.createDataFrame(list(rows), BOOKS)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    c = spark.createDataFrame([(2, "x", 1), (2, "y", 3), (3, "z", 2)], "id int, v string, seq int")
    assert rows(B.upsert(t, c, "id", "seq"), "id", "v") == [(1, "a"), (2, "y"), (3, "z")]


def test_import_files_is_idempotent(spark):
    f = spark.createDataFrame([("a.txt", b"one", 1), ("b.txt", b"two", 2), ("c.txt", b"one", 3), ("n.txt", None, 4)], "name string, content binary, seq int")
    once, twice = B.import_files(f), B.import_files(f.unionByName(f))
    assert rows(once, "file_name", "added_seq", "size") == rows(twice, "file_name", "added_seq", "size")
    assert ("c.txt", 1, 3) in rows(once, "file_name", "added_seq", "size")


def test_delete_cascades(spark):
    left = B.delete_books({"books": (books(spark, book("a"), book("b")), "id"), "notes": (spark.createDataFrame([("n", "a"), ("m", "b")], "nid string, book_id string"), "book_id")}, spark.createDataFrame([("a",)], "id string"))
    assert rows(left["books"], "id") == [("b",)] and rows(left["notes"], "nid") == [("m",)]


def test_progress_is_sticky(spark):
    saves = spark.createDataFrame([("a", (3, 1), 0.996, 20), ("a", (1, 0), 0.2, 30), ("c", (0, 0), 0.5, 5)], "id string, anchor struct<b:int,o:int>, percent double, ts bigint")
    got = B.saved_progress(books(spark, book("a"), book("b", finished=True)), saves)
    assert rows(got, "id", "percent", "last_read_at", "finished") == [("a", 0.2, 30, True), ("b", 0.0, 0, True)]
    assert rows(B.restarted(got), "id", "percent", "finished") == [("a", 0.0, False), ("b", 0.0, False)]
    assert rows(B.toggled_finished(got), "id", "finished") == [("a", False), ("b", False)]


def note(i, **x):
    base = {"id": i, "book_id": "a", "b": 1, "o": 0, "quote": "q", "text": "t", "chapter_title": "", "created_at": None, "updated_at": 50}
    return tuple((base | x).values())


def test_notes(spark):
    old = spark.createDataFrame([note("n", created_at=5, updated_at=5)], NOTES)
    edits = spark.createDataFrame([note("n", text=" new "), note("m"), note("x", text="　 ")], NOTES)
    got = B.save_notes(old, edits)
    assert rows(got, "id", "text", "created_at", "updated_at") == [("m", "t", 50, 50), ("n", "new", 5, 50)]
    assert rows(B.note_counts(books(spark, book("a"), book("b")), got), "id", "annot_count") == [("a", 2), ("b", 0)]
    spans = spark.createDataFrame([("a", 1, 0), ("a", 1, 4)], "doc_id string, b int, o int")
    assert rows(B.noted(spans, got.select(F.col("book_id").alias("doc_id"), "b", "o")), "o", "noted") == [(0, True), (4, False)]


def test_shelf(spark):
    got = B.shelf(books(spark, book("a", last_read_at=0, added_at=30), book("b", last_read_at=40, title="", percent=0.499), book("c", last_read_at=None, added_at=None, title=None, file_name=None, format="epub")))
    assert [(r.id, r.title, r.tag, r.pct) for r in got.orderBy("place").collect()] == [("b", "b.txt", "txt", 50), ("a", "Ta", "txt", 0), ("c", "未命名", "epub", 0)]


def test_merge_backup(spark):
    local = books(spark, book("a", last_read_at=10, percent=0.5), book("b", last_read_at=10, percent=0.5), book("c", last_read_at=None, percent=0.1))
    remote = books(spark, book("a", last_read_at=20, percent=0.0, anchor=(7, 7), finished=None), book("b", last_read_at=10, percent=0.9), book("c", last_read_at=1, percent=0.9, anchor=None, finished=True), book("z", last_read_at=99))
    got = B.merge_backup(local, remote)
    assert rows(got, "id", "percent", "last_read_at", "finished", "updated") == [("a", 0.5, 20, False, True), ("b", 0.5, 10, False, False), ("c", 0.9, 1, True, True)]
    assert {r.id: tuple(r.anchor) for r in got.collect()} == {"a": (7, 7), "b": (0, 0), "c": (0, 0)}
    notes = spark.createDataFrame([note("n"), note("k")], NOTES)
    merged = B.merge_notes(notes, spark.createDataFrame([note("n", text="theirs"), note(""), note("y", book_id=None)], NOTES))
    assert rows(merged, "id", "text") == [("k", "t"), ("n", "theirs")]


def test_backup_round_trip(spark, tmp_path):
    b = books(spark, book("a", last_read_at=5), book("b", last_read_at=9))
    n = spark.createDataFrame([note("n", book_id="a"), note("m", book_id="b", b=2), note("l", book_id="b", b=1), note("gone", book_id="zz")], NOTES)
    out = K.export_backup(b, n, "shelf", F.lit("2024-01-02T00:00:00Z")).first().value
    data = json.loads(out)
    assert [x["id"] for x in data["books"]] == ["b", "a"] and [x["id"] for x in data["annots"]] == ["l", "m", "n"]
    (tmp_path / "b.json").write_text(json.dumps(data, indent=2))
    again, notes = K.read_backup(spark, str(tmp_path / "b.json"), "shelf")
    assert rows(again, "id", "last_read_at") == [("a", 5), ("b", 9)] and notes.count() == 3
    (tmp_path / "x.json").write_text('{"app": "other", "books": [{"id": "q"}]}')
    with pytest.raises(Exception, match="not a backup"):
        K.read_backup(spark, str(tmp_path / "x.json"), "shelf")[0].collect()
    assert spark.range(1).select(K.backup_name(F.lit("2024-01-02").cast("date"), "shelf").alias("n")).first().n == "shelf-backup-2024-01-02.json"


def test_settings(spark):
    texts = ['{"font": 9, "line": 4, "theme": "dark", "rate": 1.6, "rateEn": 0.1, "keepAwake": false, "edgeTap": false}', '{"tapMode": "updown", "edgeTap": true, "font": 0}', "broken", None]
    got = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", B.settings(F.col("t")).alias("s")).orderBy("i").collect()]
    assert (got[0].font, got[0].line, got[0].theme, got[0].rate, got[0].rate_en, got[0].keep_awake, got[0].tap_mode) == (2, 4, "dark", 1.6, 0.85, False, "off")
    assert (got[1].font, got[1].tap_mode) == (0, "updown")
    assert got[2] == got[3] and got[2].theme == "paper" and got[2].tap_mode == "edge"


def test_settings_are_parsed_once(spark):
    text = F.col("id").cast("string")
    rows = spark.range(1).select(B.settings(B.settings_text(B.settings(text))).alias("s")).select("s.*")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 2


def test_tap_direction(spark):
    df = spark.createDataFrame([("edge", 0.1, 0.5), ("edge", 0.9, 0.5), ("edge", 0.5, 0.0), ("updown", 0.0, 0.2), ("updown", 0.0, 0.7), ("off", 0.0, 0.0)], "m string, x double, y double")
    assert [r.d for r in df.select(B.tap_direction(F.col("m"), F.col("x"), F.col("y")).alias("d")).collect()] == [-1, 1, 0, -1, 1, 0]


def test_page_saves_and_the_end(spark):
    saves = spark.createDataFrame([("s", 3, 4, 1), ("t", 2, 3, 1), ("x", 1, 0, 1)], "id string, page int, n_pages int, ts long")
    b = books(spark, book("s", format="pdf-image"), book("t", format="pdf"), book("x", format="pdf-image"))
    docs = spark.createDataFrame([("t", [0, 2], [0, 5, 8], 10)], "id string, starts array<int>, before array<long>, total long")
    got = {r.id: (tuple(r.anchor), r.percent) for r in B.page_saves(saves, b, docs).collect()}
    assert got == {"s": ((2, 0), 0.75), "t": ((2, 0), 0.8)}
    blocks = spark.createDataFrame([("t", 0, "p", "abc"), ("t", 1, "p", "de")], "doc_id string, b int, k string, t string")
    end = B.end_of_book(blocks, F.lit(9).cast("long"))
    assert [(r.id, tuple(r.anchor), r.percent, r.ts) for r in end.collect()] == [("t", (1, 2), 1.0, 9)]
    done = B.saved_progress(b, end)
    assert rows(done.where("id = 't'"), "finished", "percent") == [(True, 1.0)]


def test_open_and_render(spark):
    from folio.operators.speech import rendered

    units = spark.createDataFrame([("a", 0, 0, 1), ("a", 1, 1, 3)], "id string, ci int, start int, `end` int")
    notes = spark.createDataFrame([note("n", b=2, o=0), note("m", b=1, o=4)], NOTES)
    got = B.open_books(books(spark, book("a", anchor=(2, 0)), book("b")), units, notes)
    assert {r.id: (r.ci, [x.note for x in r.notes or []]) for r in got.collect()} == {"a": (1, ["m", "n"]), "b": (0, [])}
    blocks = spark.createDataFrame([("a", 0, "h", "Title"), ("a", 1, "p", "One here. Two there."), ("a", 2, "q", "Three.")], "doc_id string, b int, k string, t string")
    spans = rendered(blocks, units.withColumnRenamed("id", "doc_id"), notes.select(F.col("book_id").alias("doc_id"), "b", "o"))
    assert rows(spans, "ci", "b", "k", "t", "noted") == [(0, 0, "h", "Title", False), (1, 1, "p", " Two there.", False), (1, 1, "p", "One here.", False), (1, 2, "q", "Three.", True)]


def test_backups_with_an_id_twice(spark):
    """Rows of one id are taken one after another, as they stand."""
    local = books(spark, book("a", last_read_at=10, percent=0.5))
    remote = books(spark, book("a", last_read_at=20, percent=0.3, anchor=(1, 1)), book("a", last_read_at=30, percent=0.0, anchor=None), book("a", last_read_at=25, percent=0.9)).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    got = B.merge_backup(local, remote)
    assert rows(got, "id", "percent", "last_read_at", "updated") == [("a", 0.3, 30, True)] and tuple(got.first().anchor) == (1, 1)
    notes = spark.createDataFrame([note("n")], NOTES)
    twice = spark.createDataFrame([note("n", text="one"), note("n", text="two"), note("m", text="x"), note("m", text="y")], NOTES).coalesce(1).withColumn("seq", F.monotonically_increasing_id())
    assert rows(B.merge_notes(notes, twice), "id", "text") == [("m", "y"), ("n", "two")]


def test_import_into_a_library(spark):
    f = spark.createDataFrame([("new.txt", b"one", 7), ("b.epub", b"two", 8)], "name string, content binary, seq int")
    have = B.import_files(f.where("seq = 7")).first().id
    lib = books(spark, book(have, added_at=0, percent=0.4), book("z"))
    got = {r.id: r for r in B.import_into(lib, f).collect()}
    assert len(got) == 3
    assert (got[have].file_name, got[have].added_at, got[have].percent, got[have].title) == ("new.txt", 7, 0.4, f"T{have}")
    fresh = next(r for k, r in got.items() if k not in (have, "z"))
    assert (fresh.title, fresh.format, fresh.file_name, fresh.added_at, fresh.last_read_at, tuple(fresh.anchor)) == ("b", "epub", "b.epub", 8, 0, (0, 0))


def test_counters_deletes_and_last_book(spark):
    outcomes = spark.createDataFrame([("a", None), ("b", "broken"), ("c", None)], "id string, error string")
    assert tuple(B.import_summary(outcomes).first()) == (2, 1)
    notes = spark.createDataFrame([note("n"), note("m")], NOTES)
    b, left = B.delete_notes(books(spark, book("a"), book("b")), notes, spark.createDataFrame([("n",), ("n",)], "id string"))
    assert rows(b, "id", "annot_count") == [("a", 1), ("b", 0)] and rows(left, "id") == [("m",)]
    opened = spark.createDataFrame([(1, "a"), (2, "gone")], "k int, last_book string")
    assert rows(B.last_opened(opened, books(spark, book("a"))), "k") == [(1,)]
    stale = books(spark, book("a"), book("b"), book("c")).select("id", F.lit(True).alias("stale"))
    docs, files = spark.createDataFrame([("a", 2), ("b", 2)], "id string, parser_version int"), spark.createDataFrame([("a",), ("c",)], "id string")
    got = {r.id: (r.doc_version, r.reparse) for r in B.with_documents(stale, docs, files).collect()}
    assert got == {"a": (2, True), "b": (2, False), "c": (None, True)}


def test_settings_text(spark):
    text = '{"font": 4, "line": 0, "theme": "dark", "rate": 1.5, "rateEn": 0.7, "keepAwake": false, "tapMode": "off", "lastBook": "x"}'
    row = spark.createDataFrame([(text,)], "t string").select(B.settings(F.col("t")).alias("s"))
    again = row.select("s", B.settings(B.settings_text(F.col("s"))).alias("again")).first()
    assert again.s == again.again and json.loads(row.select(B.settings_text(F.col("s")).alias("x")).first().x)["rateEn"] == 0.7


def test_rates_and_replay(spark):
    from folio.operators.speech import rate_for, replay_from

    row = spark.createDataFrame([("en", 3), ("zh", 0)], "lang string, place int").withColumn("s", F.struct(F.lit(1.2).alias("rate"), F.lit(0.8).alias("rate_en")))
    assert [(r.r, r.p) for r in row.select(rate_for(F.col("lang"), F.col("s")).alias("r"), replay_from(F.col("place")).alias("p")).collect()] == [(0.8, 2), (1.2, 0)]


def test_shelves_by_owner(spark):
    b = books(spark, book("a", last_read_at=60_000, annot_count=2), book("b")).withColumn("owner", F.lit(1)).unionByName(books(spark, book("c")).withColumn("owner", F.lit(2)))
    assert rows(B.shelf(b, "owner"), "owner", "id", "place", "read", "notes") == [(1, "a", 1, "1970-01-01 00:01", 2), (1, "b", 2, B.NEVER_READ, 0), (2, "c", 1, B.NEVER_READ, 0)]
