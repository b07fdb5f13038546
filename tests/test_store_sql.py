"""Keyed reads, named files, backups as files, markup from SQL, voices by locale."""

import json
import os

import pytest
from pyspark.sql import functions as F
from test_sources import NAV, NCX, PAGE

from folio.operators import speech as S
from folio.sources import backup as K
from folio.sources import markup as M
from folio.sources import named, sql_functions
from folio.sources.store import Store


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.fixture(scope="module")
def store(spark):
    s = Store(spark, "folio_store_test", buckets=8)
    yield s
    spark.sql("DROP DATABASE folio_store_test CASCADE")


def test_store(spark, store):
    store.put("books", spark.createDataFrame([(f"b{i}", f"Book {i}", i) for i in range(40)], "id string, title string, n int"))
    store.put("books", spark.createDataFrame([("b3", "Third", 33), ("b99", "New", 99), ("b99", "New", 99)], "id string, title string, n int"))
    assert [tuple(r) for r in store.get("books", "b3").collect()] == [("b3", "Third", 33)]
    assert store.all("books").count() == 41
    store.put("notes", spark.createDataFrame([(f"n{i}", f"b{i % 4}", f"text {i}") for i in range(30)], "id string, book_id string, text string"))
    store.put("notes", spark.createDataFrame([("n4", "b0", "changed")], "id string, book_id string, text string"))
    assert {r.id: r.text for r in store.get("notes", "b0").collect()} == {f"n{i}": "changed" if i == 4 else f"text {i}" for i in range(0, 30, 4)}
    store.delete("notes", spark.createDataFrame([("b0", "n8"), ("b1", "n8")], "book_id string, id string"))
    assert "n8" not in {r.id for r in store.get("notes", "b0").collect()} and store.all("notes").count() == 29
    store.delete_books(spark.createDataFrame([("b0",), ("b77",)], "id string"))
    assert store.get("books", "b0").count() == 0 and store.get("notes", "b0").count() == 0 and store.all("notes").count() == 22
    before = {k: sorted(map(str, store.all(k).collect())) for k in ("books", "notes")}
    for k in before:
        store.compact(k)
    assert {k: sorted(map(str, store.all(k).collect())) for k in ("books", "notes")} == before
    store.put("notes", spark.createDataFrame([("n1", "b1", "after")], "id string, book_id string, text string"))
    assert {r.text for r in store.get("notes", "b1").where("id = 'n1'").collect()} == {"after"}


def test_a_key_reads_one_bucket(spark, store):
    rows = spark.createDataFrame([(f"b{i}", i) for i in range(20)], "id string, n int")
    store.put("docs", rows)
    store.put("docs", rows)
    plan = plan_of(store.get("docs", "b7"))
    assert "SelectedBucketsCount: 1 out of 8" in plan and "Exchange" not in plan
    assert "SelectedBucketsCount: 8 out of 8" in plan_of(store.all("docs"))


def test_named_files(spark, tmp_path):
    named.register(spark)
    save = lambda df: df.write.format("folio_named").mode("append").save(str(tmp_path / "out"))
    save(spark.createDataFrame([("a.json", "1"), ("b.json", "zwei é"), ("c", None)], "name string, value string").repartition(3))
    read = lambda: {n: (tmp_path / "out" / n).read_text() for n in os.listdir(tmp_path / "out")}
    assert read() == {"a.json": "1", "b.json": "zwei é", "c": ""}
    save(spark.createDataFrame([("a.json", "new")], "name string, value string"))
    assert read()["a.json"] == "new"
    before = read()
    for bad in ([("d", "1"), ("x/y", "2")], [("d", "1"), (None, "2")], [("d", "1"), ("d", "2")]):
        with pytest.raises(Exception, match="name"):
            save(spark.createDataFrame(bad, "name string, value string").repartition(2))
        assert read() == before
    failing = spark.range(4, numPartitions=4).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.when(F.col("id") == 3, F.raise_error(F.lit("task lost"))).otherwise(F.lit("x")).alias("value"))
    with pytest.raises(Exception, match="task lost"):
        save(failing)
    assert read() == before


def test_backups_as_files(spark, tmp_path):
    book = "id string, title string, author string, format string, file_name string, size long, total_chars long, added_at long, last_read_at long, finished boolean, anchor struct<b:int,o:int>, percent double, owner string"
    books = spark.createDataFrame([(f"b{i}", f"T{i}", "", "txt", "f", 1, 2, i, i, None, (i, 0), 0.5, "anna" if i % 2 else "ben") for i in range(6)], book)
    notes = spark.createDataFrame([(f"n{i}", f"b{i % 8}", 0, 0, "q", f"note {i}", "c", 1, 2) for i in range(16)], "id string, book_id string, b int, o int, quote string, text string, chapter_title string, created_at long, updated_at long")
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    K.write_backups(books, notes, "folio", at, str(tmp_path / "k"), "owner")
    assert sorted(os.listdir(tmp_path / "k")) == ["anna-folio-backup-2024-05-06.json", "ben-folio-backup-2024-05-06.json"]
    one = json.loads((tmp_path / "k" / "anna-folio-backup-2024-05-06.json").read_text())
    assert [b["id"] for b in one["books"]] == ["b5", "b3", "b1"] and len(one["annots"]) == 6
    read, kept = K.read_backup(spark, str(tmp_path / "k"), "folio")
    assert {(r.id, r.title, r.finished, r.anchor.b) for r in read.collect()} == {(f"b{i}", f"T{i}", False, i) for i in range(6)}
    assert {(r.id, r.text) for r in kept.collect()} == {(f"n{i}", f"note {i}") for i in range(16) if i % 8 < 6}
    with pytest.raises(Exception, match="not a backup"):
        K.read_backup(spark, str(tmp_path / "k"), "other")[0].count()


def test_markup_from_sql(spark, sf_dir):
    sql_functions.register(spark)
    odd = spark.createDataFrame([(-1, PAGE), (-2, None), (-3, ""), (-4, NAV), (-5, NCX), (-6, "<nav><ol><li><a href='../a%20b/./c%E6%BC%A2#x%20y'>one</a><li><a href='%FF'>bad</a><li><a href='#only'>none</a><li><a href='/top/z'>top</a></ol></nav><p>Chapter 3<p>第一章　x")], "page_id long, html string")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").unionByName(odd).withColumn("path", F.concat(F.lit("O/t/"), F.col("page_id").cast("string")))
    pages.createOrReplaceTempView("marked")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.sql("SELECT page_id, x.b, x.k, x.t FROM marked, LATERAL html_blocks(html) x")) == key(M.html_blocks(pages))
    got = spark.sql("SELECT page_id, x.* FROM marked, LATERAL nav_toc(html, path) x")
    assert key(got) == key(M.nav_toc(pages, path_col="path")) and got.where("page_id = -6").count() == 3
    counted = spark.sql("SELECT count(*) AS n FROM marked, LATERAL html_blocks(html) x WHERE x.k = 'h'").first().n
    assert counted == M.html_blocks(pages).where("k = 'h'").count() > 0


def test_voices_by_locale(spark):
    voices = spark.createDataFrame([(n, "en-US", n) for n in ("Zoe", "anna", "Émile", "Eva", "Öse", "Olga")], "name string, lang string, uri string")
    order = lambda **k: [r.name for r in S.ranked_voices(voices, "en", **k).orderBy("place").collect()]
    assert order() == ["anna", "Émile", "Eva", "Olga", "Öse", "Zoe"]
    assert order(collation="UTF8_BINARY") == ["Eva", "Olga", "Zoe", "anna", "Émile", "Öse"]
    assert order(collation="sv") == ["anna", "Émile", "Eva", "Olga", "Zoe", "Öse"]  # in Swedish Ö follows Z
    assert S.pick_voice(voices, "en", "Zoe").first().name == "Zoe" and S.pick_voice(voices, "en", "gone").first().name == "anna" and S.pick_voice(voices, "zh").count() == 0
