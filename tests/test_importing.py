"""Import of mixed folders, at once and as a stream."""

import pytest
from test_sources import BASE, LONG, NAV, TEXT, zipped

from folio.sources import importing as I

BOOK = zipped(**BASE, **{"O/nav.xhtml": NAV})
FILES = {
    "plain.txt": f"Chapter 1\n\n{LONG}".encode(), "again.TXT": f"Chapter 1\n\n{LONG}".encode(), "big5.txt": TEXT.encode("big5"), "noext": b"words", "book.epub": BOOK, "copy of book.EPUB": BOOK,
    "cut.epub": BOOK[:100], "locked.epub": zipped(**BASE, **{"META-INF/encryption.xml": "x"}), "scan.pdf": b"%PDF-1.4", "broken.txt": b"\xff\xfe\x00",
}


def put(folder, names):
    folder.mkdir(exist_ok=True)
    for n in names:
        (folder / n).write_bytes(FILES[n])


def shown(catalogue):
    return {r.name: (r.format, r.title, r.encoding, r.n_blocks, r.error) for r in catalogue.collect()}


def test_mixed_folder(spark, tmp_path):
    put(tmp_path / "in", FILES)
    files = I.named_files(spark.read.format("binaryFile").load(str(tmp_path / "in")))
    tables, counts = I.imported(files, str(tmp_path / "parts"))
    got = shown(tables["catalogue"])
    assert got["again.TXT"] == ("txt", "again", "utf-8", 2, None) and "plain.txt" not in got  # equal content: once, by the least name
    assert got["big5.txt"][2:] == ("big5", 2, None) and got["noext"] == ("txt", "noext", "utf-8", 1, None)
    assert got["book.epub"] == ("epub", "My Book", "utf-8", 7, None) and "copy of book.EPUB" not in got
    assert got["cut.epub"][0] == "epub" and got["cut.epub"][3] is None and got["cut.epub"][4] and got["locked.epub"][4] == "protected"
    assert got["scan.pdf"][3:] == (None, "no decoder for pdf")
    assert len(got) == 8 and tables["blocks"].select("id").distinct().count() == 5
    assert counts["n_files"] == 8 and counts["n_broken"] == 2 and counts["n_bytes"] == sum(len(FILES[n]) for n in got)
    assert counts["n_parts"] == 4 + 2 + len(BASE) + 1 + len(BASE) + 1
    lazily, none = I.imported(files)
    assert none is None and shown(lazily["catalogue"]) == got


def test_null_and_no_files(spark):
    files = spark.createDataFrame([(None, None), (None, b"x"), ("a.txt", None), ("b.epub", None)], "name string, content binary")
    got = {(r.name, r.size): r.error for r in I.imported(files)[0]["catalogue"].collect()}
    assert got == {("", 0): None, ("", 1): None}  # the empty contents are equal: the least name is the empty one
    assert I.imported(files.limit(0))[0]["catalogue"].collect() == []


def run(spark, source, target, a_batch=3):
    query = I.import_stream(I.file_stream(spark, str(source), a_batch), str(target)).start()
    query.awaitTermination(240)
    assert query.exception() is None


def test_stream_imports_once(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "library"
    put(source, ["plain.txt", "book.epub", "cut.epub"])
    run(spark, source, target)
    first = shown(I.library(spark, str(target))["catalogue"])
    assert set(first) == {"plain.txt", "book.epub", "cut.epub"} and first["cut.epub"][4]
    put(source, ["again.TXT", "noext", "copy of book.EPUB"])  # two of them are known by their content
    run(spark, source, target)
    run(spark, source, target)  # nothing new
    got = I.library(spark, str(target))
    assert set(shown(got["catalogue"])) == {"again.TXT", "copy of book.EPUB", "cut.epub", "noext"}  # the last names
    assert got["catalogue"].count() == 4 and got["blocks"].count() == 2 + 7 + 1
    assert sorted((r.n_seen, r.n_new, r.n_failed) for r in I.import_progress(spark, str(target)).collect()) == [(3, 1, 0), (3, 3, 1)]


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    files = lambda *names: spark.createDataFrame([(n, FILES[n]) for n in names], "name string, content binary")
    write = I.import_batches(str(tmp_path / "l"))
    write(files("plain.txt", "noext"), 0)
    # the second batch fails before its catalogue is written: none of its rows is read
    put, made = I.tables_of, []

    def failing(rows):
        tables = put(rows)
        made.append(tables)
        return tables | {"catalogue": tables["catalogue"].selectExpr("raise_error('lost')")}

    I.tables_of = failing
    try:
        with pytest.raises(Exception, match="lost"):
            write(files("again.TXT", "big5.txt"), 1)
    finally:
        I.tables_of = put
    before = I.library(spark, str(tmp_path / "l"))
    assert before["catalogue"].count() == 2 and before["blocks"].count() == 3 and made
    for _ in range(2):  # the restart, and the same batch once more
        write(files("again.TXT", "big5.txt"), 1)
        got = I.library(spark, str(tmp_path / "l"))
        assert set(shown(got["catalogue"])) == {"again.TXT", "noext", "big5.txt"} and got["blocks"].count() == 5
