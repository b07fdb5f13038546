"""The source of zipped archives."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F
from test_sources import CONTAINER, NAV, OPF

from folio.sources import archive as A
from folio.sources import zipped as Z


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("archives")
    (top / "in").mkdir()
    with zipfile.ZipFile(top / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.mkdir("empty")
        z.writestr("one.txt", "eins" * 1000)
        z.writestr("stored.bin", bytes(range(256)), zipfile.ZIP_STORED)
        z.writestr("d/漢字.txt", "zwei")
    with zipfile.ZipFile(top / "in" / "big.zip", "w", zipfile.ZIP_STORED) as z:
        for k in range(40):
            z.writestr(f"m{k:02}.bin", bytes([k]) * (3 << 20 if k == 7 else 50_000 + k))
    with zipfile.ZipFile(top / "zip64.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("large.txt", "w", force_zip64=True) as f:
        f.write(b"x" * 70_000)
    data = bytearray((top / "a.zip").read_bytes())
    at = data.index(b"one.txt") + len("one.txt")
    data[at : at + 4] = b"\xff\xff\xff\xff"
    (top / "broken_member.zip").write_bytes(data)
    (top / "cut.zip").write_bytes((top / "a.zip").read_bytes()[:-30])
    (top / "none.zip").write_bytes(b"")
    (top / "_hidden.zip").write_bytes(b"PK")
    return top


def read(spark, path, **options):
    Z.register(spark)
    return spark.read.format("folio_archive").options(**options).load(str(path))


def test_members(spark, folder):
    rows = {(r.path.rpartition("/")[2], r.name): r for r in read(spark, folder).collect()}
    assert rows["a.zip", "one.txt"].content == b"eins" * 1000 and rows["a.zip", "one.txt"].method == zipfile.ZIP_DEFLATED
    assert rows["a.zip", "stored.bin"].content == bytes(range(256)) and rows["a.zip", "stored.bin"].stored == 256
    assert rows["a.zip", "d/漢字.txt"].content == "zwei".encode() and ("a.zip", "empty/") not in rows
    assert rows["zip64.zip", "large.txt"].content == b"x" * 70_000
    assert all(rows["big.zip", f"m{k:02}.bin"].content == bytes([k]) * (3 << 20 if k == 7 else 50_000 + k) for k in range(40))
    bad = rows["broken_member.zip", "one.txt"]
    assert bad.content is None and bad.error and rows["broken_member.zip", "d/漢字.txt"].content == "zwei".encode()
    assert rows["cut.zip", None].error and rows["none.zip", None].error
    assert len(rows) == 3 + 40 + 1 + 3 + 2


def test_large_archives_are_split_by_members(spark, folder):
    df = read(spark, folder / "in", splitBytes=300_000)
    assert df.rdd.getNumPartitions() > 6
    assert df.count() == 40 and df.select("ordinal").distinct().count() == 40
    assert {r.n for r in df.where("length < 1000000").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()} <= set(range(1, 7))


def test_a_large_archive_is_planned_from_its_directory(folder, monkeypatch):
    reads = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def read(self, *n):
            data = self.f.read(*n)
            reads.append(len(data))
            return data

    class System:
        def open_input_file(self, path):
            return Counting(open(path, "rb"))

    reader = Z.ArchiveReader({"path": str(folder / "in"), "splitbytes": "300000"})
    monkeypatch.setattr(Z, "opened", lambda path: (System(), path))
    runs = reader.runs_of(str(folder / "in" / "big.zip"))
    assert runs[0][0] == 0 and runs[-1][1] == 40 and all(a[1] == b[0] for a, b in zip(runs, runs[1:], strict=False))
    assert sum(reads) < 70_000  # of 5 MB


def test_filters_reach_the_source(spark, folder):
    df = read(spark, folder)
    for condition, want in (("name = 'one.txt'", 2), ("name LIKE '%.bin'", 1 + 40 + 1), ("name LIKE 'm0%' AND path LIKE '%big.zip'", 10), ("name IN ('large.txt', 'x')", 1)):
        assert df.where(condition).count() == want
    reader = Z.ArchiveReader({"path": "x"})
    left = list(reader.pushFilters([Z.EqualTo(("name",), "a"), Z.EqualTo(("length",), 3), Z.StringEndsWith(("path",), ".zip")]))
    assert left == [Z.EqualTo(("length",), 3)] and [t("a") for t in reader.tests["name"]] == [True] and not reader.tests["path"][0]("b.txt")
    listed = read(spark, folder, content="false").where("name = 'one.txt'").collect()
    assert {r.content for r in listed} == {None} and {r.length for r in listed} == {4000}


def test_paths(spark, folder):
    assert read(spark, folder / "a.zip").count() == 3
    assert read(spark, folder / "z*.zip").count() == 1
    assert read(spark, f"{folder}/a.zip\nfile://{folder}/zip64.zip").count() == 4
    assert read(spark, folder, recursive="false").where("name LIKE 'm%'").count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read(spark, folder / "nowhere").count()


def test_books_from_a_folder(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", CONTAINER)
        z.writestr("O/book.opf", OPF)
        z.writestr("O/nav.xhtml", NAV)
        z.writestr("O/t/one.xhtml", "<h2>One</h2><p>text one</p>" + "<p>" + "more text " * 500_000 + "</p>")  # larger than an Arrow batch
    (tmp_path / "book.epub").write_bytes(data.getvalue())
    (tmp_path / "bad.epub").write_bytes(struct.pack("<I", 0x04034B50) + b"cut")
    files = spark.createDataFrame([(f"{tmp_path}/{n}.epub", (tmp_path / f"{n}.epub").read_bytes()) for n in ("book", "bad")], "id string, content binary")
    loaded, whole = A.load_books(spark, str(tmp_path)), A.read_books(files)
    for table in ("books", "blocks"):
        assert sorted(map(str, loaded[table].collect())) == sorted(map(str, whole[table].collect()))
    assert max(len(r.t) for r in loaded["blocks"].collect()) > 4 << 20 and [r.id.rpartition("/")[2] for r in loaded["rejected"].collect()] == ["bad.epub"]
