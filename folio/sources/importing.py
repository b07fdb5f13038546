"""Import of files of any kind: one scan, routed by format, to one schema.

Every file becomes one row of the catalogue, with the reason in `error` where it could not
be read; one file's fault stops no other.  Plain texts are decoded, archives are taken
apart in the scan itself, pages that are no text (PDF) are refused, as nothing here decodes
them.  What the scan makes, members of archives and texts, can be written to a folder once,
so that the tables made from it do not read the files again; its rows are counted as they
pass.  A file is known by the SHA-256 of its bytes: files of equal content are imported once.

import_batches() does the same for a stream of files.  A batch writes its tables in folders
of its own number, the catalogue last, and asks the other batches' catalogues what is known:
run again after a failure it writes the same rows once more in the same place.  Only
batches that have a catalogue are read by library().
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio.functions.rows import in_small_batches, stacked
from folio.functions.text import base_name, format_of
from folio.operators.documents import txt_blocks
from folio.sources.archive import books_of_members
from folio.sources.files import decoded

REFUSED = "no decoder for {}"
#: Bytes of members that go to Spark together; a larger one goes alone.
BATCH_BYTES = 1 << 20
TABLES = ("blocks", "catalogue")

_PART = pa.schema([("id", pa.string()), ("name", pa.string()), ("format", pa.string()), ("size", pa.int64()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])


def named_files(files: DataFrame) -> DataFrame:
    """(name, content) of rows of the binaryFile source, batch or stream."""
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")


def identified(files: DataFrame) -> DataFrame:
    """(id, name, content) of files (name, content): null content is empty, a null name is none."""
    content = F.coalesce("content", F.lit("").cast("binary"))
    return files.select(F.sha2(content, 256).alias("id"), F.coalesce("name", F.lit("")).alias("name"), content.alias("content"))


def once_each(files: DataFrame) -> DataFrame:
    """Of files (id, name, content) with equal content the one of the least name, and of equal names one."""
    names = files.groupBy("id", "name").agg(F.count("*").alias("n"))
    kept = names.groupBy("id").agg(F.min("name").alias("name"))
    repeated = names.where("n > 1").select("id", "name")
    one = files.join(kept, ["id", "name"], "left_semi")
    # copies of one name are rare; only they are gathered by content
    single = one.join(repeated, ["id", "name"], "left_anti")
    return single.transform(stacked, one.join(repeated, ["id", "name"], "left_semi").dropDuplicates(["id", "name"]))


def parts(files: DataFrame) -> DataFrame:
    """(id, name, format, size, member, content, error) of files (id, name, content): an archive's members, else the file."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                for part in taken_apart(row):
                    size = len(part["content"] or b"")
                    if rows and held + size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _PART)
                        rows, held = [], 0
                    rows.append(part)
                    held += size
            yield pa.RecordBatch.from_pylist(rows, _PART)

    routed = in_small_batches(files).select("id", "name", format_of(F.col("name")).alias("format"), F.octet_length("content").cast("long").alias("size"), "content")
    return routed.mapInArrow(read, "id string, name string, format string, size bigint, member string, content binary, error string")


def taken_apart(row: dict) -> Iterator[dict]:
    """The parts of one file."""
    data, part = row["content"], row | {"member": None, "content": None, "error": None}
    if row["format"] == "txt":
        yield part | {"content": data}
    elif row["format"] != "epub":
        yield part | {"error": REFUSED.format(row["format"])}
    else:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for m in z.infolist():
                    if not m.is_dir():
                        try:
                            yield part | {"member": m.filename, "content": z.read(m)}
                        except Exception as e:  # one member's fault is not the book's
                            yield part | {"member": m.filename, "error": str(e) or type(e).__name__}
        except (OSError, ValueError, zipfile.BadZipFile) as e:
            yield part | {"error": str(e) or type(e).__name__}


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """Parts to tables: catalogue (id, name, format, size, title, author, lang, encoding, n_blocks, total_chars, error), blocks, units and toc of books."""
    texts = rows.where("format = 'txt'").select("id", "name", F.octet_length("content").alias("size"), decoded(F.col("content")).alias("d"))
    texts = texts.select("id", "name", "size", "d.text", "d.encoding")
    books = books_of_members(rows.where("format = 'epub'").select("id", F.col("member").alias("name"), "content", "error"))
    blocks = txt_blocks(texts, "id").transform(stacked, books["blocks"])
    files = rows.groupBy("id").agg(F.min("name").alias("name"), F.min("format").alias("format"), F.min("size").alias("size"), F.max(F.when(F.col("member").isNull(), F.col("error"))).alias("broken"))
    counted = blocks.groupBy("id").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("t").cast("long")).alias("total_chars"))
    about = books["books"].select("id", "title", "author", "lang", F.lit(None).cast("string").alias("encoding"), F.lit(None).cast("string").alias("error"))
    about = about.transform(stacked, books["rejected"].select("id", *[F.lit(None).cast("string").alias(c) for c in about.columns[1:-1]], "error"))
    about = about.transform(stacked, texts.select("id", *[F.lit(None).cast("string").alias(c) for c in ("title", "author", "lang")], "encoding", F.lit(None).cast("string").alias("error")))
    j = files.join(about, "id", "left").join(counted, "id", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), base_name(F.col("name")))
    # texts of archives are read as UTF-8
    encoding = F.coalesce("encoding", F.when(F.col("format") == "epub", "utf-8"))
    error = F.coalesce("broken", "error")
    none = lambda c: F.when(error.isNull(), c)
    catalogue = j.select("id", "name", "format", "size", title.alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("lang", F.lit("")).alias("lang"), none(encoding).alias("encoding"), none(F.col("n_blocks")).alias("n_blocks"), none(F.col("total_chars")).alias("total_chars"), error.alias("error"))
    return {"catalogue": catalogue, "blocks": blocks, "units": books["units"], "toc": books["toc"]}


def imported(files: DataFrame, folder: str | None = None) -> tuple[dict[str, DataFrame], dict[str, int] | None]:
    """Files (name, content) to tables_of(); with `folder`, a path no one has written to, the parts are kept
    there and counted: n_files, n_bytes, n_broken files, n_parts, n_broken_parts."""
    rows = parts(once_each(identified(files)))
    if folder is None:
        return tables_of(rows), None
    seen, whole = Observation("import"), F.col("member").isNull()
    # an archive's size counts once, at its first part: distinct files are counted exactly from the parts afterwards
    rows.observe(seen, F.count("*").alias("n_parts"), F.count_if(F.col("error").isNotNull() & ~whole).alias("n_broken_parts"), F.count_if(F.col("error").isNotNull() & whole).alias("n_broken")).write.parquet(folder)
    rows = rows.sparkSession.read.schema(rows.schema).parquet(folder)
    n, size = rows.select("id", "size").distinct().agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return tables_of(rows), dict(seen.get) | {"n_files": n, "n_bytes": size}


def batches_of(spark: SparkSession, path: str, table: str) -> list[int]:
    """Numbers of the batches that have written `table`."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return []
    done = [s.getPath() for s in system.listStatus(top)]
    return sorted(int(p.getName().partition("=")[2]) for p in done if system.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def table_of(spark: SparkSession, path: str, table: str, batches: list[int]) -> DataFrame | None:
    return spark.read.option("basePath", f"{path}/{table}").parquet(*[f"{path}/{table}/batch={n}" for n in batches]) if batches else None


def import_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a stream of files (name, content): every content once, under `path`."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = table_of(spark, path, "catalogue", [n for n in batches_of(spark, path, "catalogue") if n != number])
        files = identified(batch)
        if known is not None:
            files = files.join(known.select("id").distinct(), "id", "left_anti")
        put = lambda df, table: df.write.mode("overwrite").parquet(f"{path}/{table}/batch={number}")
        # names of every file seen, known or not: the last one is a book's name
        put(identified(batch).select("id", "name").distinct(), "names")
        put(parts(once_each(files)), "parts")
        made = tables_of(spark.read.parquet(f"{path}/parts/batch={number}"))
        for table in TABLES:  # the catalogue last
            put(made[table], table)

    return write


def import_stream(files: DataFrame, path: str):
    """A writer for a stream of files (name, content) that takes what there is and ends; start() it again for more."""
    return files.writeStream.foreachBatch(import_batches(path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)


def file_stream(spark: SparkSession, folder: str, files_a_batch: int = 10_000) -> DataFrame:
    """A stream (name, content) of the files that lie or come under `folder`."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return named_files(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(folder))


def library(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """catalogue, with the last name of each file, and blocks, of the batches that are whole."""
    done = batches_of(spark, path, "catalogue")
    found = {t: table_of(spark, path, t, done) for t in (*TABLES, "names")}
    last = found["names"].groupBy("id").agg(F.max_by("name", F.struct("batch", "name")).alias("last"))
    catalogue = found["catalogue"].join(last, "id").withColumn("name", F.col("last")).drop("last")
    return {"catalogue": catalogue, "blocks": found["blocks"].drop("batch")}


def import_progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n_seen, n_new, n_failed, n_blocks) of each whole batch; catalogue has the same by document."""
    done = batches_of(spark, path, "catalogue")
    new = table_of(spark, path, "catalogue", done).groupBy("batch").agg(F.count("*").alias("n_new"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_blocks"))
    seen = table_of(spark, path, "names", done).groupBy("batch").agg(F.countDistinct("id").alias("n_seen"))
    return seen.join(new, "batch", "left").select("batch", "n_seen", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_new", "n_failed", "n_blocks")])
