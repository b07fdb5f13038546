"""Backups: books' progress and notes as one nested JSON record per backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators.library import BACKUP_COLUMNS, exported_notes
from folio.sources import named

VERSION = 1
BOOK = "struct<id:string,title:string,author:string,format:string,file_name:string,size:bigint,total_chars:bigint,added_at:bigint,last_read_at:bigint,finished:boolean,anchor:struct<b:int,o:int>,percent:double>"
NOTE = "struct<id:string,book_id:string,b:int,o:int,quote:string,text:string,chapter_title:string,created_at:bigint,updated_at:bigint>"
SCHEMA = f"app string, version int, exportedAt string, books array<{BOOK}>, annots array<{NOTE}>"


def export_backup(books: DataFrame, notes: DataFrame, app: str, at: Column, owner: str | None = None) -> DataFrame:
    """Rows (owner, value): per owner the JSON text of a backup, books in shelf order, notes of books that exist in their books' order.

    A backup is one library's: without `owner`, a column of books, all of it is one record.
    """
    key = F.col(owner) if owner else F.lit(0)
    when = F.coalesce(F.nullif("last_read_at", F.lit(0)), F.nullif("added_at", F.lit(0)), F.lit(0))
    b = books.withColumns({"finished": F.coalesce("finished", F.lit(False)), "owner_": key, "k_": -when})
    n = exported_notes(notes, books).join(b.select(F.col("id").alias("book_id"), "owner_", "k_"), "book_id")
    listed = n.select("owner_", F.struct("k_", F.struct("book_id", "b", "o", "id").alias("o"), F.struct("id", "book_id", "b", "o", "quote", "text", "chapter_title", "created_at", "updated_at").alias("x")).alias("e"))
    one = b.groupBy("owner_").agg(F.transform(F.array_sort(F.collect_list(F.struct("k_", F.col("id").alias("i"), F.struct(*BACKUP_COLUMNS).alias("x")))), lambda e: e["x"]).alias("books"))
    two = listed.groupBy("owner_").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["x"]).alias("annots"))
    whole = one.join(two, "owner_", "left").withColumn("annots", F.coalesce("annots", F.array().cast(two.schema["annots"].dataType)))
    return whole.select(*([F.col("owner_").alias(owner)] if owner else []), F.to_json(F.struct(F.lit(app).alias("app"), F.lit(VERSION).alias("version"), at.alias("exportedAt"), "books", "annots")).alias("value"))


def backup_name(at: Column, app: str) -> Column:
    return F.concat(F.lit(f"{app}-backup-"), F.date_format(at, "yyyy-MM-dd"), F.lit(".json"))


def write_backups(books: DataFrame, notes: DataFrame, app: str, at: Column, path: str, owner: str | None = None) -> None:
    """One file a library under `path`, called by backup_name(), and by the owner where there is one; all or none of them."""
    named.register(books.sparkSession)
    rows = export_backup(books, notes, app, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX"), owner)
    whose = F.concat(F.col(owner).cast("string"), F.lit("-")) if owner else F.lit("")
    rows.select(F.concat(whose, backup_name(at, app)).alias("name"), "value").write.format("folio_named").mode("append").save(path)


def parsed_backup(raw: DataFrame, app: str, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(books, notes), with their place `seq`, of rows with the fields of SCHEMA; those of another app are refused."""
    good = raw.where(F.assert_true(F.col("app").eqNullSafe(F.lit(app)), "not a backup of this library").isNull())
    return tuple(good.select(*keys, F.posexplode(c).alias("seq", "x")).select(*keys, "x.*", "seq") for c in ("books", "annots"))


def read_backup(spark: SparkSession, path: str, app: str) -> tuple[DataFrame, DataFrame]:
    """(books, notes) of the backup files of `app` under `path`; other files are refused."""
    return parsed_backup(spark.read.schema(SCHEMA).json(path, multiLine=True), app)
