"""A keyed store: bucketed tables in which a key, and the notes of a book, are read from one bucket.

Tables hold versions of rows: put() and delete() append, a read takes the last version of
each row, and compact() leaves one.  A table is bucketed by the column that it is asked
for; reading a key prunes to its bucket, and the last versions are found without an
exchange, as all of them lie in it.  Each write makes one file a bucket at most.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of rows: the columns that identify one, and the one that tables are bucketed by.
KINDS = {"books": (["id"], "id"), "docs": (["id"], "id"), "files": (["id"], "id"), "notes": (["book_id", "id"], "book_id")}
VERSION, GONE = "version_", "gone_"


class Store:
    def __init__(self, spark: SparkSession, database: str, buckets: int = 64):
        self.spark, self.database, self.buckets = spark, database, buckets
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")

    def table(self, kind: str) -> str:
        return f"{self.database}.{kind}"

    def has(self, kind: str) -> bool:
        return self.spark.catalog.tableExists(self.table(kind))

    def _append(self, kind: str, rows: DataFrame, gone: bool) -> None:
        by = KINDS[kind][1]
        # versions only have to rise from one write to the next of the store's one writer
        rows = rows.withColumns({VERSION: F.lit(time.time_ns()), GONE: F.lit(gone)})
        self._written(rows, by, self.table(kind), "append")

    def _written(self, rows: DataFrame, by: str, table: str, mode: str) -> None:
        rows.repartition(self.buckets, by).write.mode(mode).format("parquet").bucketBy(self.buckets, by).sortBy(by).saveAsTable(table)

    def put(self, kind: str, rows: DataFrame) -> None:
        """Add rows or replace those with their keys; of equal keys in `rows` one stays."""
        self._append(kind, rows.dropDuplicates(KINDS[kind][0]), False)

    def all(self, kind: str) -> DataFrame:
        return self._last(kind, self.spark.table(self.table(kind)))

    def _last(self, kind: str, rows: DataFrame) -> DataFrame:
        keys = KINDS[kind][0]
        kept = [c for c in rows.columns if c not in (VERSION, GONE)]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*kept, GONE), VERSION).alias("r"))
        return last.where(~F.col(f"r.{GONE}")).select(*[F.col("r")[c].alias(c) for c in kept])

    def get(self, kind: str, *keys) -> DataFrame:
        """The rows with one of `keys` in the column that the table is bucketed by: a book's row, a book's notes."""
        return self._last(kind, self.spark.table(self.table(kind)).where(F.col(KINDS[kind][1]).isin(*keys)))

    def delete(self, kind: str, keys: DataFrame) -> None:
        """Delete the rows whose key columns, all or the first of them, are in `keys`."""
        on = [c for c in KINDS[kind][0] if c in keys.columns]
        self._append(kind, self.all(kind).join(keys.select(*on).distinct(), on, "left_semi"), True)

    def delete_books(self, ids: DataFrame) -> None:
        """Delete books (id) with everything that belongs to them; the books' rows last, so that what fails can be run again."""
        for kind in ("notes", "files", "docs", "books"):
            if self.has(kind):
                self.delete(kind, ids.select(F.col("id").alias(KINDS[kind][0][0])))

    def compact(self, kind: str) -> None:
        """Write the last versions anew, beside the table, and put them in its place."""
        table, fresh = self.table(kind), f"{self.table(kind)}_fresh"
        self.spark.sql(f"DROP TABLE IF EXISTS {fresh}")
        rows = self.all(kind).withColumns({VERSION: F.lit(time.time_ns()), GONE: F.lit(False)})
        self._written(rows, KINDS[kind][1], fresh, "overwrite")
        self.spark.sql(f"DROP TABLE {table}")
        self.spark.sql(f"ALTER TABLE {fresh} RENAME TO {table}")
