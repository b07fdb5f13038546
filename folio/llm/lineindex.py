"""A line index in a folder, which outlives the session that made it.

The counts and filters are those of linededup.LineIndex.  A batch of documents, inserted or
deleted, makes a new version: its reference counts, and the repeated keys and the filters
of the shards that it touches; for all others the version says which earlier one holds
them.  The manifest, written last, names all this: an index is opened at the last whole
manifest, and what a failed batch has left behind is never read.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folio.llm import linededup
from folio.llm.common import if_small, materialise
from folio.llm.linededup import LineIndex


class StoredLineIndex(LineIndex):
    """LineIndex under `path`, opened if there is one; its two limits must then be the same."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 40, min_docs: int = 5):
        super().__init__(spark, min_chars, min_docs, path.rstrip("/"))
        self.version = max(self._versions(), default=-1)
        self._open()

    def _versions(self) -> list[int]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        system = top.getFileSystem(conf)
        if not system.exists(top):
            return []
        return [int(s.getPath().getName()) for s in system.listStatus(top) if system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]

    def _open(self) -> None:
        """Take on the state of the last manifest."""
        held = {"batches": [], "shards": linededup.LEAST_SHARDS, "repeated": {}, "filters": {}, "limits": [self.min_chars, self.min_docs]}
        if self.version >= 0:
            held = json.loads(self.spark.read.text(f"{self.path}/manifests/{self.version}", wholetext=True).first().value)
        if held["limits"] != [self.min_chars, self.min_docs]:
            raise ValueError(f"the index under {self.path} has the limits {held['limits']}")
        self.batches, self.shards = held["batches"], held["shards"]
        self.places = {t: {int(s): at for s, at in held[t].items()} for t in ("repeated", "filters")}
        self.schemas = held.get("schemas")
        if self.schemas:
            self._repeated, self.filters = (self._held(t, None) for t in ("repeated", "filters"))
            self.filter_bytes = self.filters.agg(F.coalesce(F.sum(F.octet_length("filter")), F.lit(0))).first()[0]

    def _held(self, table: str, shards: list[int] | None) -> DataFrame:
        """The rows of `table` of some shards, or of all."""
        paths = [f"{at}/{table}/part={s}" for s, at in sorted(self.places[table].items()) if shards is None or s in shards]
        schema = StructType.fromJson(self.schemas[table])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> None:
        try:
            self._add(rows)
        except BaseException:
            self._open()  # as if the batch had not been there
            raise

    def _add(self, rows: DataFrame) -> None:
        at = f"{self.path}/{self.version + 1:06d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{at}/refs")
        first = not self.batches
        self.batches = [*self.batches, f"{at}/refs"]
        keys = materialise(self.spark.read.parquet(f"{at}/refs").select("hi", "lo").distinct(), "changed")
        counts = self.postings(None if first else keys).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        counts = materialise(counts.where(F.col("n_docs") >= self.min_docs), "counts")
        touched, before = None, None
        if not first:
            touched = sorted(r[0] for r in keys.select(self._shard().alias("s")).distinct().collect())  # at most as many as shards
            before = self._held("repeated", touched)
            grown = self._held("repeated", None).count() + counts.count()
            if max(linededup.LEAST_SHARDS, 1 << (grown // linededup.SHARD_KEYS).bit_length()) > self.shards:
                touched, before = None, self._held("repeated", None)
            counts = counts.unionByName(before.join(if_small(keys), ["hi", "lo"], "left_anti"))
        self._repeated = materialise(counts, "repeated")
        self.filters = None if touched is None else self._held("filters", touched)
        self._update_filters(None if touched is None else before)
        self.schemas = {"repeated": self._repeated.schema.jsonValue(), "filters": self.filters.schema.jsonValue()}
        for table, part in (("repeated", self._shard()), ("filters", F.col("shard"))):
            df = getattr(self, "_repeated" if table == "repeated" else table).withColumn("part", part)
            df.repartition("part").write.partitionBy("part").parquet(f"{at}/{table}")
            now = {r[0]: at for r in df.select("part").distinct().collect()}
            self.places[table] = now if touched is None else {s: p for s, p in self.places[table].items() if s not in touched} | now
        self._commit()
        self._open()

    def _commit(self) -> None:
        self.version += 1
        held = {"batches": self.batches, "shards": self.shards, "limits": [self.min_chars, self.min_docs], "schemas": self.schemas, **self.places}
        try:
            self.spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/{self.version}")
        except BaseException:
            self.version -= 1
            raise
