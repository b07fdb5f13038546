"""Reversible line dedup: exact reference counts with sharded cuckoo filters before them.

A line's key is the line stripped of white space at both ends with A-Z lower-cased; keys
of `min_chars` code points or more are indexed.  A LineIndex is a folder of postings
(128-bit key, document, references), one table a batch, signed: inserting documents adds
references, deleting them takes the same ones away again.  Keys found in `min_docs`
documents are the repeated ones; a batch changes the counts of its own keys alone.

The repeated keys are dealt over shards, each with a cuckoo filter kept in a table: keys
that reach `min_docs` are inserted, keys that fall below are deleted, and a filter about
to be full is made anew, twice as large, from the exact counts of its shard.  Lines are
first asked of the filters.  While all filters together are small they are broadcast;
beyond, the line keys go to the tasks that hold their shard's filter.  Keys that pass are
joined with the exact counts, so a filter never decides anything by itself.

A repeated key keeps its lines in one document, the largest id that holds it.

Edge cases: a null or empty text is one empty line; a document that repeats a line counts
once; repeated rows (same id) are one document, and each keeps or loses the same lines;
a null id is never the one that keeps a repeated line unless all its holders are null;
deleting what was never inserted changes nothing; an empty table gives an empty table;
a text of any length is split by one task; other columns are not read and may have any
name, but for the two that apply() adds, which replace those of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_ROWS, SPACE_BYTES, bound_batches, if_small, materialise, new_path, set_aside, text_or_empty

#: Repeated keys in a shard, about; shards are a power of two, at least LEAST_SHARDS.
SHARD_KEYS, LEAST_SHARDS = 200_000, 64
#: Filters are broadcast up to this many bytes in all; beyond, line keys are shuffled to them.
FILTER_BYTES = 16 << 20
SLOTS, KICKS = 4, 500
#: Parts that the lines of a shard are dealt into where they are shuffled to its filter.
SALTS = 8
#: The share of its slots up to which a filter is filled before it is made anew.
FULLEST = 0.9


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key has two buckets, each found from the other."""

    def __init__(self, buckets: int):
        self.table = np.zeros((1 << max(0, (buckets - 1).bit_length()), SLOTS), np.uint16)
        self.spare: list[tuple[int, int]] = []  # what found no place: kept aside, never lost

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        return cls(max(1, int(n / (SLOTS * 0.8)) + 1))

    @classmethod
    def of_keys(cls, keys: list[int]) -> CuckooFilter:
        """A filter of these keys, of twice the size for as long as one finds no place."""
        n = len(keys)
        while True:
            out = cls.for_keys(n)
            for k in keys:
                out.insert(k)
                if out.spare:
                    break
            else:
                return out
            n = 2 * n + SLOTS

    def has_room(self, n: int, more: int) -> bool:
        """Whether `more` keys may come to the n that are there."""
        return n + more <= FULLEST * self.table.size

    @staticmethod
    def mix(x: int) -> int:
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
        return x ^ (x >> 33)

    def places(self, key: int) -> tuple[int, int, int]:
        h = self.mix(key & 0xFFFFFFFFFFFFFFFF)
        mark = (h >> 48) or 1
        a = h & (len(self.table) - 1)
        return mark, a, self.other(a, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (self.mix(mark) & (len(self.table) - 1))

    def put(self, bucket: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[bucket] == 0)
        if free.size:
            self.table[bucket, free[0]] = mark
        return bool(free.size)

    def insert(self, key: int) -> None:
        mark, a, b = self.places(key)
        if self.put(a, mark) or self.put(b, mark):
            return
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[b, slot] = int(self.table[b, slot]), mark
            b = self.other(b, mark)
            if self.put(b, mark):
                return
        self.spare.append((b, mark))

    def delete(self, key: int) -> None:
        """Take out a key that was inserted."""
        mark, a, b = self.places(key)
        for bucket in (a, b):
            at = np.flatnonzero(self.table[bucket] == mark)
            if at.size:
                self.table[bucket, at[0]] = 0
                return
        for place in ((a, mark), (b, mark)):
            if place in self.spare:
                self.spare.remove(place)
                return

    def might_hold(self, keys: np.ndarray) -> np.ndarray:
        """For many keys at once (int64)."""
        h = self.mixes(keys.astype(np.uint64))
        mark = (h >> np.uint64(48)).astype(np.uint64)
        mark[mark == 0] = 1
        cover = np.uint64(len(self.table) - 1)
        a = h & cover
        b = a ^ (self.mixes(mark) & cover)
        found = (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)
        for bucket, one in self.spare:
            found |= ((a == bucket) | (b == bucket)) & (mark == one)
        return found

    @staticmethod
    def mixes(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(33))

    def to_bytes(self) -> bytes:
        head = np.array([len(self.table), len(self.spare), *[v for p in self.spare for v in p]], np.int64)
        return head.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        n, spare = np.frombuffer(data, np.int64, 2)
        out = cls(1)
        flat = np.frombuffer(data, np.int64, 2 * int(spare), 16).tolist()
        out.spare = list(zip(flat[::2], flat[1::2], strict=True))
        out.table = np.frombuffer(data, np.uint16, int(n) * SLOTS, 16 + 16 * int(spare)).reshape(-1, SLOTS).copy()
        return out


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE_BYTES).lower()  # bytes.lower() changes A-Z alone


def points(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data) - len(data.translate(None, bytes([*range(0x80), *range(0xC0, 0x100)])))


def halves(key: bytes) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(key), ">i8")
    return int(d[0]), int(d[1])


def passing(hi: np.ndarray, lo: np.ndarray, shards: int, filters: dict[int, CuckooFilter]) -> np.ndarray:
    """Which keys the filters of their shards let through."""
    shard, keep = hi & (shards - 1), np.zeros(hi.size, bool)
    order = np.argsort(shard, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if mine.size and (one := filters.get(int(shard[mine[0]]))) is not None:
            keep[mine] = one.might_hold(lo[mine])
    return keep


def line_keys(docs: DataFrame, min_chars: int, filters: Broadcast | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, tag, pos, hi, lo) for the lines with a key to index; tag tells texts of one id apart.

    With `filters` (a broadcast of the number of shards and their filters), only lines that
    a filter lets through.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, digests = [], [], []
            for i, text in enumerate(batch.column(2)):
                for k, line in enumerate(text.as_py().encode().split(b"\n")):
                    if len(line) >= min_chars and len(key := line_key(line)) >= min_chars and points(key) >= min_chars:
                        row.append(i)
                        pos.append(k)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            row, pos = np.array(row, np.int64), np.array(pos, np.int32)
            if filters is not None and len(row):
                keep = passing(halves[:, 0], halves[:, 1], *filters.value)
                row, pos, halves = row[keep], pos[keep], halves[keep]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc", "tag", "pos", "hi", "lo"])

    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_or_empty(text_col)).alias("tag"), text_or_empty(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    return texts.mapInArrow(keys, f"doc {kind}, tag bigint, pos int, hi bigint, lo bigint")


class LineIndex:
    """Reference counts of lines in a folder of the shared file system, batch by batch."""

    def __init__(self, spark: SparkSession, min_chars: int = 40, min_docs: int = 5, path: str | None = None):
        self.spark, self.min_chars, self.min_docs = spark, min_chars, min_docs
        self.path = path or new_path(spark, "lines")
        self.batches: list[str] = []
        self.shards, self.filter_bytes = LEAST_SHARDS, 0
        #: (shard, n_keys, filter), and (hi, lo, n_docs, last_doc) of the repeated keys.
        self.filters: DataFrame | None = None
        self._repeated: DataFrame | None = None

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        found = line_keys(docs, self.min_chars, None, id_col, text_col)
        # a document's own repeats become one reference count before anything is written
        self._write(found.groupBy("hi", "lo", "doc").agg(F.count("*").alias("refs")))

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take back documents that were inserted, given with their texts; others are passed over."""
        if not self.batches:
            return
        found = line_keys(docs, self.min_chars, None, id_col, text_col)
        gone = materialise(found.groupBy("hi", "lo", F.col("doc").alias("of")).agg(F.count("*").alias("less")), "gone")
        held = self.postings(gone.select("hi", "lo").distinct())
        taken = held.join(gone, ["hi", "lo"]).where(F.col("doc").eqNullSafe(F.col("of")))
        self._write(taken.select("hi", "lo", "doc", (-F.least("refs", "less")).alias("refs")))

    def _write(self, rows: DataFrame) -> None:
        at = f"{self.path}/batch-{len(self.batches):06d}"
        rows.write.parquet(at)
        first = not self.batches
        self.batches.append(at)
        keys = None if first else materialise(self.spark.read.parquet(at).select("hi", "lo").distinct(), "changed")
        counts = self.postings(keys).groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc")).where(F.col("n_docs") >= self.min_docs)
        before = self._repeated
        if before is not None:
            counts = counts.unionByName(before.join(if_small(keys), ["hi", "lo"], "left_anti"))
        self._repeated = materialise(counts, "repeated")
        self._update_filters(before)

    def postings(self, keys: DataFrame | None = None) -> DataFrame:
        """(hi, lo, doc, refs): the documents that hold each key now, or each of the given keys.

        Of the earlier batches only the rows of these keys are shuffled.
        """
        rows = self.spark.read.parquet(*self.batches)
        if keys is not None:
            rows = rows.join(if_small(keys), ["hi", "lo"], "left_semi")
        if len(self.batches) == 1:
            return rows
        return rows.groupBy("hi", "lo", "doc").agg(F.sum("refs").alias("refs")).where("refs > 0")

    def repeated(self) -> DataFrame:
        """(hi, lo, n_docs, last_doc) of keys in at least min_docs documents."""
        return self._repeated

    def _update_filters(self, before: DataFrame | None) -> None:
        """Per shard: insert keys that have become repeated, delete those that no longer are.

        All filters are made anew when the keys outgrow the number of shards.
        """
        now = self._repeated.select("hi", "lo")
        shards = max(LEAST_SHARDS, 1 << (max(1, now.count()) // SHARD_KEYS).bit_length())
        if before is None or self.filters is None or shards > self.shards:
            self.shards, old = max(shards, self.shards), None
            change = now.withColumn("step", F.lit(1))
        else:
            old = self.filters
            change = now.join(before, ["hi", "lo"], "left_anti").withColumn("step", F.lit(1)).unionByName(before.select("hi", "lo").join(now, ["hi", "lo"], "left_anti").withColumn("step", F.lit(-1)))
        change = change.withColumn("shard", self._shard())
        if old is not None:
            # shards that would be too full are made anew from all their keys (step 0: as they are)
            change = materialise(change, "change")
            more = change.where("step > 0").groupBy("shard").agg(F.count("*").alias("more"))
            slots = (F.octet_length("filter") - 16) / 2
            full = materialise(more.join(old, "shard", "left").where(F.coalesce("n_keys", F.lit(0)) + F.col("more") > FULLEST * F.coalesce(slots, F.lit(0))).select("shard"), "full")
            change = change.unionByName(now.withColumn("step", F.lit(0)).withColumn("shard", self._shard()).join(F.broadcast(full), "shard", "left_semi"))

        def build(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
            lo, step = rows["lo"].to_numpy(), rows["step"].to_numpy()
            if (step == 0).any() or not held.num_rows:
                # with step 0, rows hold every key of the shard, new ones twice
                keys = np.sort(lo[step == 0]) if (step == 0).any() else np.sort(lo[step > 0])
                one, n = CuckooFilter.of_keys(keys.tolist()), keys.size
            else:
                one, n = CuckooFilter.from_bytes(held["filter"][0].as_py()), held["n_keys"][0].as_py()
                for k, d in sorted(zip(lo.tolist(), step.tolist(), strict=True)):
                    one.insert(k) if d > 0 else one.delete(k)
                    n += d
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "n_keys": pa.array([n], pa.int64()), "filter": pa.array([one.to_bytes()], pa.binary())})

        held = old if old is not None else self.spark.createDataFrame([], "shard bigint, n_keys bigint, filter binary")
        changed = change.select("shard", "lo", "step").groupBy("shard").cogroup(held.join(change.select("shard").distinct(), "shard", "left_semi").groupBy("shard"))
        filters = changed.applyInArrow(build, "shard bigint, n_keys bigint, filter binary")
        if old is not None:
            filters = filters.unionByName(old.join(change.select("shard").distinct(), "shard", "left_anti"))
        self.filters = materialise(filters, "filters")
        self.filter_bytes = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0

    def _shard(self):
        return F.col("hi").bitwiseAND(self.shards - 1)

    def _passing(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """line_keys() of the lines that the filters let through."""
        if self.filter_bytes <= FILTER_BYTES:
            held = {r.shard: CuckooFilter.from_bytes(r.filter) for r in self.filters.toLocalIterator()}
            return line_keys(docs, self.min_chars, self.spark.sparkContext.broadcast((self.shards, held)), id_col, text_col)
        lines = line_keys(docs, self.min_chars, None, id_col, text_col)
        kind = lines.schema["doc"].dataType
        none = lambda x, t: F.lit(None).cast(t).alias(x)
        salts = F.array(*[F.lit(i) for i in range(SALTS)])
        heads = self.filters.withColumn("salt", F.explode(salts)).select((F.col("shard") * SALTS + F.col("salt")).alias("place"), "filter", none("doc", kind), none("tag", "bigint"), none("pos", "int"), none("hi", "bigint"), none("lo", "bigint"))
        rows = lines.select((self._shard() * SALTS + F.pmod(F.xxhash64("doc", "pos"), F.lit(SALTS))).alias("place"), none("filter", "binary"), "doc", "tag", "pos", "hi", "lo").unionByName(heads)
        # a shard's filter, then a part of its lines, as one stream
        routed = rows.repartition("place").sortWithinPartitions("place", F.col("filter").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, one = None, None
            for batch in batches:
                places = batch.column(0).to_numpy()
                for at in np.flatnonzero(np.r_[True, np.diff(places) != 0])[: batch.num_rows].tolist():
                    rows = batch.slice(at, int(np.searchsorted(places, places[at], side="right")) - at)
                    if places[at] != here:
                        here, one = places[at], None
                    if rows.column(1)[0].is_valid:
                        one, rows = CuckooFilter.from_bytes(rows.column(1)[0].as_py()), rows.slice(1)
                    keep = np.zeros(rows.num_rows, bool) if one is None else one.might_hold(rows.column(6).to_numpy())
                    yield pa.RecordBatch.from_arrays(rows.columns[2:], names=["doc", "tag", "pos", "hi", "lo"]).filter(pa.array(keep))

        return routed.mapInArrow(probe, f"doc {kind.simpleString()}, tag bigint, pos int, hi bigint, lo bigint")

    def dropped_lines(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc, tag, drops): the positions of the lines each text loses, for texts that lose any."""
        hits = self._passing(docs, id_col, text_col)
        exact = hits.join(if_small(self._repeated), ["hi", "lo"]).where(~F.col("doc").eqNullSafe(F.col("last_doc")))
        return exact.groupBy("doc", "tag").agg(F.collect_set("pos").alias("drops"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """`docs` without the lines that repeat: all its columns, then __line_total and __line_drops.

        The joined text replaces text_col; a null text stays null.
        """
        drops = materialise(self.dropped_lines(docs, id_col, text_col), "drops")
        if (drops.agg(F.sum(F.size("drops"))).first()[0] or 0) <= BROADCAST_ROWS:
            drops = F.broadcast(drops)
        texts, names = set_aside(docs)
        ident, text = names[id_col], names[text_col]
        joined = texts.withColumn("text_tag", F.xxhash64(text_or_empty(text))).join(drops, F.col(ident).eqNullSafe(F.col("doc")) & (F.col("text_tag") == F.col("tag")), "left")
        lines = F.split(text_or_empty(text), "\n", -1)
        kept = F.when(F.col("drops").isNull(), F.col(text)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("drops"), i)), "\n"))
        old = [(kept if c == text_col else F.col(n)).alias(c) for c, n in names.items() if c not in ("__line_total", "__line_drops")]
        return joined.select(*old, F.size(lines).cast("long").alias("__line_total"), F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("__line_drops"))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index `docs` and return it without its repeated lines (see LineIndex.apply)."""
    index = LineIndex(docs.sparkSession, min_chars, min_docs)
    index.insert(docs, id_col, text_col)
    return index.apply(docs, id_col, text_col)
