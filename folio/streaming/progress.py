"""Throttled progress saves: few writes for many position events.

On an event: the newest position is pending and a running timer is dropped.  If the last
save is over SAVE_AFTER_MS ago it is saved at once; else a timer of WAIT_LONG_MS starts
(last save under WAIT_LONG_MS ago) or of WAIT_SHORT_MS.  A timer that runs out saves.  A timer due at
the time of an event fires before it.

A pause longer than SAVE_AFTER_MS + WAIT_LONG_MS leaves nothing pending and makes the next
event save at once whatever came before.  The batch form therefore cuts a key's events
into sessions at such pauses, and folds over one session at a time; the stream form keeps
(last save, pending, due) per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAVE_AFTER_MS, WAIT_LONG_MS, WAIT_SHORT_MS = 8000, 2500, 700
APART_MS = SAVE_AFTER_MS + WAIT_LONG_MS

_SAVES = "array<struct<at:bigint,pos:double,timer:boolean>>"


def throttled_saves(events: DataFrame, key: str, ts_ms: str, pos: str, tie: str) -> DataFrame:
    """(key, at, pos, timer): when which position is saved, and whether by a timer; `tie` orders events of one time."""
    w = Window.partitionBy(key).orderBy(ts_ms, tie)
    apart = F.coalesce(F.col(ts_ms) - F.lag(ts_ms).over(w) > APART_MS, F.lit(True))
    rows = events.select(key, ts_ms, tie, pos, apart.alias("__new")).withColumn("__session", F.sum(F.col("__new").cast("long")).over(w))
    sessions = rows.groupBy(key, "__session").agg(F.array_sort(F.collect_list(F.struct(F.col(ts_ms).alias("t"), F.col(tie).alias("tie"), F.col(pos).cast("double").alias("pos")))).alias("es"))
    none = F.lit(None).cast("bigint")
    state = F.struct(F.array().cast(_SAVES).alias("out"), none.alias("saved"), none.alias("due"), F.lit(None).cast("double").alias("pending"))
    save = lambda at, p, timer: F.struct(at.alias("at"), p.alias("pos"), F.lit(timer).alias("timer"))

    def step(s: Column, e: Column) -> Column:
        fired = s["due"].isNotNull() & (s["due"] <= e["t"])
        out = F.when(fired, F.array_append(s["out"], save(s["due"], s["pending"], True))).otherwise(s["out"])
        saved = F.when(fired, s["due"]).otherwise(s["saved"])
        since = e["t"] - saved
        now = saved.isNull() | (since > SAVE_AFTER_MS)
        due = e["t"] + F.when(since < WAIT_LONG_MS, WAIT_LONG_MS).otherwise(WAIT_SHORT_MS)
        return F.struct(F.when(now, F.array_append(out, save(e["t"], e["pos"], False))).otherwise(out).alias("out"), F.when(now, e["t"]).otherwise(saved).alias("saved"), F.when(~now, due).alias("due"), F.when(~now, e["pos"]).alias("pending"))

    done = F.aggregate("es", state, step, lambda s: F.when(s["due"].isNull(), s["out"]).otherwise(F.array_append(s["out"], save(s["due"], s["pending"], True))))
    return sessions.select(key, F.inline(done))


def throttled_stream(events: DataFrame, key: str, ts: str, pos: str, late: str = "1 minute", tie: str | None = None) -> DataFrame:
    """The same over a stream with an event time `ts`: events are taken as they come, later ones than `late` are lost.

    `tie`, a column of numbers, orders events of one time that come together; without it their positions do.

    Timers run on event time: they fire at the next event of their key or when the
    watermark has passed them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def saves(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved, due, pending = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            if due is not None:
                out.append((due, pending, True))
                saved, due, pending = due, None, None
            elif state.getCurrentWatermarkMs() > saved + APART_MS:
                # whatever comes next is saved at once: nothing to remember
                state.remove()
                yield pd.DataFrame({"key": [], "at": [], "pos": [], "timer": []})
                return
        else:
            rows = pd.concat(frames).sort_values(["ms", "tie"], kind="stable")
            for t, p in zip(rows["ms"].tolist(), rows["pos"].tolist(), strict=True):
                if due is not None and due <= t:
                    out.append((due, pending, True))
                    saved, due, pending = due, None, None
                if saved is None or t - saved > SAVE_AFTER_MS:
                    out.append((t, p, False))
                    saved, due, pending = t, None, None
                else:
                    due, pending = t + (WAIT_LONG_MS if t - saved < WAIT_LONG_MS else WAIT_SHORT_MS), p
        state.update((saved, due, pending))
        wake = saved + APART_MS + 1 if due is None else due
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "at": [x[0] for x in out], "pos": [x[1] for x in out], "timer": [x[2] for x in out]})

    kind = events.schema[key].dataType.simpleString()
    rows = events.withWatermark(ts, late).select(F.col(key).alias("key"), F.col(ts), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(pos).cast("double").alias("pos"), F.col(tie or pos).cast("double" if tie is None else events.schema[tie].dataType).alias("tie"))
    out = rows.groupBy("key").applyInPandasWithState(saves, f"key {kind}, at bigint, pos double, timer boolean", "saved bigint, due bigint, pending double", "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumnRenamed("key", key)


def latest_into(path: str, key: str, seq: str, buckets: int = 64):
    """A foreachBatch sink that keeps the last row per key in Parquet folders path/v0, path/v1, ...

    Every batch writes a new version from the one before it, so a batch that is run again
    after a failure writes the same.  Keys lie in
    folders by hash, and only the folders that a batch touches are written anew: a version
    says for the others which version holds them.  Read with latest().

    A version stays until two more have been written: readers of the last but one are not
    disturbed, and what neither of the last two holds is deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        held = _places(spark, path, number - 1) if number > 0 else {}
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        new = batch.withColumn("bucket_", bucket)
        touched = sorted(r[0] for r in new.select("bucket_").distinct().collect())  # at most `buckets`
        old = [f"{path}/v{held[b]}/rows/bucket_={b}" for b in touched if b in held]
        if old:
            new = new.unionByName(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket_", bucket))
        last = new.groupBy("bucket_", key).agg(F.max_by(F.struct(*batch.columns), F.struct(seq, F.xxhash64(*batch.columns))).alias("r")).select("r.*", "bucket_")
        last.write.mode("overwrite").partitionBy("bucket_").parquet(f"{path}/v{number}/rows")
        places = sorted((held | dict.fromkeys(touched, number)).items())
        spark.createDataFrame(places, "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{number}/places")
        batch.unpersist()
        if number > 1 and _exists(spark, f"{path}/v{number - 2}/places"):
            for b, v in _places(spark, path, number - 2).items():
                if held.get(b) != v and (b, v) not in places:
                    _delete(spark, f"{path}/v{v}/rows/bucket_={b}")
            _delete(spark, f"{path}/v{number - 2}/places")

    return write


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    system, p = _hadoop(spark, path)
    return system.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    system, p = _hadoop(spark, path)
    system.delete(p, True)


def _places(spark: SparkSession, path: str, number: int) -> dict[int, int]:
    """Which version holds each bucket, as of version `number`."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{path}/v{number}/places").collect()}


def latest(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The rows that latest_into() holds as of batch `number`."""
    held = _places(spark, path, number)
    parts: dict[int, list[str]] = {}
    for b, v in held.items():
        parts.setdefault(v, []).append(f"{path}/v{v}/rows/bucket_={b}")
    return spark.read.parquet(*[p for ps in parts.values() for p in ps])
