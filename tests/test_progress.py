import random
from datetime import datetime, timedelta

import spec
from pyspark.sql import functions as F

from folio.streaming.progress import latest, latest_into, throttled_saves, throttled_stream


def made(seed, keys=4, n=120):
    rng, out = random.Random(seed), []
    for k in range(keys):
        t = 1_700_000_000_000
        for i in range(n):
            t += rng.choice([0, 100, 699, 700, 900, 2500, 2600, 8000, 8001, 10_500, 10_501, 50_000])
            out.append((k, t, float(i), len(out)))
    return out


def test_batch_against_the_rule(spark):
    rows = made(3)
    got = throttled_saves(spark.createDataFrame(rows, "k int, ms long, pos double, n int"), "k", "ms", "pos", "n")
    have = sorted((r.k, r.at, r.pos, r.timer) for r in got.collect())
    want = sorted((k, *s) for k in range(4) for s in spec.saves([(t, p) for kk, t, p, _ in rows if kk == k]))
    assert have == want
    empty = throttled_saves(spark.createDataFrame([], "k int, ms long, pos double, n int"), "k", "ms", "pos", "n")
    assert empty.collect() == []


def test_stream_against_the_rule(spark, tmp_path):
    rows = made(5, keys=2, n=60)
    base = datetime(2024, 1, 1)
    t0 = min(r[1] for r in rows)
    df = spark.createDataFrame([(k, base + timedelta(milliseconds=t - t0), p) for k, t, p, _ in rows] + [(99, base + timedelta(days=1), 0.0)], "k int, ts timestamp, pos double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = throttled_stream(stream, "k", "ts", "pos").writeStream.format("memory").queryName("saves").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.k, r.pos, r.timer) for r in spark.sql("SELECT * FROM saves").where("k <> 99").collect())
    want = sorted((k, p, timer) for k in range(2) for _, p, timer in spec.saves([(t, p) for kk, t, p, _ in rows if kk == k]))
    assert got == want


def test_latest_sink(spark, tmp_path):
    write = latest_into(str(tmp_path / "t"), "id", "seq")
    one = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, seq int")
    two = spark.createDataFrame([(1, "c", 2), (2, "old", 0)], "id int, v string, seq int")
    write(one, 0)
    write(two, 1)
    write(two, 1)  # a batch that is run again
    write(spark.createDataFrame([(3, "n", 5)], "id int, v string, seq int"), 2)  # touches one bucket alone
    assert sorted(map(tuple, latest(spark, str(tmp_path / "t"), 1).select("id", "v", "seq").collect())) == [(1, "c", 2), (2, "b", 1)]
    assert sorted(map(tuple, latest(spark, str(tmp_path / "t"), 2).select("id", "v", "seq").collect())) == [(1, "c", 2), (2, "b", 1), (3, "n", 5)]
    assert len(list((tmp_path / "t" / "v2" / "rows").glob("bucket_=*"))) == 1


def test_latest_sink_keeps_two_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    write = latest_into(path, "id", "seq", buckets=4)
    held = {}
    for n in range(6):
        rows = [(k, f"{n}", n) for k in range(n, 30, 3)]
        held |= {k: f"{n}" for k, _, _ in rows}
        write(spark.createDataFrame(rows, "id int, v string, seq int"), n)
        assert {r.id: r.v for r in latest(spark, path, n).collect()} == held
        write(spark.createDataFrame(rows, "id int, v string, seq int"), n)  # run again
    before = {r.id: r.v for r in latest(spark, path, 4).collect()}
    assert before == {k: max(str(n) for n in range(5) if (k - n) % 3 == 0 and k >= n) for k in before}
    # of older versions there are only the buckets that the last two still hold
    folders = {p.parent.parent.name for p in (tmp_path / "t").glob("v*/rows/bucket_=*")}
    assert {"v4", "v5"} <= folders and len(list((tmp_path / "t").glob("v*/rows/bucket_=*"))) <= 2 * 4 and not (tmp_path / "t" / "v3" / "places").exists()


def test_stream_orders_equal_times_by_tie(spark, tmp_path):
    base = datetime(2024, 1, 1)
    rows = [(1, base, 5.0, 1), (1, base + timedelta(seconds=20), 9.0, 2), (1, base + timedelta(seconds=20), 3.0, 3), (1, base + timedelta(seconds=20), 7.0, 4), (99, base + timedelta(days=1), 0.0, 5)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, pos double, n int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = throttled_stream(stream, "k", "ts", "pos", tie="n").writeStream.format("memory").queryName("tied").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.pos, r.timer) for r in spark.sql("SELECT * FROM tied").where("k = 1").collect())
    batch = throttled_saves(df.where("k = 1").withColumn("ms", F.unix_millis("ts")), "k", "ms", "pos", "n")
    assert got == sorted((r.pos, r.timer) for r in batch.collect()) == [(5.0, False), (7.0, True), (9.0, False)]
