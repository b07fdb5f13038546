"""The line index that outlives its session."""

import brute
import pytest
from test_dedup import line_rows

from folio.llm import common, linededup
from folio.llm.linededup import CuckooFilter
from folio.llm.lineindex import StoredLineIndex

LINE = "line number {} that is long enough to be counted as one"
ROWS = [(i, "\n".join(LINE.format(k) for k in range(60) if (k + i) % 3 or k < 12) + f"\nshort {i}") for i in range(12)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def check(index, spark, rows):
    assert line_rows(index.apply(docs_of(spark, rows))) == sorted(brute.lines(rows))
    keys = {(r.hi, r.lo) for r in index.repeated().collect()}
    for r in index.filters.collect():
        one = CuckooFilter.from_bytes(r.filter)
        assert int((one.table > 0).sum()) + len(one.spare) == r.n_keys == sum(hi & index.shards - 1 == r.shard for hi, _ in keys)


def test_reopened(spark, tmp_path):
    path = str(tmp_path / "index")
    StoredLineIndex(spark, path).insert(docs_of(spark, ROWS[:5]))
    common.release(spark)  # the session's working tables go, the index does not need them
    index = StoredLineIndex(spark, path)
    index.insert(docs_of(spark, ROWS[5:]))
    common.release(spark)
    check(StoredLineIndex(spark, path), spark, ROWS)
    again = StoredLineIndex(spark, path)
    again.delete(docs_of(spark, ROWS[8:]))
    common.release(spark)
    check(StoredLineIndex(spark, path), spark, ROWS[:8])
    with pytest.raises(ValueError, match="limits"):
        StoredLineIndex(spark, path, min_docs=6)


def test_a_failed_batch_leaves_nothing(spark, tmp_path, monkeypatch):
    index = StoredLineIndex(spark, str(tmp_path / "index"))
    index.insert(docs_of(spark, ROWS[:7]))
    for step in ("_update_filters", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(index, step, lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                index.insert(docs_of(spark, ROWS[7:]))
        check(index, spark, ROWS[:7])
    check(StoredLineIndex(spark, str(tmp_path / "index")), spark, ROWS[:7])
    index.insert(docs_of(spark, ROWS[7:]))  # the batch once more
    check(index, spark, ROWS)


def test_only_touched_shards_are_written(spark, tmp_path, monkeypatch):
    index = StoredLineIndex(spark, str(tmp_path / "index"))
    index.insert(docs_of(spark, ROWS))
    one = [(100, LINE.format(3))]
    index.insert(docs_of(spark, one))
    last = sorted((tmp_path / "index").glob("000001-*"))[0]
    assert [len(list((last / t).glob("part=*"))) for t in ("repeated", "filters")] == [1, 1]
    check(index, spark, ROWS + one)
    # more keys than the shards are meant for: all are dealt anew
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    monkeypatch.setattr(linededup, "LEAST_SHARDS", 2)
    index.insert(docs_of(spark, [(101, LINE.format(4))]))
    assert index.shards >= 64
    check(StoredLineIndex(spark, str(tmp_path / "index")), spark, [*ROWS, *one, (101, LINE.format(4))])


def test_empty_batches(spark, tmp_path):
    index = StoredLineIndex(spark, str(tmp_path / "index"))
    index.insert(docs_of(spark, []))
    index.delete(docs_of(spark, ROWS[:1]))
    check(index, spark, ROWS[:2])
    index.insert(docs_of(spark, ROWS))
    index.insert(docs_of(spark, []))
    check(StoredLineIndex(spark, str(tmp_path / "index")), spark, ROWS)
