"""The reading queue as a stream against the queue in batch."""

import json

import pytest
from pyspark.sql import functions as F

from folio.operators import documents as D
from folio.operators import speech as S
from folio.streaming import reading as R

SCHEMA = f"key string, at timestamp, kind string, items {R.ITEMS}"
DAY = 1_700_000_000_000


def run(spark, folder, batches, name):
    """The answers to batches of commands (key, seconds, kind, items), each a micro-batch; stopped and started again in between."""
    (folder / "in").mkdir()
    out = []
    for k, batch in enumerate(batches):
        lines = [json.dumps({"key": key, "at": spark.range(1).select(F.timestamp_millis(F.lit(DAY + int(sec * 1000))).cast("string")).first()[0], "kind": kind, "items": items}) for key, sec, kind, items in batch]
        (folder / "in" / f"{k}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(SCHEMA).json(str(folder / "in"))
        sink = lambda df, n: out.extend(df.collect())
        q = R.reading_stream(stream, "key", {"en": 1.0}, "0 seconds").writeStream.foreachBatch(sink).option("checkpointLocation", str(folder / "checkpoint")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return [(r.key, r.at_ms - DAY, r.place, r.say, r.cause) for r in out]


@pytest.fixture(scope="module")
def queue(spark):
    docs = spark.createDataFrame([(1, "One sentence is here. Another, with a clause: follows it.\n\nA second block.")], "doc_id int, text string")
    return [{"say": r.say, "lang": r.lang, "pause_ms": r.pause_ms} for r in S.speech_queue(D.txt_blocks(docs)).orderBy("seq").collect()]


def test_queue_with_replay(spark, tmp_path, queue):
    said = [(k, x["say"]) for k, x in enumerate(queue) if x["say"] is not None]
    assert len(said) >= 4 and any(x["pause_ms"] for x in queue)
    # each end two seconds after the last, when all pauses are over; interrupted while the third is said
    ends = [("a", 2.0 * (k + 1), "end", None) for k in range(len(said) + 2)]
    first = [("a", 0, "play", queue), ("b", 0, "play", queue), *ends[:2], ("a", 4.9, "hide", None)]
    second = [("a", 5.5, "end", None), ("a", 60.0, "show", None), *[(k, t + 60, *r) for k, t, *r in ends]]
    got = run(spark, tmp_path, [first, second, [("c", 90.0, "stop", None)]], "replay")
    own = [(place, say) for key, _, place, say, _ in got if key == "a"]
    assert own == said[:3] + said[2:]  # the third is said again, and everything else once
    causes = [c for key, *_, c in got if key == "a"]
    assert causes[0] == "play" and causes[3] == "again" and set(causes[1:3] + causes[4:]) <= {"end", "pause"}
    # nothing ends for b: the guard moves its queue, and everything is said
    others = [(place, say, cause) for key, _, place, say, cause in got if key == "b"]
    assert [x[:2] for x in others] == said[: len(others)] and len(others) >= 2 and others[0][2] == "play"


def test_ends_guards_and_more(spark, tmp_path):
    item = lambda say, pause=None: {"say": say, "lang": "en", "pause_ms": pause}
    words = [item("one"), item(None, 300), item("two"), item("three")]
    batches = [
        [("a", 0, "play", words), ("a", 1, "end", None), ("a", 1.1, "end", None)],  # an end in a pause ends nothing
        [("a", 2, "end", None), ("a", 3, "end", None), ("a", 4, "end", None), ("a", 5, "add", [item("four")])],
        [("a", 6, "stop", None), ("a", 7, "end", None), ("a", 8, "show", None), ("b", 8, "end", None)],
        [("a", 20, "play", words[:1] + words[2:3]), ("a", 100, "add", [])],
    ]
    got = run(spark, tmp_path, batches, "more")
    assert got == [
        ("a", 0, 0, "one", "play"), ("a", 1300, 2, "two", "pause"), ("a", 2000, 3, "three", "end"), ("a", 5000, 4, "four", "play"),
        ("a", 20_000, 0, "one", "play"), ("a", 20_000 + 8000 + 2400, 1, "two", "guard"),
    ]
