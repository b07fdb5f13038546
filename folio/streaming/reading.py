"""The queue that is read aloud, as a stream: one state a listener, timers for pauses and lost ends.

Commands (key, at, kind, items) drive it: "play" starts a new queue with `items`, "add"
appends to it, "end" says that what was said has ended, "hide" that it was interrupted,
"show" that reading goes on, "stop" ends it.  Answers (key, at_ms, place, say, lang, cause)
are what is to be said, in order; `cause` tells why: "play", "end", "pause" (a pause is
over), "guard" (no end was heard in time) or "again".

The item being said when the listener was interrupted is said again: every item is said at
least once.  While hidden, neither ends nor timers move the queue.  At the end of the queue
it waits for more; items added then are read on.  Timers run on event time: one that is due
at the time of a command fires before it, else it fires when the watermark has passed it.
Items lie in a map by place, so that a step reads one of them and not the queue.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folio.operators.speech import GUARD_MS, GUARD_MS_PER_CHAR

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ITEMS = "array<struct<say:string,lang:string,pause_ms:int>>"
ANSWER = "at_ms bigint, place int, say string, lang string, cause string"
#: Of commands of one time the order in which they hold.
KINDS = ("stop", "play", "add", "end", "hide", "show")


class Reader(StatefulProcessor):
    """State: `queue` by place, and where reading stands: the next place, how many there are, whether
    it plays, waits for more or is hidden, and when the timer that runs is due."""

    def __init__(self, rates: dict[str, float], key: str):
        self.rates, self.key = rates, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "place int", "say string, lang string, pause_ms int")
        self.stand = handle.getValueState("stand", "place int, size int, playing boolean, waiting boolean, hidden boolean, due bigint, why string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s = self.loaded()
        for r in sorted(rows, key=lambda r: (r.ms, KINDS.index(r.kind))):
            while s["due"] is not None and s["due"] <= r.ms:
                yield from self.told(key, self.fired(s))
            yield from self.told(key, self.done(s, r))
        self.saved(s, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self.loaded()
        # timers that follow from one another may all lie before the watermark
        while s["due"] is not None and s["due"] <= timerValues.getCurrentWatermarkInMs():
            yield from self.told(key, self.fired(s))
        self.saved(s, timerValues)

    def told(self, key, answers: Iterator[tuple]) -> Iterator[Row]:
        for a in answers:
            yield Row(**dict(zip((self.key, "at_ms", "place", "say", "lang", "cause"), (key[0], *a), strict=True)))

    def loaded(self) -> dict:
        names = ("place", "size", "playing", "waiting", "hidden", "due", "why")
        return dict(zip(names, self.stand.get() if self.stand.exists() else (0, 0, False, False, False, None, None), strict=True))

    def saved(self, s: dict, timer_values) -> None:
        self.stand.update(tuple(s.values()))
        for t in list(self.handle.listTimers()):
            if t != s["due"]:
                self.handle.deleteTimer(t)
        if s["due"] is not None:
            self.handle.registerTimer(max(s["due"], timer_values.getCurrentWatermarkInMs() + 1))

    def done(self, s: dict, r: Row) -> Iterator[tuple]:
        if r.kind in ("play", "stop"):
            self.queue.clear()
            s |= {"place": 0, "size": 0, "playing": r.kind == "play", "waiting": False, "hidden": False, "due": None}
        if r.kind in ("play", "add"):
            for k, x in enumerate(r["items"] or [], s["size"]):
                self.queue.updateValue((k,), (x["say"], x["lang"], x["pause_ms"]))
            s["size"] += len(r["items"] or [])
        if not s["playing"]:
            return
        if r.kind == "play" or (r.kind == "add" and s["waiting"] and not s["hidden"]):
            yield from self.next(s, r.ms, "play")
        elif r.kind == "end" and s["why"] == "guard" and s["due"] is not None:
            yield from self.next(s, r.ms, "end")
        elif r.kind == "hide" and not s["hidden"]:
            s |= {"hidden": True, "due": None}
        elif r.kind == "show" and s["hidden"]:
            s |= {"hidden": False, "place": s["place"] if s["waiting"] else max(s["place"] - 1, 0)}
            yield from self.next(s, r.ms, "again")

    def fired(self, s: dict) -> Iterator[tuple]:
        at, why = s["due"], s["why"]
        s["due"] = None
        yield from self.next(s, at, why)

    def next(self, s: dict, at: int, cause: str) -> Iterator[tuple]:
        """Go on at a time: say the next item, or let the pause run that it is."""
        s |= {"due": None, "waiting": s["place"] >= s["size"]}
        if s["waiting"]:
            return
        say, lang, pause = self.queue.getValue((s["place"],))
        s["place"] += 1
        if say is None:
            s |= {"due": at + (pause or 0), "why": "pause"}
            return
        s |= {"due": at + GUARD_MS + int(len(say) * GUARD_MS_PER_CHAR / self.rates.get(lang, 1.0) + 0.5), "why": "guard"}
        yield at, s["place"] - 1, say, lang, cause


def reading_stream(commands: DataFrame, key: str, rates: dict[str, float] | None = None, late: str = "1 minute") -> DataFrame:
    """(key, at_ms, place, say, lang, cause) for a stream of commands (key, at, kind, items)."""
    spark: SparkSession = commands.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = commands.withWatermark("at", late).select(key, "at", F.unix_millis("at").alias("ms"), "kind", F.col("items").cast(ITEMS).alias("items"))
    kind = commands.schema[key].dataType.simpleString()
    return rows.groupBy(key).transformWithState(statefulProcessor=Reader(rates or {}, key), outputStructType=f"`{key}` {kind}, {ANSWER}", outputMode="Append", timeMode="EventTime")
