"""Benchmark decontamination by an Aho-Corasick automaton over normalised test items.

Texts are normalised to lower-case words between single blanks: only A-Z are lower-cased,
ASCII characters other than letters and digits separate words, all others belong to them.
Every run of `window` words of an item is a key of the automaton, an item of fewer words is
one key as a whole.  A document is normalised in the same way and read once by the
automaton; matches are merged to runs of words as they come, and runs are mapped back to
code points of the original text.

Keys with the same items form one class.  The automaton holds classes, so that a document
gets one row for each class it meets, however many windows it shares with an item, and the
items are joined by class afterwards.  Items with equal words are one text there.

The keys are broadcast in blocks of at most KEY_BYTES bytes, and each worker builds the
automaton of a block once.  A benchmark that fits in one block, as ordinary ones do, takes
one scan of the documents; each further block takes one more scan, and the runs of all
blocks are merged by row.  Words of more than LONG_WORD bytes stand in both texts as their
SHA-256 digest, so that no key is long.

Edge cases: null and empty texts have no words and are not contaminated; items without
words are found nowhere; an item without an id marks words, but is counted and listed
nowhere; items with one id count once; repeated rows each get their own row; texts of any
length are read whole; empty tables of documents or items give tables without hits; other
columns are not read, and columns that clash with those returned do no harm.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import bound_batches, if_small, materialise, text_or_empty

#: Words in a window.
WINDOW = 10
#: Bytes of keys in one automaton; each takes a state of some 70 bytes at most.
KEY_BYTES = 2 << 20
#: Longer words are held by digest.
LONG_WORD = 64

BLANK = 0x20
#: Lower-case letters and digits stay, upper-case letters are lowered, other ASCII separates; bytes of other characters stay.
NORMAL = bytes(b if b >= 0x80 or chr(b).isalnum() else BLANK for b in bytes(range(256)).lower())

RUNS = "array<struct<first: bigint, last: bigint, start: bigint, stop: bigint>>"
_AUTOMATA: dict[str, ahocorasick.Automaton] = {}


def words_of(raw: bytes | None) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    words = (raw or b"").translate(NORMAL).split()
    if any(len(w) > LONG_WORD for w in words):
        words = [w if len(w) <= LONG_WORD else b"\x01" + hashlib.sha256(w).hexdigest().encode() for w in words]
    return words


def joined(words: list[bytes]) -> str:
    """One character a byte, a blank before and after each word."""
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def windows_of(words: list[bytes], size: int) -> list[str]:
    return [joined(words[k : k + size]) for k in range(max(len(words) - size, 0) + 1)] if words else []


def item_keys(items: DataFrame, id_col: str, texts: tuple[str, ...], size: int) -> tuple[DataFrame, DataFrame]:
    """(class, key) and (class, item_id): every key of the items once, and the items of each class of keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch["item_id"], batch["raw"].to_pylist(), strict=True):
                if words := words_of(raw):
                    found = sorted(set(windows_of(words, size)))
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.string()), pa.array([hashlib.sha256(joined(words).encode("latin-1")).digest()] * len(found)), pa.array(found)], ["item_id", "text", "key"])

    raw = items.select(F.col(id_col).cast("string").alias("item_id"), F.explode(F.array(*[F.col(t).cast("binary") for t in texts])).alias("raw"))
    found = materialise(raw.mapInArrow(keys, "item_id string, text binary, key string"), "windows")
    sets = materialise(found.groupBy("key").agg(F.sort_array(F.collect_set("text")).alias("texts")), "keys")
    classes = materialise(sets.select("texts").distinct().withColumn("class", F.monotonically_increasing_id()), "classes")
    of_class = classes.select("class", F.explode("texts").alias("text"))
    links = of_class.join(found.select("text", "item_id").distinct(), "text").select("class", "item_id").distinct()
    return sets.join(classes, "texts").select("class", "key"), links


def blocks_of(keys: DataFrame, most: int) -> list[DataFrame]:
    """`keys` in parts of about `most` bytes of keys, told apart by hash."""
    total = keys.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    parts = max(1, -(-total // most))
    if parts == 1:
        return [keys]
    return [keys.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k) for k in range(parts)]


class Block:
    """A part of the keys, sent to the executors: as many bytes as blocks_of() lets it have."""

    def __init__(self, keys: DataFrame):
        self.name = uuid.uuid4().hex
        self.sent = keys.sparkSession.sparkContext.broadcast([(r.key, r["class"]) for r in keys.select("key", "class").collect()])

    def automaton(self) -> ahocorasick.Automaton:
        """Made once in a worker, which holds one automaton at a time."""
        if self.name not in _AUTOMATA:
            _AUTOMATA.clear()
            made = ahocorasick.Automaton()
            for key, of in self.sent.value:
                made.add_word(key, (of, len(key)))
            if made:
                made.make_automaton()
            _AUTOMATA[self.name] = made
        return _AUTOMATA[self.name]


def matches(automaton: ahocorasick.Automaton, text: str) -> tuple[list[list[int]], set[int]]:
    """Maximal stretches [start, stop) that matches cover or that they join, and the classes met."""
    runs, classes = [], set()
    for end, (of, length) in automaton.iter(text):
        start, stop = end + 1 - length, end + 1
        classes.add(of)
        # matches come by their end; a longer one may reach back over several runs. Neighbours share a blank.
        while runs and start < runs[-1][1]:
            start = min(start, runs.pop()[0])
        runs.append([start, stop])
    return runs, classes


def word_runs(runs: list[list[int]], text: str, raw: bytes) -> list[dict]:
    """Runs of the normalised text by word numbers and by code points of the original."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.frombuffer(b" " + raw.translate(NORMAL) + b" ", np.uint8) != BLANK
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out, first, at = [], 0, 0
    for start, stop in runs:
        first += text.count(" ", at, start)
        last = first + text.count(" ", start, stop) - 2
        out.append({"first": first, "last": last, "start": int(points[edges[2 * first]]), "stop": int(points[edges[2 * last + 1]])})
        at = start
    return out


def scan(docs: DataFrame, block: Block, every_row: bool) -> DataFrame:
    """row, id, n_words, runs, classes of documents (row, id, raw); those without hits only where `every_row`."""
    kind = docs.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = block.automaton()
        for batch in batches:
            counts, all_runs, all_classes = [], [], []
            for raw in batch["raw"].to_pylist():
                words = words_of(raw)
                text = joined(words)
                runs, classes = matches(automaton, text) if words and len(automaton) else ([], ())
                counts.append(len(words))
                all_runs.append(word_runs(runs, text, raw) if runs else [])
                all_classes.append(sorted(classes))
            out = pa.RecordBatch.from_arrays([batch["row"], batch["id"], pa.array(counts, pa.int64()), pa.array(all_runs, RUN_TYPE), pa.array(all_classes, pa.list_(pa.int64()))], ["row", "id", "n_words", "runs", "classes"])
            yield out if every_row else out.filter(pa.array([bool(r) for r in all_runs], pa.bool_()))

    return docs.mapInArrow(read, f"row bigint, id {kind}, n_words bigint, runs {RUNS}, classes array<bigint>")


RUN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "stop")]))


def merged(hits: DataFrame) -> DataFrame:
    """row, runs, classes of hits of several blocks: runs that meet become one."""
    by_row = Window.partitionBy("row").orderBy("first", "last")
    before = F.max("last").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("row", F.inline("runs")).withColumn("new", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int"))
    runs = runs.withColumn("island", F.sum("new").over(by_row)).groupBy("row", "island")
    runs = runs.agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("stop").alias("stop"))
    runs = runs.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "last", "start", "stop"))).alias("runs"))
    return runs.join(hits.groupBy("row").agg(F.flatten(F.collect_list("classes")).alias("classes")), "row")


def hits_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, key_bytes: int) -> DataFrame:
    """row, id, n_words, runs, classes of every document: a working table."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw"))
    blocks = blocks_of(keys, key_bytes)
    if len(blocks) == 1:
        return materialise(scan(rows, Block(blocks[0]), True), "hits")
    rows = materialise(rows, "rows")
    first = materialise(scan(rows, Block(blocks[0]), True), "hits")
    hits = first.where(F.size("runs") > 0).select("row", "runs", "classes")
    for block in blocks[1:]:
        hits = hits.unionByName(materialise(scan(rows, Block(block), False), "hits").select("row", "runs", "classes"))
    found = merged(hits)
    none = [F.coalesce(F.col(c), F.array().cast(first.schema[c].dataType)).alias(c) for c in ("runs", "classes")]
    return materialise(first.select("row", "id", "n_words").join(found, "row", "left").select("row", "id", "n_words", *none), "merged")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: tuple[str, ...] = ("text",), key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per document: its id, n_words, n_hit, item_ids (sorted as strings), spans (start and
    stop in code points of the original text of each maximal run of hit words), contaminated.

    `item_texts` names the columns of an item that are searched for, as its question and its answer.
    """
    keys, links = item_keys(items, item_col, item_texts, window)
    hits = hits_of(docs, keys, id_col, text_col, key_bytes)
    met = hits.where(F.size("classes") > 0).select("row", F.explode(F.array_distinct("classes")).alias("class"))
    listed = met.join(if_small(materialise(links, "links")), "class").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    listed = if_small(materialise(listed, "listed"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return hits.join(listed, "row", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))).alias("spans"),
        (n_hit > 0).alias("contaminated"),
    )


def contamination_report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """decontaminate() with the items counted and digested."""
    found = decontaminate(docs, items, window)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
