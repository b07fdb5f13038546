"""Suffix-array dedup: bytes covered by long strings that start in two places or more.

Finding where to look.  Every window of LENGTH bytes has one anchor, the rightmost least
hash among the GRAM-byte strings in it, and equal windows have it at the same place.  So
the windows of a text fall into runs with one anchor each; a run's context is the bytes
that its windows span.  Contexts whose anchor occurs once in the corpus hold nothing
repeated.  All others are compared; a hash that two strings share costs work, no result.

Comparing.  Contexts are counted by their bytes before they are shuffled: one that occurs
k times is a kind of count k.  The kinds go, by anchor, into buckets of bounded size, where
a suffix array over the concatenated kinds gives the Burrows-Wheeler transform; each of its
rows stands for k suffixes.  Starting from the interval of the empty string, intervals are
extended backwards breadth first; the string length at which a boundary between two
suffixes is first met is their common prefix.  The search stops at LENGTH: boundaries not
met by then separate suffixes that share at least so many bytes.  A window is repeated if
the rows of its interval of LENGTH bytes stand for two suffixes or more.

An anchor with too many kinds for a bucket has them cut into parts whose windows share a
core, a string that all of them hold.  Parts with one core are compared as contexts with
one anchor are; where there are still too many they are cut again, down to single windows,
which are their own cores.

Kinds find their occurrences again by a hash of the bytes.  Where two kinds of one anchor
share it, the occurrences are joined by their bytes instead.

Edge cases: null is the empty text; texts shorter than LENGTH are only hashed; repeated
rows repeat each other and lose all such bytes; null ids are ids like others; an empty
table gives an empty table; very long texts are looked at in overlapping pieces of PIECE
window starts; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bound_batches, discard, if_small, materialise, release, text_or_empty, working_tables

LENGTH, GRAM = 200, 64
#: Window starts looked at together; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Bytes of contexts in a bucket, and different contexts of one anchor beyond which they are cut into parts.
BUCKET_BYTES, MOST_CONTEXTS = 1 << 20, 8000
#: How far apart the windows of a part start at first; a quarter of it where parts are cut again.
PART_WIDTH = 32
#: Contexts of a text that are handed on together.
BODIES = 4000
_PLACE_BITS = 24
_STEPS = np.random.default_rng(7).integers(0, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the `gram` (a power of two) bytes that start at each place."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < gram:
        h = h[:-width] * _STEPS[width.bit_length()] + h[width:]
        width *= 2
    return scrambled(h)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    have = 1
    low = keys
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: low.size - rest], low[rest:]) if rest else low


def context_runs(data: np.ndarray, usable: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, anchor hash) of each run of usable windows with one anchor."""
    hashes = gram_hashes(data, gram)
    place = np.arange(hashes.size, dtype=np.uint64)
    low_bits = np.uint64((1 << _PLACE_BITS) - 1)
    minima = window_minima((hashes & ~low_bits) | (low_bits - place), length - gram + 1)  # ties: the rightmost
    anchor = (low_bits - (minima & low_bits)).astype(np.int64)
    ok = usable[: anchor.size]
    first = ok & np.r_[True, (anchor[1:] != anchor[:-1]) | ~ok[:-1]]
    last = ok & np.r_[(anchor[1:] != anchor[:-1]) | ~ok[1:], True]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) - start + 1, hashes[anchor[start]]


def pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text number, offset, bytes) in groups of about PIECE window starts."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - length + 1, PIECE):
            part = t[at : at + PIECE + length - 1]
            group.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tag, text): rows are told apart by their id and a hash of their text."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tag"), text.alias("text"))


def contexts(texts: DataFrame, length: int, gram: int, name_bits: int) -> DataFrame:
    """(id, tag, h, c, s, n): anchor hash, `name_bits` of a context hash, first window start and number of windows."""
    name_mask = np.uint64((1 << name_bits) - 1)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2)]
            for group in pieces(data, length):
                lengths = np.array([len(p) for _, _, p in group])
                ends = np.cumsum(lengths)
                whole = b"".join(p for _, _, p in group)
                bytes_ = np.frombuffer(whole, np.uint8)
                usable = np.repeat(ends, lengths) - np.arange(bytes_.size) >= length
                start, n, h = context_runs(bytes_, usable, length, gram)
                c = np.fromiter((xxhash.xxh3_64_intdigest(whole[a : a + k]) for a, k in zip(start.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, start.size) & name_mask
                of = np.searchsorted(ends, start, side="right")
                row = np.array([i for i, _, _ in group])[of]
                s = start - (ends - lengths)[of] + np.array([at for _, at, _ in group])[of]
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(s), pa.array(n.astype(np.int32))], names=["id", "tag", "h", "c", "s", "n"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(find, f"id {kind}, tag bigint, h bigint, c bigint, s bigint, n int")


def suffix_order(symbols: np.ndarray, context: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix array of contexts end to end: symbols 1..256, and 0 at each context's end.

    Ends differ from each other and are ordered by context.  Prefix doubling, sorting only
    what is not yet told apart.
    """
    n = symbols.size
    left = end - np.arange(n)  # symbols before the suffix's end mark
    key = np.zeros(n, np.int64)
    for j in range(7):
        moved = np.zeros(n, np.int64)
        moved[: max(0, n - j)] = symbols[j:]
        key = (key << 9) | np.where(left >= j, moved, 0)
    tie = np.where(left < 7, context + 1, 0)
    order = np.argsort(key)
    near_end = np.flatnonzero(left[order] < 7)  # told apart by context
    last = order[near_end]
    order[near_end] = last[np.lexsort((last, key[last]))]
    head = np.r_[True, (key[order][1:] != key[order][:-1]) | (tie[order][1:] != tie[order][:-1])]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step, place = 7, np.arange(n)
    while True:
        alone = head & np.r_[head[1:], True]
        open_ = ~alone
        if not open_.any():
            return order
        place = place[open_]
        items = order[place]
        both = rank[items].astype(np.int64) * n + rank[items + step]
        by = np.argsort(both)
        items, both = items[by], both[by]
        order[place] = items
        head = np.r_[True, both[1:] != both[:-1]]
        rank[items] = np.maximum.accumulate(np.where(head, place, 0))
        step *= 2


def met_below(order: np.ndarray, symbols: np.ndarray, n_ends: int, length: int) -> np.ndarray:
    """For each boundary before row r of the suffix array: whether its common prefix is under `length`.

    Breadth-first backward extension of intervals on the Burrows-Wheeler transform; step
    l handles the intervals of strings of l symbols and meets the common prefixes of l.
    """
    n = order.size
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    before = order - 1
    bwt = np.where(before >= 0, symbols[before], 0).astype(np.int16)
    to = inverse[before].astype(np.int32)  # the row of the suffix one symbol longer
    met = np.zeros(n + 1, bool)
    met[: n_ends + 1] = True  # rows that begin with an end mark
    met[n] = True
    low, high, bits = np.array([0]), np.array([n]), n.bit_length()
    for step in range(length):
        size = high - low
        rows = np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        of = np.repeat(np.arange(size.size), size)
        real = bwt[rows] > 0
        rows, of = rows[real], of[real]
        if not rows.size:
            break
        key = np.sort((of * 257 + bwt[rows] << bits) | rows)
        key, rows = key >> bits, key & (1 << bits) - 1
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tail = np.r_[head[1:], key.size] - 1
        low, high = to[rows[head]].astype(np.int64), to[rows[tail]].astype(np.int64) + 1
        new = ~met[high]
        low, high = low[new], high[new]
        met[high] = True
        if step == 0:  # every end mark is a string of one symbol too
            low, high = np.r_[low, np.arange(n_ends)], np.r_[high, np.arange(n_ends) + 1]
        if not low.size:
            break
    return met[:n]


def repeated_runs(parts: list[bytes], length: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last) of each run of window starts whose `length` bytes start elsewhere too, in order.

    The contexts differ from each other; `counts` says how often each occurs.
    """
    sizes = np.array([len(p) for p in parts])
    symbols = np.zeros(sizes.sum() + sizes.size, np.int64)
    ends = np.cumsum(sizes + 1) - 1
    context = np.repeat(np.arange(sizes.size), sizes + 1)
    inside = np.ones(symbols.size, bool)
    inside[ends] = False
    symbols[inside] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + 1
    order = suffix_order(symbols, context, ends[context])
    met = met_below(order, symbols, sizes.size, length)
    # suffixes that each row stands for: none if it ends before `length` symbols
    of_row = context[order]
    stands = np.where(ends[of_row] - order >= length, counts[of_row], 0)
    first = np.flatnonzero(met)
    total = np.repeat(np.add.reduceat(stands, first), np.diff(np.r_[first, met.size]))
    at = np.sort(order[(total > 1) & (stands > 0)])
    of = context[at]
    rel = at - (ends - sizes)[of]
    edge = (np.diff(at) != 1) | (np.diff(of) != 0)
    first, last = np.flatnonzero(np.r_[at.size > 0, edge]), np.flatnonzero(np.r_[edge, at.size > 0])
    return of[first], rel[first], rel[last]


def repeated_windows(parts: list[bytes], length: int, counts: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """repeated_runs() as a list of runs for each context; without `counts`, each occurs once."""
    out: list[list[tuple[int, int]]] = [[] for _ in parts]
    for k, a, b in zip(*(x.tolist() for x in repeated_runs(parts, length, np.array(counts or [1] * len(parts)))), strict=True):
        out[k].append((a, b))
    return out


def bucket_runs(kinds: DataFrame, bucket_bytes: int, length: int) -> DataFrame:
    """(kind, runs) for kinds (h, kind, k, body), compared in buckets of about `bucket_bytes` by h."""
    size = kinds.agg(F.sum(F.octet_length("body"))).first()[0] or 0

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("h", "ascending"), ("kind", "ascending")])
        of, first, last = repeated_runs(rows["body"].to_pylist(), length, rows["k"].to_numpy())
        kinds, at = np.unique(of, return_index=True)
        runs = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["a", "b"])
        return pa.table({"kind": rows["kind"].take(pa.array(kinds)), "runs": pa.ListArray.from_arrays(pa.array(np.r_[at, of.size], pa.int32()), runs)})

    bucket = F.pmod("h", F.lit(max(1, -(-size // bucket_bytes))))
    return kinds.select("h", "kind", "k", "body", bucket.alias("bucket")).groupBy("bucket").applyInArrow(compare, "kind bigint, runs array<struct<a:int,b:int>>")


def anchor_offset(body: bytes, h: int, n: int, length: int, gram: int) -> int:
    """Where in a context of n windows the gram of hash h lies that all of them hold, the rightmost."""
    hashes = gram_hashes(np.frombuffer(body, np.uint8), gram)
    return int(np.flatnonzero(hashes[n - 1 : length - gram + 1] == np.uint64(h & (1 << 64) - 1))[-1]) + n - 1


def split_contexts(kinds: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Kinds (h, kind, k, d, body) cut into parts: (kind, k, j, h2, d, body).

    The windows of a part start up to `width` apart, in blocks of distances before the anchor,
    so equal windows lie in the same block.  j is a part's place in its kind, h2 the hash of
    what all windows of the block hold; d is the distance from the first window to the anchor
    (null at first).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, kind, k, d, body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                n = len(body) - length + 1
                d = anchor_offset(body, h, n, length, gram) if d is None else d
                j = 0
                while j < n:
                    block = (d - j) // width
                    upto = min(n, d - block * width + 1)
                    # the block's windows start from d - block * width back to width - 1 bytes before
                    core = body[d - block * width : d - block * width - width + 1 + length]
                    name = np.frombuffer(xxhash.xxh3_64_digest(f"{h} {block} {width} ".encode() + core), ">i8")[0]
                    out.append((kind, k, j, int(name), d - j, body[j : upto + length - 1]))
                    j = upto
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=["kind", "k", "j", "h2", "d", "body"])

    return kinds.select("h", "kind", "k", "d", "body").mapInArrow(cut, "kind bigint, k bigint, j int, h2 bigint, d int, body binary")


def numbered(kinds: DataFrame, tag: str) -> DataFrame:
    """`kinds` as a working table with a number for each row, `kind`."""
    return materialise(kinds.withColumn("kind", F.monotonically_increasing_id()), tag)


def kind_runs(kinds: DataFrame, length: int, gram: int, bucket_bytes: int, most: int, width: int) -> DataFrame:
    """(kind, runs) of kinds (h, kind, k, d, body): runs (a, b) of the windows that are repeated.

    Kinds of an anchor with over `most` of them are cut into parts that are up to `width`
    windows wide.  Parts of one window that share their core are the same, so there are
    never many; they are compared like the others.
    """
    crowded = materialise(kinds.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > most).select("h"), "crowded")
    if width == 0 or crowded.isEmpty():
        return bucket_runs(kinds, bucket_bytes, length)
    parts = materialise(split_contexts(kinds.join(if_small(crowded), "h", "left_semi"), length, gram, width), "parts")
    part_kinds = parts.groupBy(F.col("h2").alias("h"), "body").agg(F.sum("k").alias("k"), F.first("d").alias("d"))
    part_kinds = numbered(part_kinds, "part-kinds")
    several = materialise(part_kinds.groupBy("h").agg(F.sum("k").alias("k")).where("k > 1").select("h"), "several")
    found = kind_runs(part_kinds.join(if_small(several), "h", "left_semi"), length, gram, bucket_bytes, most, -(-width // 4) if width > 1 else 0)
    flags = materialise(part_kinds.select(F.col("h").alias("h2"), "body", "kind").join(found, "kind").drop("kind"), "part-flags")
    moved = F.transform("runs", lambda r: F.struct((F.col("j") + r["a"]).cast("int").alias("a"), (F.col("j") + r["b"]).cast("int").alias("b")))
    by_parts = parts.join(flags, ["h2", "body"]).groupBy("kind").agg(F.flatten(F.collect_list(moved)).alias("runs"))
    return bucket_runs(kinds.join(if_small(crowded), "h", "left_anti"), bucket_bytes, length).unionByName(by_parts)


def context_bodies(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(id, tag, h, c, s, body) for wanted contexts (id, tag, h, c, s, n), read from their texts; repeated rows give them again."""
    listed = materialise(wanted.groupBy(F.col("id").alias("id_"), F.col("tag").alias("tag_")).agg(F.collect_set(F.struct("h", "c", "s", "n")).alias("list")), "listed")
    joined = texts.join(listed, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_"))).select("id", "tag", "text", "list")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py().encode("utf-8", "surrogatepass")
                own = batch.column(3)[i].values
                for at in range(0, len(own), BODIES):
                    h, c, s, n = own.slice(at, BODIES).flatten()
                    part = [data[a : a + k + length - 1] for a, k in zip(s.to_pylist(), n.to_pylist(), strict=True)]
                    row = pa.array([i] * len(h))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), h, c, s, pa.array(part, pa.binary())], names=["id", "tag", "h", "c", "s", "body"])

    kind = texts.schema["id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"id {kind}, tag bigint, h bigint, c bigint, s bigint, body binary")


def repeated_spans(texts: DataFrame, length: int, gram: int, bucket_bytes: int, most_contexts: int, name_bits: int) -> DataFrame:
    """(id, tag, spans): byte ranges (a, b) of each text that repeated strings cover, not merged."""
    found = materialise(contexts(texts, length, gram, name_bits), "contexts")
    twice = materialise(found.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h"), "twice")
    here = materialise(found.join(twice, "h"), "occurrences")
    for done in (found, twice):
        discard(done)
    bodies = context_bodies(texts, here, length)
    kinds = numbered(bodies.groupBy("h", "c", "body").agg(F.count("*").alias("k")), "kinds")
    flags = materialise(kind_runs(kinds.withColumn("d", F.lit(None).cast("int")), length, gram, bucket_bytes, most_contexts, PART_WIDTH), "flags")
    alike = materialise(kinds.groupBy("h", "c").agg(F.count("*").alias("m")).where("m > 1").select("h", "c"), "alike")
    names = kinds.select("h", "c", "kind").join(if_small(alike), ["h", "c"], "left_anti")
    runs = here.join(names.join(flags, "kind"), ["h", "c"]).select("id", "tag", "s", "runs")
    if not alike.isEmpty():
        several = kinds.join(if_small(alike), ["h", "c"], "left_semi").join(flags, "kind").select("h", "c", "body", "runs")
        again = context_bodies(texts, here.join(if_small(alike), ["h", "c"], "left_semi"), length)
        runs = runs.unionByName(again.join(several, ["h", "c", "body"]).select("id", "tag", "s", "runs"))
    spans = F.transform("runs", lambda r: F.struct((F.col("s") + r["a"]).alias("a"), (F.col("s") + r["b"] + length).alias("b")))
    return runs.select("id", "tag", spans.alias("spans")).groupBy("id", "tag").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES, most_contexts: int = MOST_CONTEXTS, id_col: str = "doc_id", text_col: str = "text", name_bits: int = 64) -> DataFrame:
    """One row per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    Removed is every byte that a string of `length` bytes covers which also starts
    anywhere else in the table; `gram` (a power of two) must be shorter than `length`.
    The sizes of buckets, and the bits of the hash that names contexts, change the work only.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts, before = keyed(docs, id_col, text_col), working_tables(spark)
    spans = materialise(repeated_spans(texts, length, gram, bucket_bytes, most_contexts, name_bits).withColumnsRenamed({"id": "id_", "tag": "tag_"}), "spans")
    release(spark, spans, [p for p in working_tables(spark) if p not in before])
    joined = texts.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("tag") == F.col("tag_")), "left").select("id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                data, gone = text.as_py().encode("utf-8", "surrogatepass"), merged(spans.as_py() or [])
                edges = [0, *(x for r in gone for x in r), len(data)]
                left = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if gone else data
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                runs.append(len(gone))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_bytes binary")
