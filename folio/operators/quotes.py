"""Quotes in texts: an inverted index of character n-grams, joined by key and then verified.

White space does not count: a quote is searched for by its first QUOTE_CHARS characters that
are none, at least QUOTE_LEAST.  Each quote is looked up by one n-gram, and each text offers
only some of its n-grams, the same by one rule: the one with the least hash among the
n-grams of a window.  A window of a quote that lies in a text is a window of the text, so
that both pick the same n-gram of it.  Quotes come in three kinds by length, each with its
size of n-gram and of window; kinds that no quote has are not looked for.

A text row carries the characters around its n-gram, so that what the key brings together
is compared in place, and the offsets in the original text, so that no text is read again.
Where quotes are few enough to be sent to every task, so are their n-grams, and a text
offers those of its n-grams that some quote has, wherever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.functions import chars as C
from folio.functions.rows import in_small_batches, stacked
from folio.functions.text import text_of

QUOTE_CHARS, QUOTE_LEAST = 24, 4
#: Least length of a kind's quotes: (length of its longest ones, characters in an n-gram, n-grams in a window).
KINDS = {24: (24, 8, 17), 12: (23, 8, 5), 4: (11, 4, 1)}
#: Quotes of up to 24 characters that are sent to every task with their keys, 8 bytes each; more are joined by a shuffle of both sides.
BROADCAST_QUOTES = 250_000
#: Quotes of one document that are each looked for in the whole of it.
FEW_QUOTES = 16

_SPACE = np.zeros(1 << 16, bool)
_SPACE[[ord(c) for c in C.WS_CHARS]] = True


def stripped(c: Column) -> Column:
    return F.regexp_replace(text_of(c), f"[{C.WS}]+", "")


def quote_key(quote: Column) -> Column:
    """What is searched for: the first QUOTE_CHARS characters that are no white space; null if too few."""
    key = F.substring(stripped(quote), 1, QUOTE_CHARS)
    return F.when(F.char_length(key) >= QUOTE_LEAST, key)


def points_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text that are no white space, and their places in it."""
    every = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(~_SPACE[np.minimum(every, 0xFFFE)])
    return every[at], at


def gram_hashes(points: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each n-gram."""
    n = len(points) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + points[k : k + n]
    # spread, so that the least one is no matter of the alphabet
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(33))


def least_of_windows(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of each window, the first of equals; each place once."""
    if window == 1:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(views.argmin(1) + np.arange(len(views)))


def keyed_quotes(quotes: DataFrame) -> DataFrame:
    """(q, ...) with the kind, the n-gram that stands for q and its place in q."""
    fields = [pa.field(f.name, to_arrow_type(f.dataType)) for f in quotes.schema] + [pa.field("kind", pa.int32()), pa.field("gram", pa.int64()), pa.field("at", pa.int32())]
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, grams, places = [], [], []
            for q in batch["q"].to_pylist():
                points, _ = points_of(q)
                kind = next(k for k in KINDS if len(points) >= k)
                hashes = gram_hashes(points[:kind], KINDS[kind][1])[: KINDS[kind][2]]
                at = int(hashes.argmin())
                kinds.append(kind)
                grams.append(int(hashes[at].astype(np.int64)))
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kinds, pa.int32()), pa.array(grams, pa.int64()), pa.array(places, pa.int32())], schema=schema)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quotes.schema)
    return in_small_batches(quotes).mapInArrow(read, f"{kept}, kind int, gram bigint, at int")


def found_in(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the hashes that are among the sorted `wanted`."""
    at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
    return np.flatnonzero(wanted[at] == hashes)


def gram_index(blocks: DataFrame, kinds: list[int], id_col: str = "doc_id", wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(id, b, kind, gram, spot, lead, around, starts): the n-grams that blocks (id, b, t) are found by.

    `around` holds the characters from `lead` before the n-gram to where the longest quote
    that begins with it ends; `starts` the offset in t of a quote that begins 0, 1, ... up to
    `lead` characters before the n-gram, `spot` the n-gram's place without white space.
    With `wanted`, sorted n-grams by kind, only these are offered.
    """
    sent = blocks.sparkSession.sparkContext.broadcast(wanted)
    kind_of_id = to_arrow_type(blocks.schema[id_col].dataType)
    named = [("id", kind_of_id), ("b", pa.int32()), ("kind", pa.int32()), ("gram", pa.int64()), ("spot", pa.int32()), ("lead", pa.int32()), ("around", pa.string()), ("starts", pa.list_(pa.int32()))]
    schema = pa.schema(named)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kind_parts, gram_parts, spots, leads, arounds, starts = [], [], [], [], [], [], []
            for i, text in enumerate(batch["t"].to_pylist()):
                points, at = points_of(text or "")
                solid = begins = None
                for kind in kinds:
                    longest, size, window = KINDS[kind]
                    if len(points) < kind:
                        continue
                    hashes = gram_hashes(points, size)
                    offered = least_of_windows(hashes, window) if sent.value is None else found_in(hashes, sent.value[kind])
                    if len(offered) and solid is None:
                        solid = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
                        # a quote begins right after the character before it
                        begins = np.concatenate([[0], at + 1]).astype(np.int32)
                    for spot in offered.tolist():
                        lead = min(spot, window - 1)
                        rows.append(i)
                        kind_parts.append(kind)
                        gram_parts.append(int(hashes[spot].astype(np.int64)))
                        spots.append(spot)
                        leads.append(lead)
                        arounds.append(solid[spot - lead : spot + longest])
                        starts.append(begins[spot - lead : spot + 1][::-1])
            take = pa.array(rows, pa.int64())
            sizes = np.concatenate([[0], np.cumsum([len(s) for s in starts])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(starts) if starts else [], pa.int32()))
            cols = [batch["id"].take(take), batch["b"].take(take), pa.array(kind_parts, pa.int32()), pa.array(gram_parts, pa.int64()), pa.array(spots, pa.int32()), pa.array(leads, pa.int32()), pa.array(arounds, pa.string()), listed]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    texts = blocks.select(F.col(id_col).alias("id"), F.col("b").cast("int").alias("b"), "t")
    return in_small_batches(texts).mapInArrow(read, f"id {blocks.schema[id_col].dataType.simpleString()}, b int, kind int, gram bigint, spot int, lead int, around string, starts array<int>")


def occurrences(quotes: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(q, id, b, o, spot): the first occurrence in each document of every row of quotes (q), in each
    that holds it; with a column `id` of quotes, only in that document."""
    own = ["id"] if "id" in quotes.columns else []
    keyed = keyed_quotes(quotes.select("q", *own).distinct())
    per_kind = {r.kind: r.n for r in keyed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    wanted = None
    if sum(per_kind.values()) <= BROADCAST_QUOTES:
        rows = keyed.select("kind", "gram").distinct().collect()
        wanted = {k: np.sort(np.array([r.gram for r in rows if r.kind == k], np.int64).astype(np.uint64)) for k in per_kind}
        keyed = F.broadcast(keyed)
    index = gram_index(blocks, sorted(per_kind, reverse=True), id_col, wanted)
    met = index.join(keyed, ["kind", "gram", *own])
    same = (F.col("lead") >= F.col("at")) & (F.expr("substring(around, lead - at + 1, char_length(q))") == F.col("q"))
    found = met.where(same).select("q", "id", F.struct("b", (F.col("spot") - F.col("at")).alias("spot"), F.get("starts", F.col("at")).alias("o")).alias("x"))
    return found.groupBy("q", "id").agg(F.min("x").alias("x")).select("q", "id", "x.b", "x.o", "x.spot")


def locate_quotes(quotes: DataFrame, blocks: DataFrame, quote_id: str = "item_id", id_col: str = "doc_id") -> DataFrame:
    """(quote_id, id, b, o): where each quote (quote_id, text) first occurs in each document."""
    keys = quotes.select(quote_id, quote_key(F.col("text")).alias("q")).where("q IS NOT NULL")
    hits = occurrences(keys, blocks, id_col)
    return keys.join(hits, "q").select(quote_id, F.col("id").alias(id_col), "b", "o")


def offset_after(text: Column, solid: Column) -> Column:
    """The offset in `text` right after its first `solid` characters that are no white space; 0 for none."""
    # pieces between single white-space characters: each piece that ends before the place has one of them after it
    state = F.struct(F.lit(0).alias("read"), F.lit(0).alias("spaces"))

    def step(s: Column, piece: Column) -> Column:
        read = s["read"] + F.char_length(piece)
        return F.struct(read.alias("read"), (s["spaces"] + (read < solid).cast("int")).alias("spaces"))

    return solid + F.aggregate(F.split(text, f"[{C.WS}]", -1), state, step, lambda s: s["spaces"])


def own_occurrences(quotes: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """occurrences() of quotes (q, id) in their own documents, by looking through each: for documents of few quotes."""
    texts = blocks.select(F.col(id_col).alias("id"), "b", "t")
    met = texts.join(quotes.select("q", "id"), "id").select("q", "id", "b", "t", (F.instr(stripped(F.col("t")), F.col("q")) - 1).alias("spot")).where("spot >= 0")
    first = met.groupBy("q", "id").agg(F.min(F.struct("b", "spot", "t")).alias("x"))
    return first.select("q", "id", "x.b", offset_after(F.col("x.t"), F.col("x.spot")).alias("o"), "x.spot")


def quotes_in_own_document(annots: DataFrame, blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`annots` (id, quote, ...) with the anchor (hit_b, hit_o) of the first block that holds the quote, or null.

    A document is looked through for its quotes if they are FEW_QUOTES at most; its n-grams
    are laid out only if there are more.
    """
    keyed = annots.withColumn("__q", quote_key(F.col("quote")))
    inner = keyed.where(F.col("__q").isNotNull() & F.col(id_col).isNotNull()).select(F.col("__q").alias("q"), F.col(id_col).alias("id")).distinct()
    counts = inner.groupBy("id").agg(F.count("*").alias("n"))
    many = counts.where(F.col("n") > FEW_QUOTES).select("id")
    if many.isEmpty():
        found = own_occurrences(inner, blocks, id_col)
    else:
        rest = own_occurrences(inner.join(many, "id", "left_anti"), blocks, id_col)
        of_many = blocks.join(many.withColumnRenamed("id", id_col), id_col, "left_semi")
        found = rest.transform(stacked, occurrences(inner.join(many, "id", "left_semi"), of_many, id_col).select(*rest.columns))
    hits = found.select(F.col("q").alias("__q"), F.col("id").alias(id_col), F.col("b").alias("hit_b"), F.col("o").alias("hit_o"))
    return keyed.join(hits, ["__q", id_col], "left").select(*annots.columns, "hit_b", "hit_o")
