"""Best-fit packing of token pieces into fixed-length sequences, improved by swaps.

Each text becomes ids (library ids, then an end id); longer ones are cut into full
pieces with the remainder first.  Full pieces are sequences of their own.  The others,
at most one a document, are dealt evenly into groups of bounded size; each group is
packed best-fit decreasing and then improved by local search: from the emptiest bin on,
a piece moves into another bin's gap, or one or two pieces change places with a smaller
one of another bin, all pairs of sizes in the bin being tried.  Every step raises the sum
of squared fills, so the search ends: when a pass over the bins changes nothing.  Bins
that run empty are gone.

Edge cases: a null or empty text is one piece that holds the end id; repeated rows are
packed each on their own; an empty table gives an empty table; a text of any length is
encoded whole, by one task; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bound_batches, materialise, text_or_empty
from folio.llm.tokens import default_tokenizer, settled

END_ID = 2
#: Pieces packed together by one task: large enough that the last bins of a group do not matter.
GROUP_PIECES = 20_000


class Encoder:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them.

    `ranks` is the same vocabulary as merge ranks; for texts of settled characters the
    two libraries agree and the rank form is several times faster.  Any other text, and
    any that holds a special string, goes to the tokenizers library.
    """

    RUN = re.compile(r"\s\s")

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.plain = self.full = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
            # without runs of white space the look-ahead says nothing, and costs half the time
            self.plain = tiktoken.Encoding("plain", pat_str=rf"{words}|\s+", mergeable_ranks=table, special_tokens={})
            self.full = tiktoken.Encoding("full", pat_str=rf"{words}|\s+(?!\S)|\s+", mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.plain is None or not settled(text) or any(s in text for s in self.specials):
            return self.library.encode(text, add_special_tokens=False).ids
        return (self.full if self.RUN.search(text) else self.plain).encode_ordinary(text)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32): each text's pieces of at most `capacity` ids."""
    path = tokenizer or default_tokenizer()
    ranks = ranks or (None if tokenizer else default_ranks())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path, ranks)  # of this task alone, so that idle workers do not hold one
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = np.array(enc.ids(text.as_py()), "<u4")
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                at, first = 0, ids.size % capacity or capacity
                k = 0
                while at < ids.size:
                    part = ids[at : at + (first if k == 0 else capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(part.size)
                    crc.append(zlib.crc32(part.tobytes()))
                    at, k = at + part.size, k + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(cut, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: there is a bin with gap g
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = gaps >> s
        if fits:
            g = s + (fits & -fits).bit_length() - 1
            b = by_gap[g].pop()
            if not by_gap[g]:
                gaps &= ~(1 << g)
            bins[b].append(i)
            g -= s
        else:
            bins.append([i])
            b, g = len(bins) - 1, capacity - s
        by_gap[g].append(b)
        gaps |= 1 << g
    return bins


class LocalSearch:
    """Moves and swaps between underfull bins; each raises the sum of squared fills."""

    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.bins, self.capacity = sizes.tolist(), bins, capacity
        self.gap = [capacity - sum(self.sizes[i] for i in b) for b in bins]
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.widest = np.zeros(capacity + 1, np.int64)  # by size: the largest gap of a bin that holds this size
        self.reach = np.arange(capacity + 1)
        self.by_gap: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.changes = 0
        for b in range(len(bins)):
            self.enter(b)

    def enter(self, b: int) -> None:
        if not self.bins[b] or not self.gap[b]:
            return
        self.by_gap[self.gap[b]].add(b)
        for s in {self.sizes[i] for i in self.bins[b]}:
            heapq.heappush(self.heaps[s], (-self.gap[b], b))
            self.widest[s] = max(self.widest[s], self.gap[b])

    def leave(self, b: int) -> set[int]:
        self.by_gap[self.gap[b]].discard(b)
        return {self.sizes[i] for i in self.bins[b]}

    def holder(self, s: int, a: int, need: int) -> int | None:
        """A bin at least as full as a that holds size s and has a gap of `need` or more, the emptiest of these."""
        heap, aside, found = self.heaps[s], [], None
        while heap and found is None:
            gap, b = heap[0]
            if -gap != self.gap[b] or not any(self.sizes[i] == s for i in self.bins[b]):
                heapq.heappop(heap)  # an old entry
            elif -gap < need:
                break
            elif b != a and -gap <= self.gap[a]:
                found = b
            else:
                entry = heapq.heappop(heap)
                if entry not in aside[-1:]:
                    aside.append(entry)
        self.widest[s] = -(aside or heap or [(0, 0)])[0][0]
        for entry in aside:
            heapq.heappush(heap, entry)
        return found

    def change(self, a: int, out_a: list[int], b: int, out_b: list[int]) -> None:
        self.changes += 1
        self.leave(a), self.leave(b)
        for i in out_a:
            self.bins[a].remove(i)
        for i in out_b:
            self.bins[b].remove(i)
        self.bins[a] += out_b
        self.bins[b] += out_a
        for x in (a, b):
            self.gap[x] = self.capacity - sum(self.sizes[i] for i in self.bins[x])
            self.enter(x)

    def move(self, a: int, i: int) -> bool:
        s = self.sizes[i]
        for g in range(s, self.capacity):
            for b in self.by_gap[g]:
                if b != a and self.gap[b] <= self.gap[a]:
                    self.change(a, [i], b, [])
                    return True
        return False

    def swap(self, a: int, items: list[int]) -> bool:
        """Give `items` (one or two) of bin a for one smaller piece of a bin at least as full."""
        total = sum(self.sizes[i] for i in items)
        low = max(1, total - self.capacity)
        y = self.reach[low : min(total, self.capacity + 1)]
        for s in y[self.widest[y] >= total - y].tolist():
            b = self.holder(s, a, total - s)
            if b is not None:
                self.change(a, items, b, [next(i for i in self.bins[b] if self.sizes[i] == s)])
                return True
        return False

    def empty(self, a: int) -> bool:
        """Work on bin a until it is empty or nothing helps."""
        going = True
        while self.bins[a] and going:
            going = False
            by_size: dict[int, list[int]] = {}
            for i in sorted(self.bins[a], key=lambda i: -self.sizes[i]):
                by_size.setdefault(self.sizes[i], []).append(i)
            ones = [of[0] for of in by_size.values()]
            # two pieces of each pair of sizes, or of one size twice
            pairs = ([x, y] for k, x in enumerate(ones) for y in [*by_size[self.sizes[x]][1:2], *ones[k + 1 :]])
            going = any(self.move(a, i) for i in ones) or any(self.swap(a, [i]) for i in ones) or any(self.swap(a, pair) for pair in pairs)
        return not self.bins[a]

    def run(self) -> list[list[int]]:
        """Passes over the underfull bins, the emptiest first, until one changes nothing."""
        before = -1
        while self.changes != before:
            before = self.changes
            for b in sorted((b for b in range(len(self.bins)) if self.bins[b] and self.gap[b]), key=lambda b: -self.gap[b]):
                if self.bins[b] and self.gap[b]:
                    self.empty(b)
        return [b for b in self.bins if b]


def packed(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id") -> DataFrame:
    """Add sequence_id and offset to (materialised) rows with a `length` of 1 to `capacity`."""
    kind = pieces.schema[id_col].dataType.simpleString()
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    parts = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-parts.count() // group_pieces))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])  # the same bins in whatever order rows came
        sizes = rows["length"].to_numpy()
        bins = LocalSearch(sizes, best_fit(sizes, capacity), capacity).run()
        seq, off = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for k, items in enumerate(bins):
            seq[items] = (key[0].as_py() << 32) + k
            off[items] = np.concatenate([[0], np.cumsum(sizes[items])[:-1]])
        return rows.drop_columns(["group"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    dealt = parts.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return whole.unionByName(dealt.groupBy("group").applyInArrow(pack, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"))


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, ranks: str | None = None, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack `docs`: one row per piece with its sequence and offset there."""
    return packed(materialise(token_pieces(docs, capacity, tokenizer, ranks, id_col, text_col), "pieces"), capacity, group_pieces, id_col)
