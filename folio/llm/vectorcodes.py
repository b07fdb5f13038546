"""Vector code compression: product codes learned by the filtering form of Lloyd's algorithm.

Components become integers floor(scale * x) and vectors are cut into `parts` consecutive
parts, each with its own codebook.  Every partition packs its vectors in blocks of at most
BLOCK_ROWS and builds, once, a kd-tree over each part of a block.  A tree is a heap of
equal halves: node i has the children 2i+1 and 2i+2, and each node holds the bounding box,
the sum and the count of its points.  The blocks are written once and read by each round.

A round sends the codebooks to the blocks, a few hundred integers.  All nodes of a level
are filtered at once: of a node's entries the one nearest to the middle of its box is held
against each other one at the corner of the box that favours the other most; an entry that
is no nearer even there is dropped.  A node with one entry left is assigned as a whole
through its cached sum and count; points of leaves with several entries left are compared
with these alone.  Everything is integer arithmetic, so that ties are ties: they go to the
lower index.  The sums of blocks meet in one row per task, part and entry.

The last step fills the code of every vector in the same way and adds up its distances.

Edge cases: rows whose vector is null, empty or holds null or non-finite components are
dropped, and so are those with a component of magnitude MOST or more after scaling, whose
squared distances no long could hold, and those not as long as the vector of the smallest
id; a length that `parts` does not divide is cut as evenly as it can be; with fewer rows
than entries the codebooks are shorter; repeated rows each count; a null id comes last in
order; null labels form one label; an empty table gives an empty table; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folio.llm.common import bound_batches, if_small, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block, points in a leaf.
BLOCK_ROWS, LEAF_ROWS = 4096, 16
#: Components are smaller than this in magnitude: squares of differences of up to 1,000 components fit in a long.
MOST = 1 << 26

BLOCK = "n bigint, ids binary, labels binary, points binary, orders binary, lows binary, highs binary, sums binary"


def integers(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """(vec_id, label, x) of the rows that are kept, x as integers."""
    whole = lambda x: F.floor(x.cast("double") * scale)
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < MOST)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    return rows.where((F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(fits(x), F.lit(False)))).select("vec_id", "label", F.transform("v", whole).alias("x"))


def bounds_of(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * k // parts, width * (k + 1) // parts) for k in range(parts)]


def depth_of(n: int) -> int:
    """Levels below the root until leaves hold at most LEAF_ROWS of n points."""
    depth = 0
    while n > LEAF_ROWS << depth:
        depth += 1
    return depth


def cuts_of(n: int) -> list[np.ndarray]:
    """For each level the places at which its nodes begin, and n."""
    return [np.arange((1 << level) + 1) * n >> level for level in range(depth_of(n) + 1)]


def tree_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of points by leaf, and lows, highs and sums of the nodes, level after level.

    Each node is split in halves along the longest side of its box.
    """
    n, order = len(points), np.arange(len(points))
    cuts = cuts_of(n)
    for level in range(len(cuts) - 1):
        for a, b, m in zip(cuts[level][:-1], cuts[level][1:], cuts[level + 1][1::2], strict=True):
            own = points[order[a:b]]
            axis = int(np.argmax(own.max(0) - own.min(0)))
            order[a:b] = order[a:b][np.argpartition(own[:, axis], m - a)]
    placed = points[order]
    lows, highs, sums = (np.concatenate([f.reduceat(placed, c[:-1], axis=0) for c in cuts]) for f in (np.minimum, np.maximum, np.add))
    return order, lows, highs, sums


def pack(ids: pa.Array, labels: pa.Array, points: np.ndarray, parts: int) -> dict:
    """One block as a row of BLOCK; arrays of all parts one after another."""
    trees = [tree_of(points[:, a:b]) for a, b in bounds_of(points.shape[1], parts)]
    flat = lambda k, kind: b"".join(np.ascontiguousarray(t[k], kind).tobytes() for t in trees)
    held = lambda a: pa.RecordBatch.from_arrays([a], ["a"]).serialize().to_pybytes()
    return {"n": len(points), "ids": held(ids), "labels": held(labels), "points": points.astype(np.int32).tobytes(), "orders": flat(0, np.int32), "lows": flat(1, np.int32), "highs": flat(2, np.int32), "sums": flat(3, np.int64)}


def blocks_of(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """Vectors (vec_id, label, x) as blocks with their trees."""
    kinds = pa.schema([("n", pa.int64()), *[(n, pa.binary()) for n in ("ids", "labels", "points", "orders", "lows", "highs", "sums")]])

    def made(ids, labels, points) -> pa.RecordBatch:
        block = pack(pa.chunked_array(ids).combine_chunks(), pa.chunked_array(labels).combine_chunks(), np.concatenate(points), parts)
        return pa.RecordBatch.from_pylist([block], kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, points, n = [], [], [], 0
        for batch in batches:
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            at = 0
            while at < len(x):
                end = min(len(x), at + BLOCK_ROWS - n)
                ids.append(batch["vec_id"].slice(at, end - at))
                labels.append(batch["label"].slice(at, end - at))
                points.append(x[at:end])
                n, at = n + end - at, end
                if n == BLOCK_ROWS:
                    yield made(ids, labels, points)
                    ids, labels, points, n = [], [], [], 0
        if n:
            yield made(ids, labels, points)

    return rows.mapInArrow(read, BLOCK)


class Tree:
    """One part of a block, and the assignment of its points to a codebook."""

    def __init__(self, points: np.ndarray, order: np.ndarray, lows: np.ndarray, highs: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.lows, self.highs, self.sums = points, order, lows, highs, sums
        self.cuts = cuts_of(len(points))

    def kept(self, nodes: np.ndarray, open_: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Which of the open entries of each node may be nearest to a point of its box."""
        lows, highs = self.lows[nodes], self.highs[nodes]
        middle = (lows + highs)[:, None, :] - 2 * book[None]
        best = np.argmin(np.where(open_, (middle * middle).sum(2), np.iinfo(np.int64).max), axis=1)
        toward = book[None] - book[best][:, None, :]
        # the least of |p-z|^2 - |p-best|^2 over the box is taken at the corner in the direction of z
        corner = np.maximum(toward * lows[:, None, :], toward * highs[:, None, :]).sum(2)
        norms = (book * book).sum(1)
        least = norms[None] - norms[best][:, None] - 2 * corner
        index = np.arange(len(book))
        beaten = (least > 0) | ((least == 0) & (index[None] > best[:, None]))
        return open_ & (~beaten | (index[None] == best[:, None]))

    def assign(self, book: np.ndarray, codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the points of each entry; `codes`, if given, is filled by point."""
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        for level, cuts in enumerate(self.cuts):
            first = (1 << level) - 1
            open_ = self.kept(first + nodes, open_, book)
            single = open_.sum(1) == 1
            won = open_[single].argmax(1)
            np.add.at(sums, won, self.sums[first + nodes[single]])
            np.add.at(counts, won, np.diff(cuts)[nodes[single]])
            if codes is not None:
                for node, entry in zip(nodes[single], won, strict=True):
                    codes[self.order[cuts[node] : cuts[node + 1]]] = entry
            nodes, open_ = nodes[~single], open_[~single]
            if level < len(self.cuts) - 1:
                nodes, open_ = np.concatenate([2 * nodes, 2 * nodes + 1]), np.concatenate([open_, open_])
        sizes = np.diff(self.cuts[-1])[nodes]
        if len(nodes):
            own = self.order[np.concatenate([np.arange(a, b) for a, b in zip(self.cuts[-1][nodes], self.cuts[-1][nodes + 1], strict=True)])]
            left = np.repeat(open_, sizes, axis=0)
            gaps = np.full(left.shape, np.iinfo(np.int64).max)
            for k in range(len(book)):
                if (at := np.flatnonzero(left[:, k])).size:
                    gap = self.points[own[at]] - book[k]
                    gaps[at, k] = (gap * gap).sum(1)
            won = gaps.argmin(1)
            np.add.at(sums, won, self.points[own])
            counts += np.bincount(won, minlength=len(book))
            if codes is not None:
                codes[own] = won
        return sums, counts


def trees_of(block: dict, width: int, parts: int) -> Iterator[tuple[int, Tree]]:
    n = block["n"]
    points = np.frombuffer(block["points"], np.int32).reshape(n, width).astype(np.int64)
    nodes = sum(1 << level for level in range(depth_of(n) + 1))
    orders = np.frombuffer(block["orders"], np.int32).reshape(parts, n)
    boxes = {k: np.frombuffer(block[k], kind).astype(np.int64) for k, kind in (("lows", np.int32), ("highs", np.int32), ("sums", np.int64))}
    for part, (a, b) in enumerate(bounds_of(width, parts)):
        yield part, Tree(points[:, a:b], orders[part], *[boxes[k][nodes * a : nodes * b].reshape(nodes, b - a) for k in ("lows", "highs", "sums")])


def rounded(blocks: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one more round."""
    parts = len(books)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for block in batch.to_pylist():
                for part, tree in trees_of(block, width, parts):
                    s, c = tree.assign(books[part])
                    sums[part] += s
                    counts[part] += c
        rows = [{"part": p, "entry": e, "n": int(counts[p][e]), "at": d, "total": int(sums[p][e][d])} for p in range(parts) for e in range(len(books[p])) if counts[p][e] for d in range(books[p].shape[1])]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.int64()) for c in ("part", "entry", "n", "at", "total")]))

    found = blocks.mapInArrow(read, "part bigint, entry bigint, n bigint, at bigint, total bigint")
    means = found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = [b.copy() for b in books]
    for r in means.collect():  # one row for each component of a codebook
        out[r.part][r.entry][r.at] = r.total // r.n
    return out


def encoded(blocks: DataFrame, books: list[np.ndarray], width: int, kinds: tuple[str, str]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    parts = len(books)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                codes, errors = np.zeros((block["n"], parts), np.uint8), np.zeros(block["n"], np.int64)
                for part, tree in trees_of(block, width, parts):
                    own = np.zeros(block["n"], np.int64)
                    tree.assign(books[part], own)
                    codes[:, part] = own
                    gaps = tree.points - books[part][own]
                    errors += (gaps * gaps).sum(1)
                ids, labels = (pa.ipc.read_record_batch(pa.py_buffer(block[k]), pa.schema([("a", t)]))["a"] for k, t in (("ids", types[0]), ("labels", types[1])))
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)], ["vec_id", "label", "code", "error"])

    types = [to_arrow_type(t) for t in kinds]
    return blocks.mapInArrow(read, f"vec_id {kinds[0].simpleString()}, label {kinds[1].simpleString()}, code string, error bigint")


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the final codebooks: one array of entries a part.

    At most 256 entries: a code has one byte a part, as two hexadecimal digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = integers(vectors, id_col, vec_col, label_col, scale)
    by_id = [F.col("vec_id").isNull(), "vec_id", "x"]
    smallest = rows.orderBy(*by_id).first()
    width = len(smallest.x) if smallest else 0
    rows = rows.where(F.size("x") == width)
    kinds = (rows.schema["vec_id"].dataType, rows.schema["label"].dataType)
    least = [r.x for r in rows.orderBy(*by_id).limit(entries).collect()]
    first = np.array(least, np.int64).reshape(len(least), width)
    books = [first[:, a:b] for a, b in bounds_of(width, parts)]
    blocks = materialise(blocks_of(rows, width, parts), "trees")
    for _ in range(rounds if width else 0):
        books = rounded(blocks, books, width)
    return encoded(blocks, books, width, kinds), books


def codebooks_text(books: list[np.ndarray]) -> str:
    """All components by part, entry and position."""
    return ",".join(str(int(x)) for book in books for entry in book for x in entry)


def code_report(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (the errors of a label, added up) and the digest of the codebooks."""
    codes, books = vector_codes(vectors, parts, entries, rounds, scale)
    codes = materialise(codes, "codes")
    labels = materialise(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    digest = hashlib.sha256(codebooks_text(books).encode()).hexdigest()
    return codes.join(if_small(labels), F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
