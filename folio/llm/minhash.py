"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A text's set is its distinct 5-word shingles as 64-bit hashes; equal sets are one node.
A node's signature has CHUNKS * SYMBOLS minwise symbols of 32 bits.  By pigeonhole, two
signatures that differ in fewer than CHUNKS * (ERRORS + 1) symbols agree in some chunk up
to ERRORS symbols, so with ERRORS = 1 every chunk is indexed once for each symbol left
out, and every pair under that distance (28 of 84) meets in a bucket.  At similarity 0.75
a pair meets nowhere with probability 2e-5, less above it.

Nothing is joined on a mere meeting.  Pairs that meet are first held against each other by
their signatures and by sketches that bound how far two sets are apart; those that agree
enough by their full sets; only links
confirmed by full sets make components.  To keep the pairs few, each bucket's members are
compared with two of them; then only buckets that still hold several components are in
question.  There what lies outside a bucket's main component is held by its signature
against every member, in cells of bounded size, and a node that comes near another
component is compared by its full set with all of it: a large group of near copies is never
compared with itself, and nodes near it give one row each.

Edge cases: a null, empty or blank text has an empty set, is linked with nothing and is
its own component; texts of one to four words have one shingle; repeated rows fall into
one node and get the same component; null ids count as larger than any id; an empty table
gives an empty table; other columns are not read.  A text of any length has one signature
and one set, of 8 bytes a shingle, which one task holds whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bound_batches, if_small, materialise, text_or_empty

WORDS = 5
CHUNKS, SYMBOLS, ERRORS = 14, 6, 1
K = CHUNKS * SYMBOLS
#: Bytes of full sets in a cell; members of a bucket beyond which it is cut into blocks of so many.
CELL_BYTES, BLOCK = 8 << 20, 1000
#: Bucket rows that one task's group pools, and pairs of signatures held against each other at once.
POOL_ROWS, PAIRS = 20_000, 100_000
#: Keys of buckets with two nodes or more are broadcast up to this many (two longs each).
KEY_ROWS = 1_000_000
#: Bits of a set's parity sketch, and 64-bit words of a node's marks that hold the low bytes of its signature.
PARITY = 1024
LOW_WORDS = -(-K // 8)
GROUP_BYTES = 1 << 18

_RNG = np.random.default_rng(20240101)
_ODD = lambda *shape: _RNG.integers(0, 1 << 63, shape, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = _ODD(1)[0]
_PLACE, _SHORT = _ODD(WORDS), _ODD(WORDS)
_FLIP, _MULT = _ODD(K), _ODD(K)
_SYMBOL, _SALT = _ODD(K), _ODD(K)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each run of bytes that are no white space."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.r_[False, ~_SPACE[data], False].astype(np.int8)
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(data.size)
    upto = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power)]
    return start, scrambled((upto[end] - upto[start]) * inverse[start])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    parts = [t.encode("utf-8", "replace").lower() for t in texts]  # bytes.lower() changes A-Z alone
    bounds = np.cumsum([0, *[len(p) + 1 for p in parts]])
    start, words = word_hashes(np.frombuffer(b"\n".join(parts), np.uint8))
    first = np.searchsorted(start, bounds)
    n = max(0, words.size - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled += words[k : k + n] * _PLACE[k]
    rolled = scrambled(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            out.append(scrambled(np.sum(words[a:b] * _PLACE[: b - a], keepdims=True) + _SHORT[b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(values: np.ndarray) -> np.ndarray:
    low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, values.size, 2048):
        low = np.minimum(low, ((values[i : i + 2048, None] ^ _FLIP) * _MULT).min(0))
    return (low >> np.uint64(7)).astype(np.uint32)  # b = 32 bits of each minimum


def parity(values: np.ndarray) -> bytes:
    """For each of PARITY places, whether an odd number of elements falls there.

    Every place in which two sketches differ holds an element of one set that is not in the other.
    """
    return np.packbits(np.bincount((values >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1).tobytes()


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """(nodes, K) keys: chunk j with its symbol p left out, for all j and p."""
    mixed = scrambled(signatures.astype(np.uint64) + _SYMBOL).reshape(-1, CHUNKS, SYMBOLS)
    return scrambled((mixed.sum(2, keepdims=True, dtype=np.uint64) - mixed).reshape(-1, K) ^ _SALT)


def groups_of(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about GROUP_BYTES."""
    texts, began, size = [], 0, 0
    for i, t in enumerate(batch.column(column)):
        texts.append(t.as_py())
        size += len(texts[-1])
        if size >= GROUP_BYTES:
            yield began, texts
            texts, began, size = [], i + 1, 0
    if texts:
        yield began, texts


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit names of the sets, as two longs."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def signed_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hi, lo, n, sig) for each row: the set's name and size, its signature and parity sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for began, texts in groups_of(batch, 1):
                sets = shingle_sets(texts)
                names = names_of(sets)
                sig = pa.array([signature(s).tobytes() + parity(s) if s.size else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(began, len(texts)), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.size for s in sets], pa.int64()), sig], names=["id", "hi", "lo", "n", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(sign, f"id {kind}, hi bigint, lo bigint, n bigint, sig binary")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, items) for the given nodes: their texts are read again, only theirs."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in groups_of(batch, 0):
                sets = shingle_sets(texts)
                names = names_of(sets)
                items = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), items], names=["hi", "lo", "items"])

    ids = if_small(materialise(nodes.select(F.col("id").alias("__id")).distinct(), "ids"))
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).join(ids, F.col("id").eqNullSafe(F.col("__id")), "left_semi").select("text")
    bound_batches(docs.sparkSession)
    sets = texts.mapInArrow(collect, "hi bigint, lo bigint, items binary")
    # rows of one id offer sets of other nodes, and repeated rows the same set again
    return sets.join(if_small(nodes.select("node", "hi", "lo")), ["hi", "lo"]).groupBy("node").agg(F.first("items").alias("items"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for nodes with an edge.

    Large-star and small-star steps; each is a minimum per node and a join, so a node
    with very many links is pre-aggregated and its join can be split.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            # stars: every node has one link, to its root
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "small")


def mark_words(marks: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A node's marks, LOW_WORDS numbers for the low bytes of its signature and then its parity sketch."""
    return np.frombuffer(b"".join(marks.to_pylist()), np.uint64).reshape(-1, LOW_WORDS + PARITY // 64)


def marks_of(sig: list[bytes]) -> list[bytes]:
    whole = np.frombuffer(b"".join(sig), np.uint8).reshape(-1, 4 * K + PARITY // 8)
    low = np.pad(np.ascontiguousarray(whole[:, : 4 * K]).view(np.uint32).astype(np.uint8), ((0, 0), (0, 8 * LOW_WORDS - K)))
    return [x.tobytes() for x in np.concatenate([low, whole[:, 4 * K :]], 1)]


def agreement(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """In how many of K bytes the rows are equal, counted in whole numbers at once."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    x = one ^ two
    different = (((x & low) + low) | x) & ~low  # the top bit of each byte that is not zero
    return K - np.bitwise_count(different).sum(1, dtype=np.int64)


def may_link(one: np.ndarray, two: np.ndarray, n: np.ndarray, m: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m with these marks agree in enough symbols and can be linked.

    The second is a certain bound: their sketches differ in no more places than the sets have
    elements apart.
    """
    out = agreement(one[:, :LOW_WORDS], two[:, :LOW_WORDS]) >= least
    at = np.flatnonzero(out)
    apart = np.bitwise_count(one[at, LOW_WORDS:] ^ two[at, LOW_WORDS:]).sum(1, dtype=np.int64)
    n, m = n[at], m[at]
    common = np.minimum(np.minimum(n, m), (n + m - apart) // 2)
    out[at] = 100 * common >= percent * (n + m - common)
    return out


def agreeing(pairs: DataFrame, nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b) that may_link()."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("marks").alias(f"m{x}"), F.col("n").alias(f"n{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = pa.array(may_link(mark_words(batch.column(2)), mark_words(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy(), least, percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "ma", "mb", "na", "nb").mapInArrow(close, "a bigint, b bigint")


def runs_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows with new keys begin, and the number of rows at the end (rows sorted by keys)."""
    new = np.zeros(keys[0].size, bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.r_[np.flatnonzero(new), keys[0].size]


def met_in_buckets(cells: DataFrame, least: int, percent: int) -> DataFrame:
    """(node, label): nodes that share a cell with one of another component that they may_link() to.

    Rows are (pool, key, i, j, node, label, size, left, right, marks, n): a pool is a task's group of
    many cells (key, i, j), and left rows of a cell are compared with its right rows.  Of two
    components the larger is named, so many nodes near one component give a row each.
    """

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("i", "ascending"), ("j", "ascending"), ("node", "ascending")])
        key, i, j, node, label, size, left, right, n_items = (rows[c].to_numpy() for c in ("key", "i", "j", "node", "label", "size", "left", "right", "n"))
        marks = mark_words(rows["marks"])
        nodes, short = np.unique(node, return_inverse=True)
        labels, of_label = np.unique(label, return_inverse=True)
        edge = runs_of(key, i, j)
        of = np.repeat(np.arange(edge.size - 1), np.diff(edge))
        those = np.flatnonzero(right)
        first = np.searchsorted(those, edge)  # right rows of each cell
        these = np.flatnonzero(left)
        many = (first[1:] - first[:-1])[of[these]]
        found = []
        for part in np.split(these, np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum(), PAIRS))):
            n = (first[1:] - first[:-1])[of[part]]
            x = np.repeat(part, n)
            y = those[np.repeat(first[of[part]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if n.sum() else x[:0]
            twice = left[y] & right[x]  # met from both sides: once is enough
            keep = (label[x] != label[y]) & (~twice | (node[x] < node[y]))
            x, y = x[keep], y[keep]
            for k in range(0, x.size, PAIRS):
                a, b = x[k : k + PAIRS], y[k : k + PAIRS]
                near = may_link(marks[a], marks[b], n_items[a], n_items[b], least, percent)
                a, b = a[near], b[near]
                swap = (size[a] > size[b]) | ((size[a] == size[b]) & (label[a] < label[b]))
                found.append(np.where(swap, short[b], short[a]) * labels.size + np.where(swap, of_label[a], of_label[b]))
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        return pa.table({"node": pa.array(nodes[pairs // max(1, labels.size)]), "label": pa.array(labels[pairs % max(1, labels.size)])})

    return cells.groupBy("pool").applyInArrow(compare, "node bigint, label bigint")


def linked(pairs: DataFrame, sets: DataFrame, percent: int, cell_bytes: int) -> DataFrame:
    """Those of the (materialised) pairs (a, b) that the full sets (node, items, bytes) link.

    Sets come to cells of about `cell_bytes`: b's with all its partners a, or with a part of
    them where they hold more than a quarter of a cell.
    """
    size = sets.select("node", "bytes")
    loads = pairs.join(size.select(F.col("node").alias("a"), F.col("bytes").alias("load")), "a").groupBy("b").agg(F.sum("load").alias("load"))
    loads = materialise(loads.join(size.select(F.col("node").alias("b"), "bytes"), "b").withColumn("parts", F.ceil(F.col("load") * 4 / cell_bytes)), "loads")
    whole = loads.agg(F.sum(F.col("load") + F.col("bytes") * F.col("parts"))).first()[0] or 0
    cell = F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))), F.lit(-(-int(whole) // cell_bytes) or 1))
    placed = pairs.join(if_small(loads.select("b", "parts")), "b").select(cell.alias("cell"), "a", "b")
    partners = placed.groupBy("cell", F.col("b").alias("node")).agg(F.collect_list("a").alias("partners"))
    mates = placed.select("cell", F.col("a").alias("node")).distinct().withColumn("partners", F.lit(None).cast("array<bigint>"))
    needed = partners.unionByName(mates).groupBy("cell", "node").agg(F.first("partners", True).alias("partners"))
    filled = needed.join(sets.select("node", "items"), "node")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")  # the same links in whatever order rows came
        node, sets = rows["node"].to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"]]
        sizes = np.array([s.size for s in sets])
        # elements as small numbers, so that a set can be marked in an array and others read there
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        sets, marked, out = np.split(codes, np.cumsum(sizes)[:-1]), np.zeros(values.size, bool), []
        for y, partners in enumerate(rows["partners"]):
            if not partners.is_valid:
                continue
            xs = np.searchsorted(node, np.sort(partners.values.to_numpy()))
            marked[sets[y]] = True
            same = marked[np.concatenate([sets[x] for x in xs.tolist()])]
            marked[sets[y]] = False
            common = np.add.reduceat(same, np.r_[0, np.cumsum(sizes[xs])[:-1]], dtype=np.int64)
            hit = xs[100 * common >= percent * (sizes[xs] + sizes[y] - common)]
            out.append(np.stack([node[hit], np.full(hit.size, node[y])], 1))
        links = np.concatenate([np.zeros((0, 2), np.int64), *out])
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    return materialise(filled.groupBy("cell").applyInArrow(compare, "a bigint, b bigint"), "links")


def linked_to_components(near: DataFrame, members: DataFrame, sets: DataFrame, percent: int, cell_bytes: int) -> DataFrame:
    """Links (a, b) between nodes near (node, label) a component and its members (node, label).

    Both are dealt into blocks of about half a cell, and each cell holds a block of either;
    a node gets one link a cell at most.
    """
    sized = sets.select("node", "bytes")
    theirs = materialise(members.join(near.select("label").distinct(), "label", "left_semi").join(sized, "node"), "members")
    ours = materialise(near.join(sized, "node"), "near")
    weight = lambda rows, name: rows.groupBy("label").agg(F.sum("bytes").alias(name))
    both = weight(theirs, "x").join(weight(ours, "y"), "label")
    blocks = materialise(both.select("label", "x", "y", F.ceil(F.col("x") * 2 / cell_bytes).alias("p"), F.ceil(F.col("y") * 2 / cell_bytes).alias("q")), "component-blocks")
    whole = blocks.agg(F.sum(F.col("x") * F.col("q") + F.col("y") * F.col("p"))).first()[0] or 0
    mine, upto = F.xxhash64("node"), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    placed = theirs.join(if_small(blocks), "label").select("label", "node", F.lit(False).alias("near"), F.pmod(mine, "p").alias("i"), F.explode(upto(F.col("q"))).alias("j"))
    dealt = ours.join(if_small(blocks), "label").select("label", "node", F.lit(True).alias("near"), F.explode(upto(F.col("p"))).alias("i"), F.pmod(mine, "q").alias("j"))
    pool = F.pmod(F.xxhash64("label", "i", "j"), F.lit(-(-int(whole) // cell_bytes) or 1))
    filled = placed.unionByName(dealt).withColumn("pool", pool).join(sets.select("node", "items"), "node")

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("label", "ascending"), ("i", "ascending"), ("j", "ascending"), ("near", "ascending"), ("node", "ascending")])
        label, i, j, node, near = (rows[c].to_numpy() for c in ("label", "i", "j", "node", "near"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["items"]]
        sizes, out = np.array([s.size for s in sets]), []
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        sets, marked = np.split(codes, np.cumsum(sizes)[:-1]), np.zeros(values.size, bool)
        edge = runs_of(label, i, j)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            cut = a + int(np.searchsorted(near[a:b], True))
            if a == cut or cut == b:
                continue
            held, first = np.concatenate(sets[a:cut]), np.r_[0, np.cumsum(sizes[a:cut])[:-1]]
            for y in range(cut, b):
                marked[sets[y]] = True
                common = np.add.reduceat(marked[held], first, dtype=np.int64)
                marked[sets[y]] = False
                hit = np.flatnonzero(100 * common >= percent * (sizes[a:cut] + sizes[y] - common))
                if hit.size:
                    out.append((node[a + hit[0]], node[y]))
        links = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(links[:, 0]), "b": pa.array(links[:, 1])})

    return materialise(filled.groupBy("pool").applyInArrow(compare, "a bigint, b bigint"), "links")


class Links:
    """Links confirmed so far, the full sets read for them, and what they connect."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, percent: int, id_col: str, text_col: str, cell_bytes: int):
        self.docs, self.nodes, self.percent, self.columns, self.cell_bytes = docs, nodes, percent, (id_col, text_col), cell_bytes
        self.sets = self.labels = None

    def read_sets(self, wanted: DataFrame) -> None:
        """Read the full sets of nodes (node) that have none yet."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        wanted = materialise(self.nodes.select("node", "id", "hi", "lo").join(wanted, "node", "left_semi"), "wanted")
        if self.sets is None or not wanted.isEmpty():
            more = materialise(full_sets(self.docs, wanted, *self.columns).withColumn("bytes", F.octet_length("items").cast("long")), "sets")
            self.sets = more if self.sets is None else self.sets.unionByName(more)

    def add(self, links: DataFrame) -> None:
        if links.isEmpty():
            return
        if self.labels is not None:
            links = links.unionByName(self.labels.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.labels = materialise(components(links), "labels")

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of (materialised) pairs (a, b)."""
        if not pairs.isEmpty():
            self.read_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
            self.add(linked(pairs, self.sets, self.percent, self.cell_bytes))

    def confirm_near(self, near: DataFrame) -> None:
        """Compare the full sets of (materialised) nodes near (node, label) a component with those of its members."""
        if not near.isEmpty():
            alone = near.select(F.col("label").alias("node"), "label").distinct()
            members = alone if self.labels is None else self.labels.select("node", F.col("root").alias("label")).unionByName(alone.join(self.labels.select("node"), "node", "left_anti"))
            self.read_sets(near.select("node").unionByName(alone.select("node")).distinct())
            self.add(linked_to_components(near, members, self.sets, self.percent, self.cell_bytes))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """`rows` with the label of their node, its component's least node or itself, and the component's size."""
        if self.labels is None:
            return rows.withColumns({"label": F.col("node"), "size": F.lit(1).cast("long")})
        sized = self.labels.join(self.labels.groupBy("root").agg(F.count("*").alias("size")), "root")
        joined = rows.join(if_small(materialise(sized, "sized-labels")), "node", "left")
        return joined.withColumns({"label": F.coalesce("root", "node"), "size": F.coalesce("size", F.lit(1).cast("long"))}).drop("root")


def least_agreement(percent: int) -> int:
    """Symbols in which linked sets agree but for about one pair in 200,000 (4.4 deviations)."""
    p = percent / 100
    return max(1, int(np.ceil(K * p - 4.4 * np.sqrt(K * p * (1 - p)))))


def confirmed_links(docs: DataFrame, nodes: DataFrame, met: DataFrame, percent: int, id_col: str, text_col: str, cell_bytes: int, block: int) -> DataFrame | None:
    """(node, root): components of the links among nodes that met in buckets (node, key, lead, last)."""
    least = least_agreement(percent)
    found = Links(docs, nodes, percent, id_col, text_col, cell_bytes)
    ends = met.select(F.explode(F.array("lead", "last")).alias("b"), F.col("node").alias("a")).where("a <> b")
    pairs = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found.confirm(materialise(agreeing(pairs, nodes, least, percent), "pairs"))
    rows = materialise(found.labelled(met.select("key", "node")), "bucket-labels")
    by_label = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = materialise(mixed.select("key", "n", F.col("top.label").alias("main"), (F.col("n") - F.col("top.n")).alias("others")), "mixed")
    rows = rows.join(if_small(mixed, KEY_ROWS), "key").withColumn("other", F.col("label") != F.col("main"))
    # all that is left: in each bucket, what lies outside its main component against every member
    small = F.col("n") <= block
    left_blocks, right_blocks = F.ceil(F.col("others") / block), F.ceil(F.col("n") / block)
    i, j = F.pmod(F.xxhash64("node"), left_blocks), F.pmod(F.xxhash64("node"), right_blocks)
    cell = lambda i, j, left, right: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), left.alias("left"), right.alias("right"))
    yes, no, zero = F.lit(True), F.lit(False), F.lit(0)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    as_right = F.transform(upto(left_blocks), lambda x: cell(x, j, no, yes))
    as_left = F.when(F.col("other"), F.transform(upto(right_blocks), lambda x: cell(i, x, yes, no))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean,right:boolean>>"))
    cells = rows.withColumn("cell", F.explode(F.when(small, F.array(cell(zero, zero, F.col("other"), yes))).otherwise(F.concat(as_right, as_left))))
    cells = cells.select("key", "node", "label", "size", "cell.*")
    weight = mixed.select(F.when(small, F.col("n")).otherwise(F.col("n") * left_blocks + F.col("others") * right_blocks).alias("w")).agg(F.sum("w")).first()[0] or 0
    if weight:
        pools = -(-int(weight) // POOL_ROWS)
        cells = cells.withColumn("pool", F.pmod(F.xxhash64("key", "i", "j"), F.lit(pools))).join(nodes.select("node", "marks", "n"), "node")
        found.confirm_near(materialise(met_in_buckets(cells, least, percent).distinct(), "near"))
    return found.labels


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", cell_bytes: int = CELL_BYTES, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept.

    Texts are linked if their sets' similarity is at least `percent` per cent; component_id
    is the smallest id that can be reached; kept marks the rows that have that id.  The
    number of chunks suits 75 per cent and more: pairs below it may meet in no bucket.
    """
    signed = materialise(signed_documents(docs, id_col, text_col), "signed")
    nodes = signed.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("n").alias("n"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                whole = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, 4 * K + PARITY // 8)
                found = bucket_keys(np.ascontiguousarray(whole[:, : 4 * K]).view(np.uint32))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), K)), pa.array(found.ravel().view(np.int64))], names=["node", "key"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                marks = pa.array(marks_of(batch.column(5).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], marks], names=["node", "id", "hi", "lo", "n", "marks"])

    bound_batches(docs.sparkSession)
    rows = nodes.select("node", "sig").mapInArrow(keys, "node bigint, key bigint")
    multi = materialise(rows.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last"), "buckets")
    met = materialise(rows.join(if_small(multi, KEY_ROWS), "key").select("node", "key", "lead", "last"), "met")
    near = if_small(materialise(met.select("node").distinct(), "met-nodes"))
    kind = docs.schema[id_col].dataType.simpleString()
    close = nodes.join(near, "node", "left_semi").select("node", "id", "hi", "lo", "n", "sig").mapInArrow(marked, f"node bigint, id {kind}, hi bigint, lo bigint, n bigint, marks binary")
    labels = confirmed_links(docs, materialise(close, "met-marks"), met, percent, id_col, text_col, cell_bytes, block)
    named = nodes.select("hi", "lo", "node", "id")
    named = named.withColumn("root", F.col("node")) if labels is None else named.join(if_small(labels), "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialise(named, "named")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    least = materialise(least, "least")
    out = signed.select("id", "hi", "lo", "n")
    # a set that stands alone has the id of its node, which may be that of another row
    found = materialise(named.join(if_small(least), "root", "left").select("hi", "lo", F.coalesce("component_id", "id").alias("component_id")), "found")
    out = out.join(if_small(found), ["hi", "lo"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
