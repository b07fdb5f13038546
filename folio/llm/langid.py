"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes long is counted on labelled
texts and then frozen.  The code length of a byte after its context is that of the
longest context seen, with escapes of method C on the way down: n occurrences and d
distinct followers give c / (n + d) to a follower and d / (n + d) to the escape.  A text
gets the language in which its bytes have the shortest code.

Contexts are counted with Spark over a bounded sample of labelled texts: about SAMPLE whole
texts a language at most, taken by a hash of the id and fewer of each language where the
trees of all would take more than MODEL_BYTES.  Every n-gram of the sample is kept.  The
frozen trees are tables of n-grams, each with a row of log probabilities for all languages.

Edge cases: null labels are not learned from; null ids are; a null text, or one without a
letter, is `und` with score 0; with nothing to learn from every text is `und`; repeated rows
give a row each; an empty table gives an empty table; a text of any length is scored whole,
by one task; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bound_batches, materialise, text_or_empty

ORDER = 3
#: Labelled texts a language, about, that the trees are counted on.
SAMPLE = 4000
#: Bytes of frozen trees, of all languages together, that are broadcast.
MODEL_BYTES = 96 << 20
UNKNOWN = "und"
#: Texts scored together, and positions looked up at once (a row of floats for each).
GROUP_BYTES, STEP = 1 << 20, 1 << 17
LETTER = regex.compile(r"\p{L}")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each position, packed; positions before n - 1 hold fewer (zero bytes)."""
    out = data.astype(np.uint64)
    for k in range(1, n):
        shifted = np.zeros(data.size, np.uint64)
        shifted[k:] = data[: max(0, data.size - k)]
        out |= shifted << np.uint64(8 * k)
    return out


def with_margin(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, each after ORDER zero bytes (its start context); the margins' lengths excluded by bounds."""
    bounds = np.cumsum([0, *[len(t) + ORDER for t in texts]])
    return np.frombuffer(b"".join(bytes(ORDER) + t for t in texts), np.uint8), bounds


def sampled(docs: DataFrame, learn: Column, id_col: str, text_col: str, lang_col: str, sample: int) -> DataFrame:
    """Labelled texts to learn from, thinned by a hash of id and text to about `sample` a language."""
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = materialise(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")), "labels")
    part = F.pmod(F.xxhash64(F.col(id_col), F.length(text_col)), F.lit(1 << 30)) / float(1 << 30)
    return rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), part.alias("part")).join(counts, "lang").where(F.col("part") * F.col("n") < sample).select("lang", "text")


def context_counts(texts: DataFrame) -> DataFrame:
    """(lang, size, gram, n): occurrences of every n-gram of 1 to ORDER + 1 bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for lang, part in frame.groupby("lang"):
                data, bounds = with_margin([t.encode("utf-8", "replace") for t in part["text"]])
                own = np.ones(data.size, bool)
                for k in range(ORDER):
                    own[bounds[:-1] + k] = False
                for size in range(1, ORDER + 2):
                    gram, n = np.unique(grams(data, size)[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * gram.size), pa.array(np.full(gram.size, size, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n)], names=["lang", "size", "gram", "n"])

    bound_batches(texts.sparkSession)
    return texts.mapInArrow(count, "lang string, size int, gram bigint, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Slots:
    """Open addressing with linear probing: from n-grams to their numbers 1, 2, ..., 0 for others."""

    def __init__(self, grams: np.ndarray):
        self.bits = max(4, int(4 * grams.size).bit_length())
        self.key, self.number = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        keys, numbers = grams.astype(np.uint64) + np.uint64(1), np.arange(1, grams.size + 1, dtype=np.int32)
        at = self.first(keys)
        while keys.size:
            free = np.flatnonzero(self.key[at] == 0)
            _, one = np.unique(at[free], return_index=True)  # one n-gram takes a slot, the others go on
            took = free[one]
            self.key[at[took]], self.number[at[took]] = keys[took], numbers[took]
            rest = np.ones(keys.size, bool)
            rest[took] = False
            keys, numbers, at = keys[rest], numbers[rest], self.next(at[rest])

    def first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def find(self, grams: np.ndarray) -> np.ndarray:
        keys = grams + np.uint64(1)
        at = self.first(keys)
        held = self.key[at]
        out = np.where(held == keys, self.number[at], 0)
        going = np.flatnonzero((held != keys) & (held != 0))
        while going.size:
            at[going] = self.next(at[going])
            held = self.key[at[going]]
            found = held == keys[going]
            out[going[found]] = self.number[at[going[found]]]
            going = going[~found & (held != 0)]
        return out


class ContextTrees:
    """Frozen log2 probabilities of all languages: for each order the n-grams counted in any language.

    `rows[k]` has, for each n-gram of k + 1 bytes, the logarithms of its last byte's
    probability after the first k, escapes included; `leave[k]` has, for each context of k
    bytes (numbered as the n-grams of k bytes are), what it costs to leave it.  Row 0 stands
    for n-grams not counted: as such it is the uniform code of order -1 in rows[0], and
    nothing to leave in leave[k].
    """

    def __init__(self, langs: list[str], size: np.ndarray, gram: np.ndarray, lang: np.ndarray, n: np.ndarray):
        self.langs, n_lang = langs, len(langs)
        self.slots, self.rows, self.leave = [], [], []
        uniform = np.full((1, n_lang), 1 / 256)
        for k in range(ORDER + 1):
            of = size == k + 1
            grams = np.unique(np.r_[gram[of], 0])  # zero: what stands before a text is a context too
            c = np.zeros((grams.size, n_lang))
            c[np.searchsorted(grams, gram[of]), lang[of]] = n[of]
            # sums over the followers of each context of k bytes
            context = self.slots[-1].find(grams.astype(np.uint64) >> np.uint64(8)) if k else np.ones(grams.size, np.int64)
            contexts = len(self.rows[-1]) if k else 2
            total, kinds = np.zeros((contexts, n_lang)), np.zeros((contexts, n_lang))
            np.add.at(total, context, c)
            np.add.at(kinds, context, c > 0)
            shorter = np.exp2(self.chain(grams.astype(np.uint64), k - 1).astype(np.float64)) if k else np.repeat(uniform, grams.size, 0)
            leave = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
            p = np.where(c > 0, c / np.maximum(total + kinds, 1)[context], leave[context] * shorter)
            if k == 0:
                unseen = leave[1:2] * uniform
                leave = leave[1:2]
            self.leave.append(np.log2(leave).astype(np.float32))
            self.rows.append(np.log2(np.vstack([unseen if k == 0 else uniform, p])).astype(np.float32))
            self.slots.append(Slots(grams))

    @staticmethod
    def part(grams: np.ndarray, size: int) -> np.ndarray:
        """The last `size` bytes of packed n-grams."""
        return grams & np.uint64((1 << 8 * size) - 1)

    def chain(self, grams: np.ndarray, order: int) -> np.ndarray:
        """(n-grams, languages): log probability of the last byte after up to `order` bytes before it.

        Contexts begin with what stands before in the packed n-gram; from the longest order
        down, only n-grams not found are looked up again.
        """
        bits = np.zeros((grams.size, len(self.langs)), np.float32)
        left = np.arange(grams.size)
        for k in range(order, -1, -1):
            row = self.slots[k].find(self.part(grams[left], k + 1))
            found = row > 0 if k else np.ones(left.size, bool)
            bits[left[found]] += self.rows[k][row[found]]
            left = left[~found]
            if not left.size:
                break
            # of contexts of no language nothing is left
            bits[left] += self.leave[k][self.slots[k - 1].find(self.part(grams[left] >> np.uint64(8), k))]
        return bits

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each text under each language's tree."""
        data, bounds = with_margin(texts)
        every, of = grams(data, ORDER + 1), np.repeat(np.arange(len(texts)), np.diff(bounds))
        own = np.ones(data.size, bool)
        for k in range(ORDER):
            own[bounds[:-1] + k] = False
        every, of = every[own], of[own]
        out = np.zeros((len(texts), len(self.langs)))
        for k in range(0, of.size, STEP):
            part = of[k : k + STEP]
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            out[part[first]] -= np.add.reduceat(self.chain(every[k : k + STEP], ORDER), first, axis=0, dtype=np.float64)
        return out


def trained(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, model_bytes: int = MODEL_BYTES) -> ContextTrees | None:
    """Count and freeze the trees; None if no labelled text is there.

    What reaches the driver is the n-grams of the sample, which is halved until the trees
    take at most `model_bytes`: a bound that does not grow with the table.
    """
    while True:
        counts = materialise(context_counts(sampled(docs, learn, id_col, text_col, lang_col, sample)), "contexts")
        n_grams, n_langs = counts.agg(F.count_distinct("size", "gram"), F.count_distinct("lang")).first()
        # a row of floats for each n-gram, as itself and as a context, and about eight slots
        if n_grams * (8 * n_langs + 96) <= model_bytes or sample <= 1:
            break
        sample //= 2
    if not n_grams:
        return None
    table = counts.toArrow().combine_chunks()
    langs = sorted(pc.unique(table["lang"]).to_pylist())
    lang = pc.index_in(table["lang"], pa.array(langs)).to_numpy()
    return ContextTrees(langs, table["size"].to_numpy(), table["gram"].to_numpy(), lang, table["n"].to_numpy())


def predict(docs: DataFrame, trees: ContextTrees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score (the languages' share of probability, per 64 bytes)."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = model.value
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if tree is not None and LETTER.search(t)]
            while known:
                part, size = [], 0
                while known and (size < GROUP_BYTES or not part):
                    part.append(known.pop())
                    size += len(texts[part[-1]])
                data = [texts[i].encode("utf-8", "replace") for i in part]
                bits = tree.code_lengths(data)
                scaled = (bits - bits.min(1, keepdims=True)) / np.maximum(1, np.array([[len(d)] for d in data]) / 64)
                share = 1 / np.exp2(-scaled).sum(1)
                for i, best, s in zip(part, bits.argmin(1), share, strict=True):
                    lang[i], score[i] = tree.langs[best], min(1.0, s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col), text_or_empty(text_col).alias("text")).mapInArrow(classify, f"`{id_col}` {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all: id, held_out, lang_pred, score."""
    trees = trained(docs, ~held_out(id_col), id_col, text_col, lang_col)
    return predict(docs, trees, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
