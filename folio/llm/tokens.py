"""Token counts: byte-pair merging over batches of pre-tokens held as ragged numpy arrays.

A batch of texts is cut into pre-tokens; the distinct ones are laid end to end in one
array of symbols with an array of sequence numbers beside it.  Each round looks up the
rank of every adjacent pair inside a sequence, finds each sequence's lowest rank, and
merges all occurrences of that pair in all sequences at once.  What survives is counted.

Texts hold mostly pre-tokens seen before, so counts are remembered per worker, up to a
fixed number of entries.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows give a row each;
an empty table gives an empty table; a text of any length is counted whole, by one task;
other columns are not read.  The special string of
the vocabulary inside a text counts as one token, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import bound_batches, text_or_empty

#: Pre-tokens remembered per Python worker before the memory is started afresh.
REMEMBERED = 400_000
#: Texts are taken in groups of about this many characters.
GROUP_CHARS = 4_000_000

#: Below this code point all versions of the Unicode tables agree on letters and numbers.
FIRST_UNSETTLED = "\u0530"
_UNSETTLED_BYTES = bytes(range(0xD5))


def settled(text: str) -> bool:
    """Whether every character is below FIRST_UNSETTLED (told from the UTF-8 lead bytes)."""
    return text.isascii() or not text.encode("utf-8", "surrogatepass").translate(None, _UNSETTLED_BYTES)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class MergeTable:
    """The ranks of a byte-level BPE vocabulary, as sorted arrays of packed symbol pairs."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE vocabulary without normaliser or prefix space is needed")
        self.library = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs, made = [], []
        for merge in spec["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pairs.append(vocab[a] * int(self.base) + vocab[b])
            made.append(vocab[a + b])
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs = np.array(pairs, np.int64)[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array(made, np.int64)  # by rank
        self.no_rank = np.int64(len(made))
        self.pattern = settled_pattern()
        self.counts: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds no special string."""
        if settled(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """How many symbols each word keeps once no pair of it has a rank."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(n), lengths)
        kept = lengths.copy()
        while sym.size > 1:
            inside = seq[1:] == seq[:-1]
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), self.pairs.size - 1)
            rank = np.where(inside & (self.pairs[at] == key), self.ranks[at], self.no_rank)
            first = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(np.r_[rank, self.no_rank], first)  # the last pair of a sequence reaches out of it: no rank
            size = np.diff(np.r_[first, sym.size])
            low = np.repeat(lowest, size)
            hit = np.flatnonzero((rank == low[:-1]) & (rank < self.no_rank))
            # runs such as "aaa" offer overlapping pairs: take every other one from the left
            if hit.size:
                start = np.r_[True, np.diff(hit) != 1]
                run_at = np.maximum.accumulate(np.where(start, np.arange(hit.size), 0))
                hit = hit[(np.arange(hit.size) - run_at) % 2 == 0]
            alive = low < self.no_rank  # finished sequences leave the arrays
            sym = sym.copy()
            sym[hit] = self.made[rank[hit]]
            keep = alive.copy()
            keep[hit + 1] = False
            done_ids = seq[first[lowest == self.no_rank]]
            kept[done_ids] = size[lowest == self.no_rank]
            sym, seq = sym[keep], seq[keep]
        kept[seq] = 1  # a last single symbol
        return kept

    def learn(self, words: set[str]) -> None:
        """Count the words of a group that are not remembered yet."""
        if len(self.counts) > REMEMBERED:
            self.counts.clear()
        new = [w for w in words if w not in self.counts]
        for i in range(0, len(new), 100_000):
            part = new[i : i + 100_000]
            self.counts.update(zip(part, self.merged_lengths([w.encode("utf-8", "replace") for w in part]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        cut, specials = [], []
        for t in texts:
            parts = self.special.split(t) if self.specials and any(s in t for s in self.specials) else [t]
            specials.append(len(parts) - 1)
            cut.append([w for p in parts for w in self.pre_tokens(p)])
        self.learn({w for c in cut for w in c})
        of = self.counts.__getitem__
        return [sum(map(of, c)) + s for c, s in zip(cut, specials, strict=True)]


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte.

    Visible Latin-1 characters stand for themselves, the rest follow from U+0100 up.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def settled_pattern() -> re.Pattern:
    """The pre-token pattern for texts below FIRST_UNSETTLED: contractions, then runs of letters, numbers or other signs with one space before them, then white space."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(ord(FIRST_UNSETTLED)) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{kinds['L']}]+| ?[{kinds['N']}]+| ?[^\s{kinds['L']}{kinds['N']}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A map over partitions: no shuffle, and memory bounded by GROUP_CHARS and one text.
    The vocabulary file must be readable on the executors at `tokenizer`.
    """
    path = tokenizer or default_tokenizer()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = merge_table(path)
        for batch in batches:
            texts, n = batch.column(1), 0
            while n < batch.num_rows:
                group, chars, began = [], 0, n
                while n < batch.num_rows and (chars < GROUP_CHARS or not group):
                    group.append(texts[n].as_py())
                    chars += len(group[-1])
                    n += 1
                counts = np.array(table.count(group), np.int64)
                sizes = np.array([len(t.encode()) for t in group], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(began, n - began), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    return narrow.mapInArrow(count, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
