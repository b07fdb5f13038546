"""Exact dedup by distributed most-significant-digit radix partitioning.

The normalised texts are written once as a table with one column per digit: digit k is
the k-th block of successive bytes, of width 64, 128, 256, ...  A round reads one digit
column for the rows still in question, splits every group by it, and settles the groups
that are singletons or whose texts have ended (a digit shorter than its width).  Texts
that end together after equal digits are equal byte for byte; no digest is compared.

A group is named by the smallest row number in it.  Groups are formed by partial
aggregation, so a group of copies of any size arrives at its reducer as one row a task.

Edge cases: null counts as the empty text and equals it; repeated rows belong to one
group, of which one row is kept; ties on length and id fall to the first row number; null
ids lose to any id; an empty table gives an empty table; very long texts only add digits,
the last of which may hold half of such a text; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.common import SPACES, if_small, materialise, text_or_empty

#: Bytes in the first digit; each further one is twice as wide.
FIRST_WIDTH = 64


def digit_columns(norm: Column, length: Column, first: int, digits: int) -> dict[str, Column]:
    """d0, d1, ...: null where the text ended before the digit began."""
    out, at, width = {}, 0, first
    for k in range(digits):
        out[f"d{k}"] = F.substring(norm, at + 1, width) if k == 0 else F.when(length >= at, F.substring(norm, at + 1, width))
        at, width = at + width, width * 2
    return out


def digits_needed(longest: int, first: int) -> int:
    """Digits until a text of `longest` bytes has ended."""
    k, at = 0, 0
    while at <= longest:
        at, k = at + (first << k), k + 1
    return k


def exact_groups(docs: DataFrame, first_width: int = FIRST_WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (row, id, n_points, text_sha256, group): group is equal exactly for equal normalised texts.

    `text_sha256` only describes a row; it takes no part in the grouping.
    """
    longest = docs.agg(F.max(F.octet_length(text_col))).first()[0] or 0
    digits = digits_needed(longest, first_width)
    norm = F.regexp_replace(text_or_empty(text_col), f"[{SPACES}]+", "")
    cut = (
        docs.select(F.col(id_col).alias("id"), F.length(text_or_empty(text_col)).alias("n_points"), norm.alias("norm"))
        .select(F.monotonically_increasing_id().alias("row"), "id", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.col("norm").cast("binary").alias("norm"))
        .select("row", "id", "n_points", "text_sha256", *[c.alias(k) for k, c in digit_columns(F.col("norm"), F.octet_length("norm"), first_width, digits).items()])
    )
    table = materialise(cut, "digits")
    state = table.select("row", F.lit(0).cast("long").alias("group"), F.col("d0").alias("digit"))
    settled, width = [], first_width
    for k in range(digits):
        parts = state.groupBy("group", "digit").agg(F.min("row").alias("part"), F.count("*").alias("n"))
        # a settled singleton stays where it is: only its own row names it
        many = materialise(parts.where("n > 1"), "parts")
        split = state.join(if_small(many, text="digit"), ["group", "digit"]).select("row", F.col("part").alias("group"), "n", (F.octet_length("digit") < width).alias("ended"))
        split = materialise(split, "split")
        settled.append(split.where("ended").select("row", "group"))
        open_rows = split.where("NOT ended").select("row", "group")
        if k + 1 == digits or open_rows.isEmpty():
            break
        width *= 2
        state = table.where(F.col(f"d{k + 1}").isNotNull()).select("row", F.col(f"d{k + 1}").alias("digit")).join(if_small(open_rows), "row")
    groups = settled[0]
    for more in settled[1:]:
        groups = groups.unionByName(more)
    return table.select("row", "id", "n_points", "text_sha256").join(if_small(materialise(groups, "groups")), "row", "left").withColumn("group", F.coalesce("group", "row"))


def exact_dedup(docs: DataFrame, first_width: int = FIRST_WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Of equal texts (white space aside) the row with the most code points in its own text
    stays, then the one with the smallest id.
    """
    rows = materialise(exact_groups(docs, first_width, id_col, text_col), "exact")
    best = rows.groupBy("group").agg(F.min(F.struct((-F.col("n_points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("id"), F.col("row").alias("row"))).alias("best"), F.count("*").alias("group_size"))
    shared = materialise(best.where("group_size > 1"), "best")
    joined = rows.join(if_small(shared), "group", "left")
    alone = F.col("best").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )
