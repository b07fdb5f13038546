"""Positions in documents: anchors (b, o), shares of the text, chapters, pages, notes.

As-of lookups are one shuffle on the document: both sides are laid in order and the last
(or first) entry is carried along by a window, so no interval join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.rows import stacked
from folio.operators.quotes import quotes_in_own_document


def prefix(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, b, len, before, total): characters before each block and in the document."""
    n = F.char_length("t").cast("long")
    doc = Window.partitionBy(id_col)
    before = F.coalesce(F.sum("len").over(doc.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.select(id_col, "b", n.alias("len")).select(id_col, "b", "len", before.cast("long").alias("before"), F.sum("len").over(doc).alias("total"))


def share_of(before: Column, o: Column, total: Column) -> Column:
    """What share of the text lies before an anchor; 0 for an empty text."""
    return F.when(F.coalesce(total, F.lit(0)) == 0, F.lit(0.0)).otherwise((F.coalesce(before, F.lit(0)) + F.coalesce(o, F.lit(0))) / total)


def as_of(left: DataFrame, right: DataFrame, on: str, at: str, values: list[str], forward: bool = False) -> DataFrame:
    """`left` with the `values` of the last row of `right` (by `at`) not after it, within `on`; null if none.

    forward: the first row not before it.  Of rows of `right` at one place the last given
    by their values counts.
    """
    kept = right.groupBy(on, at).agg(F.max(F.struct(*values)).alias("__v"))
    rows = left.select(on, at, F.struct(*left.columns).alias("__l"), F.lit(None).cast(kept.schema["__v"].dataType).alias("__v"), F.lit(1).alias("__s"))
    rows = rows.transform(stacked, kept.select(on, at, F.lit(None).cast(rows.schema["__l"].dataType).alias("__l"), "__v", F.lit(0).alias("__s")))
    w = Window.partitionBy(on)
    w = w.orderBy(F.col(at).desc_nulls_last(), "__s") if forward else w.orderBy(F.col(at).asc_nulls_first(), "__s")
    found = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__f", found).where("__s = 1").select("__l.*", *[F.col(f"__f.{v}").alias(v) for v in values])


def chapter_of(anchors: DataFrame, units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`anchors` (id, b, ...) with `ci`, the unit that holds block b, else 0."""
    found = as_of(anchors, units.select(id_col, F.col("start").alias("b"), "ci", "end"), id_col, "b", ["ci", "end"])
    return found.withColumn("ci", F.when(F.col("b") < F.col("end"), F.col("ci")).otherwise(0)).drop("end")


def anchor_at_share(targets: DataFrame, blocks: DataFrame, id_col: str = "doc_id", share: str = "share") -> DataFrame:
    """`targets` (id, share, ...) with the anchor (b, o) there: the first block that ends beyond it, else the last block."""
    p = prefix(blocks, id_col)
    docs = p.groupBy(id_col).agg(F.max("total").alias("__total"), F.max("b").alias("__last"))
    aimed = targets.join(docs, id_col, "left").withColumn("__x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(share), F.lit(0.0)))) * F.coalesce("__total", F.lit(0)))
    # the first block with before + len > x is the last non-empty one with before <= x
    found = as_of(aimed, p.where("len > 0").select(id_col, F.col("before").cast("double").alias("__x"), "b", "len"), id_col, "__x", ["b", "len"])
    inside = F.col("b").isNotNull() & (F.col("__x") < F.col("__total"))
    start = found.join(p.select(id_col, "b", "before"), [id_col, "b"], "left")
    o = F.when(inside, F.greatest(F.lit(0), F.floor(F.col("__x") - F.col("before")))).otherwise(0).cast("int")
    return start.select(*targets.columns, F.when(inside, F.col("b")).otherwise(F.greatest(F.lit(0), F.coalesce("__last", F.lit(0)))).alias("b"), o.alias("o"))


def nearest_sentence(anchors: DataFrame, spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`anchors` (id, b, o, ...) with the span (span_b, span_o) to go to: the last one not after, else the first."""
    key = F.struct("b", "o")
    found = as_of(anchors.withColumn("__at", key), spans.select(id_col, key.alias("__at"), F.col("b").alias("span_b"), F.col("o").alias("span_o")), id_col, "__at", ["span_b", "span_o"])
    first = spans.groupBy(id_col).agg(F.min(key).alias("__first"))
    j = found.join(first, id_col, "left")
    return j.select(*anchors.columns, F.coalesce("span_b", "__first.b").alias("span_b"), F.coalesce("span_o", "__first.o").alias("span_o"))


def page_of_block(page_starts: Column, b: Column) -> Column:
    """1-based page of a block by an array of first blocks: counts up to the first start beyond it; 1 at least."""
    b = F.coalesce(b, F.lit(0))
    upto = F.aggregate(page_starts, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, p: F.struct((s["n"] + (s["go"] & (p <= b)).cast("int")).alias("n"), (s["go"] & (p <= b)).alias("go")), lambda s: s["n"])
    return F.when(F.coalesce(F.size(page_starts), F.lit(0)) <= 0, 1).otherwise(F.greatest(F.lit(1), upto))


def block_of_page(page_starts: Column, page: Column) -> Column:
    """First block of a 1-based page, clamped into range; 0 without pages."""
    n = F.size(page_starts)
    at = F.greatest(F.lit(1), F.least(n, F.coalesce(F.nullif(page, F.lit(0)), F.lit(1))))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0).otherwise(F.coalesce(F.get(page_starts, at - 1), F.lit(0)))


def remap_annotations(annots: DataFrame, old_blocks: DataFrame, new_blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`annots` (id, b, o, quote, ...) moved to re-parsed documents, with `moved`.

    By the quote where it is found, else by the share of the text that lay before the note.
    """
    old = prefix(old_blocks, id_col)
    bounds = old.groupBy(id_col).agg(F.max("b").alias("__max"), F.max("total").alias("__total"))
    a = annots.join(bounds, id_col, "left").withColumn("__b", F.greatest(F.lit(0), F.least("__max", F.col("b"))))
    a = a.join(old.select(id_col, F.col("b").alias("__b"), "before"), [id_col, "__b"], "left")
    a = a.withColumn("share", share_of(F.col("before"), F.col("o"), F.col("__total")))
    a = a.select(*[F.col(c).alias(f"old_{c}" if c in "bo" else c) for c in annots.columns], "share")
    placed = anchor_at_share(a, new_blocks, id_col)
    hit = quotes_in_own_document(placed, new_blocks, id_col)
    b, o = F.when(F.col("hit_b").isNotNull(), F.col("hit_b")).otherwise(F.col("b")), F.when(F.col("hit_b").isNotNull(), F.col("hit_o")).otherwise(F.col("o"))
    moved = ~(b.eqNullSafe(F.col("old_b")) & o.eqNullSafe(F.col("old_o")))
    return hit.select(*[b.alias("b") if c == "b" else o.alias("o") if c == "o" else F.col(c) for c in annots.columns], moved.alias("moved"))
