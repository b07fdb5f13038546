"""Tables of contents: resolving entries to blocks, the foldable tree, the entry being read.

Entries are rows (doc, ti, t, lv, b) in reading order.  The tree logic is a fold over one
document's list of entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import clean_title, pct
from folio.operators.position import as_of, prefix


def first_labels(entries: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One entry per (path, frag): the first."""
    w = Window.partitionBy(id_col, "path", "frag").orderBy("ti")
    return entries.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolve_toc(entries: DataFrame, files: DataFrame, fragments: DataFrame, totals: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entries (id, ti, path, frag, label, lv) to (id, ti, t, lv, b).

    files: (id, path, base) of what is read, fragments: (id, path, frag, b), totals: (id, n_blocks).
    Entries of other files go; an unknown fragment means the file's start; levels start at 0.
    """
    j = entries.join(files.select(id_col, "path", "base"), [id_col, "path"]).join(fragments.select(id_col, "path", "frag", F.col("b").alias("frag_b")), [id_col, "path", "frag"], "left").join(totals.select(id_col, "n_blocks"), id_col)
    b = F.least(F.when(F.col("frag") != "", F.coalesce("frag_b", "base")).otherwise(F.col("base")), F.col("n_blocks") - 1)
    rows = j.select(id_col, "ti", clean_title(F.col("label")).alias("t"), "lv", b.cast("int").alias("b")).where("b >= 0")
    doc = Window.partitionBy(id_col)
    return rows.select(id_col, (F.row_number().over(doc.orderBy("ti")) - 1).alias("ti"), "t", (F.col("lv") - F.min("lv").over(doc)).alias("lv"), "b")


def with_fold(toc: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add `fold`, the level from which entries are folded (null: never), and `has_kids`, whether there is something to unfold."""
    doc = Window.partitionBy(id_col)
    deepest = F.max("lv").over(doc)
    rows = toc.withColumn("fold", F.when(deepest > 0, F.least(deepest, F.lit(2))))
    after = F.lead("lv").over(doc.orderBy("ti"))
    return rows.withColumn("has_kids", F.coalesce((after > F.col("lv")) & (after >= F.col("fold")), F.lit(False)))


def tree(toc: DataFrame, blocks: DataFrame, units: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The listing: fold, has_kids, level class (4 at most), the unit and the share of the text of each entry."""
    p = prefix(blocks, id_col).select(id_col, "b", "before", "total")
    rows = with_fold(toc, id_col).join(p, [id_col, "b"], "left")
    found = as_of(rows, units.select(id_col, F.col("start").alias("b"), "ci"), id_col, "b", ["ci"])
    share = F.coalesce(F.col("before"), F.lit(0)) / F.greatest(F.coalesce(F.col("total"), F.lit(1)), F.lit(1))
    return found.select(id_col, "ti", "t", "lv", F.least("lv", F.lit(4)).alias("level"), "b", F.coalesce("ci", F.lit(0)).alias("ci"), "has_kids", pct(share).alias("pct"))


def _listed(toc: DataFrame, id_col: str) -> DataFrame:
    rows = with_fold(toc, id_col)
    return rows.groupBy(id_col).agg(F.first("fold").alias("fold"), F.array_sort(F.collect_list(F.struct("ti", "lv", "b", "t"))).alias("es"))


def visible(toc: DataFrame, opened: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ti, shown): an entry shows if every ancestor from the level above the fold on is opened (id, ti)."""
    lists = _listed(toc, id_col).join(opened.groupBy(id_col).agg(F.collect_set("ti").alias("open")), id_col, "left")
    fold, open_ = F.col("fold"), F.coalesce("open", F.array().cast("array<int>"))
    state = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        cut = F.slice(s["stack"], 1, e["lv"])
        padded = F.concat(cut, F.array_repeat(F.lit(-1), F.greatest(e["lv"] - F.size(cut), F.lit(0))))
        since = F.greatest(F.coalesce(fold, e["lv"] + 1) - 1, F.lit(0))
        asked = F.slice(padded, since + 1, F.greatest(e["lv"] - since, F.lit(0)))
        return F.struct(F.array_append(padded, e["ti"]).alias("stack"), F.array_append(s["out"], F.forall(asked, lambda a: (a >= 0) & F.array_contains(open_, a))).alias("out"))

    shown = F.aggregate("es", state, step, lambda s: s["out"])
    return lists.select(id_col, F.posexplode(shown).alias("ti", "shown"))


def active_entry(toc: DataFrame, anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`anchors` (id, b, ...) with `here` (the last entry up to the first one beyond b), `label` and `expand`.

    label: the nearest entry above the fold, null before the first entry; expand: the
    entries to open so that `here` shows.
    """
    j = anchors.join(_listed(toc, id_col), id_col)
    b = F.coalesce("b", F.lit(0))
    run = F.aggregate("es", F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, e: F.struct((s["n"] + (s["go"] & (e["b"] <= b)).cast("int")).alias("n"), (s["go"] & (e["b"] <= b)).alias("go")), lambda s: s["n"])
    j = j.withColumn("here", F.greatest(run - 1, F.lit(0)))
    upto = F.slice("es", 1, F.col("here") + 1)
    above = F.filter(upto, lambda e: (e["ti"] == 0) | F.coalesce(e["lv"] < F.col("fold"), F.lit(True)))
    label = F.element_at(above, -1)
    walk = F.aggregate(
        F.reverse(upto),
        F.struct(F.array().cast("array<int>").alias("out"), F.get("es", F.col("here"))["lv"].alias("lv")),
        lambda s, e: F.when((s["lv"] >= F.col("fold")) & (e["lv"] < s["lv"]), F.struct(F.array_append(s["out"], e["ti"]).alias("out"), e["lv"].alias("lv"))).otherwise(s),
        lambda s: s["out"],
    )
    return j.select(*anchors.columns, "here", F.when(label["b"] <= b, label["t"]).alias("label"), F.coalesce(walk, F.array().cast("array<int>")).alias("expand"))
