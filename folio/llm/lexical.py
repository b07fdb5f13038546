"""Ranked lexical search over a tiered index.

A text's terms are its lower-case words (ASCII letters and digits and all characters beyond
ASCII).  The index holds for each posting (term, document) its impact, the part of the
score that does not depend on the query; the weight of a term times its impact is what a
document gains by it.  The postings of a term are cut into tiers by impact: the first tier
holds about FIRST_TIER postings of highest impact, each further one GROWTH times as many.
The cut is read from a histogram of impacts, so that no term is ever sorted.  Each tier
leaves a residual bound for the term: its weight times the largest impact below that tier.

All items are searched in the first tier at once.  What a document has not shown there it
can still gain, at most the residual bounds of the terms it was not met with.  An item is
proven when the bounds of all its terms together stay under the score that its k-th
document already has: no unseen document can come in.  The documents seen whose upper bound
reaches that score are then looked up in the lower tiers, which makes their scores exact.
Items without that proof fall through to the next tier, and to the last one at worst, which
has no residuals.  Rare terms are whole in the first tier, frequent ones have little
weight, so that long tails of frequent terms are read for few items.

Postings are dealt by document, so that the scores of a document meet without another
exchange, and the best k of each task are found before any row leaves it.

Edge cases: null, empty and blank texts have no terms and are never found; items without
terms, or whose terms no document has, return no rows; a term repeated in an item counts as
often; equal scores go by id (null last), then by row; repeated rows are documents of their
own, and items of one id are searched as one row each; texts of any length are read whole;
an empty table of documents or items gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import BROADCAST_ROWS, bound_batches, if_small, materialise, text_or_empty
from folio.llm.decontam import NORMAL

#: Postings of a term in its first tier, and how many times as many the next tiers hold.
FIRST_TIER, GROWTH = 2048, 8
#: Impacts lie from 0 to 1,000,000; the histogram has a class for each so many.
IMPACT_CLASS = 4096
#: Pairs of an item and a document that one task scores.
PAIRS_A_TASK = 4_000_000
#: Bytes of the items' terms that are sent to every task.
WORD_BYTES = 16 << 20


def counted_terms(rows: DataFrame, only: set[bytes] | None = None) -> DataFrame:
    """row, id, term, tf, n of rows (row, id, raw): one line a term, and one with a null term for each row.

    `only` keeps other terms out of the lines; n counts all terms of the text.
    """
    kind = rows.schema["id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, terms, tfs, ns = [], [], [], []
            for k, raw in enumerate(batch["raw"].to_pylist()):
                words = raw.translate(NORMAL).split()
                found = Counter(words)
                held = found.keys() if sent.value is None else found.keys() & sent.value
                source += [k] * (len(held) + 1)
                terms += [None, *held]
                tfs += [0, *[found[t] for t in held]]
                ns += [len(words)] * (len(held) + 1)
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([batch["row"].take(at), batch["id"].take(at), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64()), pa.array(ns, pa.int64())], ["row", "id", "term", "tf", "n"])

    return rows.mapInArrow(read, f"row bigint, id {kind}, term string, tf bigint, n bigint")


def numbered(table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return table.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("raw"))


class Index:
    """Working tables of an index.

    `postings` (tier, term_no, row, id, impact), `terms` (term, term_no, weight, last: its
    last tier, bounds: the largest impact below tier 1, 2, ..., held: the postings up to tier
    1, 2, ...).  `tiers` counts the tiers, `size` the documents with a term, `length` all
    their terms.  With `only`, other terms are left out of the tables, not of the counts.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", only: set[bytes] | None = None, first_tier: int = FIRST_TIER, growth: int = GROWTH):
        bound_batches(docs.sparkSession)
        found = materialise(counted_terms(numbered(docs, id_col, text_col), only), "terms")
        self.size, self.length = found.where("term IS NULL AND n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # integer division throughout, as scores are exact
        m = F.expr(f"100 - 75 + (75 * n * {self.size}L) div {max(self.length, 1)}L")
        hits = found.where("term IS NOT NULL").select("term", "row", "id", "tf", m.alias("m")).withColumn("impact", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)"))
        step = F.expr(f"impact div {IMPACT_CLASS}")
        classes = materialise(hits.groupBy("term", step.alias("step")).agg(F.count("*").alias("n"), F.max("impact").alias("top")), "classes")
        # a term has at most 1,000,000 / IMPACT_CLASS classes
        down = Window.partitionBy("term").orderBy(F.desc("step"))
        above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edges = [first_tier * growth**k for k in range(40) if first_tier * growth**k < 1 << 62]
        tier = F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge <= F.col("above"))) + 1
        each = classes.withColumn("above", above).withColumn("tier", tier).groupBy("term", "tier").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.min("step").alias("least"))
        terms = each.groupBy("term").agg(F.sum("n").alias("df"), F.max("tier").alias("last"), F.collect_list(F.struct("tier", "n", "top", "least")).alias("tiers"))
        weight = F.floor(1000 * F.log((2 * F.lit(self.size).cast("double") + 2) / (2 * F.col("df") + 1)))
        upto = lambda t: F.filter("tiers", lambda x: x["tier"] <= t)
        below = F.transform(F.sequence(F.lit(1), "last"), lambda t: F.coalesce(F.array_max(F.transform(F.filter("tiers", lambda x: x["tier"] > t), lambda x: x["top"])), F.lit(0)))
        held = F.transform(F.sequence(F.lit(1), "last"), lambda t: F.aggregate(upto(t), F.lit(0).cast("long"), lambda n, x: n + x["n"]))
        self.terms = materialise(terms.select("term", F.monotonically_increasing_id().alias("term_no"), weight.alias("weight"), "last", below.alias("bounds"), held.alias("held"), "tiers"), "weights")
        self.tiers = self.terms.agg(F.max("last")).first()[0] or 0
        placed = hits.join(if_small(self.terms.select("term", "term_no", "tiers")), "term")
        own = F.array_min(F.transform(F.filter("tiers", lambda x: step >= x["least"]), lambda x: x["tier"]))
        self.postings = materialise(placed.select(own.alias("tier"), "term_no", "row", "id", "impact"), "postings", "tier")


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term, times) of every item, numbered: a working table."""
    bound_batches(items.sparkSession)
    found = counted_terms(numbered(items, id_col, text_col)).where("term IS NOT NULL")
    return materialise(found.select(F.col("row").alias("item"), F.col("id").alias("item_id"), "term", F.col("tf").alias("times")), "items")


def best(scores: DataFrame, k: int) -> DataFrame:
    """The first k rows of each item by score, id and row, with their rank."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scored(index: Index, wanted: DataFrame, tier: int) -> DataFrame:
    """(item, row, id, score, open) over the tiers up to `tier`; `open` is what the document can still gain."""
    held = F.coalesce(F.try_element_at("held", F.lit(tier)), F.element_at("held", -1))
    pairs = wanted.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    spread = max(index.postings.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_TASK))
    own = if_small(wanted.select("item", "term_no", "factor", (F.col("factor") * bound_at(tier)).alias("rest")))
    totals = if_small(materialise(own.groupBy("item").agg(F.sum("rest").alias("least")), "least"))
    hits = index.postings.where(F.col("tier") <= tier).join(if_small(materialise(wanted.select("term_no").distinct(), "pending")), "term_no", "left_semi")
    met = hits.repartition(spread, "row").join(own, "term_no").groupBy("item", "row")
    met = met.agg(F.min("id").alias("id"), F.sum(F.col("factor") * F.col("impact")).alias("score"), F.sum("rest").alias("shown"))
    return met.join(totals, "item").select("item", "row", "id", "score", (F.col("least") - F.col("shown")).alias("open"))


def bound_at(tier: int):
    """The largest impact of a term below `tier`."""
    return F.coalesce(F.try_element_at("bounds", F.lit(tier)), F.lit(0))


def looked_up(index: Index, wanted: DataFrame, candidates: DataFrame, tier: int) -> DataFrame:
    """`candidates` (item, row, id, score) with what they gain below `tier` added."""
    rows = if_small(materialise(candidates.select("row").distinct(), "rows"))
    lower = index.postings.where(F.col("tier") > tier).join(rows, "row", "left_semi")
    gains = lower.join(if_small(wanted.select("item", "term_no", "factor")), "term_no").select("item", "row", "id", (F.col("factor") * F.col("impact")).alias("score"))
    gains = gains.join(if_small(candidates.select("item", "row")), ["item", "row"], "left_semi")
    both = candidates.select("item", "row", "id", "score").unionByName(gains)
    return both.groupBy("item", "row").agg(F.min("id").alias("id"), F.sum("score").alias("score"))


def search(index: Index, items: DataFrame, k: int = 10) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """(item, rank, id, score) of the best k documents of each item of item_terms(), and for each tier
    how many items were searched in it, proven by bounds, and settled because all they ask for was read."""
    wanted = items.join(if_small(index.terms), "term").select("item", "term_no", (F.col("times") * F.col("weight")).alias("factor"), "bounds", "held")
    wanted = materialise(wanted.where("factor > 0"), "wanted")
    found, story = None, []
    for tier in range(1, index.tiers + 1):
        top = materialise(best(scored(index, wanted, tier), k).select("item", "row", "id", "score", "rank"), "top")
        state = wanted.groupBy("item").agg(F.sum(F.col("factor") * bound_at(tier)).alias("least"))
        reached = top.where(F.col("rank") == k).select("item", F.col("score").alias("reached"))
        state = materialise(state.join(reached, "item", "left"), "state")
        whole = state.where("least = 0")
        proven = state.where("least > 0 AND least < reached")
        done = top.join(if_small(whole.select("item")), "item", "left_semi")
        n_whole, n_proven, n_all = whole.count(), proven.count(), state.count()
        story.append((n_all, n_proven, n_whole))
        if n_proven:
            own = materialise(wanted.join(if_small(proven.select("item")), "item", "left_semi"), "proven")
            reach = scored(index, own, tier).join(if_small(proven.select("item", "reached")), "item").where("score + open >= reached")
            done = done.unionByName(best(looked_up(index, own, materialise(reach.drop("open", "reached"), "candidates"), tier), k))
        done = materialise(done.select("item", "rank", "id", "score"), "found")
        found = done if found is None else found.unionByName(done)
        if n_whole + n_proven == n_all:
            break
        rest = state.where("least > 0 AND (reached IS NULL OR least >= reached)").select("item")
        wanted = materialise(wanted.join(if_small(rest), "item", "left_semi"), "wanted")
    return found, story


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", first_tier: int = FIRST_TIER, growth: int = GROWTH) -> DataFrame:
    """item_id, rank, doc_id, score: the best k documents of each item.

    The index is made for the terms of the items, if these are few enough to be sent to
    every task, and else for all terms.
    """
    terms = item_terms(items, item_col, item_text)
    words = materialise(terms.select("term").distinct(), "words")
    few = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    only = {bytes(r.term) for r in words.select(F.col("term").cast("binary").alias("term")).collect()} if few[0] <= BROADCAST_ROWS and few[1] <= WORD_BYTES else None
    index = Index(docs, id_col, text_col, only, first_tier, growth)
    found, _ = search(index, terms, k)
    ids = terms.select("item", F.col("item_id").alias(item_col)).distinct()
    if found is None:
        return ids.select(item_col, F.lit(0).alias("rank"), F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), F.lit(0).cast("long").alias("score")).where("false")
    return found.join(ids, "item").select(item_col, "rank", F.col("id").alias(id_col), "score")
