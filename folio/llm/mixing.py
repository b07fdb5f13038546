"""Mixing sources to target weights by entropy balancing.

Each source has a number of words to give.  A document's rate is tilted exponentially by
its size, r = 2 e^(lx) / (1 + e^(lx)) with x its size over its source's mean, so rates lie
between 0 and 2 and deviate as little as they can (in relative entropy) from 1; l is its
source's multiplier.  The convex dual of "rates times sizes give the target" is solved by
Newton iterations inside a bracket, all sources at once; a round is one aggregation over a
histogram of (source, size, documents), which holds everything that the dual depends on.

Rates become copies by systematic rounding down the sizes: the running sum of rates is
rounded, so the words taken stay within about one large document of the target, and last
single documents are given or lose a copy where that brings a source nearer.

Edge cases: a null text has size 0; a null source is a source of its own, last in order;
sources without words have target 0; repeated rows are documents of their own; ties go by
a hash of the id; an empty table gives an empty table; a text of any length is counted
whole; other columns are not read, and mixed_documents() keeps those of any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import SPACES, if_small, materialise, set_aside, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
#: Steps of the dual at most; the brackets of the slowest source halve in each, from 2e6 to under the last bit of a double.
ROUNDS = 120
TOLERANCE = 1e-9
#: Documents of one source and size are ranked in blocks of about so many.
BLOCK = 50_000
#: Rounds of giving or taking single copies at the end.
REPAIRS = 3


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")).cast("long")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, n_docs, source_size, rank): ranks from 0 by code point, null last.

    Ranks come from a range partitioning and the partitions' row counts.
    """
    sums = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    placed = materialise(sums.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "sources")
    part, row = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, offsets = 0, []
    for p, n in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row per partition
        offsets += [F.lit(p), F.lit(before)]
        before += n
    base = F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0)
    return materialise(placed.select("source", "n_docs", "source_size", (base + row).alias("rank")), "ranked")


def with_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Add `target`: `share` of all words dealt by weight, none above ceiling * source_size.

    The level t at which min(ceiling * size, t * weight) sums to the whole is found by
    Newton steps; each is the resharing of what the capped sources leave.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = sources.withColumns({"weight": weight, "most": F.col("source_size") * float(ceiling)})
    whole = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = (F.col("most") < level * F.col("weight")) if capped >= 0 else F.lit(False)
        n, held, left = s.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == capped or not left:
            break
        level, capped = (whole - (held or 0.0)) / left, n
    return s.withColumn("target", F.least("most", F.lit(level) * F.col("weight"))).drop("weight", "most")


def solved_rates(hist: DataFrame, sources: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """(rank, lam): the multiplier of each source that can be balanced; null where all is taken or nothing there."""
    c = float(ceiling)
    state = sources.select("rank", "target", "source_size", (F.col("source_size") / F.greatest("n_docs", F.lit(1))).alias("mean"))
    open_ = (F.col("source_size") > 0) & (F.col("target") < c * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    state = state.withColumns({"lam": F.when(open_, F.lit(0.0)), "lo": F.lit(-1e6), "hi": F.lit(1e6), "done": ~open_})
    state = materialise(state, "dual")
    few = state.count() <= 100_000
    for _ in range(ROUNDS):
        if state.where("NOT done").isEmpty():
            break
        going = state.where("NOT done").select("rank", "lam", "mean")
        x = F.col("size") / F.col("mean")
        sig = 1 / (1 + F.exp(-F.col("lam") * x))
        sums = hist.join(F.broadcast(going) if few else going, "rank").groupBy("rank").agg(F.sum(F.col("n") * F.col("size") * c * sig).alias("f"), F.sum(F.col("n") * F.col("size") * x * c * sig * (1 - sig)).alias("g"))
        joined = state.join(sums, "rank", "left")
        low, high = F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("f") - F.col("target")) / F.greatest("g", F.lit(1e-300))
        inside = (newton > low) & (newton < high) & (F.abs(newton - F.col("lam")) < 8 + F.abs("lam"))
        # a step that leaves the bracket or the known region is replaced by a doubling towards the root
        other = F.when(F.col("f") > F.col("target"), F.greatest((low + F.col("lam")) / 2, F.col("lam") * 2 - 1 - F.abs("lam"))).otherwise(F.least((high + F.col("lam")) / 2, F.col("lam") * 2 + 1 + F.abs("lam")))
        near = F.abs(F.col("f") - F.col("target")) <= TOLERANCE * F.col("target")
        step = F.when(F.col("done") | near, F.col("lam")).otherwise(F.when(inside, newton).otherwise(other))
        moved = joined.select("rank", "target", "source_size", "mean", step.alias("lam"), F.when(F.col("done"), F.col("lo")).otherwise(low).alias("lo"), F.when(F.col("done"), F.col("hi")).otherwise(high).alias("hi"), (F.col("done") | near).alias("done"))
        state = materialise(moved, "dual")
    else:
        if left := state.where("NOT done").count():
            raise ArithmeticError(f"{left} sources were not balanced in {ROUNDS} rounds")
    return state.select("rank", "lam", "mean")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tag: Column | None = None) -> DataFrame:
    """One row per row of `docs`: id, tag, size, source_size, target, copies, taken.

    `tag` is any further column to carry along, such as a hash of the text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), (tag if tag is not None else F.lit(None).cast("long")).alias("tag"), text_or_empty(text_col).alias("text"))
    rows = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "tag", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = materialise(with_targets(ranked_sources(rows), weights, share, ceiling), "targets")
    ranked = materialise(rows.join(if_small(sources), rows.source.eqNullSafe(sources.source)).select("row", "id", "tag", "size", "rank", "source_size", "target"), "ranked-rows")
    hist = materialise(ranked.groupBy("rank", "size").agg(F.count("*").alias("n"), F.first("source_size").alias("source_size"), F.first("target").alias("target")), "histogram")
    rates = solved_rates(hist, sources, ceiling)
    taken_whole = F.when(F.col("target") > 0, F.lit(float(ceiling))).otherwise(F.lit(0.0))
    rate = F.when(F.col("size") == 0, F.lit(0.0)).otherwise(F.coalesce(ceiling / (1 + F.exp(-F.col("lam") * F.col("size") / F.col("mean"))), taken_whole))
    down = Window.partitionBy("rank").orderBy(F.col("size").desc())  # over distinct sizes, not documents
    total = F.sum(F.col("n") * F.col("rate")).over(down)
    quota = hist.join(if_small(rates), "rank").withColumn("rate", rate).withColumn("upto", total)
    before = F.coalesce(F.lag("upto").over(down), F.lit(0.0))
    quota = quota.withColumn("m", F.least(F.floor(F.col("upto") + 0.5) - F.floor(before + 0.5), ceiling * F.col("n")))
    quota = materialise(quota.select("rank", "size", "n", F.floor(F.col("m") / F.col("n")).alias("base"), (F.col("m") % F.col("n")).alias("extra")), "quota")
    given = ranked.join(if_small(quota), ["rank", "size"])
    # the `extra` documents of least hash within a source and size get one copy more; only these cells are ranked
    settled = given.where("extra = 0").withColumn("copies", F.col("base"))
    block = F.pmod(F.coalesce(F.when(F.col("id").isNotNull(), F.xxhash64("id")), F.xxhash64("row")), F.ceil(F.col("n") / BLOCK))
    given = given.where("extra > 0").withColumn("block", block)
    blocks = given.groupBy("rank", "size", "block").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("rank", "size").orderBy("block")) - F.col("k")
    many = materialise(blocks.withColumn("skip", upto).where("skip > 0").select("rank", "size", "block", "skip"), "blocks")
    at = F.row_number().over(Window.partitionBy("rank", "size", "block").orderBy(F.xxhash64("id", "tag"), "id", "row")) + F.coalesce("skip", F.lit(0))
    copied = given.join(if_small(many), ["rank", "size", "block"], "left").withColumn("copies", F.col("base") + F.when(at <= F.col("extra"), 1).otherwise(0))
    copied = copied.select(*settled.columns).unionByName(settled)
    out = materialise(copied.select("row", "id", "tag", "size", "rank", "source_size", "target", "copies"), "copies")
    for _ in range(REPAIRS):
        gaps = out.groupBy("rank").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"), F.first("target").alias("aim"))
        gaps = materialise(gaps.where(F.abs("gap") > F.greatest(F.lit(1.0), 0.0005 * F.col("aim"))).select("rank", "gap"), "gaps")
        if gaps.isEmpty():
            break
        useful = F.when(F.col("gap") > 0, F.col("copies") < ceiling).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.col("size") < 2 * F.abs("gap"))
        pick = out.join(if_small(gaps), "rank").where(useful).groupBy("rank").agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("off"), F.xxhash64("id"), F.col("id"), F.col("row").alias("row"), F.signum("gap").cast("long").alias("step"))).alias("p"))
        pick = materialise(pick.select(F.col("p.row").alias("row"), F.col("p.step").alias("step")), "repair")
        if pick.isEmpty():
            break
        out = materialise(out.join(if_small(pick), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0))).drop("step"), "copies")
    return out.select(F.col("id").alias(id_col), "tag", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs` with every row as often as the mix takes it; documents it does not take are gone."""
    tag = F.xxhash64(text_or_empty(text_col), F.col(source_col))
    copies = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, tag=tag, **options)
    copies = materialise(copies.groupBy(F.col(id_col).alias("__id"), F.col("tag").alias("__tag")).agg(F.sum("copies").cast("int").alias("__copies")).where("__copies > 0"), "taken")
    if docs.isEmpty():
        return docs
    rows, names = set_aside(docs)
    ident = names[id_col]
    rows = rows.withColumn("tagged", F.xxhash64(text_or_empty(names[text_col]), F.col(names[source_col])))
    # repeated rows share their copies: one of them stands for all
    repeated = materialise(rows.groupBy(F.col(ident).alias("r"), F.col("tagged").alias("rt")).agg(F.count("*").alias("times")).where("times > 1"), "repeats")
    if not repeated.isEmpty():
        rows = rows.dropDuplicates([ident, "tagged"])
    joined = rows.join(if_small(copies), F.col(ident).eqNullSafe(F.col("__id")) & (F.col("tagged") == F.col("__tag")))
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(names[c]).alias(c) for c in docs.columns])
