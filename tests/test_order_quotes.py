"""Order statistics, page-wise layout of long documents, and quotes by n-grams against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folio.functions import chars as C
from folio.operators import layout as L
from folio.operators import order as O
from folio.operators import quotes as Q

LINE = "doc_id int, page int, i int, t string, x double, y double, h double"


def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [(k % 7, rng.choice([None, *range(9)]) if k % 7 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(5)
    groups = {g: sorted(v for k, v in rows if k == g and v is not None) for g in range(7)}
    got = {r.g: r.median for r in O.upper_medians(df, ["g"], "v").collect()}
    assert got == {g: v[len(v) // 2] for g, v in groups.items() if v}
    third = O.order_statistic(df, ["g"], "v", lambda n: F.floor(n * 0.9), "high")
    assert {r.g: r.high for r in third.collect()} == {g: v[int(len(v) * 0.9)] for g, v in groups.items() if v}
    few = O.order_statistic(df, ["g"], "v", lambda n: n + 5, "none")
    assert few.collect() == []


def plain_opened(lines):
    """[(page, i, heading, new, block)] of one document's lines, one after another."""
    median = lambda v, other: sorted(v)[len(v) // 2] if v else other
    h = median([x[6] for x in lines if x[6] > 0], L.DEFAULT_HEIGHT)
    out, block, before = [], -1, None
    for page in sorted({x[1] for x in lines}):
        own = sorted((x for x in lines if x[1] == page), key=lambda x: x[2])
        ups = [a[5] - b[5] for a, b in zip(own, own[1:], strict=False)]
        gap, left = median([u for u in ups if u > 0], h * L.DEFAULT_GAP), min(x[4] for x in own)
        for k, (_, _, i, t, x, _, height) in enumerate(own):
            heading = height > h * L.HEADING_RISE and len(t) <= C.MAX_HEADING
            free = before is None or before[1]
            ended = not free and re.search("[。！？!?：:；;」』）】\\]”\"]\\s*$", before[0]) is not None
            new = free or heading or (k > 0 and ups[k - 1] > gap * L.WIDE_GAP) or (x - left > h * L.INDENT and (ended or k == 0))
            block, before = block + new, (t, heading)
            out.append((page, i, heading, bool(new), block))
    return out


def test_blocks_of_random_pages(spark):
    rng = random.Random(2)
    docs = {}
    for d in range(12):
        docs[d] = [(d, p, i, rng.choice(["a line", "an end。", "end!", "x" * 50, "tail:"]), rng.choice([72.0, 72.0, 90.0]), 800.0 - 14 * i - rng.choice([0, 0, 0, 9]), rng.choice([12.0, 12.0, 12.0, 18.0, 0.0])) for p in rng.sample(range(9), 5) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame([x for v in docs.values() for x in v], LINE).repartition(4)
    got = {}
    for r in L.ended_blocks(df).collect():
        got.setdefault(r.doc_id, []).append((r.page, r.i, r.heading, r.new, r.block))
    assert {d: sorted(v) for d, v in got.items()} == {d: plain_opened(v) for d, v in docs.items()}
    starts = {r.doc_id: (r.starts, r.n_blocks) for r in L.page_starts(df).collect()}
    for d, v in docs.items():
        opened = plain_opened(v)
        last = max(x[0] for x in opened)
        assert starts[d] == ([sum(x[3] for x in opened if x[0] < p) for p in range(last + 1)], sum(x[3] for x in opened))


def test_one_document_of_100000_lines(spark):
    n = 100_000
    k = F.col("id")
    df = spark.range(n).select(F.lit(1).alias("doc_id"), (k / 40).cast("int").alias("page"), (k % 40).cast("int").alias("i"), F.concat(F.lit("line number "), k.cast("string"), F.when(k % 3 == 0, ".!").otherwise("")).alias("t"), F.when(k % 5 == 0, 90.0).otherwise(72.0).alias("x"), (800.0 - 14 * (k % 40)).cast("double").alias("y"), (12.0 + (k % 997) / 1000).alias("h"))
    began = time.perf_counter()
    blocks = L.lines_to_blocks(df).count()
    starts = L.page_starts(df).first()
    assert time.perf_counter() - began < 40  # two passes; one alone took over a minute for 16,000 lines when medians were lists
    assert starts.n_blocks == blocks and len(starts.starts) == n // 40 and starts.starts == sorted(starts.starts)


def plain_hits(quotes, blocks):
    """{(quote, document): (b, o)} by searching each block for each quote."""
    out = {}
    for n, text in quotes:
        q = "".join(c for c in text or "" if c not in C.WS_CHARS)[: Q.QUOTE_CHARS]
        if len(q) < Q.QUOTE_LEAST:
            continue
        for d, b, t in sorted(blocks, key=lambda x: (x[0], x[1])):
            at = [i for i, c in enumerate(t or "") if c not in C.WS_CHARS]
            found = "".join(t[i] for i in at).find(q) if t else -1
            if found >= 0:
                out.setdefault((n, d), (b, at[found - 1] + 1 if found else 0))
    return out


def corpus(rng, docs=30):
    words = ["the", "river", "and", "到", "這裡", "😀", "ab", "a", "x" * 30, "naïve", "　", " now"]
    return [(d, b, rng.choice(["", " ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for d in range(docs) for b in range(4)]


@pytest.mark.parametrize("sent", [Q.BROADCAST_QUOTES, 0])
def test_quotes_of_every_length(spark, monkeypatch, sent):
    monkeypatch.setattr(Q, "BROADCAST_QUOTES", sent)
    rng = random.Random(9)
    blocks = [*corpus(rng), (50, 0, None), (51, 0, ""), (52, 0, " \n"), (53, 0, "abab" * 40), (53, 1, "abab" * 40)]
    quotes = [(0, None), (1, "abc"), (2, "not there at all"), (3, "abababab" * 5), (4, "a b a b")]
    for n in range(5, 160):
        _, _, t = rng.choice(blocks[:120])
        at = rng.randint(0, max(0, len(t) - 3))
        quotes.append((n, t[at : at + rng.randint(3, 60)]))
    quotes += [(n + 500, t) for n, t in quotes[5:20]]  # the same quotes again
    df = spark.createDataFrame(blocks, "doc_id int, b int, t string").repartition(4)
    qs = spark.createDataFrame(quotes, "item_id int, text string").repartition(3)
    want = plain_hits(quotes, blocks)
    assert len({len("".join(t.split())) for n, t in quotes if t}) > 15 and len(want) > 150
    assert {(r.item_id, r.doc_id): (r.b, r.o) for r in Q.locate_quotes(qs, df).collect()} == want
    notes = qs.withColumn("doc_id", F.col("item_id") % 30).withColumnRenamed("text", "quote")
    own = {(r.item_id, r.doc_id): (r.hit_b, r.hit_o) for r in Q.quotes_in_own_document(notes, df).collect()}
    assert own == {(n, n % 30): want.get((n, n % 30), (None, None)) for n, _ in quotes}


@pytest.mark.parametrize("few", [1, 16])
def test_quotes_of_own_documents_need_no_index(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW_QUOTES", few)  # more quotes than that in documents 0 and 1, as two of them are there
    monkeypatch.setattr(Q, "BROADCAST_QUOTES", 0)
    blocks = [(d, b, t) for d in range(4) for b, t in enumerate(["  a b\n\nc d e", "", f"x  y\u3000z {d} \U0001f600 tail", "x y z 2 again"])]
    notes = [(0, 1, "abcd"), (0, 2, "xyz0"), (1, 3, "cde!"), (1, 4, "b cde"), (2, 5, "xyz2"), (3, 6, "\U0001f600 tail"), (3, None, None)]
    df, qs = spark.createDataFrame(blocks, "doc_id int, b int, t string"), spark.createDataFrame(notes, "doc_id int, n int, quote string")
    found = Q.quotes_in_own_document(qs, df)
    got = {r.n: (r.hit_b, r.hit_o) for r in found.collect()}
    assert got == {1: (0, 0), 2: (2, 0), 3: (None, None), 4: (0, 3), 5: (2, 0), 6: (2, 8), None: (None, None)}
    assert ("mapinarrow" in found._jdf.queryExecution().optimizedPlan().toString().lower()) == (few == 1)


def test_quotes_are_not_gathered_on_the_driver(spark):
    blocks = spark.createDataFrame(corpus(random.Random(3)), "doc_id int, b int, t string")
    quotes = spark.range(5000).select(F.col("id").alias("item_id"), F.concat(F.lit("quote number "), F.col("id").cast("string"), F.lit(" of many that no text has")).alias("text"))
    assert Q.locate_quotes(quotes, blocks).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert Q.locate_quotes(none, blocks).collect() == []
    assert Q.locate_quotes(quotes, blocks.limit(0)).collect() == []
