import random

import spec
from pyspark.sql import functions as F

from folio.operators import documents as D
from folio.operators import position as P
from folio.operators import quotes as Q
from folio.operators.speech import block_sentences

BOOK = "第一章 開始\n\n這是第一段。\n還是第一段。\n\n　　第二段很長" + "，字字字字" * 20 + "。\n\n第二章\n\n短\n\nChapter 3\n\nThe end of it all comes here, in a body that is long enough to stand alone."


def blocks(spark, texts):
    return D.txt_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def listed(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_blocks(spark):
    got = listed(blocks(spark, [BOOK, "a\n b \n\nc\nd", "x\ny", "", None, " \n \n"]), "doc_id", "b", "k", "t")
    assert [r[2] for r in got if r[0] == 0] == ["h", "p", "p", "h", "p", "h", "p"]
    assert [r[1:] for r in got if r[0] == 1] == [(0, "p", "a\n b"), (1, "p", "c\nd")]
    assert [r[1:] for r in got if r[0] == 2] == [(0, "p", "x"), (1, "p", "y")]
    assert [r[3] for r in got if r[0] in (3, 4, 5)] == [D.C.EMPTY_FILE] * 3


def made(rng):
    out = []
    for _ in range(rng.randrange(1, 40)):
        out.append(rng.choice([f"Chapter {rng.randrange(99)}", "序", "p " * rng.choice([1, 5, 30, 3000]), "longer paragraph of text. " * rng.randrange(1, 400)]).strip())
    return "\n".join(out)


def test_units(spark):
    rng = random.Random(8)
    texts = [made(rng) for _ in range(60)] + [BOOK, "", "Chapter 1\nChapter 2"]
    b = blocks(spark, texts).cache()
    by_doc = {}
    for doc, i, k, t in listed(b, "doc_id", "b", "k", "t"):
        by_doc.setdefault(doc, []).append((k, t))
    got = {}
    for doc, ci, title, start, end, chars in listed(D.document_units(b), "doc_id", "ci", "title", "start", "end", "chars"):
        got.setdefault(doc, []).append((title, start, end))
        assert ci == len(got[doc]) - 1 and chars == sum(len(t) for _, t in by_doc[doc][start:end])
    for doc, bs in by_doc.items():
        assert got[doc] == spec.units(bs), doc
        assert [u[1] for u in got[doc]][1:] == [u[2] for u in got[doc]][:-1]
        assert got[doc][0][1] == 0 and got[doc][-1][2] == len(bs)


def test_stats_and_prefix(spark):
    b = blocks(spark, [BOOK, "ab\ncde", None])
    assert listed(D.doc_stats(b).where("doc_id = 1"), "n_blocks", "total_chars", "body_chars", "n_headings") == [(2, 5, 5, 0)]
    assert listed(P.prefix(b).where("doc_id = 1"), "b", "len", "before", "total") == [(0, 2, 0, 5), (1, 3, 2, 5)]


def test_anchor_at_share(spark):
    b = blocks(spark, ["ab\ncde\nf"])
    shares = [0.0, 0.1, 0.34, 0.5, 0.9, 1.0, 2.0, -1.0, None]
    t = spark.createDataFrame([(0, i, s) for i, s in enumerate(shares)], "doc_id long, i int, share double")
    got = {r.i: (r.b, r.o) for r in P.anchor_at_share(t, b).collect()}
    assert [got[i] for i in range(9)] == [(0, 0), (0, 0), (1, 0), (1, 1), (2, 0), (2, 0), (2, 0), (0, 0), (0, 0)]


def test_chapter_of(spark):
    units = spark.createDataFrame([(1, 0, 2, 4), (1, 1, 4, 9)], "doc_id long, ci int, start int, `end` int")
    a = spark.createDataFrame([(1, b) for b in (0, 2, 3, 4, 8, 9)] + [(2, 3)], "doc_id long, b int")
    assert listed(P.chapter_of(a, units), "doc_id", "b", "ci") == [(1, 0, 0), (1, 2, 0), (1, 3, 0), (1, 4, 1), (1, 8, 1), (1, 9, 0), (2, 3, 0)]


def test_pages_and_blocks(spark):
    df = spark.createDataFrame([([0, 5, 9], b) for b in (-3, 0, 4, 5, 8, 9, 999, None)] + [([], 4), (None, 4)], "s array<int>, b int")
    assert [r.p for r in df.select(P.page_of_block(F.col("s"), F.col("b")).alias("p")).collect()] == [1, 1, 1, 2, 2, 3, 3, 1, 1, 1]
    df = spark.createDataFrame([([0, 5, 9], p) for p in (-1, 0, 1, 2, 3, 99, None)] + [([], 2), (None, 1)], "s array<int>, p int")
    assert [r.b for r in df.select(P.block_of_page(F.col("s"), F.col("p")).alias("b")).collect()] == [0, 0, 0, 5, 9, 9, 0, 0, 0]


def test_nearest_sentence(spark):
    spans = spark.createDataFrame([(1, 0, 0), (1, 0, 10), (1, 2, 0)], "doc_id long, b int, o int")
    a = spark.createDataFrame([(1, 0, 10), (1, 0, 12), (1, 1, 5), (1, 9, 9), (1, -1, 0), (2, 0, 0)], "doc_id long, b int, o int")
    got = {(r.doc_id, r.b, r.o): (r.span_b, r.span_o) for r in P.nearest_sentence(a, spans).collect()}
    assert got == {(1, 0, 10): (0, 10), (1, 0, 12): (0, 10), (1, 1, 5): (0, 10), (1, 9, 9): (2, 0), (1, -1, 0): (0, 0), (2, 0, 0): (None, None)}


def test_as_of_forward(spark):
    left, right = spark.createDataFrame([(1, 3), (1, 9)], "k int, t int"), spark.createDataFrame([(1, 3, "a"), (1, 5, "b")], "k int, t int, v string")
    assert listed(P.as_of(left, right, "k", "t", ["v"], forward=True).fillna("-"), "t", "v") == [(3, "a"), (9, "-")]


def test_quotes(spark):
    b = blocks(spark, ["one two\nfind  me here　please now\nfind me here please now", "nothing\nhere"])
    notes = spark.createDataFrame([(0, 1, "find me here  please now and more"), (0, 2, "abc"), (0, 3, None), (1, 4, "herex")], "doc_id long, n int, quote string")
    got = {r.n: (r.hit_b, r.hit_o) for r in Q.quotes_in_own_document(notes, b).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (None, None)}
    notes = spark.createDataFrame([(0, 1, "me  here please"), (0, 2, "two"), (0, 5, "onetwo")], "doc_id long, n int, quote string")
    got = {r.n: (r.hit_b, r.hit_o) for r in Q.quotes_in_own_document(notes, b).collect()}
    assert got == {1: (1, 4), 2: (None, None), 5: (0, 0)}
    items = spark.createDataFrame([(7, "me here please"), (8, "nothing"), (9, "x"), (10, "me here please")], "item_id long, text string")
    assert listed(Q.locate_quotes(items, b), "item_id", "doc_id", "b", "o") == [(7, 0, 1, 4), (8, 1, 0, 0), (10, 0, 1, 4)]


def test_remap(spark):
    old, new = blocks(spark, ["alpha beta gamma\ndelta epsilon zeta\nlast words here"]), blocks(spark, ["delta epsilon zeta\nalpha beta gamma\nlast words here"])
    notes = spark.createDataFrame([(0, 1, 0, "delta epsilon", "a"), (0, 2, 5, "gone quote", "b"), (0, 0, 0, "", "c")], "doc_id long, b int, o int, quote string, id string")
    got = {r.id: (r.b, r.o, r.moved) for r in P.remap_annotations(notes, old, new).collect()}
    assert got == {"a": (0, 0, True), "b": (2, 5, False), "c": (0, 0, False)}


def test_needs_upgrade(spark):
    books = spark.createDataFrame([("a", "txt"), ("b", "txt"), ("c", "epub"), ("d", "pdf"), ("e", "txt"), ("f", "pdf")], "id string, format string")
    docs = spark.createDataFrame([("a", 5, 3, None), ("b", 5, 2, None), ("c", 5, 2, None), ("d", 5, 2, 1), ("f", 5, 3, 2)], "id string, n_blocks int, parser_version int, page_version int")
    assert listed(D.needs_upgrade(books, docs, 3, 2), "id", "stale") == [("a", False), ("b", False), ("c", True), ("d", True), ("e", True), ("f", False)]


def test_block_sentences(spark):
    rows = block_sentences(blocks(spark, ["Ab cd. Ef gh.\n好人。壞人。"]))
    assert listed(rows, "b", "i", "t", "o") == [(0, 0, "Ab cd.", 0), (0, 1, " Ef gh.", 6), (1, 0, "好人。", 0), (1, 1, "壞人。", 3)]
