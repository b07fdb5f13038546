from pyspark.sql import functions as F

from folio.operators import layout as L
from folio.operators import speech as S
from folio.operators import toc as O

LINE = "doc_id int, page int, i int, t string, x double, y double, h double"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_items_to_lines(spark):
    tr = lambda x, y, h=10.0: [1.0, 0.0, 0.0, h, x, y]
    items = [(1, 0, 0, "Hello ", tr(10.0, 700.0), 0.0, False), (1, 0, 1, "world", tr(5.0, 701.0, 12.0), 0.0, True), (1, 0, 2, " next ", tr(10.0, 680.0, 0.0), 9.0, False), (1, 0, 3, None, None, 0.0, False), (1, 0, 4, "far", tr(10.0, 600.0), 0.0, False), (1, 0, 5, "   ", tr(10.0, 500.0), 0.0, True), (1, 1, 0, "⼀", None, 0.0, None)]
    got = L.items_to_lines(spark.createDataFrame(items, "doc_id int, page int, seq int, str string, transform array<double>, height double, has_eol boolean"))
    assert rows(got, "page", "i", "t", "x", "y", "h") == [(0, 0, "Hello world", 5.0, 700.0, 12.0), (0, 1, "next", 10.0, 680.0, 9.0), (0, 2, "far", 10.0, 600.0, 10.0), (1, 0, "一", 0.0, 0.0, 1.0)]


def lines(spark, pages, h=12.0):
    return spark.createDataFrame([(1, p, i, t, 72.0, 700.0 - 14 * i, h) for p, ls in enumerate(pages) for i, t in enumerate(ls)], LINE)


def test_running_heads(spark):
    pages = [["My Book 1", "a", "b", "- 1 -"], ["My Book 2", "f", "foot"], ["My Book 3", "g", "foot"], ["e", "iv"]]
    assert rows(L.strip_running_heads(lines(spark, pages)), "page", "t") == [(0, "a"), (0, "b"), (1, "f"), (1, "foot"), (2, "foot"), (2, "g"), (3, "e")]
    two = [["Head", "a", "12"], ["Head", "第 3 頁"]]
    assert rows(L.strip_running_heads(lines(spark, two)), "page", "t") == [(0, "Head"), (0, "a"), (1, "Head")]
    alone = [["Same"], ["Same"], ["Same"], ["other", "x"]]
    assert rows(L.strip_running_heads(lines(spark, alone)), "page", "t") == [(3, "other")]
    # empty pages count
    n = spark.createDataFrame([(1, 9)], "doc_id int, n_pages int")
    assert L.strip_running_heads(lines(spark, alone), n).count() == 4


def test_lines_to_blocks(spark):
    data = [
        (1, 0, 0, "Title", 72.0, 800.0, 20.0), (1, 0, 1, "First para-", 72.0, 780.0, 12.0), (1, 0, 2, "graph goes", 72.0, 766.0, 12.0), (1, 0, 3, "on here!", 72.0, 752.0, 12.0),
        (1, 0, 4, "Indented start", 90.0, 738.0, 12.0), (1, 0, 5, "wide gap", 72.0, 700.0, 12.0), (1, 2, 0, "continues 漢", 72.0, 780.0, 12.0), (1, 2, 1, "字", 72.0, 766.0, 12.0), (1, 2, 2, "indented only", 90.0, 752.0, 12.0), (1, 2, 3, "end。", 72.0, 738.0, 12.0),
    ]
    ls = spark.createDataFrame(data, LINE)
    assert rows(L.lines_to_blocks(ls), "b", "k", "t") == [(0, "h", "Title"), (1, "p", "First paragraph goes on here!"), (2, "p", "Indented start"), (3, "p", "wide gap continues 漢字indented only end。")]
    pages = spark.createDataFrame([(1, 4)], "doc_id int, n_pages int")
    assert L.page_starts(ls, pages).first().starts == [0, 4, 4, 4]
    assert rows(L.scan_test(ls, pages), "n_pages", "scanned") == [(4, True)]


def test_outline(spark):
    tree = spark.createDataFrame([(1, 0, "A", 2, [("A.1", 2), ("A.2", 4)]), (1, 1, "B", None, None), (1, 2, "", 3, None), (1, 3, "C", 99, None)], "doc_id int, seq int, title string, page int, children array<struct<title:string,page:int>>")
    flat = L.flat_outline(tree)
    assert rows(flat, "seq", "title", "page") == [(0, "A", 2), (1, "A.1", 2), (2, "A.2", 4), (3, "", 3), (4, "C", 99)]
    starts = spark.createDataFrame([(1, [0, 3, 5, 8, 9])], "doc_id int, starts array<int>")
    n = spark.createDataFrame([(1, 12)], "doc_id int, n_blocks int")
    assert rows(L.outline_chapters(flat, starts, n), "start", "end", "title") == [(0, 3, "開頭"), (3, 8, "A"), (8, 9, "A.2"), (9, 12, "C")]


LEVELS = [0, 1, 2, 2, 1, 2, 2, 0, 1, 2, 2, 0]


def toc(spark):
    return spark.createDataFrame([(1, i, f"e{i}", lv, i * 10) for i, lv in enumerate(LEVELS)], "doc_id int, ti int, t string, lv int, b int")


def test_fold_and_visible(spark):
    t = toc(spark)
    got = O.with_fold(t)
    assert {r.fold for r in got.collect()} == {2} and [r[0] for r in rows(got.where("has_kids"), "ti")] == [1, 4, 8]
    shown = lambda opened: [r.ti for r in O.visible(t, spark.createDataFrame([(1, x) for x in opened], "doc_id int, ti int")).where("shown").orderBy("ti").collect()]
    assert shown([]) == [0, 1, 4, 7, 8, 11]
    assert shown([4]) == [0, 1, 4, 5, 6, 7, 8, 11]
    flat = t.where("lv = 0")
    assert {r.fold for r in O.with_fold(flat).collect()} == {None} and O.visible(flat.withColumn("ti", F.col("ti")), spark.createDataFrame([], "doc_id int, ti int")).where("NOT shown").isEmpty()


def test_active_entry(spark):
    a = spark.createDataFrame([(1, b) for b in (-5, 0, 35, 59, 200)], "doc_id int, b int")
    got = {r.b: (r.here, r.label, r.expand) for r in O.active_entry(toc(spark), a).collect()}
    assert got == {-5: (0, None, []), 0: (0, "e0", []), 35: (3, "e1", [1]), 59: (5, "e4", [4]), 200: (11, "e11", [])}


def test_resolve_toc(spark):
    entries = spark.createDataFrame([(1, 0, "a", "", " Part\nx", 1), (1, 1, "a", "f", "One", 2), (1, 2, "nope", "", "gone", 0), (1, 3, "b", "missing", "Two", 2), (1, 4, "c", "", "Three", 1)], "doc_id int, ti int, path string, frag string, label string, lv int")
    files = spark.createDataFrame([(1, "a", 0), (1, "b", 4), (1, "c", 9)], "doc_id int, path string, base int")
    frags = spark.createDataFrame([(1, "a", "f", 2)], "doc_id int, path string, frag string, b int")
    n = spark.createDataFrame([(1, 9)], "doc_id int, n_blocks int")
    assert rows(O.resolve_toc(entries, files, frags, n), "ti", "t", "lv", "b") == [(0, "Part", 0, 0), (1, "One", 1, 2), (2, "Two", 1, 4), (3, "Three", 0, 8)]
    same = spark.createDataFrame([(1, 0, "a", "", "x"), (1, 1, "a", "", "y")], "doc_id int, ti int, path string, frag string, label string")
    assert rows(O.first_labels(same), "label") == [("x",)]


def test_speech_queue(spark):
    blocks = spark.createDataFrame([(1, 0, "p", "Good day, dear friend. ... Next one."), (1, 1, "p", "你好，世界！")], "doc_id int, b int, k string, t string")
    got = [(r.say or r.pause_ms) for r in S.speech_queue(blocks).orderBy("seq").collect()]
    assert got == ["Good day", 150, "dear friend", 150, 150, "Next one", 250, "你好", 150, "世界", 250]
    start = spark.createDataFrame([(1, 0, 24)], "doc_id int, from_b int, from_o int")
    assert [(r.say or r.pause_ms) for r in S.speech_queue(blocks, start).orderBy("seq").collect()][:2] == ["Next one", 250]


def test_voices(spark):
    v = spark.createDataFrame([("Zed", "en-AU", "z"), ("Ann", "en_US", "a"), ("Google UK", "en-GB", "g"), ("X", "cmn-TW", "x"), ("Meijia", "zh-TW", "m"), (None, None, "n")], "name string, lang string, uri string")
    assert [r.uri for r in S.ranked_voices(v, "en").orderBy("place").collect()] == ["g", "a", "z"]
    assert [r.uri for r in S.ranked_voices(v, "zh").orderBy("place").collect()] == ["m", "x"]
    assert S.pick_voice(v, "en", "z").first().uri == "z" and S.pick_voice(v, "en", "?").first().uri == "g" and S.pick_voice(v.limit(0), "en").collect() == []
    assert spark.range(1).select(S.guard_ms(F.lit("abcd"), F.lit(0.85)).alias("g")).first().g == 8000 + 3765


def test_epoch_fence(spark):
    e = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (3, "k", 1), (4, "k", 2), (5, "j", 1)], "ts int, key string, epoch int")
    assert rows(S.epoch_fence(e, "key", "epoch", ["ts"]), "ts") == [(1,), (2,), (4,), (5,)]


def test_page_documents(spark):
    """Scanned documents apart; chapters from the outline, else from headings; a block that says that there is no text."""
    long = "some words of text that fill a line of the page here "
    text = [[f"{long}{'abc'[i]}{'wxyz'[k]}" for k in range(4)] for i in range(3)]
    data = [(1, p, i, t, 72.0, 700.0 - 14 * i, 12.0) for p, ls in enumerate(text) for i, t in enumerate(ls)]
    data += [(2, p, i, t, 72.0 if i else 90.0, 700.0 - 14 * i, 12.0) for p, ls in enumerate(text) for i, t in enumerate(ls)] + [(3, 5, 0, "x", 72.0, 700.0, 12.0)]
    outline = spark.createDataFrame([(2, 0, "One", 1), (2, 1, "Two", 3)], "doc_id int, seq int, title string, page int")
    got = L.page_documents(spark.createDataFrame(data, LINE), outline)
    assert rows(got["scanned"], "doc_id", "n_pages") == [(3, 6)]
    assert {r.doc_id for r in got["blocks"].collect()} == {1, 2}
    assert [r[1] for r in rows(got["units"].where("doc_id = 2"), "start", "title")] == ["One", "Two"]
    assert rows(got["units"].where("doc_id = 1"), "ci", "title") == [(0, "全文")]
    bare = L.lines_to_blocks(spark.createDataFrame(data, LINE).where("doc_id = 1"), pages=spark.createDataFrame([(1,), (9,)], "doc_id int"))
    assert rows(bare.where("doc_id = 9"), "b", "k") == [(0, "p")]


def test_quotes_with_any_kind_of_id(spark):
    from folio.operators.quotes import locate_quotes

    blocks = spark.createDataFrame([(1, 0, "p", "nothing here"), (1, 1, "p", "a phrase to find, and more")], "doc_id int, b int, k string, t string").repartition(3)
    for kind, one, two in (("int", 1, 2), ("string", "x", "y"), ("bigint", 1, 2)):
        quotes = spark.createDataFrame([(one, "phrase to find"), (two, "not in any text")], f"item_id {kind}, text string")
        assert rows(locate_quotes(quotes, blocks), "item_id", "doc_id", "b", "o") in ([(one, 1, 1, 2)], [(one, 1, 1, 1)])


def test_lines_come_in_parts_of_bounded_size(spark, sf_dir):
    from folio.plans import tables

    lines = tables.page_lines(spark, sf_dir)
    splits = tables.table(spark, sf_dir, "documents").rdd.getNumPartitions()
    assert lines.rdd.getNumPartitions() == tables.PARTS_A_SPLIT * splits > spark.sparkContext.defaultParallelism
