import io
import zipfile

from pyspark.sql import functions as F

from folio.sources import archive as A
from folio.sources import files as S
from folio.sources import markup as M


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TEXT = "第一章 開頭\n\n這是一本書，裡面有中文。" + "「真的嗎？」她問。他點點頭，說：「當然是真的；我從來不騙人！」" * 3


def test_decoding(spark, tmp_path):
    files = {
        "utf8.txt": TEXT.encode(), "bom.txt": b"\xef\xbb\xbf" + TEXT.encode(), "le.txt": b"\xff\xfe" + TEXT.encode("utf-16le"), "be.txt": b"\xfe\xff" + TEXT.encode("utf-16be"),
        "big5.txt": TEXT.encode("big5"), "gb.txt": TEXT.encode("gb18030"), "empty.txt": b"", "skip.pdf": b"%PDF", "copy.TXT": TEXT.encode(),
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    read = S.read_files(spark, str(tmp_path))
    assert read.count() == 8 and read.select("id").distinct().count() == 7  # Spark lists no empty files
    got = {r.name: (r.text, r.encoding) for r in S.decode_texts(read).collect()}
    assert {k: v[1] for k, v in got.items()} == {"utf8.txt": "utf-8", "bom.txt": "utf-8", "le.txt": "utf-16le", "be.txt": "utf-16be", "big5.txt": "big5", "gb.txt": "gb18030", "copy.TXT": "utf-8"}
    assert all(v[0] == TEXT for v in got.values())
    empty = spark.createDataFrame([(b"",), (None,)], "c binary")
    assert [tuple(r.d) for r in empty.select(S.decoded(F.col("c")).alias("d")).collect()] == [("", "utf-8")] * 2


def test_python_holds_little_at_a_time(spark):
    from folio.functions.rows import BATCH_BYTES, BATCH_ROWS, in_small_batches

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 100, 100_000).otherwise(1)).alias("t"))
    sizes = in_small_batches(texts).mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= BATCH_ROWS and max(r["size"] for r in sizes) < 2 * BATCH_BYTES
    files = texts.select(F.lit("txt").alias("format"), F.encode("t", "utf-16").alias("content"))
    plan = S.decode_texts(files)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("decode(") == 1  # a text goes to Python once


PAGE = """<html><head><title>no</title><style>p {}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div>loose text<br>Chapter 2<h2 id="top">Title</h2> tail<p>one <b>two<p id=x>three<img alt=q><script>var p = "<p>no</p>"</script></p></div><a name="late"></a><blockquote>quoted<br>line</blockquote><ul><li>i1<li>i2</ul></body></html>"""


def test_html_blocks(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain only"), (5, "<p>unclosed <i>x")], "page_id long, html string")
    got = rows(M.html_blocks(pages), "page_id", "b", "k", "t")
    assert [r[2:] for r in got if r[0] == 1] == [("p", "Home"), ("p", "loose text"), ("h", "Chapter 2"), ("h", "Title"), ("p", "tail"), ("p", "one two"), ("p", "three"), ("q", "quoted\nline"), ("p", "i1"), ("p", "i2")]
    assert [r[2:] for r in got if r[0] in (2, 3)] == [] and [r[3] for r in got if r[0] in (4, 5)] == ["plain only", "unclosed x"]
    ids = M.parse_pages(pages, ["page_id"]).where("page_id = 1").first().ids
    assert ids == {"top": 1, "x": 1, "late": 7}  # loose text belongs to the div, which holds both


def test_markup_of_any_depth():
    n = 30_000
    deep = M.parsed("<div>" * n + "<p id=x>far down<p>and <b>on</b>" + "</div>" * n + "<p>after")
    out = []
    M.blocks_of(deep, out)
    assert [(k, t) for k, t, _ in out] == [("p", "far down"), ("p", "and on"), ("p", "after")] and M.id_blocks(deep, out) == {"x": 0}
    spans = M.parsed("<p>" + "<span>a" * n + "</p>")
    out = []
    M.blocks_of(spans, out)
    assert [(k, t) for k, t, _ in out] == [("p", "a" * n)] and spans.text() == "a" * n
    nested = "<nav>" + "".join(f"<ol><li><a href='{k}'>t{k}</a>" for k in range(3000)) + "</nav>"
    assert M.nav_entries(M.parsed(nested)) == [(str(k), f"t{k}", k) for k in range(3000)]
    points = "<navMap>" + "".join(f"<navPoint><navLabel><text>t{k}</text></navLabel><content src='{k}'/>" for k in range(3000)) + "</navMap>"
    assert M.nav_entries(M.parsed(points)) == [(str(k), f"t{k}", k) for k in range(3000)]


def test_references_end_in_a_semicolon(spark):
    page = "<nav><a href='q?a=1&copy=2&amp;b=3'>R&amp</a></nav><h1>A &amp; B&amp</h1><p>&#38; &#38 &#x41; &copy; &copy &notit; &amp;copy; &</p>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [r.t for r in M.html_blocks(pages).orderBy("b").collect()] == ["R&amp", "A & B&amp", "& &#38 A © &copy &notit; &copy; &"]
    assert [(r.path, r.label) for r in M.nav_toc(pages).collect()] == [("q?a=1&copy=2&b=3", "R&amp")]


NAV = """<html xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="landmarks"><ol><li><a href="l">L</a></li></ol></nav><nav epub:type="toc"><ol>
<li><a href="t/one.xhtml">Part One</a><ol><li><a href="t/one.xhtml#s%201">Section</a></li><li><span>no link</span><ol><li><a href="t/two.xhtml">Two</a></li></ol></li></ol></li></ol></nav></body></html>"""
NCX = """<?xml version="1.0"?><ncx><navMap><navPoint><navLabel><text>One</text></navLabel><content src="t/one.xhtml"/><navPoint><navLabel><text>In</text></navLabel><content src="t/one.xhtml#s%201"/></navPoint></navPoint></navMap></ncx>"""


def test_navigation(spark):
    pages = spark.createDataFrame([(1, "O/nav.xhtml", NAV), (2, "O/toc.ncx", NCX), (3, "x", "<nav><a href='q'>flat</a></nav>")], "page_id long, path string, html string")
    got = rows(M.nav_toc(pages, path_col="path"), "page_id", "ti", "path", "frag", "label", "lv")
    assert got == [(1, 0, "O/t/one.xhtml", "", "Part One", 0), (1, 1, "O/t/one.xhtml", "s 1", "Section", 1), (1, 2, "O/t/two.xhtml", "", "Two", 1), (2, 0, "O/t/one.xhtml", "", "One", 0), (2, 1, "O/t/one.xhtml", "s 1", "In", 1), (3, 0, "q", "", "flat", 0)]


CONTAINER = '<container><rootfiles><rootfile full-path="O/book.opf" media-type="x"/></rootfiles></container>'
OPF = """<package xmlns:dc="d"><metadata><dc:title>My  Book</dc:title><dc:creator>Someone</dc:creator><dc:language>en</dc:language></metadata><manifest>
<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>
<item id="one" href="t/one.xhtml" media-type="application/xhtml+xml"/><item id="two" href="t/two.xhtml" media-type="application/xhtml+xml"/><item id="gone" href="t/gone.xhtml" media-type="application/xhtml+xml"/><item id="aux" href="aux.xhtml" media-type="application/xhtml+xml"/><item id="img" href="i.png" media-type="image/png"/></manifest>
<spine toc="ncx"><itemref idref="one"/><itemref idref="aux" linear="no"/><itemref idref="img"/><itemref idref="unknown"/><itemref idref="two"/><itemref idref="gone"/></spine></package>"""
LONG = "Words of a paragraph that is long enough to count as a body."
ONE = f"<html><body><h1>Start</h1><p>{LONG}</p><h2 id='s 1'>Inside</h2><p>{LONG}</p></body></html>"
TWO = f"<html><body><h3>Second</h3><div><p>{LONG}</p></div></body></html>"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


BASE = {"mimetype": "application/epub+zip", "META-INF/container.xml": CONTAINER, "O/book.opf": OPF, "O/t/one.xhtml": ONE, "O/t/two.xhtml": TWO, "O/aux.xhtml": TWO}


def test_books(spark):
    data = [("nav", zipped(**BASE, **{"O/nav.xhtml": NAV})), ("ncx", zipped(**BASE, **{"O/toc.ncx": NCX})), ("drm", zipped(**BASE, **{"META-INF/encryption.xml": "x"})), ("bad", b"not a zip"), ("none", zipped(a="b")), ("null", None)]
    got = A.read_books(spark.createDataFrame(data, "id string, content binary").repartition(2))
    assert rows(got["rejected"], "id", "error")[1:] == [("drm", "protected"), ("none", "no container"), ("null", "File is not a zip file")]
    assert rows(got["books"], "id", "title", "author", "lang") == [(i, "My Book", "Someone", "en") for i in ("nav", "ncx")]
    blocks = rows(got["blocks"].where("id = 'nav'"), "b", "k", "t")
    assert [b[:2] for b in blocks] == [(0, "h"), (1, "p"), (2, "h"), (3, "p"), (4, "h"), (5, "p"), (6, "p")] and blocks[6][2].startswith("（此章無法解析：")
    assert rows(got["units"].where("id = 'nav'"), "ci", "title", "start", "end") == [(0, "Part One", 0, 2), (1, "Section", 2, 4), (2, "Two", 4, 7)]
    assert rows(got["toc"].where("id = 'nav'"), "ti", "t", "lv", "b") == [(0, "Part One", 0, 0), (1, "Section", 1, 2), (2, "Two", 1, 4)]
    assert rows(got["toc"].where("id = 'ncx'"), "ti", "t", "lv", "b") == [(0, "One", 0, 0), (1, "In", 1, 2)]
    assert rows(got["units"].where("id = 'ncx'"), "title", "start") == [("In", 2), ("One", 0), ("Second", 4)]
