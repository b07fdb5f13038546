import random

import spec
from pyspark.sql import functions as F

from folio.functions import segment as S
from folio.functions import text as X

ALPHABET = ["a", "B", "Mr", "e", " ", " ", ".", ".", "!", "?", "。", "！", "…", "」", "”", '"', "'", "’", ")", ",", "，", "、", "：", ":", ";", "-", "3", "14", "漢", "字", "か", "한", "é", "\n", "\t", "　", " ", "word ", "etc", "vol", "$", "%", "_", "（", "·"]
LITERALS = [
    None, "", " ", ".", "。", "He paid 3.14 to Mr. Smith. J. R. R. left!", "他說：「好。」然後走了。But he stayed... \"Yes!\" she said.", "版本 2.0.1 很好，真的。", "a. b. c.", "U.S.A. is e.g. here", "x" * 181, ("word " * 60).strip(), "字" * 400 + "。" + "，".join(["漢字漢字"] * 80),
    "好，a，b，壞人，好人。", "1,000 and 12:30, then more; and so on: done", "don't -- well-known 'quoted' $5 & 10% @home #tag a_b", "這是 iPhone 的 PWA 應用，very long English phrase here 然後回來", "Il dit ’oui’ 漢", "emoji 😀. Next one! 😀", "last \U0010ffff code. Point \U0010ffff, here.",
]


def samples(n=1500, seed=4):
    rng = random.Random(seed)
    return LITERALS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 60))) for _ in range(n)] + ["".join(rng.choice(ALPHABET) for _ in range(400)) for _ in range(60)]


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in df.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_sentences(spark):
    texts = samples()
    got = column(spark, texts, S.sentences)
    for t, x in zip(texts, got):
        assert [(s.o, s.t) for s in x] == spec.sentences(t or ""), repr(t)


def test_sentence_properties(spark):
    texts = [t for t in samples(400, 9) if t]
    for t, x in zip(texts, column(spark, texts, S.sentences)):
        rest = t
        for s in x:
            assert len(s.t) <= 183 and s.t.strip(spec.WS)
            assert t[s.o :].startswith(s.t[:1])
        if x and all(len(s.t.strip(spec.WS)) > 1 for s in x) and "\n" not in rest and len(t) < 180:
            assert all(t[s.o : s.o + len(s.t)] == s.t for s in x[-1:])


def test_clauses(spark):
    texts = samples()
    for t, x in zip(texts, column(spark, texts, S.clauses)):
        assert [(s.o, s.t) for s in x] == spec.clauses(t or ""), repr(t)
        assert "".join(s.t for s in x) == (t or "")


def test_speech_clean(spark):
    texts = samples()
    assert column(spark, texts, X.strip_speech_punctuation) == [spec.said(t or "") for t in texts]


def test_lang_runs(spark):
    texts = samples()
    for t, x in zip(texts, column(spark, texts, S.lang_runs)):
        assert [(r.t, r.lang, r.o) for r in x] == spec.runs(t or ""), repr(t)
    for t, x in zip(texts, column(spark, texts, lambda c: S.lang_runs(c, 3, 2))):
        assert [(r.t, r.lang, r.o) for r in x] == spec.runs(t or "", 3, 2), repr(t)


def test_weights(spark):
    texts = samples(300)
    got = column(spark, texts, lambda c: F.struct(*[w.alias(n) for w, n in zip((*X.script_weights(X.text_of(c)), X.solid_count(X.text_of(c))), "abc")]))
    assert [tuple(r) for r in got] == [(len(spec.HAN.findall(t or "")), len(spec.LATIN.findall(t or "")), spec.solid(t or "")) for t in texts]


def test_speech_parts(spark):
    df = spark.createDataFrame([("今天，我們去 Taipei Main Station, the big one, 好嗎？",)], "t string").withColumn("runs", S.lang_runs(F.col("t")))
    parts = df.select(S.parts_of_runs(F.col("runs")).alias("p")).first().p
    assert [(p.say, p.lang, p.brk) for p in parts] == [("今天", "zh", True), ("我們去", "zh", False), ("Taipei Main Station", "en", True), ("the big one", "en", False), ("好嗎", "zh", False)]


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "﻿a\r\nb\rc ​d \t e", X.normalize) == "a\nb\nc d e"
    assert one(spark, " 　a \n\n  b  c\n", X.clean_text) == "a\nb c"
    assert one(spark, "  " + "t" * 50 + "\nsecond", X.clean_title) == "t" * 40
    for t, want in [("第十二章 風起", True), ("Chapter 3", True), ("PART iv: x", True), ("Chapterhouse 3", False), ("Section 9a", False), ("序", True), ("序曲", False), ("第三章" + "長" * 40, False), ("a line", False), ("", False), (None, False), ("　目錄 ", True)]:
        assert one(spark, t, X.looks_heading) is want, t
    assert one(spark, "⼀⽂⻅⻰⺟x", X.fix_radicals) == "一文见龙母x"
    assert one(spark, " Page 12 of 300 ", X.head_key) == "Page#of#"
    assert [one(spark, v, X.norm_lang) for v in ("zh_hant_tw", "EN-us", "", None, "yue--HK", "de-1996")] == ["zh-Hant-TW", "en-US", "", "", "yue-HK", "de-1996"]
    assert [one(spark, v, X.format_of) for v in ("a.EPUB", "b.pdf", "c.pdf.txt", None)] == ["epub", "pdf", "txt", "txt"]
    assert [one(spark, v, X.base_name) for v in ("a.b.txt", "noext", "", None)] == ["a.b", "noext", "未命名", "未命名"]
    assert one(spark, "a�b\x01\t\n\x1f", X.bad_score) == 5
    assert [one(spark, v, X.pct, "double") for v in (0.005, 0.00499, 1.5, -1.0, None, 0.995)] == [1, 0, 100, 0, 0, 100]
    assert [one(spark, v, X.size_label, "bigint") for v in (0, 1, 1536, 1 << 20, 3 << 30, None)] == ["", "0 KB", "2 KB", "1.0 MB", "3.0 GB", ""]


def test_paths(spark):
    cases = [("OEBPS/text", "../img/a.png", "OEBPS/img/a.png"), ("", "x.html#f", "x.html"), ("a", "/b.html", "a/b.html"), ("a", "%E6%BC%A2/./b//c", "a/漢/b/c"), ("a", "100%", "a/100%"), ("a", "#f", ""), ("a", None, ""), ("a", "../../../x", "x"), ("a", "b+c", "a/b+c")]
    df = spark.createDataFrame(cases, "b string, r string, w string")
    assert all(r.x == r.w for r in df.select("r", "w", X.resolve_path(F.col("b"), F.col("r")).alias("x")).collect())
    assert [one(spark, v, X.dir_of) for v in ("a/b/c.x", "c.x", "a/")] == ["a/b", "", "a"]
    assert [one(spark, v, X.fragment_of) for v in ("a#b%20c", "a", "#x")] == ["b c", "", "x"]


def test_many_sentences_in_one_text(spark):
    """50,000 sentences, some of them short: places are right, and the time grows about as the text does."""
    import time

    took = []
    for n in (10_000, 50_000):
        unit = F.concat(F.lit("Sentence number "), F.col("id").cast("string"), F.when(F.col("id") % 50 == 0, ". ! ").otherwise(" goes on. "))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", unit.alias("t")))), lambda x: x["t"]), "")
        df = spark.range(n).agg(text.alias("t")).persist()
        whole = df.first().t
        began = time.perf_counter()
        got = df.select(F.explode(S.sentences(F.col("t"))).alias("s")).select("s.t", "s.o").collect()
        took.append(time.perf_counter() - began)
        assert all(whole[r.o : r.o + len(r.t)] == r.t for r in got) and "".join(r.t for r in got).rstrip() == whole.rstrip() and n <= len(got) <= n + n // 50 + 1
    assert took[1] < 15 * took[0] + 5


def seconds(df):
    import time

    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def against_one_look(spark, make):
    """How often longer than one look at every character with a short class `make` takes over plain prose."""
    prose = F.repeat(F.concat(F.lit("It was a plain line, of words: and it went on until it ended. "), F.col("id").cast("string")), 40)
    df = spark.range(0, 6000, 1, 4).select(prose.alias("t")).persist()
    df.count()
    took = {}
    for name, c in (("one", F.col("t").rlike("[#~]")), ("all", make(F.col("t")))):
        took[name] = min(seconds(df.select(c)) for _ in range(4))
    df.unpersist()
    return took["all"] / took["one"]


def test_speech_clean_looks_at_most_characters_once(spark):
    runs = ["-" * 60_000, "a" + "- " * 30_000 + "b", " " * 60_000, "字" * 60_000 + "。", "a.b,c:1.5," * 6000]
    assert column(spark, runs, X.strip_speech_punctuation) == ["", "a b", "", "字" * 60_000, ("a b c 1.5 " * 6000).strip()] == [spec.said(t) for t in runs]
    assert against_one_look(spark, X.strip_speech_punctuation) < 12


def test_speech_parts_look_at_most_characters_once(spark):
    parts = lambda c: S.parts_of_runs(F.array(F.struct(c.alias("t"), F.lit("en").alias("lang"), F.lit(0).alias("o"))))
    assert against_one_look(spark, parts) < 38
    odd = ["-" * 300 + ",x, " + "." * 300, ",:;，" * 50, "a, b, cd, 漢, 1,5,  ;; ef"]
    assert [[(s.o, s.t) for s in x] for x in column(spark, odd, S.clauses)] == [spec.clauses(t) for t in odd]
