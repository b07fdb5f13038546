import zlib

import brute

from folio.llm import quality as Q
from folio.llm.langid import language_id, trained
from folio.llm.queries import op8_quality_rules, op9_language_id

COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts(edge_docs, edge_rows):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in Q.quality_report(edge_docs).collect()}
    assert got == {r[0]: brute.base_counts(r[1]) for r in edge_rows}


def test_base_counts_of_the_table(spark, sf_dir, table_rows):
    rows = op8_quality_rules(spark, sf_dir).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in rows} == {d: brute.base_counts(t) for d, t in table_rows}
    assert not any(r.kept and r.base_failed for r in rows)


def test_repeats_beyond_the_packed_positions(edge_docs, edge_rows, monkeypatch):
    """Texts with more words than the short positions count are counted in full."""
    monkeypatch.setattr(Q, "POSITION_BITS", 4)
    got = {r.doc_id: r.n_repeat_words for r in Q.quality_report(edge_docs).collect()}
    assert got == {r[0]: brute.base_counts(r[1])[4] for r in edge_rows}


def test_no_python_in_the_plan(spark, sf_dir):
    plan = op8_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


PROSE = "The committee met on Tuesday to talk about the harbour and the new road that leads there, and found both in need of repair.\n"


def test_line_rules(spark):
    lines = {
        PROSE.strip(): True,
        "A short line that ends well.": True,
        "Chapter One": True,
        "Home | About | Contact | News": False,
        "Please read our privacy policy here.": False,
        "a line of words without an end": False,
        "Price & quality: 5 % off, and that is all there is to say about it for now, is it not, dear friend?": True,
        "word&&& and*** more### of$$$ this%%% noise&&& for*** a### whole$$$ long%%% line&&& of*** words### here$$$ and%%% there.": False,
        "BUY!! NOW!! AND!! NEVER!! THINK!! ABOUT!! IT!! AGAIN!! OR!! YOU!! WILL!! BE!! SORRY!! FOR!! EVER!! AND!! EVER!!": False,
        "What!! he cried, and then he said nothing more for the rest of that long evening, but looked at the fire!!": True,
        "***** ///// #### ---- !!!": False,
        "------------------------------------------------------------------------------------ and words after that": False,
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    got = {r.t: r.ok for r in df.select("t", Q.line_passes(df.t).alias("ok")).collect()}
    assert got == lines


def test_cleaning_and_verdict(spark):
    different = "".join(PROSE.replace("Tuesday", f"day {i}").replace("harbour", f"harbour{i} {i * 7}").replace("road", f"road{i} {i * 3}").replace("repair", f"repair{i}") .replace("committee", f"committee{i}").replace("found both", f"found{i} both{i}").replace("that leads", f"that{i} leads{i}") for i in range(8))
    menu = "Home | About | Contact | News | Sitemap\n"
    docs = spark.createDataFrame([(1, different), (2, different + menu), (3, menu * 40 + different[:130]), (4, PROSE), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    assert got[1].kept and got[1].clean_text == different
    assert got[2].kept and got[2].clean_text == different
    assert not got[3].kept and not got[4].kept and not got[5].kept


WRAPPED = """\
Call me Ishmael. Some years ago, never mind how long precisely, having
little or no money in my purse, and nothing particular to interest me on
shore, I thought I would sail about a little and see the watery part of
the world. It is a way I have of driving off the spleen and regulating
the circulation.

Whenever I find myself growing grim about the mouth; whenever it is a
damp, drizzly November in my soul; whenever I find myself involuntarily
pausing before coffin warehouses, I account it high time to get to sea
as soon as I can. This is my substitute for pistol and ball, and with a
philosophical flourish Cato throws himself upon his sword while I take
"""


def test_wrapped_prose_stays(spark):
    junk = "Top stories of this day\nWatch the latest videos now\nMore from all our partners\n"
    docs = spark.createDataFrame([(1, WRAPPED), (2, WRAPPED.replace("\n", "\r\n")), (3, WRAPPED + "\n" + junk), (4, junk * 12), (5, "\n\n".join(WRAPPED.split("\n")))], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    assert got[1].kept and got[1].clean_text == WRAPPED
    assert got[2].kept and got[2].clean_text == WRAPPED.replace("\n", "\r\n")
    assert got[3].kept and got[3].clean_text == WRAPPED + "\n"
    assert not got[4].kept and not got[5].kept


def test_end_marks_and_phrases(spark):
    lines = {
        "यह एक छोटा वाक्य है।": True,
        "यह एक छोटा वाक्य है": False,
        "هل هذا سؤال قصير جدا؟": True,
        "یہ ایک چھوٹا جملہ ہے۔": True,
        "Αυτή είναι μια μικρή ερώτηση\u037e": True,
        "ይህ አጭር ዓረፍተ ነገር ነው።": True,
        "The catalog in the hall was long.": True,
        "Please log in to go on.": False,
        "LOG IN": False,
    }
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    got = {r.t: r.ok for r in df.select("t", Q.line_passes(df.t).alias("ok")).collect()}
    assert got == lines


MENUS = (
    "Accueil\nNos produits\nMentions légales\nNous contacter\nPlan du site\n",
    "Startseite\n\nÜber uns\n\nImpressum\n \nKontakt\n",
    "Inicio\nQuiénes somos\nAviso legal\nMapa del sitio\n",
    "首页\n关于我们\n联系方式\n隐私政策\n",
)


def test_menus_of_any_language_fall(spark):
    """Four fragments in a row are a menu in whatever language; fewer, verse and lists that end are not."""
    body = WRAPPED.replace("Ishmael", "Éloïse")
    verse = "so much depends\nupon\n\na red wheel\nbarrow\n\nglazed with rain\nwater\n"
    stays = [body + "\nChapter One\n\nThe Sea\n\nLoomings\n" + body, body + verse, body + "Yes.\nNo!\nWhy?\nSo.\nWell.\n", "Titre\n" * 3 + body]
    falls = [menu + body for menu in MENUS] + [body + menu for menu in MENUS] + [body + "© 2024 Société Éloïse, tous droits réservés.\n"]
    docs = spark.createDataFrame(list(enumerate(stays + falls)), "doc_id int, text string")
    got = {r.doc_id: r for r in Q.quality(docs).collect()}
    assert [got[i].clean_text for i in range(len(stays))] == stays
    for i in range(len(stays), len(got)):
        assert got[i].clean_text.strip() == body.strip()


def test_sql_judges_the_same(spark, edge_rows, tmp_path):
    """The registered SQL over wrapped prose, other scripts, menus and awkward texts."""
    import duckdb
    import pandas as pd

    from folio.llm.queries import ORACLES

    junk = "Top stories of this day\nWatch the latest videos now\nMore from all our partners\n"
    hindi = "यह एक छोटा वाक्य है\nऔर यह आगे बढ़ता है।\n" * 20
    texts = [r[1] for r in edge_rows] + [WRAPPED, WRAPPED.replace("\n", "\r\n"), WRAPPED + "\n" + junk * 3, junk * 12, "\n\n".join(WRAPPED.split("\n")), hindi, "The catalog is long\n" * 30 + WRAPPED, "Please log in now.\n" * 9 + WRAPPED, PROSE * 3 + "Home | About | Contact\n" * 20]
    texts += [m * k + t for m in MENUS for k in (1, 30) for t in (WRAPPED, "\n" + PROSE)] + ["Titre\n" * 3 + WRAPPED + "A\n\nb\nC D E\nF\nG" * 9, "© Éloïse\n" * 30 + WRAPPED]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({ORACLES['op8_quality_rules']})").fetchall()}
    got = {r.doc_id: tuple(r) for r in Q.quality_report(spark.read.parquet(f"file://{tmp_path}/d.parquet")).collect()}
    assert got == want


def test_quality_of_repeated_rows_and_empty_tables(null_id_docs, empty_docs, edge_rows):
    assert Q.quality_report(null_id_docs).count() == 3 * len(edge_rows)
    assert Q.quality_report(empty_docs).collect() == []


def test_language_id_on_held_out_rows(spark, sf_dir):
    truth = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op9_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and truth[r.doc_id][1] and any(c.isalpha() for c in truth[r.doc_id][0] or "")]
    right = sum(r.lang_pred == truth[r.doc_id][1] for r in judged)
    assert right >= 0.97 * len(judged), (right, len(judged))


def test_language_id_edges(edge_docs, empty_docs, null_id_docs, edge_rows):
    got = {r.doc_id: r for r in language_id(edge_docs).collect()}
    for r in edge_rows:
        letters = any(c.isalpha() for c in r[1] or "")
        assert (got[r[0]].lang_pred == "und") == (not letters)
        assert got[r[0]].lang_pred in ("und", "en", "de")
    assert language_id(null_id_docs).count() == 3 * len(edge_rows)
    assert language_id(empty_docs).collect() == []
    import pyspark.sql.functions as F

    assert trained(edge_docs, F.lit(False)) is None


def test_code_lengths_are_those_of_plain_ppm(spark, table_rows):
    """Every n-gram counts, also those seen once, whatever language it is in."""
    import pyspark.sql.functions as F

    rows = [(i, t, f"l{i % 7}") for i, (_, t) in enumerate(r for r in table_rows if r[1]) if i < 60] + [(99, "漢字とかな", "zh"), (100, "é", "l1")]
    trees = trained(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    plain = [brute.ppm([t.encode() for _, t, x in rows if x == lang]) for lang in trees.langs]
    texts = [t[:400].encode() for _, t, _ in rows[::3]] + ["漢かé".encode(), b"zzqq", b"a", bytes([0xC3])]
    got = trees.code_lengths(texts)
    for row, text in zip(got, texts, strict=True):
        assert all(abs(x - f(text)) <= 1e-6 * max(1, f(text)) + 1e-5 * len(text) ** 0.5 for x, f in zip(row, plain, strict=True))


def test_trees_are_bounded_by_bytes(spark, sf_dir):
    import pyspark.sql.functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    large, small = trained(docs, F.lit(True)), trained(docs, F.lit(True), model_bytes=1_500_000)
    size = lambda t: sum(x.nbytes for x in (*t.rows, *t.leave)) + sum(s.key.nbytes + s.number.nbytes for s in t.slots)
    assert size(small) <= 1_500_000 < size(large) and small.langs == large.langs


def test_colliding_grams_are_all_found():
    import numpy as np

    from folio.llm.langid import Slots

    grams = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 5000, np.uint64))
    slots = Slots(grams)
    assert (slots.find(grams) == np.arange(1, grams.size + 1)).all()
    others = np.setdiff1d(np.random.default_rng(4).integers(0, 1 << 32, 5000, np.uint64), grams)
    assert not slots.find(others).any()


def test_frozen_probabilities_sum_to_one(spark, sf_dir):
    """Over all followers of a context the probabilities add up to at most one; escapes waste little of it."""
    import numpy as np
    import pyspark.sql.functions as F

    trees = trained(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.lit(True))
    for context in (b"the", b"q", b"", b"\xff\xfe\xfd"):
        each = trees.code_lengths([context + bytes([b]) for b in range(256)]) - trees.code_lengths([context or b"x"]) * bool(context)
        total = np.exp2(-each).sum(0)
        assert (total <= 1 + 1e-4).all() and (total > 0.5).all()
