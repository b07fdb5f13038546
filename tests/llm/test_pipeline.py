import zlib

import brute
import corpus_pipeline as P
from folio.llm.mixing import mix
from folio.llm.quality import quality
from test_tokens_packing import check_packing


def staged(spark, docs, folder, sf_dir):
    """What each stage gets and gives, as lists of rows, written in between."""
    out, columns = [], docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, sf_dir)
        if k + 1 < len(P.STAGES):
            assert got.columns == columns, name
        got.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((docs.collect(), after.collect()))
        docs = after
    return out


def check_stages(spark, docs, folder, sf_dir):
    (a, b), (c, d), (e, f), (g, h), (i, j) = staged(spark, docs, str(folder), sf_dir)
    want = {(r.doc_id, r.clean_text) for r in quality(docs.select("doc_id", "text")).where("kept").collect()}
    assert {(r.doc_id, r.text) for r in b} == want and len(b) <= len(a)
    assert all(r.n_chars == len(r.text) for r in b)
    assert sorted((r.doc_id, r.text) for r in d) == sorted((x, t) for x, _, _, t in brute.lines([(r.doc_id, r.text) for r in c]))
    groups = brute.near([(r.doc_id, r.text) for r in e])
    assert sorted(r.doc_id for r in f) == sorted({least for _, _, least in groups})
    texts = {r.doc_id: r.text for r in e}
    assert all(texts[r.doc_id] == r.text for r in f)
    sources, words = {}, {}
    for r in g:
        sources[r.source] = sources.get(r.source, 0) + len(brute.words(r.text))
    target = brute.mix_targets(sources)
    for r in h:
        words[r.source] = words.get(r.source, 0) + len(brute.words(r.text))
    for s in sources:
        assert abs(words.get(s, 0) - target[s]) <= max(0.01 * target[s], max(len(brute.words(r.text)) for r in g if r.source == s)), s
    bins, least = check_packing(j, [(r.doc_id, r.text) for r in i], 1024)
    assert bins <= least * 1.05 + 1
    return a, b, j


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b, j = check_stages(spark, docs, tmp_path / "out", sf_dir)
    assert len(b) > 0.3 * len(a)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, P.run(spark, sf_dir).collect())) == sorted(map(key, j))


def prose(i):
    """A few lines of words that differ from one i to the next."""
    return "\n".join(" ".join(f"word{zlib.crc32(f'{i} {k} {j}'.encode()) % 5000}" for j in range(20)) + "." for k in range(6))


def test_edges(spark, edge_rows, tmp_path, sf_dir):
    """Nulls, repeats, null ids and columns with the operators' names pass through the stages."""
    from conftest import DOCS

    rest = edge_rows[0][5:]
    rows = edge_rows + [(1000 + i, prose(i % 9), "en", "web", 7, *rest) for i in range(14)] + [(1000, prose(0), "en", "web", 7, *rest)] * 2 + [(None, prose(20), None, None, None, *rest)] * 2
    docs = spark.createDataFrame(rows, DOCS)
    steps = staged(spark, docs, str(tmp_path / "edges"), sf_dir)
    assert [r.doc_id for r in steps[2][1]].count(1000) == 1
    assert [r.doc_id for r in steps[2][1]].count(None) == 1
    empty = staged(spark, docs.limit(0), str(tmp_path / "empty"), sf_dir)
    assert all(after == [] for _, after in empty)


def test_dotted_and_clashing_columns(spark, tmp_path, sf_dir):
    """Columns of any name pass through the stages unchanged, and through the quality rules."""
    odd = ["a.b", "a`b", "__words", "__text", "__fails", "__lost", "n_words", "clean_text", "in_text", "c0", "copies"]
    rows = [(i, prose(i % 9), "en", f"s{i % 3}", 7, *(f"{n} {i % 9}" for n in odd)) for i in range(30)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", *odd])
    for _, after in staged(spark, docs, str(tmp_path / "dotted"), sf_dir)[:-1]:
        assert after and all([r[n] for n in odd] == [f"{n} {r.doc_id % 9}" for n in odd] for r in after)
    judged = quality(docs)
    assert judged.columns[:5] == docs.columns[:5] and set(odd) <= set(judged.columns)
    for r in judged.collect():
        assert r["a.b"] == f"a.b {r.doc_id % 9}" and r["__lost"] == f"__lost {r.doc_id % 9}" and r["n_words"] == 120 and r["clean_text"] == r.text


def test_stages_leave_other_tables_alone(spark, sf_dir, tmp_path):
    """A frame of another operator, not written yet, can still be read after the pipeline; its own tables go."""
    from folio.llm import common
    from folio.llm.exact import exact_dedup

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.release(spark)
    other = exact_dedup(docs)
    before = set(common.working_tables(spark))
    P.run(spark, sf_dir).write.parquet(str(tmp_path / "packed"))
    assert other.count() == docs.count() and before <= set(common.working_tables(spark))
    common.release(spark)
    assert common.working_tables(spark) == []
