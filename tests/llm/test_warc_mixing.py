import gzip
import math
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from folio.llm.common import new_path
from folio.llm.mixing import mix, mixed_documents
from folio.llm.queries import op2_warc, op3_mixing
from folio.llm.warc import captures, read_warc, warc_round_trip, write_warc

PAGES = [
    (1, "http://a.example/x", "<html>one</html>"),
    (2, "http://a.example/y", "<html>one</html>"),
    (3, "http://b.example/", "WARC/1.0\r\n\r\nnot a record\r\n\r\n\r\n"),
    (4, None, None),
    (5, "https://c.example/p?q=1", ""),
    (6, "odd\r\nurl", "é漢😀\r\n\r\n"),
    (7, "http://a.example/z", "<html>one</html>"),
    (8, "http://d.example/long", "long " * 50_000),
]


def warc_rows(df):
    return sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, type string").repartition(3)
    assert warc_rows(warc_round_trip(pages)) == sorted(brute.warc([(p, h) for p, _, h in PAGES]))


def test_min_bytes(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert {r.record_type for r in warc_round_trip(pages, min_bytes=100).collect()} == {"response"}


def test_round_trip_of_the_table(spark, sf_dir):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert warc_rows(op2_warc(spark, sf_dir)) == sorted(brute.warc(rows))


def test_payloads_come_back(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    write_warc(pages, path)
    rows = captures(read_warc(spark, path)).collect()
    assert sorted(bytes(r.payload) for r in rows if r.type == "response") == sorted({(h or "").encode() for _, _, h in PAGES})
    assert all(r.request is not None and r.metadata is not None for r in rows)


def test_foreign_archives(spark, tmp_path):
    one = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200\r\n\r\nabc\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Concurrent-To: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nGET\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one.replace(b"uuid:1", b"uuid:3")) + gzip.compress(two.replace(b"uuid:2", b"uuid:4").replace(b"uuid:1", b"uuid:3")))
    rows = captures(read_warc(spark, str(tmp_path))).collect()
    assert sorted((r.record_id, bytes(r.payload), r.request.id, r.metadata) for r in rows) == [("<urn:uuid:1>", b"abc", "<urn:uuid:2>", None), ("<urn:uuid:3>", b"abc", "<urn:uuid:4>", None)]


def test_cut_archive_is_an_error(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 50\r\n\r\nshort")
    with pytest.raises(Exception, match="cut short"):
        read_warc(spark, str(tmp_path)).collect()


def test_warc_null_ids_repeats_and_empty(spark):
    schema = "page_id long, url string, html string"
    rows = [(None, "http://n.example/", "same"), (9, "http://n.example/", "same"), (9, "http://n.example/", "same"), (None, None, None)]
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc_round_trip(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 0, "response", None), (0, 4, "revisit", 9), (9, 4, "response", None), (9, 4, "response", None)]
    assert warc_round_trip(spark.createDataFrame([], schema)).collect() == []


def check_mix(rows, docs):
    """rows: result; docs: [(doc_id, text, source)]"""
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in docs)
    sizes, of, total = defaultdict(int), {}, defaultdict(int)
    for d, t, s in docs:
        sizes[s] += len(brute.words(t))
        of[d] = s
    want = brute.mix_targets(dict(sizes))
    largest = defaultdict(int)
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        total[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(total[s] - want[s]) <= max(0.002 * want[s], min(largest[s], 40)), (s, total[s], want[s], largest[s])
    return total


def test_mix_of_the_table(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op3_mixing(spark, sf_dir).collect()
    check_mix(rows, docs)
    assert {r.doc_id: r.size for r in rows} == {d: len(brute.words(t)) for d, t, _ in docs}
    assert sorted(rows) == sorted(op3_mixing(spark, sf_dir).collect())


def test_mix_edges(spark, edge_docs, edge_rows, empty_docs, null_id_docs):
    rows = mix(edge_docs).collect()
    sizes = defaultdict(int)
    for r in edge_rows:
        sizes[r[3]] += len(brute.words(r[1]))
    want = brute.mix_targets(dict(sizes))
    of = {r[0]: r[3] for r in edge_rows}
    assert all(abs(r.target - want[of[r.doc_id]]) < 1e-6 * max(1, r.target) for r in rows)
    assert len(rows) == len(edge_rows) and all(r.taken <= 2 * r.size for r in rows)
    assert mix(null_id_docs).count() == 3 * len(edge_rows)
    assert mix(empty_docs).collect() == [] and mixed_documents(empty_docs).collect() == []


def test_mixed_documents(edge_docs):
    want = {r.doc_id: r.copies for r in mix(edge_docs).collect()}
    got = mixed_documents(edge_docs)
    assert got.columns == edge_docs.columns
    have = Counter(r.doc_id for r in got.collect())
    assert have == Counter({k: v for k, v in want.items() if v})


def test_rates_fall_with_the_tilt(spark):
    """In a source that must shrink, large documents are taken no more often than small ones."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 97), "abc"[i % 3]) for i in range(3000)], "doc_id long, text string, source string")
    rows = mix(docs).collect()
    small = [r.copies for r in rows if r.doc_id % 3 == 2 and r.size < 30]
    large = [r.copies for r in rows if r.doc_id % 3 == 2 and r.size > 70]
    assert sum(small) / len(small) > sum(large) / len(large)


def test_rates_are_those_of_the_dual(spark, edge_docs):
    """The tilted rates, against bisection of each source's dual, and the copies that they are rounded to."""
    from folio.llm.mixing import ranked_sources, solved_rates, with_targets

    rows = spark.createDataFrame([(i, s, 5 + (i * i * 37) % 400 * (1 + i % 3)) for i, s in enumerate(["a", "b", "c", "d"] * 40)], "row long, source string, size long")
    sources = with_targets(ranked_sources(rows))
    hist = rows.join(sources.select("source", "rank"), "source").groupBy("rank", "size").agg(F.count("*").alias("n"))
    rates = {r["rank"]: r for r in solved_rates(hist, sources).collect()}
    found = 0
    for s in sources.collect():
        sizes = [r.size for r in rows.where(F.col("source") == s.source).collect()]
        r = rates[s["rank"]]
        if r.lam is None:
            assert s.target >= 2 * s.source_size * (1 - 1e-9)
            continue
        found += 1
        want = brute.entropy_rates(sizes, s.target)
        got = [2 / (1 + math.exp(-r.lam * x / r.mean)) for x in sizes]
        assert max(abs(a - b) for a, b in zip(want, got)) < 1e-6
    assert found >= 2
