import brute
import pytest
from pyspark import SparkConf
from pyspark.sql import functions as F

from folio.llm import common
from folio.llm.exact import exact_dedup
from folio.llm.linededup import CuckooFilter, LineIndex, line_dedup
from folio.llm.minhash import near_duplicates
from folio.llm.queries import op4_minhash, op5_exact_dedup, op7_suffix_dedup, op10_line_dedup
from folio.llm.suffix import repeated_windows, suffix_dedup


def exact_rows(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


@pytest.mark.parametrize("width", [1, 4, 64])
def test_exact(edge_docs, edge_rows, width):
    rows = [r[:2] for r in edge_rows if width > 1 or len(r[1] or "") < 5000]
    docs = edge_docs.where(F.coalesce(F.length("text"), F.lit(0)) < (10**9 if width > 1 else 5000))
    assert exact_rows(exact_dedup(docs, first_width=width)) == sorted(brute.exact(rows))


def test_exact_of_the_table(spark, sf_dir, table_rows):
    assert exact_rows(op5_exact_dedup(spark, sf_dir)) == sorted(brute.exact(table_rows))


def test_exact_repeated_rows_and_empty(null_id_docs, empty_docs, edge_rows):
    got = exact_dedup(null_id_docs).collect()
    assert len(got) == 3 * len(edge_rows)
    assert sum(r.kept for r in got) == sum(r[3] for r in brute.exact([r[:2] for r in edge_rows]))
    assert all(r.group_size % 3 == 0 for r in got)
    assert exact_dedup(empty_docs).collect() == []


def test_exact_broadcasts_few_bytes(edge_docs, edge_rows, monkeypatch):
    """Digits of long copied texts are shuffled, however few rows they are."""
    sent, hint = [], F.broadcast

    def broadcast(df):
        if "digit" in df.columns:
            sent.append(df.agg(F.sum(F.octet_length("digit"))).first()[0] or 0)
        return hint(df)

    monkeypatch.setattr(F, "broadcast", broadcast)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 3000, raising=False)
    assert exact_rows(exact_dedup(edge_docs)) == sorted(brute.exact([r[:2] for r in edge_rows]))
    assert sent and max(sent) <= 3000


def near_rows(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_near(edge_docs, edge_rows):
    assert near_rows(near_duplicates(edge_docs)) == sorted(brute.near([r[:2] for r in edge_rows]))


def test_near_of_the_table(spark, sf_dir, table_rows):
    got = op4_minhash(spark, sf_dir)
    assert near_rows(got) == sorted(brute.near(table_rows))
    assert got.where("kept <> (doc_id = component_id)").isEmpty()


@pytest.mark.parametrize(("cell_bytes", "block"), [(1 << 23, 1000), (20_000, 20), (5_000, 3)])
def test_near_many_variants(spark, cell_bytes, block):
    """A large group of near copies that are not all similar to each other, in one cell and in many."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randrange(5)):
            text[rng.randrange(len(text))] = f"v{rng.randrange(50)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_rows(near_duplicates(docs, cell_bytes=cell_bytes, block=block)) == sorted(brute.near(rows))


def test_near_pages_that_share_a_template(spark, monkeypatch):
    """Pages that meet in buckets without being linked are not compared by their sets."""
    import random

    from folio.llm import minhash

    rng = random.Random(1)
    template = " ".join(f"t{k}" for k in range(80))
    rows = [(i, template + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(0, 400, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared, linked = [], minhash.linked
    monkeypatch.setattr(minhash, "linked", lambda pairs, *rest: compared.append(pairs.count()) or linked(pairs, *rest))
    assert near_rows(near_duplicates(docs)) == sorted(brute.near(rows))
    assert sum(compared) <= 20


def test_signature_agreement():
    import numpy as np

    from folio.llm.minhash import K, LOW_WORDS, agreement, may_link, parity

    one, two = np.random.default_rng(1).integers(0, 3, (2, 50, K), np.uint8)
    words = [np.pad(x, ((0, 0), (0, 8 * LOW_WORDS - K))).view(np.uint64) for x in (one, two)]
    assert (agreement(*words) == (one == two).sum(1)).all()
    # what the parity sketches rule out is never linked
    rng, ruled_out = np.random.default_rng(2), 0
    for _ in range(300):
        n, extra = rng.integers(1, 3000), rng.integers(0, 900)
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[rng.integers(0, n // 2 + 1) :], rng.integers(0, 1 << 63, extra, np.uint64)])
        marks = [np.concatenate([np.zeros(LOW_WORDS, np.uint64), np.frombuffer(parity(x), np.uint64)])[None] for x in (a, b)]
        common = np.intersect1d(a, b).size
        linked = 100 * common >= 75 * (a.size + b.size - common)
        able = may_link(*marks, np.array([a.size]), np.array([b.size]), 1, 75)[0]
        assert able or not linked
        ruled_out += not able
    assert ruled_out > 100


def test_near_repeated_rows_and_empty(null_id_docs, empty_docs, edge_rows):
    got = {(r.doc_id, r.component_id) for r in near_duplicates(null_id_docs).where("doc_id IS NOT NULL").collect()}
    assert got == {(d, c) for d, _, c in brute.near([r[:2] for r in edge_rows])}
    assert near_duplicates(empty_docs).collect() == []


def suffix_rows(df):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


@pytest.mark.parametrize(("length", "gram", "bucket", "most"), [(200, 32, 1 << 20, 8000), (64, 16, 3000, 8000), (40, 8, 1 << 16, 2)])
def test_suffix(edge_docs, edge_rows, length, gram, bucket, most):
    assert suffix_rows(suffix_dedup(edge_docs, length, gram, bucket, most)) == sorted(brute.suffix([r[:2] for r in edge_rows], length))


@pytest.mark.parametrize("most", [8000, 2])
def test_suffix_whatever_the_names(edge_docs, edge_rows, most):
    """With one name for all contexts, and for few of them, the results are the same."""
    for bits in (0, 3):
        got = suffix_rows(suffix_dedup(edge_docs, 64, 16, 3000, most, name_bits=bits))
        assert got == sorted(brute.suffix([r[:2] for r in edge_rows], 64))


def test_suffix_intervals_with_counts():
    """A kind of count two is repeated as a whole, as two equal contexts are; short suffixes are not windows."""
    parts, counts = [b"abcdefgh", b"xxcdefyy", b"qrstuvwx"], [1, 1, 2]
    assert repeated_windows(parts, 4, counts) == [[(2, 2)], [(2, 2)], [(0, 4)]]
    assert repeated_windows(parts, 4) == [[(2, 2)], [(2, 2)], []]


def test_suffix_of_the_table(spark, sf_dir, table_rows):
    assert suffix_rows(op7_suffix_dedup(spark, sf_dir)) == sorted(brute.suffix(table_rows, 200))


def test_suffix_repeated_rows_and_empty(null_id_docs, empty_docs, edge_rows):
    got = suffix_dedup(null_id_docs).collect()
    assert len(got) == 3 * len(edge_rows)
    assert all(r.n_removed == r.n_bytes for r in got if r.n_bytes >= 200)
    assert suffix_dedup(empty_docs).collect() == []


def test_repeated_windows_against_counting():
    import random
    from collections import Counter

    rng = random.Random(3)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(4, 40))) for _ in range(rng.randrange(1, 6))]
        n = rng.randrange(2, 9)
        counts = Counter(p[i : i + n] for p in parts for i in range(len(p) - n + 1))
        for p, runs in zip(parts, repeated_windows(parts, n)):
            flagged = {i for a, b in runs for i in range(a, b + 1)}
            assert flagged == {i for i in range(len(p) - n + 1) if counts[p[i : i + n]] > 1}


def line_rows(df):
    return sorted((r.doc_id, r["__line_total"], r["__line_drops"], r.text or "") for r in df.collect())


def test_lines(edge_docs, edge_rows):
    got = line_dedup(edge_docs)
    assert got.columns[: len(edge_docs.columns)] == edge_docs.columns
    assert line_rows(got) == sorted(brute.lines([r[:2] for r in edge_rows]))


def test_lines_of_the_table(spark, sf_dir, table_rows):
    import hashlib

    want = sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in brute.lines(table_rows))
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op10_line_dedup(spark, sf_dir).collect()) == want


def test_lines_repeated_rows_and_empty(null_id_docs, empty_docs, edge_rows):
    got = line_rows(line_dedup(null_id_docs).where("doc_id IS NOT NULL"))
    # the rows without an id count as one document, which never keeps a line that others hold
    rows = [r[:2] for r in edge_rows]
    assert got == sorted(x for x in brute.lines(rows * 2 + [(-1, t) for _, t in rows]) if x[0] >= 0)
    assert line_dedup(empty_docs).collect() == []


def test_line_index_is_reversible(spark, edge_docs, edge_rows):
    """Inserting a batch and deleting it again leaves the counts and filters of the rest."""
    plain = LineIndex(spark)
    plain.insert(edge_docs)
    index = LineIndex(spark)
    some = edge_docs.where("doc_id % 2 = 0")
    index.insert(some)
    index.insert(edge_docs.where("doc_id % 2 = 1"))
    assert sorted(index.repeated().collect()) == sorted(plain.repeated().collect())
    assert line_rows(index.apply(edge_docs)) == line_rows(plain.apply(edge_docs))
    index.delete(some)
    left = [r[:2] for r in edge_rows if r[0] % 2 == 1]
    assert line_rows(index.apply(edge_docs.where("doc_id % 2 = 1"))) == sorted(brute.lines(left))
    keys = {(r.hi, r.lo) for r in index.repeated().collect()}
    for r in index.filters.collect():
        one = CuckooFilter.from_bytes(r.filter)
        assert int((one.table > 0).sum()) + len(one.spare) == r.n_keys == sum(hi & 63 == r.shard for hi, _ in keys)


def test_deleting_what_is_not_there(spark, edge_docs, edge_rows):
    index = LineIndex(spark)
    index.delete(edge_docs)
    index.insert(edge_docs)
    index.delete(edge_docs.withColumn("doc_id", F.col("doc_id") + 100_000))
    index.delete(edge_docs.where("doc_id < 60"))
    index.delete(edge_docs.where("doc_id < 60"))
    index.insert(edge_docs.where("doc_id < 60"))
    assert line_rows(index.apply(edge_docs)) == sorted(brute.lines([r[:2] for r in edge_rows]))


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_filters_grow_and_are_used_at_every_size(spark, monkeypatch, most):
    """Many more shards and keys than at first, with filters broadcast and with lines sent to them."""
    from folio.llm import linededup

    monkeypatch.setattr(linededup, "FILTER_BYTES", most)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 20)
    monkeypatch.setattr(linededup, "LEAST_SHARDS", 2)
    passed, keys = [], linededup.CuckooFilter.might_hold
    monkeypatch.setattr(linededup.CuckooFilter, "might_hold", lambda self, k: passed.append(1) or keys(self, k))
    line = lambda k: f"line number {k} that is long enough to be counted as one"
    rows = [(i, "\n".join(line(k) for k in range(300) if (k + i) % 3 or k < 12)) for i in range(12)]
    index = LineIndex(spark, min_docs=5)
    for part in (rows[:5], rows[5:8], rows[8:]):
        index.insert(spark.createDataFrame(part, "doc_id long, text string"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert index.shards > 2
    assert line_rows(index.apply(docs)) == sorted(brute.lines(rows))
    for r in index.filters.collect():
        one = CuckooFilter.from_bytes(r.filter)
        assert not one.spare and r.n_keys <= one.table.size
    index.delete(docs.where("doc_id >= 6"))
    assert line_rows(index.apply(docs.where("doc_id < 6"))) == sorted(brute.lines(rows[:6]))


def test_lines_with_clashing_columns(spark, edge_rows):
    rows = [(*r[:2], "x", "y", "z", 7) for r in edge_rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __doc string, tag string, __text_tag string, __line_total long")
    got = line_dedup(docs)
    assert got.columns == ["doc_id", "text", "__doc", "tag", "__text_tag", "__line_total", "__line_drops"]
    assert line_rows(got) == sorted(brute.lines([r[:2] for r in edge_rows]))


def test_cuckoo_filter():
    import random

    import numpy as np

    rng = random.Random(1)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    one = CuckooFilter.for_keys(1500)  # more than it was made for: the rest is kept aside
    for k in keys:
        one.insert(k)
    assert one.might_hold(np.array(keys)).all()
    for k in keys[:2000]:
        one.delete(k)
    again = CuckooFilter.from_bytes(one.to_bytes())
    assert again.might_hold(np.array(keys[2000:])).all()
    others = np.array([rng.getrandbits(64) - (1 << 63) for _ in range(20000)])
    assert again.might_hold(others).mean() < 0.15
    made = CuckooFilter.of_keys(keys)
    assert not made.spare and made.might_hold(np.array(keys)).all() and made.might_hold(others).mean() < 0.01


def test_shared_folder(spark, monkeypatch):
    """The folder named in the session, else the one set by hand; none of this machine alone on a cluster."""
    sc = spark.sparkContext
    named = {"spark.checkpoint.dir": "file:///tmp/named/"}
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, default=None: named.get(key, default))
    monkeypatch.setattr(type(sc), "getConf", lambda self: SparkConf(loadDefaults=False))
    assert common.shared_folder(spark) == "file:///tmp/named"
    named.clear()
    monkeypatch.setattr(common, "_OWN_FOLDER", {})
    monkeypatch.setattr(type(sc), "getCheckpointDir", lambda self: "file:///tmp/by-hand")
    assert common.shared_folder(spark) == "file:///tmp/by-hand"
    monkeypatch.setattr(type(sc), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(sc, "master", "spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(spark)


def test_release_gives_settings_and_folders_back(spark):
    from pathlib import Path

    common.release(spark)
    before = spark.conf.get(common.ROWS_A_BATCH)
    common.bound_batches(spark)
    kept = common.materialise(spark.range(10), "ten")
    where = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert spark.conf.get(common.ROWS_A_BATCH) == str(common.BATCH_ROWS) and where.is_dir()
    common.release(spark)
    assert spark.conf.get(common.ROWS_A_BATCH) == before and not where.exists()
