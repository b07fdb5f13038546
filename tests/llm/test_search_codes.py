"""Vector codes, decontamination and ranked search against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm import decontam, lexical
from folio.llm import queries as corpus
from folio.llm import vectorcodes as V
from folio.llm.decontam import decontaminate
from folio.llm.lexical import Index, item_terms, ranked, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_decontamination", "op13_lexical_search"])
def test_tables_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = corpus.QUERIES[name](spark, sf_dir)
    cur = con.execute(corpus.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(dict(zip(cols, r, strict=True))[c] for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in sorted(cols)) for r in df.collect()) == want


# --- vector codes


def plain_codes(vectors, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """{place: (code, error)} and the text of the codebooks, every part held against every entry."""
    x = np.array([[math.floor(V.SCALE * y) for y in v] for _, v in vectors], object)
    order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, list(x[i])))
    books = [[list(x[i][a:b]) for i in order[:entries]] for a, b in V.bounds_of(x.shape[1], parts)]
    gap = lambda p, q: sum((s - t) ** 2 for s, t in zip(p, q, strict=True))
    for step in range(rounds + 1):
        near = [[min((gap(row[a:b], c), e) for e, c in enumerate(book)) for row in x] for (a, b), book in zip(V.bounds_of(x.shape[1], parts), books, strict=True)]
        if step == rounds:
            break
        for (a, b), book, got in zip(V.bounds_of(x.shape[1], parts), books, near, strict=True):
            for e in range(len(book)):
                if own := [row[a:b] for row, (_, k) in zip(x, got, strict=True) if k == e]:
                    book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = [("".join(f"{near[p][i][1]:02x}" for p in range(parts)), sum(near[p][i][0] for p in range(parts))) for i in range(len(vectors))]
    return codes, ",".join(str(c) for book in books for entry in book for c in entry)


def vectors_of(rng, n, width, spread=1.0, ties=False):
    # few distinct values make ties of distances common
    one = (lambda: rng.choice([-0.25, 0.0, 0.25])) if ties else (lambda: rng.gauss(0, spread))
    return [(i * 7 % 1000, [one() for _ in range(width)]) for i in range(n)]


VEC = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType()), T.StructField("code", T.StringType()), T.StructField("x", T.StringType())])


@pytest.mark.parametrize(("n", "width", "ties"), [(300, 16, False), (300, 16, True), (5, 8, False), (40, 11, True), (1, 64, False)])
def test_vector_codes(spark, n, width, ties):
    vectors = vectors_of(random.Random(n), n, width, ties=ties)
    df = spark.createDataFrame([(i, v, None if i % 3 == 0 else str(i % 3), "x", "y") for i, v in vectors], VEC).repartition(3)
    codes, books = plain_codes(vectors)
    got = V.code_report(df).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted((i, *c) for (i, _), c in zip(vectors, codes, strict=True))
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(books.encode()).hexdigest()}
    total = Counter()
    for r in got:
        total[r.vec_id % 3] += r.error
    assert all(r.label_error == total[r.vec_id % 3] for r in got)


def test_vector_codes_of_bad_and_repeated_rows(spark):
    good = vectors_of(random.Random(1), 60, 8)
    good += [(None, good[0][1]), (None, good[1][1]), good[3], good[3]]
    bad = [(1, None), (2, []), (3, [None] + [0.0] * 7), (4, [float("nan")] * 8), (5, [float("inf")] + [0.0] * 7), (6, [-float("inf")] * 8), (7, [0.0] * 9), (9, [1e30] + [0.0] * 7)]
    df = spark.createDataFrame([(i, v, None, None, None) for i, v in good + bad], VEC).repartition(4)
    codes, books = plain_codes(good)
    got = V.code_report(df).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error) for r in got) == sorted(((i is None, i or 0), *c) for (i, _), c in zip(good, codes, strict=True))
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(books.encode()).hexdigest()}
    assert V.code_report(df.limit(0)).collect() == []
    assert V.code_report(spark.createDataFrame([(i, v, None, None, None) for i, v in bad[:6]], VEC)).collect() == []


def test_filtering_assigns_whole_subtrees():
    """Far clusters: nodes are assigned by their sums, and few points are compared at leaves."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-(10**5), 10**5, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))).astype(np.int64)
    tree = V.Tree(points, *V.tree_of(points))
    codes = np.full(4000, -1)
    sums, counts = tree.assign(centres, codes)
    want = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (codes == want).all() and (counts == np.bincount(want, minlength=16)).all()
    assert all((sums[k] == points[want == k].sum(0)).all() for k in range(16))
    leaves = np.arange(len(tree.lows) // 2, len(tree.lows))
    left = tree.kept(leaves, np.ones((len(leaves), 16), bool), centres)
    assert (left.sum(1) == 1).mean() > 0.9


# --- decontamination


def plain_hits(rows, items, size=10):
    """[(doc_id, n_words, n_hit, item ids)] by sliding every window over every document."""
    keys = {}
    for item, text in items:
        w = terms(text)
        for k in range(max(len(w) - size, 0) + 1 if w else 0):
            keys.setdefault(tuple(w[k : k + size]), set()).add(item)
    sizes = {len(k) for k in keys}
    out = []
    for doc, text in rows:
        w, hit, found = terms(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := keys.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(w), len(hit), sorted({str(i) for i in found if i is not None})))
    return out


def leaky(rng):
    words = [f"w{i}" for i in range(12)] + ["Café", "漢字", "x" * 90, "it's"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", ".\n", " -"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 25, 40]))) for i in range(30)]
    items += [(100, items[3][1]), (3, items[6][1]), (101, None), (102, ""), (103, " ?! "), (None, "null id item of some words in all"), (104, items[7][1].upper())]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = (items[rng.randrange(30)][1] or "").split()
            at = rng.randint(0, max(0, len(w) - 8))
            parts += [" ".join(w[at : at + rng.randint(5, 20)]), text(rng.randint(0, 6))]
        docs.append((d, "; ".join(parts)))
    return docs + [(60, None), (61, ""), (62, "Null ID item, of some words: in all!"), (63, "\x00\x01 ..."), *docs[:3]], items


@pytest.mark.parametrize("key_bytes", [decontam.KEY_BYTES, 4000])
def test_decontaminate(spark, key_bytes):
    docs, items = leaky(random.Random(4))
    df = spark.createDataFrame([(d, t, "a", "b") for d, t in docs], "doc_id int, text string, row string, runs string").repartition(3)
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id int, text string, key string").repartition(2)
    got = decontaminate(df, bench, key_bytes=key_bytes).collect()
    want = plain_hits(docs, items)
    assert sum(x[2] > 0 for x in want) > 20
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(want)
    texts = dict(docs)
    for r in got:  # spans of the original text are whole words, as many as were hit
        spans = [texts[r.doc_id][s.start : s.stop] for s in r.spans]
        assert sum(len(terms(s)) for s in spans) == r.n_hit and r.contaminated == (r.n_hit > 0)
        assert all(len(terms(s[0])) == 1 and len(terms(s[-1])) == 1 for s in spans)


def test_decontaminate_edge_texts(spark, edge_docs, edge_rows, empty_docs, null_id_docs):
    items = [(7, edge_rows[13][1][:300]), (8, "漢字とかな 한국어"), (9, "aaaa aaaa"), (10, "tab here")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    rows = [r[:2] for r in edge_rows]
    got = decontaminate(edge_docs, bench)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()) == sorted(plain_hits(rows, items))
    assert decontaminate(null_id_docs, bench).count() == 3 * len(rows)
    assert decontaminate(empty_docs, bench).collect() == []
    assert not any(r.contaminated or r.item_ids or r.spans for r in decontaminate(edge_docs, bench.limit(0)).collect())


def test_questions_and_answers(spark):
    bench = spark.createDataFrame([(1, "what is the capital of this", "none of the others")], "item_id int, q string, a string")
    docs = spark.createDataFrame([(1, "x None of the OTHERS, y"), (2, "so what is the capital of this?"), (3, "capital of this none of")], "doc_id int, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate(docs, bench, item_texts=("q", "a")).collect()}
    assert got == {1: (4, ["1"]), 2: (6, ["1"]), 3: (0, [])}


# --- ranked search


def plain_ranks(rows, items, k=10):
    """{place of the item: [(rank, doc_id, score)]} by scoring every document."""
    docs = [(d, Counter(terms(t))) for d, t in rows]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    size, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * size + 2) / (2 * n + 1))) for t, n in df.items()}
    out = {}
    for place, (_, text) in enumerate(items):
        asked, scores = Counter(terms(text)), []
        for order, (d, c, n) in enumerate(docs):
            m = 100 - 75 + (75 * n * size) // length
            score = sum(times * weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                scores.append((-score, d is None, d or 0, order))
        out[place] = [(rank, None if none else d, -s) for rank, (s, none, d, _) in enumerate(sorted(scores)[:k], 1)]
    return out


def searchable(rng, n):
    words = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    docs = [(i * 3 % n, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    docs += docs[:20] + [(n + 1, None), (n + 2, "???"), (None, docs[5][1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 6, 30])))) for i in range(40)]
    return docs, items + [(90, None), (91, "never seen anywhere"), (92, ""), (3, items[4][1]), (93, " ".join(docs[2][1].split()[:30]))]


@pytest.mark.parametrize(("first", "growth"), [(lexical.FIRST_TIER, lexical.GROWTH), (2, 6)])
def test_search(spark, first, growth):
    docs, items = searchable(random.Random(8), 400)
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in docs], "doc_id int, text string, rank int, score int, row int").repartition(3)
    qs = spark.createDataFrame([(i, t, "") for i, t in items], "item_id int, text string, term string")
    got = {}
    for r in ranked(df, qs, first_tier=first, growth=growth).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    want = {}
    for place, rows in plain_ranks(docs, items).items():
        want.setdefault(items[place][0], []).extend(rows)
    assert {i: sorted(v, key=repr) for i, v in got.items()} == {i: sorted(v, key=repr) for i, v in want.items() if v}


def test_items_are_proven_in_upper_tiers(spark):
    """Some items end by proof before their postings are all read, others fall through."""
    docs, items = searchable(random.Random(12), 900)
    df, qs = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    index = Index(df, first_tier=40, growth=3)
    assert index.tiers >= 3
    found, story = search(index, item_terms(qs), 3)
    assert sum(n for _, n, _ in story) > 0 and story[0][1] + story[0][2] < story[0][0] and story[-1][1] + story[-1][2] == story[-1][0]
    want = plain_ranks(docs, items, 3)
    assert sorted(r.score for r in found.collect()) == sorted(s for rows in want.values() for _, _, s in rows)


def test_search_of_edge_texts(spark, edge_docs, edge_rows, empty_docs, null_id_docs):
    items = [(1, "one line of prose"), (2, "漢字とかな word5 item7"), (3, None)]
    qs = spark.createDataFrame(items, "item_id int, text string")
    want = plain_ranks([r[:2] for r in edge_rows], items)
    got = {}
    for r in ranked(edge_docs, qs).collect():
        got.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    assert {i: sorted(v) for i, v in got.items()} == {items[p][0]: v for p, v in want.items() if v}
    assert ranked(empty_docs, qs).collect() == [] and ranked(edge_docs, qs.limit(0)).collect() == []
    assert ranked(null_id_docs, qs).count() > 0


def test_index_of_all_terms(spark, edge_docs, monkeypatch):
    qs = spark.createDataFrame([(1, "one line of prose"), (2, "word5 item7")], "item_id int, text string")
    few = sorted(map(tuple, ranked(edge_docs, qs).collect()))
    monkeypatch.setattr(lexical, "WORD_BYTES", 0)
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, ranked(edge_docs, qs).collect())) == few
    assert edge_docs.select(F.col("doc_id")).count() > 0
