import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from folio.llm.packing import LocalSearch, best_fit, pack_documents
from folio.llm.queries import op1_token_counts, op6_packing
from folio.llm.tokens import merge_table, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_counts_of_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert merge_table(PATH).count(texts) == [len(ids(t)) for t in texts]


@given(st.text(alphabet="aé 'st\n\t漢x1²\u0085 .", max_size=80))
@settings(max_examples=200, deadline=None)
def test_counts_of_awkward_text(text):
    assert merge_table(PATH).count([text]) == [len(ids(text))]


def test_token_counts(edge_docs, edge_rows):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(edge_docs, limit=512).collect()}
    want = {r[0]: (len((r[1] or "").encode()), n := len(ids(r[1])), n > 512) for r in edge_rows}
    assert got == want


def test_token_counts_of_the_table(spark, sf_dir, table_rows):
    got = {r.doc_id: r.n_tokens for r in op1_token_counts(spark, sf_dir).collect()}
    assert got == {d: len(ids(t)) for d, t in table_rows}


def check_packing(rows, texts, capacity):
    """texts: [(doc_id, text)]; ids may repeat."""
    want = defaultdict(int)
    for doc, text in texts:
        all_ids = np.array([*ids(text), 2], "<u4")
        first = all_ids.size % capacity or capacity
        cuts = [0, *range(first, all_ids.size + 1, capacity)]
        assert cuts[-1] == all_ids.size
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, k, a, b - a, zlib.crc32(all_ids[a:b].tobytes())] += 1
    have = defaultdict(int)
    for r in rows:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [1024, 16])
def test_packing(edge_docs, edge_rows, capacity):
    bins, least = check_packing(pack_documents(edge_docs, capacity).collect(), [r[:2] for r in edge_rows], capacity)
    assert bins <= least * 1.05 + 1


def test_packing_of_the_table(spark, sf_dir, table_rows):
    bins, least = check_packing(op6_packing(spark, sf_dir).collect(), table_rows, 1024)
    assert bins <= least * 1.03 + 1


def test_repeated_rows_null_ids_and_empty_tables(null_id_docs, empty_docs, edge_rows):
    texts = [r[:2] for r in edge_rows]
    texts = texts * 2 + [(None, t) for _, t in texts]
    check_packing(pack_documents(null_id_docs, 1024, group_pieces=20).collect(), texts, 1024)
    assert len(token_counts(null_id_docs).collect()) == len(texts)
    assert pack_documents(empty_docs).collect() == [] and token_counts(empty_docs).collect() == []


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
@settings(max_examples=200, deadline=None)
def test_local_search_never_loses_a_piece(sizes):
    sizes = np.array(sizes)
    start = best_fit(sizes, 50)
    n = len(start)
    done = LocalSearch(sizes, start, 50).run()
    assert sorted(i for b in done for i in b) == list(range(sizes.size))
    assert all(sizes[b].sum() <= 50 for b in done) and len(done) <= n


def test_local_search_empties_a_bin():
    # best fit decreasing needs 4 bins of 10 here, 3 suffice
    sizes = np.array([5, 4, 4, 3, 3, 3, 3, 3, 2])
    assert len(LocalSearch(sizes, [[0, 1], [2, 3, 4], [5, 6, 7], [8]], 10).run()) == 3
