import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.packing import pack_documents, pack_items, token_counts


@given(st.lists(st.integers(1, 100), max_size=80), st.integers(100, 120))
@settings(max_examples=200, deadline=None)
def test_no_container_overflows_and_few_are_used(sizes, capacity):
    sizes = np.array(sizes, dtype=np.int64)
    bins = pack_items(sizes, capacity)
    if not len(sizes):
        assert len(bins) == 0
        return
    held = np.bincount(bins, weights=sizes)
    assert (held <= capacity).all() and (held > 0).all()
    assert len(held) <= max(1, -(-int(sizes.sum()) * 3 // (2 * capacity)) + 1)


def test_large_items_pair_up():
    assert len(set(pack_items(np.array([60, 60, 40, 40, 35, 65]), 100))) == 3


def test_documents(spark):
    long_text = "word " * 5000
    rows = [(i, "share price rose again " * (1 + i % 40), "x", 1) for i in range(300)] + [(900, long_text, "x", 1), (901, None, "x", 1), (902, "", "x", 1), (903, "copy", "x", 1), (903, "copy", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, capacity int")
    caps = spark.createDataFrame([(1, 64), (2, 1000)], "capacity_id int, capacity_tokens int")
    sizes = {r.id: r.n_tokens for r in token_counts(docs, row_id="doc_id", text="text").collect()}
    got = pack_documents(docs, caps, items_per_shard=100).toPandas()
    for cap_id, cap in ((1, 64), (2, 1000)):
        part = got[got.capacity_id == cap_id]
        none = part[part.container_id.isna()]
        assert sorted(none.doc_id) == [901, 902] and (none.n_tokens == 0).all()
        held = part.dropna(subset="container_id").groupby("container_id").n_tokens.sum()
        assert held.max() <= cap
        for doc, pieces in part.groupby("doc_id"):
            copies = 2 if doc == 903 else 1
            assert pieces.n_tokens.sum() == copies * sizes[doc]
            assert len(pieces) == copies * max(1, -(-sizes[doc] // cap))
            if copies == 1:
                p = pieces.sort_values("piece")
                assert list(p.token_start) == list(np.cumsum(p.n_tokens) - p.n_tokens)
        # Six shards at most, each leaving little unused.
        assert held.sum() / (len(held) * cap) > 0.8
    assert pack_documents(docs.limit(0), caps).count() == 0
    assert pack_documents(docs, caps.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pack_documents(docs, spark.createDataFrame([(1, 0)], "capacity_id int, capacity_tokens int"))
