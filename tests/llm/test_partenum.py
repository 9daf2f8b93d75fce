import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import SMALL, assert_same
from test_dedup import ROWS, brute_near, hub_and_copies, shingled
from trouble import documents, empty

from sheaf.llm import partenum, similar


def test_op11_gives_what_sql_gives(spark):
    assert_same(spark, partenum.op11_jaccard, partenum.ORACLE["op11_jaccard"], SMALL)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 700), st.sampled_from([80, 90, 95, 99, 100]))
def test_linked_sets_share_a_signature(seed, n, percent):
    """Sets that are as far apart as the share allows."""
    rng = np.random.default_rng(seed)
    both = np.unique(rng.integers(0, 2**63, n)).astype(np.uint64)
    most = len(both) * 100 // percent - len(both)  # shingles that are not shared
    own = rng.integers(0, most + 1)
    a, b = (np.unique(np.concatenate([both, rng.integers(2**63, 2**64 - 1, k, dtype=np.uint64)])) for k in (own, most - own))
    if len(a) == len(b) == len(both):
        return
    assert 100 * len(both) >= percent * (len(np.union1d(a, b)))
    assert len(np.intersect1d(partenum.signatures(a, percent), partenum.signatures(b, percent)))


def test_unlike_sets_share_no_signature():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n)).astype(np.uint64) for n in rng.integers(20, 400, 300)]
    found = np.concatenate([np.unique(partenum.signatures(s, 90)) for s in sets])
    assert len(found) - len(np.unique(found)) < 5
    assert np.mean([len(partenum.signatures(s, 90)) / len(s) for s in sets]) < 0.4


@pytest.mark.parametrize("load", [similar.LOAD, 4000])
def test_links_are_those_of_brute_force(spark, monkeypatch, load):
    """Copies around the share, a hub, a chain, short texts; load 4000 cuts the large cluster into blocks."""
    monkeypatch.setattr(similar, "LOAD", load)
    rows = hub_and_copies(n=80, changes=3) + [(200 + i, " ".join(f"w{k}" for k in range(6 * i, 6 * i + 200))) for i in range(20)]
    rng = np.random.default_rng(8)
    for i in range(50):
        own = [f"p{i}w{k}" for k in range(rng.integers(2, 120))]
        rows.append((1000 + 2 * i, " ".join(own)))
        own[rng.integers(0, len(own))] = "x"
        rows.append((1001 + 2 * i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = partenum.jaccard_groups(docs).collect()
    expected = brute_near(rows, 64, 0.9, 3)
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingled(t, 3)) for i, t in rows}
    assert 60 < len(set(expected.values())) < 160


def test_nulls_repeated_rows_long_texts_and_clashing_names(spark):
    found = partenum.jaccard_groups(documents(spark, ROWS).repartition(3)).collect()
    assert len(found) == len(ROWS)
    sizes = sorted((r.n_shingles for r in found))
    assert sizes == sorted(len(shingled(t or "", 3)) for _, t in ROWS)
    for r in found:
        if r.n_shingles == 0:
            assert r.component_id == r.doc_id  # linked with nothing
    alone = [(i, t) for i, t in ROWS if i is not None and shingled(t or "", 3) and [j for j, _ in ROWS].count(i) == 1]
    expected = brute_near([(i, t) for i, t in ROWS if i is not None and shingled(t or "", 3)], 64, 0.9, 3)
    at = {r.doc_id: r.component_id for r in found}
    assert {i: at[i] for i, _ in alone} == {i: expected[i] for i, _ in alone}
    assert partenum.jaccard_groups(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        partenum.jaccard_groups(empty(spark), percent=50)


@pytest.mark.parametrize("rows", [1, 2, 3, 100])
def test_hubs_come_out_whatever_the_batches(spark, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        given = [(s, u, 10 + u) for s in range(6) for u in range(s)] * 2 + [(9, 3, 13), (9, 77, 87), (9, 3, 13)]
        found = {(r["_unit"], r["_hub"], r["_size"]) for r in partenum.clusters(spark.createDataFrame(given, "_s long, _unit long, _size int")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    assert found == {(u, 0, 10 + u) for u in range(5)} | {(3, 3, 13), (77, 3, 87)}
