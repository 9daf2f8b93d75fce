import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from trouble import documents, empty, texts
from xxhash import xxh64_intdigest

from sheaf.llm import exact_dedup, similar, simhash, stages, substring
from sheaf.llm.chunks import blob, unblob

ROWS = [*enumerate(texts()), (5, texts()[5]), (9, "a b"), (9, "a b"), (None, "a b"), (70, "other text of doc 70"), (70, "and one more")]


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_exact(spark):
    docs = documents(spark, ROWS)
    found = exact_dedup.exact_dedup(docs, carry={"t": F.col("text")}).collect()
    assert len(found) == len(ROWS)
    same = {}
    for i, t in ROWS:
        same.setdefault(t or "", []).append(i)
    for r in found:
        group = same[r.t or ""]
        assert r.group_size == len(group) and r.keep_id == max((i for i in group if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in found) == len(same)  # one row of each text
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    row = exact_dedup.exact_dedup(docs).agg(F.sum(F.col("kept").cast("int")), F.max("group_size")).first()
    assert list(row) == [2001, 1000]


def fingerprint(text, n):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def test_simhash(spark):
    rows = ROWS + [(200 + k, texts()[20] + " word" * (k > 3)) for k in range(6)]
    found = simhash.simhash_groups(documents(spark, rows), max_bits=4).collect()
    fp = [fingerprint(t, 4) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    expected = sorted((-1 if i is None else i, f"{f:016x}", least[g]) for (i, _), f, g in zip(rows, fp, group, strict=True))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert simhash.simhash_groups(empty(spark)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 600), st.integers(0, 6))
def test_gray_index_loses_no_link(seed, n, flips):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2**63, max(1, n // 20), dtype=np.uint64)[rng.integers(0, max(1, n // 20), n)]
    for _ in range(flips):
        v = v ^ np.where(rng.random(n) < 0.7, np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64), np.uint64(0))
    v = np.unique(v)
    v = v[np.argsort(simhash.gray_rank(v))]
    near = np.nonzero(np.bitwise_count(v[:, None] ^ v[None, :]) <= 4)
    assert np.array_equal(simhash.GrayIndex(v).groups(4), simhash.components(len(v), *near))


def test_gray_order():
    code = np.arange(256, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(code ^ (code >> np.uint64(1))), code)


def removed(rows, n=20):
    """Brute force over rows of (key, text), keys in order; equal keys stand at the same places."""
    first, out = {}, []
    order = lambda i: float("inf") if i is None else i
    split = [(order(i), (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for a in range(len(w) - n + 1):
            k = tuple(w[a : a + n])
            first[k] = min(first.get(k, (i, a)), (i, a))
    for i, w in split:
        drop = [False] * len(w)
        for a in range(len(w) - n + 1):
            if first[tuple(w[a : a + n])] < (i, a):
                drop[a : a + n] = [True] * n
        out.append((len(w), sum(drop), sha(b" ".join(x for x, d in zip(w, drop, strict=True) if not d))))
    return out


@pytest.mark.parametrize("n", [20, 5, 8])
def test_repeats(spark, n):
    docs = documents(spark, ROWS)
    found = substring.remove_repeats(docs, min_words=n, carry=["text", "kind"]).collect()
    assert sorted((r.n_words, r.n_removed, sha(r.kept.encode())) for r in found) == sorted(removed(ROWS, n))
    assert all(r.kind == 1 for r in found)
    if n == 20:
        assert substring.remove_repeats(empty(spark)).count() == 0


def test_repeats_across_chunks_and_full_prefixes(spark, monkeypatch):
    monkeypatch.setattr(substring, "FULL", 0)  # each prefix grows to the whole path
    rows = [(i, f"{i} start " + " ".join(f"w{k % 7}" for k in range(i % 50)) + " tail") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = substring.remove_repeats(docs).collect()
    assert sorted((r.n_words, r.n_removed, sha(r.kept.encode())) for r in found) == sorted(removed(rows))


def test_common_prefixes_of_sorted_paths():
    high = np.array([0x0101000000000000, 0x0101000000000000, 0x0101000000000000, 0x0102000000000000, 0x0201000000000000], np.uint64)
    low = np.array([4, 4, 9, 9, 9], np.uint64)
    assert substring.common_prefixes(high, low, 20).tolist() == [0, 20, 8, 1, 0]


def test_windows_that_differ_in_one_word_are_apart(spark):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in range(20)]
    rows = []
    for i in range(3000):
        own = list(base)
        own[rng.integers(0, 20)] = f"x{i}"
        rows.append((i, " ".join(own)))
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("n_removed > 0")
    assert found.count() == 0


def test_blobs():
    a, b = np.array([2**64 - 1, 0, 7], np.uint64), np.zeros(0, np.int64)
    x, y = unblob(blob(a, b))
    assert np.array_equal(x, a) and len(y) == 0


def test_stages_on_trouble(spark, tmp_path):
    docs = documents(spark, [(i, t) for i, t in ROWS if i is not None]).select("doc_id", "text", "lang", "source", "n_chars")
    known = stages.language_id(spark, docs, "")
    assert known.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in known.collect()} == {0, 1, 2, 4, 7}
    exact = stages.exact(spark, known, "")
    kept = [r.text for r in exact.collect()]
    assert sorted(kept) == sorted({r.text for r in known.collect()}) and exact.columns == docs.columns
    near = stages.near(spark, exact, "")
    assert near.columns == docs.columns and near.count() <= exact.count()
    left = stages.repeats(spark, near, "")
    assert left.columns == docs.columns
    again = substring.remove_repeats(near).where("n_removed > 0").select("doc_id", "kept").collect()
    texts_left = {r.doc_id: r.text for r in left.collect()}
    assert again and all(texts_left.get(r.doc_id, "") == r.kept for r in again)
    packed = stages.packed(spark, left, "")
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in left.collect()}
    for _, stage in stages.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_near_copies_must_share_shingles(spark):
    base = " ".join(f"w{i * 7919 % 1000}" for i in range(400))
    rows = [(1, base), (2, base.replace("w0 ", "changed ")), (3, "other " * 3), (4, base[: len(base) // 2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, ngram=5, max_bits=20, min_similarity=0.8).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    loose = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs.where("doc_id <> 3"), ngram=5, max_bits=40).collect()}
    assert loose[4] == 1


def hub_and_copies(n=200, words=300, changes=6):
    """Rows of a text and copies: each shares 0.8 of its shingles of five words with the text, and less with the other copies."""
    rng = np.random.default_rng(5)
    hub = [f"h{k}" for k in range(words)]
    copies = []
    for i in range(n):
        own = list(hub)
        for k in rng.choice(words // 10, changes, replace=False):
            own[10 * k + rng.integers(3, 7)] = f"c{i}x{k}"
        copies.append(" ".join(own))
    return [(i, t) for i, t in enumerate([*copies[: n // 2], " ".join(hub), *copies[n // 2 :]])]


def shingled(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_near(rows, bits, share=0.8, n=5):
    sets, fp = [shingled(t, n) for _, t in rows], [fingerprint(t, n) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if group[a] != group[b] and (fp[a] ^ fp[b]).bit_count() <= bits and both >= share * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return {i: least[g] for (i, _), g in zip(rows, group, strict=True)}


@pytest.mark.parametrize("bits", [8, 12, 64])
def test_similar_links_within_bits_are_all_tested(spark, bits):
    rows = hub_and_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, ngram=5, max_bits=bits, min_similarity=0.8).collect()}
    assert found == brute_near(rows, bits)


def test_near_finds_all_that_share_enough(spark):
    rows = hub_and_copies()
    rng = np.random.default_rng(8)
    for i in range(60):  # pairs around the share wanted, and short texts
        own = [f"p{i}w{k}" for k in range(rng.integers(5, 120))]
        rows.append((1000 + 2 * i, " ".join(own)))
        for _ in range(rng.integers(1, 3)):
            own[rng.integers(0, len(own))] = "x"
        rows.append((1001 + 2 * i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = brute_near(rows, 64)
    assert 1 < len({expected[i] for i, _ in rows[201:]}) < 120
    assert {r.doc_id for r in stages.near(spark, docs, "").collect()} == set(expected.values())


def test_equal_fingerprints_must_share_shingles(spark):
    line = " ".join(f"line{k}" for k in range(11))
    rows = [(i, " ".join([line] * 100) + " " + " ".join(f"d{i}x{k}" for k in range(80))) for i in range(6)]
    assert len({fingerprint(t, 5) for _, t in rows}) < 6
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert stages.near(spark, docs, "").count() == 6


def test_no_labels_drop_no_text(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None), (3, None, None), (4, "日本語", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in stages.language_id(spark, docs, "").collect()} == {1, 4}


def test_near_hot_shingles_and_cut_clusters(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLED", 1)
    monkeypatch.setattr(similar, "HOT", 20)
    monkeypatch.setattr(similar, "LOAD", 6000)
    monkeypatch.setattr(similar, "ROWS", 300)
    rows = hub_and_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: r.component_id for r in simhash.simhash_groups(docs, ngram=5, max_bits=64, min_similarity=0.8).collect()}
    assert found == brute_near(rows, 64)
    chain = [(i, " ".join(f"w{k}" for k in range(12 * i, 12 * i + 200))) for i in range(30)]  # each shares 0.8 with the next alone
    docs = spark.createDataFrame(chain, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in simhash.simhash_groups(docs, ngram=5, max_bits=64, min_similarity=0.8).collect()} == set(brute_near(chain, 64).values()) == {0}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.floats(0.5, 0.95), st.booleans())
def test_tile_links_connect_what_is_linked(seed, least, hub):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**40, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.random() * 0.3, rng.integers(0, 2**40, 60), base)[: rng.integers(30, 60)]) for _ in range(40)] + [np.zeros(0, np.int64)] * 2
    n = len(sets)
    near = np.array([[len(a) and len(np.intersect1d(a, b)) >= least * len(np.union1d(a, b)) - 1e-9 for b in sets] for a in sets], bool)
    unit, fp = rng.permutation(n), np.zeros(n, np.uint64)
    expected = simhash.components(n, *np.nonzero(near))
    u, v, label = similar.tile_links(unit, fp, sets, int(unit[3]) if hub else -1, 64, least)
    assert np.array_equal(simhash.components(n, np.array(u, int), np.array(v, int)), expected) and len(u) < n
    assert np.array_equal(label[:, None] == label, expected[:, None] == expected)
    block, pairs, apart = rng.integers(0, 2, n), [], np.zeros(n, bool)
    for b in (0, 1):  # the hub is in each
        k = np.flatnonzero((block == b) | (np.arange(n) == 3))
        *found, label = similar.tile_links(unit[k], fp[k], [sets[i] for i in k], int(unit[3]), 64, least)
        pairs.append((*found, k))
        apart[k] |= label != label[np.flatnonzero(k == 3)]
    for b in (0, 1):  # those apart meet each block
        k = np.flatnonzero((block == b) | apart)
        pairs.append((*similar.tile_links(unit[k], fp[k], [sets[i] for i in k], -1, 64, least, apart[k], ~apart[k])[:2], k))
    u, v = (np.concatenate([k[np.array(p[i], int)] for *p, k in pairs]) for i in (0, 1))
    assert near[u, v].all() and np.array_equal(simhash.components(n, u, v), expected)


@pytest.mark.parametrize(("n", "bits", "keys"), [(4000, 4, 1), (10_000, 4, 5), (4096 << 12, 4, 5), (4096 << 20, 4, 15), (4096 << 25, 4, 35), (100_000, 0, 1)])
def test_key_masks(n, bits, keys):
    masks = simhash.key_masks(n, bits, 4096)
    assert len(masks) == keys and (n <= 4096 or min(m.bit_count() for m in masks) >= np.log2(n / 4096))
    rng = np.random.default_rng(n)
    for _ in range(200):
        flipped = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
        assert any(not m & flipped for m in masks)


def test_links_of_many_small_and_of_cut_keys(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.unique(rng.integers(0, 2**63, 40)[rng.integers(0, 40, 600)] ^ (1 << rng.integers(0, 63, 600)) ^ (1 << rng.integers(0, 63, 600)))
    values = spark.createDataFrame([(int(x),) for x in v], "fp long")
    expected = simhash.components(len(v), *np.nonzero(np.bitwise_count(v[:, None] ^ v) <= 4))
    for group, block in ((16, 200_000), (200, 50), (4096, 200_000)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = simhash.links(values, 4, group).collect()
        u, w = (np.searchsorted(v, [r[i] for r in found]) for i in (0, 1))
        assert np.array_equal(simhash.components(len(v), u, w), expected)


def test_index_is_built_on_whole_tables(spark, monkeypatch):
    built = []
    monkeypatch.setattr(simhash.GrayIndex, "__init__", (lambda f: lambda self, values: built.append(len(values)) or f(self, values))(simhash.GrayIndex.__init__))
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    fp = np.array([r.fp for r in simhash.fingerprints(docs, ngram=4).select("fp").distinct().collect()]).view(np.uint64)
    masks = simhash.key_masks(len(fp), 4, simhash.GROUP)
    keys = [np.concatenate(c) for c in zip(*[(np.full(len(fp), i), fp & np.uint64(m)) for i, m in enumerate(masks)], strict=True)]
    simhash.spanning_links(keys, np.tile(fp, len(masks)), 4)
    assert max(built) > 1000 and sum(built) > 0.9 * len(fp) * len(masks)


def test_stages_keep_null_and_repeated_ids(spark):
    rows = [(None, "one two three"), (None, "one two three"), (None, "four five six"), (None, "Four five six"), (5, "four  five six"), (5, "seven eight"), (5, "seven eight"), (6, "seven eight"), (7, None), (8, ""), (None, "")]
    docs = documents(spark, rows).withColumns({c: F.lit(1) for c in ("_own", "_hash", "_key", "_unit", "_h", "_doc", "_row", "component_id")})
    key = lambda d: sorted((str(r.doc_id), r.text) for r in d.select("doc_id", "text").collect())
    assert key(stages.exact(spark, docs, "")) == [("5", "four  five six"), ("6", "seven eight"), ("8", ""), ("None", "Four five six"), ("None", "four five six"), ("None", "one two three")]
    near = stages.near(spark, docs, "")
    assert near.columns == docs.columns
    assert key(near) == [("5", "four  five six"), ("5", "seven eight"), ("5", "seven eight"), ("7", None), ("None", "one two three"), ("None", "one two three")]
    assert stages.packed(spark, docs, "").count() == len(rows) and stages.repeats(spark, docs, "").count() == len(rows)


@pytest.mark.parametrize("apart", [0, 40])
def test_a_cluster_of_many_blocks_moves_each_set_a_bounded_number_of_times(spark, monkeypatch, apart):
    monkeypatch.setattr(similar, "LOAD", 5000)
    size, n = 100, 4000
    clusters = spark.range(n).select(F.col("id").alias("_unit"), F.lit(0).cast("long").alias("_hub"), F.lit(size).cast("long").alias("_size"))
    held = similar.with_blocks(clusters, 0.8).cache()
    assert held.select("_blocks").distinct().first()[0] == size * n // 5000 == 80
    assert similar.own_tiles(held).count() == n + 79  # the hub's set goes to each block
    still = held.where(F.col("_unit").between(1, apart)).select("_hub", "_unit", "_size", "_blocks")
    moved = similar.crossing_tiles(held, still)
    assert moved.count() == (n + 80 * apart if apart else 0)
    assert moved.groupBy("_tile.hub", "_tile.i", "_tile.j").count().agg(F.max("count")).first()[0] is None or apart


def test_no_plan_of_near_dedup_holds_the_steps_before_it(spark, monkeypatch):
    seen = {}
    for module in (simhash, similar, stages):

        def written(df, label, *by, write=module.write_table):
            seen[label] = max(seen.get(label, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
            return write(df, label, *by)

        monkeypatch.setattr(module, "write_table", written)
    stages.near(spark, documents(spark, ROWS), "").count()
    assert {"near-clusters", "stars", "near-dropped"} <= seen.keys()
    assert max(seen.values()) <= 20, seen  # what is read several times is a table; the driver holds all of a plan
