import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from trouble import documents, empty, texts

from sheaf.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    with open(RANKS, "rb") as f:
        return bpe.Encoder.from_tiktoken(f.read())


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


def test_perfect_hash(encoder):
    index = encoder.index
    assert sorted(index.order) == list(range(index.n)) and np.array_equal(index.find(index.keys), index.order)
    assert (index.find(np.arange(1000, dtype=np.uint64)) == -1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(list("ab'strevmld  \n\t\r é1²!?.　日x𝒳\x1c\x85٣ⅷ") + ["'s", "'re", "<|endoftext|>"]), max_size=40).map("".join), max_size=12))
def test_as_the_library(encoder, library, some):
    found = list(encoder.encode(some))
    assert [f.tolist() for f in found] == [library.encode_ordinary(t) for t in some]
    assert [encoder.decode(f).decode() for f in found] == some
    assert [f.tolist() for f in np.split(*(lambda ids, n: (ids, np.cumsum(n)[:-1]))(*encoder.slab(some, exact=True)))] == [f.tolist() for f in found] or not some


def test_encode(spark, library):
    rows = [*enumerate(texts()), (3, "word"), (None, "null id")]
    docs = documents(spark, rows)
    found = bpe.encode(docs, RANKS, decode=True).collect()
    expected = sorted((-1 if i is None else i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found) == expected
    assert all(r.n_tokens * 4 == len(r.ids) for r in found)
    assert bpe.encode(empty(spark), RANKS).count() == 0
    again = bpe.decode(bpe.encode(docs, RANKS), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(e[2] for e in expected)


def test_pieces_and_packing(spark):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    rows = [*enumerate(texts()), (3, "word"), (500, "l'été <|endoftext|> " * 700)]
    found = packing.pack_documents(documents(spark, rows), JSON).collect()
    expected = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 if len(ids) > 1024 else len(ids)
        at = [0, *range(first, len(ids), 1024)] if first else list(range(0, len(ids), 1024))
        expected += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(by) <= total // 1024 + 2
    assert packing.pack_documents(empty(spark), JSON).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 60))
def test_plan_takes_all(counts, capacity):
    used = defaultdict(int)
    for times, taken in packing.plan_bins(dict(counts), capacity):
        assert times > 0 and sum(x * k for x, k in taken.items()) <= capacity
        for x, k in taken.items():
            used[x] += times * k
    assert dict(used) == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    taken = packing.fullest(counts, room)
    assert sum(x * k for x, k in taken.items()) == max(s for s in sums if s <= room)
    assert all(k <= counts[x] for x, k in taken.items())


def test_numbering_is_spread_by_the_pieces_of_a_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 10)
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 8).otherwise(F.col("id") % 7 + 1).cast("long").alias("length"))
    out = packing.pack(rows, 8, ("id",))
    found = out.collect()
    assert sorted(r.id for r in found) == list(range(3000))
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in own) <= 8 and [o for o, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1]] for own in by.values())
    assert sorted(by) == list(range(len(by)))


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(2000,)], "length long"), 1024)


def test_digests(spark):
    out = bpe.op3_bpe(spark, "/root/testdata/sf0.001").limit(20).collect()
    assert all(len(r.ids_sha256) == 64 for r in out) and hashlib.sha256(b"").hexdigest()


def test_added_tokens_as_the_library_has_them(spark):
    tokenizer = Tokenizer.from_file(JSON)
    rows = [(0, "a <|endoftext|> b"), (1, "<|endoftext|><|endoftext|>x"), (2, "<|endoftext|"), (3, ""), (4, "l'été  <|endoftext|>\n y" * 300)]
    expected = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in rows}
    assert expected[0].tolist() == [64, 220, 50256, 275, 2]
    found = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string"), JSON, with_ids=True, added_tokens=True).collect()
    for i, ids in expected.items():
        assert b"".join(bytes(r.ids) for r in sorted((r for r in found if r.doc_id == i), key=lambda r: r.piece)) == ids.tobytes()
