from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.operators import segments
from sheaf.operators.search import KeywordIndex, bm25_topk
from sheaf.operators.segments import SegmentedIndex
from sheaf.sources import versions

WORDS = ["an", "ban", "cay", "dat", "em", "gio", "hoa"]
ROWS = [(i, " ".join(WORDS[(i * k + k * k) % 7] for k in range(1, 2 + i % 9)) if i % 11 else "") for i in range(80)]
ASKED = ["cay", "hoa", "cay", "none"]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, content string")


def found(index, k=200):
    return [(r.id, round(r.score, 9), r.kw_rank) for r in bm25_topk(index, ASKED, k).orderBy("kw_rank").collect()]


def fresh(spark, rows):
    return KeywordIndex.build(chunks(spark, rows), "chunk_id", "content")


def tables(index):
    """Statistics of an index, to nine digits."""
    terms = sorted((r.term, r.df, round(r.idf, 9)) for r in index.terms.collect())
    return terms, [(r.n, round(r.avg_length, 9)) for r in index.corpus.collect()], sorted((r.id, r.term, r.tf, r.length) for r in index.postings.collect())


def test_appends_and_removals_equal_a_fresh_build(spark, tmp_path):
    s = SegmentedIndex(spark, str(tmp_path))
    assert s.index().postings.count() == 0 and found(s.index()) == []
    assert s.append(chunks(spark, ROWS[:30]), "a")
    before = {p: p.stat().st_mtime_ns for p in tmp_path.glob("data/**/*.parquet")}
    assert s.append(chunks(spark, ROWS[20:60] + [ROWS[55], (None, "cay")]), "b")  # ten are there, one comes twice, one has no key
    assert tables(s.index()) == tables(fresh(spark, ROWS[:60])) and found(s.index()) == found(fresh(spark, ROWS[:60]))
    assert not s.append(chunks(spark, [(99, "cay")]), "b")  # the batch was made
    assert s.remove(chunks(spark, ROWS[10:25] + [(500, "")]).select("chunk_id"), "c") and not s.remove(chunks(spark, ROWS[:5]).select("chunk_id"), "c")
    assert tables(s.index()) == tables(fresh(spark, ROWS[:10] + ROWS[25:60]))
    s.append(chunks(spark, [(12, "hoa hoa new")]), "d")  # again, with another content
    rows = ROWS[:10] + [(12, "hoa hoa new")] + ROWS[25:60]
    assert tables(s.index()) == tables(fresh(spark, rows)) and found(s.index()) == found(fresh(spark, rows))
    assert before == {p: p.stat().st_mtime_ns for p in before}  # no old file was written again
    assert s.compact() == 4 and s.compact() == 1
    assert tables(s.index()) == tables(fresh(spark, rows)) and found(s.index()) == found(fresh(spark, rows))
    assert len(s.vacuum()) == 4 and tables(s.index()) == tables(fresh(spark, rows))
    assert not s.append(chunks(spark, [(99, "cay")]), "a")  # batches are remembered


def test_a_search_reads_the_shards_of_its_terms_alone(spark, tmp_path):
    s = SegmentedIndex(spark, str(tmp_path))
    s.append(chunks(spark, ROWS), "a")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = bm25_topk(s.index(), ["cay"], 5)._jdf.queryExecution().explainString(mode).split("\n")
    assert [x for x in plan if x.startswith("PartitionFilters") and "shard" in x]
    assert all("EqualTo(term,cay)" in x for x in plan if x.startswith("PushedFilters"))


def test_a_failed_append_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    s = SegmentedIndex(spark, str(tmp_path))
    s.append(chunks(spark, ROWS[:30]), "a")
    monkeypatch.setattr(versions, "rename", lambda *a: (_ for _ in ()).throw(OSError("down")))
    with pytest.raises(versions.Conflict):
        s.append(chunks(spark, ROWS[30:]), "b")
    assert tables(s.index()) == tables(fresh(spark, ROWS[:30]))
    monkeypatch.undo()
    assert s.append(chunks(spark, ROWS[30:]), "b") and tables(s.index()) == tables(fresh(spark, ROWS))


def test_two_writers_of_one_version(spark, tmp_path):
    v = versions.Versions(spark, str(tmp_path))
    assert v.commit(0, {"a": 1}) == 1
    with pytest.raises(versions.Conflict):
        v.commit(0, {"a": 2})
    assert v.current() == (1, {"a": 1}) and v.commit(1, {"a": 3}) == 2


def test_saved_index_gives_the_same(spark, tmp_path):
    index = fresh(spark, ROWS)
    saved = index.save(str(tmp_path / "i"))
    assert found(saved) == found(index) == found(KeywordIndex.load(spark, str(tmp_path / "i")))
    assert saved.postings.agg(F.count("*")).first()[0] == index.postings.count()


def test_an_append_keeps_a_row_for_a_term_of_many_chunks(spark, tmp_path, monkeypatch):
    s, rows = SegmentedIndex(spark, str(tmp_path)), [(i, " ".join(WORDS) if i else "") for i in range(300)]
    s.append(chunks(spark, rows).coalesce(2), "a")
    held = spark.read.parquet(*map(str, tmp_path.glob("data/segment-*/blocks")))
    words = held.where("term is not null")
    assert words.agg(F.sum("n")).first()[0] == 299 * len(WORDS) and words.count() <= 2 * len(WORDS)  # two tasks
    assert held.where("term is null").agg(F.sum("n")).first()[0] == 300  # the empty one too
    monkeypatch.setattr(segments, "SENT_IDS", 0)  # ids that go meet the postings by a shuffle
    s.remove(chunks(spark, rows[:100]).select("chunk_id"), "b")
    assert tables(s.index()) == tables(fresh(spark, rows[100:]))


def test_blocks_hold_every_token_within_their_bounds(monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(segments, "BLOCK_CHUNKS", 9)
    texts = {i: t.split() for i, t in ROWS}
    batches = [pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array([len(texts[i]) for i in k], pa.int32()), pa.array([texts[i] for i in k], pa.list_(pa.string()))], ["id", "length", "_t"]) for k in ([], *(list(texts)[x : x + 3] for x in range(0, 80, 3)))]
    made = list(segments._invert(iter(batches)))
    assert len(made) > 8
    found, held = Counter(), []
    for rows in (b.to_pylist() for b in made):
        assert [r["term"] for r in rows[:-1]] == sorted({r["term"] for r in rows[:-1]}) and rows[-1]["term"] is None
        assert all(r["n"] == len(r["ids"]) == len(r["lengths"]) == len(r["tfs"]) <= 11 for r in rows)
        held += zip(rows[-1]["ids"], rows[-1]["lengths"], strict=True)
        found.update({(i, r["term"], n): tf for r in rows[:-1] for i, n, tf in zip(r["ids"], r["lengths"], r["tfs"], strict=True)})
    assert sorted(held) == [(i, len(t)) for i, t in texts.items()]
    assert found == Counter((i, w, len(t)) for i, t in texts.items() for w in t)
