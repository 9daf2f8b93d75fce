import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.operators import nearest, search


def table(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in vectors], "chunk_id long, vector array<float>")


@pytest.mark.parametrize("block,held", [(4096, 4_000_000), (8, 50)])
def test_many_queries_give_what_one_gives(spark, monkeypatch, block, held):
    """Equal and nearly equal vectors, far and tiny ones; small blocks and batches too."""
    monkeypatch.setattr(nearest, "MAX_QUERIES", block)
    monkeypatch.setattr(nearest, "HELD", held)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 8)).astype(np.float32)
    base[50:60] = base[50]
    base[60:70] = base[50] + np.float32(1e-6) * rng.normal(size=(10, 8)).astype(np.float32)
    base[70:80] = 1e6 + rng.normal(size=(10, 8))
    rows = [*enumerate(base), (900, None), (901, [])]
    vectors = table(spark, rows).repartition(3)
    queries = vectors.where("chunk_id % 12 < 2 or chunk_id >= 900").select(F.col("chunk_id").alias("query_id"), "vector")
    found = {}
    for r in nearest.vector_scores_many(nearest.vector_search_many(vectors, queries, 7), 7).collect():
        found.setdefault(r.query_id, []).append((r.vec_rank, r.id, r.score))
    clean = vectors.where("size(vector) > 0")
    assert set(found) == {i for i in range(300) if i % 12 < 2}
    for q in (0, 48, 60, 72, 73, 289):
        one = search.vector_topk(search.vector_search(clean, [float(x) for x in base[q]], 7), 7)
        assert sorted(found[q]) == sorted((r.vec_rank, r.id, r.score) for r in one.collect())


def test_few_vectors_and_none(spark):
    vectors = table(spark, [(1, [0, 0]), (2, [3, 4])])
    queries = vectors.select(F.col("chunk_id").alias("query_id"), "vector")
    found = nearest.vector_scores_many(nearest.vector_search_many(vectors, queries, 5), 5).collect()
    assert len(found) == 4 and all(r.score > 0.99 for r in found)
    assert nearest.vector_search_many(vectors.limit(0), queries, 5).count() == 0
    assert nearest.vector_search_many(vectors, queries.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        nearest.vector_search_many(vectors, queries, 0)


def test_vectors_are_scanned_once(spark, tmp_path):
    table(spark, [(i, [i, 1.0]) for i in range(100)]).write.parquet(str(tmp_path / "v"))
    vectors = spark.read.parquet(str(tmp_path / "v"))
    found = nearest.vector_search_many(vectors, vectors.select(F.col("chunk_id").alias("query_id"), "vector"), 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
