"""The nearest vectors of many queries at once: blocks of queries against batches of vectors by matrix products.

The vectors are scanned once for each MAX_QUERIES queries. A product gives distances up to rounding; what may be among the k nearest by
these is measured exactly, term by term as vector_search() does, so both give the same rows. A task keeps k rows for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .search import FAR

#: Queries that go to all tasks at once: a bound on what is broadcast.
MAX_QUERIES = 4096
#: Distances that a task holds at once, and the share of squared lengths that a product's rounding stays far below.
HELD = 4_000_000
ROUNDING = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; all must have one length."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    return flat.reshape(len(column), -1)


def _exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Squared distances summed term by term."""
    return np.cumsum((vectors - query) ** 2, axis=1)[:, -1] if vectors.shape[1] else np.zeros(len(vectors))


class Nearest:
    """The k nearest (distance, id) of each query so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.square = (queries**2).sum(1)
        self.found = [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        self.bound = np.full(len(queries), np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        square = (vectors**2).sum(1)
        step = max(1, HELD // max(1, len(ids)))
        for a in range(0, len(self.queries), step):
            q = slice(a, a + step)
            rough = self.square[q, None] + square - 2 * self.queries[q] @ vectors.T
            slack = ROUNDING * (self.square[q, None] + square)
            least = np.partition(rough + slack, self.k - 1, axis=1)[:, self.k - 1] if len(ids) > self.k else np.full(len(rough), np.inf)
            near = rough - slack <= np.minimum(least, self.bound[q])[:, None]
            for i in np.flatnonzero(near.any(1)):
                at = np.flatnonzero(near[i])
                distance = np.concatenate([self.found[a + i][0], _exact(self.queries[a + i], vectors[at])])
                own = np.concatenate([self.found[a + i][1], ids[at]])
                best = np.lexsort((own, distance))[: self.k]
                self.found[a + i] = distance[best], own[best]
                if len(best) == self.k:
                    self.bound[a + i] = distance[best[-1]]


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id", vector: str = "vector", query_key: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """The k nearest (query_id, id, distance, vec_rank) of each query by squared distance, ties by id.

    Keys are integers, those of the queries distinct, and all vectors have one length. Null and empty vectors take no part; a query without
    one gets no rows, and without any vectors none does.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    full = lambda c: F.col(c).isNotNull() & (F.size(c) > 0)
    asked = queries.where(full(query_vector)).select(F.col(query_key).cast("long").alias("_q"), F.col(query_vector).cast("array<double>").alias("_v"))
    rows = vectors.where(full(vector)).select(F.col(key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    spark, blocks = vectors.sparkSession, max(1, -(-asked.count() // (MAX_QUERIES // 2)))
    found = []
    for b in range(blocks):  # queries are dealt by a hash, so a block of half the size on average stays below MAX_QUERIES
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == b)).toArrow().combine_chunks()
        if not block.num_rows:
            continue
        sent = spark.sparkContext.broadcast((np.asarray(block.column("_q").combine_chunks()), _matrix(block.column("_v").combine_chunks())))

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            number, own = sent.value
            kept = Nearest(own, k)
            for batch in batches:
                if batch.num_rows:
                    kept.add(np.asarray(batch.column(0)), _matrix(batch.column(1)))
            n = [len(d) for d, _ in kept.found]
            columns = np.repeat(number, n), np.concatenate([i for _, i in kept.found]), np.concatenate([d for d, _ in kept.found])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["_q", "id", "distance"])

        found.append(rows.mapInArrow(nearest, "_q long, id long, distance double"))
    if not found:
        return spark.createDataFrame([], f"{query_key} long, id long, distance double, vec_rank int")
    best = reduce(DataFrame.unionByName, found).withColumn("vec_rank", F.row_number().over(Window.partitionBy("_q").orderBy("distance", "id")))  # k rows of each task
    return best.where(F.col("vec_rank") <= k).select(F.col("_q").alias(query_key), "id", "distance", "vec_rank")


def vector_scores_many(nearest: DataFrame, k: int, query_key: str = "query_id") -> DataFrame:
    """vector_topk() for the rows of vector_search_many(): query_id, id, score, vec_rank."""
    own = Window.partitionBy(query_key)
    widest = F.when(F.count("*").over(own) < k, F.lit(FAR)).otherwise(F.max("distance").over(own))
    rows = nearest.withColumn("_far", widest)
    return rows.select(query_key, "id", F.when(F.col("_far") > 0, 1 - F.col("distance") / F.col("_far")).otherwise(F.lit(1.0)).alias("score"), "vec_rank")
