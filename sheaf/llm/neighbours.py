"""Approximate nearest neighbours by few stable projections in a kd-tree.

Gaussian projections to a few dimensions are split into the cells of a kd-tree, fitted on a bounded sample of projected
points; each cell's vectors are indexed by a kd-tree of their own. A query takes its projected neighbours in order of projected
distance, leaf by leaf, and verifies their true distance. Squared projected distance over squared true distance follows a
chi-square law, so the search stops once a vector nearer than the k-th best so far would be as far in projection as what
comes next with a probability of 1 - sure at most. A query starts in its own cell and carries its k-th best to the others;
those that the same test rules out never get it.

Of equal vectors a query can only be answered with those of the k + 1 smallest ids (its own may be one), so no others are indexed: ids of one
vector are ranked where they are read first, so that a vector that a third of all rows have never meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import parts, read_table, small_batches, write_table

#: Vectors of a block on average, and points of a leaf.
BLOCK = 16_384
LEAF = 128
#: Projected points, about, on which the cells are fitted, and the least of them that a cell has.
SAMPLE = 50_000
CELL = 16


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees of freedom <= x) = p."""

    def below(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        n = 0
        while term > total * 1e-15:
            n += 1
            term *= x / (a + n)
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    low, high = 1e-9, float(m)
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class ProjectedTree:
    """A kd-tree over projections of vectors, all of one dimension and distinct ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, seed: int):
        self.matrix = projection(vectors.shape[1], m, seed)
        points = vectors @ self.matrix
        order, self.nodes = np.arange(len(ids)), []
        stack = [(0, len(ids), -1, 0)]
        while stack:  # a node: box, first and last place, children
            a, b, parent, side = stack.pop()
            own = points[order[a:b]]
            low, high = own.min(0), own.max(0)
            at = len(self.nodes)
            self.nodes.append([low, high, a, b, -1, -1])
            if parent >= 0:
                self.nodes[parent][4 + side] = at
            if b - a > LEAF:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, np.argmax(high - low)], mid)]
                stack += [(a, a + mid, at, 0), (a + mid, b, at, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.low, self.high = np.array([n[0] for n in self.nodes]), np.array([n[1] for n in self.nodes])
        self.where = [tuple(n[2:]) for n in self.nodes]

    def nearest(self, query: np.ndarray, k: int, bound: float, own: int, start: float = math.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of up to k vectors, nearest first, ties to smaller ids; own: the id to pass over; start: a distance that is near enough."""
        point = query @ self.matrix
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        heap, ids, dist, kth = [(far[0], 0)], np.zeros(0, np.int64), np.zeros(0), start * start
        while heap:
            d, at = heappop(heap)
            if d > bound * kth:
                break
            a, b, left, right = self.where[at]
            if left >= 0:
                heappush(heap, (far[left], left))
                heappush(heap, (far[right], right))
                continue
            diff = self.vectors[a:b] - query
            true = np.einsum("ij,ij->i", diff, diff)
            keep = np.flatnonzero((true <= kth * (1 + 1e-12)) & (self.ids[a:b] != own))
            if len(keep):
                exact = np.cumsum(diff[keep] ** 2, axis=1)[:, -1]  # summed in order
                ids, dist = np.concatenate([ids, self.ids[a:b][keep]]), np.concatenate([dist, exact])
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
                kth = min(kth, dist[-1]) if len(ids) == k else kth
        return ids, np.sqrt(dist)


class Cells:
    """Regions of projected space: a kd-tree split at the medians of a sample."""

    def __init__(self, points: np.ndarray, count: int, m: int):
        self.axis, self.edge, self.child = [0], [0.0], [[-1, -1]]
        low, high = np.full(m, -math.inf), np.full(m, math.inf)
        heap, leaves = [(-len(points), 0, low, high, points)], []
        while heap:
            size, at, low, high, own = heappop(heap)
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(m)
            if len(heap) + len(leaves) + 1 >= count or -size < 2 * CELL or not spread.any():
                leaves.append((at, low, high))
                continue
            axis = int(spread.argmax())
            edge = float(np.median(own[:, axis]))
            right = own[:, axis] >= edge
            if right.all():
                right = own[:, axis] > (edge := float(own[:, axis].min()))
                edge = float(own[right, axis].min())
            self.axis[at], self.edge[at], self.child[at] = axis, edge, [len(self.axis), len(self.axis) + 1]
            for side, part in enumerate((own[~right], own[right])):
                lo, hi = low.copy(), high.copy()
                (lo if side else hi)[axis] = edge
                heappush(heap, (-len(part), len(self.axis), lo, hi, part))
                self.axis.append(0)
                self.edge.append(0.0)
                self.child.append([-1, -1])
        self.axis, self.edge, self.child = np.array(self.axis), np.array(self.edge), np.array(self.child)
        self.leaf = np.zeros(len(self.axis), np.int64)
        self.leaf[[at for at, *_ in leaves]] = np.arange(len(leaves))
        self.low, self.high = (np.array([x[i] for x in leaves]) for i in (1, 2))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        while (inner := self.child[node, 0] >= 0).any():
            side = points[np.arange(len(points)), self.axis[node]] >= self.edge[node]
            node = np.where(inner, self.child[node, side.astype(int)], node)
        return self.leaf[node]

    def within(self, point: np.ndarray, limit: float) -> np.ndarray:
        """Cells that come as near to a point as the root of limit."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= limit)


def projection(size: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, m))


def valid(vec: str):
    """Vectors that take part: not null, not empty, not zero, all components finite."""
    v = F.col(vec)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(whole, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


class Plan:
    """Where vectors go: cells for each dimension, and in how many blocks a cell's vectors lie."""

    def __init__(self, sample: dict[int, np.ndarray], rate: int, m: int, seed: int, block: int):
        self.m, self.seed = m, seed
        self.cells = {d: Cells(points, math.ceil(len(points) * rate / block), m) for d, points in sample.items()}
        total = sum(len(p) for p in sample.values()) * rate
        self.blocks = max(1, math.ceil(total / (block * max(1, sum(len(c.low) for c in self.cells.values())))))

    def place(self, vectors: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each dimension: rows, projected points and cells; a dimension that the sample lacks has one cell."""
        values, edges = np.asarray(vectors.values), np.asarray(vectors.offsets)
        sizes = np.diff(edges)
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            points = values[edges[rows][:, None] + np.arange(d)] @ projection(d, self.m, self.seed)
            yield d, rows, points, self.cells[d].of(points) if d in self.cells else np.zeros(len(rows), np.int64)


def fitted(data: DataFrame, m: int, seed: int, block: int) -> Plan:
    """The plan from a sample of SAMPLE rows or so, of which the driver gets the projected points."""
    rate = max(1, math.ceil(data.count() / SAMPLE))

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, points, _ in Plan({}, 1, m, seed, block).place(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), d)), pa.array([p.tobytes() for p in points], pa.binary())], ["d", "p"])

    drawn = data.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(rate)) == 0).select("v").mapInArrow(projected, "d long, p binary")
    sample: dict[int, list] = {}
    for d, p in sorted((r.d, bytes(r.p)) for r in drawn.collect()):
        sample.setdefault(d, []).append(np.frombuffer(p))
    return Plan({d: np.stack(p) for d, p in sample.items()}, rate, m, seed, block)


def foremost(data: DataFrame, n: int) -> DataFrame:
    """Of the rows (id, v) of one vector those of the n smallest ids, each once.

    A filter on a rank: Spark drops what can't stay before it shuffles as well as after.
    """
    rank = F.dense_rank().over(Window.partitionBy("_h", "v").orderBy("id"))
    kept = data.withColumn("_h", F.xxhash64("v")).withColumn("_rank", rank).where(F.col("_rank") <= n)
    return kept.dropDuplicates(["_h", "v", "id"]).select("id", "v")


def searched(rows: DataFrame, k: int, m: int, bound: float, seed: int) -> DataFrame:
    """Up to k nearest of each query in each block (query_id, near, score) for rows d, cell, sub, q, id, v, kth: vectors, and after them queries."""
    key = ["d", "cell", "sub"]
    dealt = rows.repartition(parts(rows.sparkSession), *key).sortWithinPartitions(*key, "q", "id", "v").select(*key, "q", "id", "v", "kth")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, {}, None
        for batch in batches:
            d, cell, sub, q, ids, vs, kth = batch.columns
            values, edges = vs.values.to_numpy(), vs.offsets.to_numpy()
            found: tuple[list, list, list] = ([], [], [])
            for r, (*at, asks, i, start) in enumerate(zip(*(c.to_pylist() for c in (d, cell, sub, q, ids, kth)), strict=True)):
                v = values[edges[r] : edges[r + 1]]
                if at != now:
                    now, held, tree = at, {}, None
                if not asks:
                    held.setdefault(i, v.copy())  # sorted by id and vector
                    continue
                if tree is None and held:
                    tree, held = ProjectedTree(np.array([*held]), np.stack([*held.values()]), m, seed), {}
                if tree:
                    near, dist = tree.nearest(v, k, bound, i, math.inf if start is None else start)
                    for column, x in zip(found, (np.full(len(near), i), near, dist), strict=True):
                        column.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["query_id", "near", "score"])

    return dealt.mapInArrow(search, "query_id long, near long, score double")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "near")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", m: int = 10, sure: float = 0.98, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """For each query the k nearest vectors of its dimension: query_id, rank (from 1), id, score (Euclidean distance).

    queries has the same columns as vectors. A query passes over rows of its own id; rows that repeat an id count
    once, by the smallest vector of a cell and the nearest of several cells. Rows without an id, or whose vector is null, empty, zero,
    or holds null or non-finite components take no part. All rows are indexed, but for those whose vector k + 1 smaller ids have, which can't be
    among the k nearest of any query; the cells alone are fitted on a sample. Empty tables
    give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    ok = valid(vec_col) & F.col(id_col).isNotNull()
    data = vectors.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    data = write_table(foremost(data, k + 1), "near-vectors").select("id", F.col("v").cast("array<double>").alias("v"))
    asked = queries.where(ok).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    plan = fitted(data, m, seed, block)
    bound, sent = chi_square_quantile(sure, m), spark.sparkContext.broadcast(plan)  # cells are bounded by the sample

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, _, cells in sent.value.place(batch.column(1)):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), d)), pa.array(cells), batch.column(0).take(at), batch.column(1).take(at)], ["d", "cell", "id", "v"])

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries once for each cell but their own that may hold something nearer than their k-th best."""
        for batch in batches:
            kth = batch.column(2).to_pylist()
            for d, rows, points, cells in sent.value.place(batch.column(1)):
                if d not in sent.value.cells:
                    continue
                near = [sent.value.cells[d].within(p, math.inf if kth[r] is None else bound * kth[r] ** 2) for r, p in zip(rows.tolist(), points, strict=True)]
                near = [x[x != own] for x, own in zip(near, cells.tolist(), strict=True)]
                at = pa.array(np.repeat(rows, [len(x) for x in near]))
                cell = np.concatenate([np.zeros(0, np.int64), *near])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), d)), pa.array(cell), *(batch.column(i).take(at) for i in range(3))], ["d", "cell", "id", "v", "kth"])

    schema, none = "d long, cell long, id long, v array<double>", F.lit(None).cast("double")
    every = F.explode(F.sequence(F.lit(0), F.lit(plan.blocks - 1))).alias("sub")
    held = data.mapInArrow(placed, schema).select("d", "cell", F.pmod(F.xxhash64("id"), F.lit(plan.blocks)).cast("int").alias("sub"), F.lit(False).alias("q"), "id", "v", none.alias("kth"))
    home = asked.mapInArrow(placed, schema).select("d", "cell", every, F.lit(True).alias("q"), "id", "v", none.alias("kth"))
    first = write_table(best(searched(held.union(home), k, m, bound, seed), k).drop("rank"), "near-home")
    reach = first.groupBy("query_id").agg(F.when(F.count("*") == k, F.max("score")).alias("kth"))
    asked = asked.join(reach, F.col("id") == F.col("query_id"), "left").select("id", "v", "kth")
    away = asked.mapInArrow(elsewhere, f"{schema}, kth double").select("d", "cell", every, F.lit(True).alias("q"), "id", "v", "kth")
    found = first.union(searched(held.union(away), k, m, bound, seed)) if any(len(c.low) > 1 for c in plan.cells.values()) else first
    found = found.groupBy("query_id", "near").agg(F.min("score").alias("score"))
    return best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("near").alias(id_col), "score")


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


QUERIES = {"op8_neighbours": op8_neighbours}
ORACLE = {
    "op8_neighbours": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        p AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score
              FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INT) AS rank, vec_id, score FROM p QUALIFY rank <= 10
    """
}
