"""Keyword search of many queries with early stop: blocks of postings whose best possible score can't reach the k-th best aren't read.

Chunks are put into windows of WINDOW chunks of like length, and a block holds a term's postings in a window, with its greatest count
and its smallest length. These bound what a chunk of the window can score for a query. The windows with the highest bounds are searched
first; their k-th best score is a floor, and of the others only those are searched whose bound reaches it. The rows are those of
bm25_topk(), ties included.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .search import B, K1, KeywordIndex, shard_of

#: Terms of queries up to which the blocks that they name are read alone.
NAMED = 10_000
#: Chunks of a window, and windows of a query that are searched first.
WINDOW = 256
FIRST = 4
#: Allowed above a floor for bounds that are summed in another order.
ROUNDING = 1e-9


def impact(tf: Column, length: Column, avg_length: Column) -> Column:
    """What a term adds to a score, but for its weight: it grows with tf and falls with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_length))


@dataclass(frozen=True)
class BlockIndex:
    """blocks (term, window, best_tf, least_length, held) beside the terms and the corpus of a keyword index."""

    spark: SparkSession
    blocks: DataFrame
    terms: DataFrame
    corpus: DataFrame

    @classmethod
    def build(cls, index: KeywordIndex, path: str) -> BlockIndex:
        """Write blocks below a path, sorted by term in folders by its hash."""
        spark = index.postings.sparkSession
        index.counted().write.mode("overwrite").parquet(f"{path}/counted")  # once: ranges are found by a sample
        # places in the order of lengths: windows are runs of them within a partition
        placed = spark.read.parquet(f"{path}/counted").repartitionByRange("length", "id").sortWithinPartitions("length", "id").withColumn("_at", F.monotonically_increasing_id())
        postings = placed.select("id", "length", F.floor(F.col("_at") / WINDOW).alias("window"), F.explode("runs").alias("_r")).select("id", "length", "window", "_r.term", "_r.tf")
        held = F.array_sort(F.collect_list(F.struct("id", "tf", "length")))  # WINDOW at most
        # postings move once: blocks are made where their folder is written
        blocks = postings.withColumn("shard", shard_of(F.col("term"))).repartition("shard").groupBy("shard", "term", "window").agg(F.max("tf").alias("best_tf"), F.min("length").alias("least_length"), held.alias("held"))
        blocks.sortWithinPartitions("shard", "term", "window").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
        return cls(spark, spark.read.parquet(f"{path}/blocks"), index.terms, index.corpus)

    def of(self, queries: DataFrame) -> BlockIndex:
        """This index with the blocks of the terms of queries alone, named so that no other files are read, if they are few."""
        words = [r[0] for r in queries.select(F.explode("terms").alias("t")).where("t is not null").distinct().limit(NAMED + 1).collect()]
        if len(words) > NAMED:
            return self
        shards = [r[0] for r in self.spark.createDataFrame([(w,) for w in words], "t string").select(shard_of(F.col("t"))).distinct().collect()]
        return replace(self, blocks=self.blocks.where(F.col("shard").isin(shards) & F.col("term").isin(words)))

    def asked(self, queries: DataFrame) -> DataFrame:
        """Rows query_id, term, weight of queries (query_id, terms); a term counts as often as the query repeats it."""
        words = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        return words.join(self.terms, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))

    def bounds(self, asked: DataFrame) -> DataFrame:
        """Rows query_id, window, bound: no chunk of the window scores more. A term of negative weight adds nothing at best."""
        rows = asked.join(self.blocks.select("term", "window", "best_tf", "least_length"), "term").crossJoin(F.broadcast(self.corpus))  # one row
        most = F.greatest(F.col("weight") * impact(F.col("best_tf"), F.col("least_length"), F.col("avg_length")), F.lit(0.0))
        return rows.groupBy("query_id", "window").agg(F.sum(most).alias("bound"))

    def touched(self, asked: DataFrame, windows: DataFrame) -> DataFrame:
        """The blocks of the terms of queries in their windows (query_id, window)."""
        return windows.join(asked, "query_id").join(self.blocks, ["term", "window"])

    def scores(self, asked: DataFrame, windows: DataFrame) -> DataFrame:
        """Rows query_id, id, score of all chunks in the windows of each query, summed in the order of the terms."""
        hits = self.touched(asked, windows).select("query_id", "term", "weight", F.explode("held").alias("_p")).crossJoin(F.broadcast(self.corpus))  # one row
        weight = F.col("weight") * F.col("_p.tf") * (K1 + 1) / (F.col("_p.tf") + K1 * (1 - B + B * F.col("_p.length") / F.col("avg_length")))
        parts = F.array_sort(F.collect_list(F.struct("term", weight.alias("w"))))
        return hits.groupBy("query_id", F.col("_p.id").alias("id")).agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["w"]).alias("score"))

    def plan(self, asked: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(windows searched first, windows that may still hold one of the k best), each query_id, window."""
        ranked = self.bounds(asked).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "window")))
        first = ranked.where(F.col("_r") <= FIRST).select("query_id", "window")
        best = _best(self.scores(asked, first), k)
        floor = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("_floor"))
        rest = ranked.where(F.col("_r") > FIRST).join(floor, "query_id", "left")
        return first, rest.where(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - ROUNDING)).select("query_id", "window")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best chunks of each query: query_id, id, score (over the query's greatest), kw_rank; those above 0, ties by id."""
        asked = self.asked(queries)
        some = self.of(queries)
        first, rest = some.plan(asked, k)
        found = _best(some.scores(asked, first.unionByName(rest)), k)
        top = F.max("score").over(Window.partitionBy("query_id"))
        return found.where("score > 0").select("query_id", "id", (F.col("score") / top).alias("score"), "kw_rank")


def _best(scores: DataFrame, k: int) -> DataFrame:
    return scores.withColumn("kw_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("kw_rank") <= k)
