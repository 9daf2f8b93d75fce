"""An index for substring search with wildcards: which rows hold which three characters in a row, by column.

A pattern's literal runs, between wildcards, must occur in a row that it matches, so their trigrams must too. The rarest of these bring
candidates, and the exact predicate is held against the candidates alone. A pattern without a run of three characters brings none:
then all rows are searched, as without the index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists

#: Trigrams of a pattern that are looked up, the rarest; and the share of all rows from which on a scan takes less than their postings.
LOOKED_UP = 4
WIDE = 0.2
#: Postings of a file, on average.
FILE_ROWS = 5_000_000


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern holds between its wildcards % and _; a backslash makes the next sign literal."""
    runs, held, signs = [], [], iter(pattern)
    for c in signs:
        if c in "%_":
            runs.append("".join(held))
            held = []
        else:
            held.append(next(signs, "") if c == "\\" else c)
    return [r for r in [*runs, "".join(held)] if r]


def pattern_grams(pattern: str) -> list[str]:
    return sorted({r[i : i + 3] for r in literal_runs(pattern) for i in range(len(r) - 2)})


class TrigramIndex:
    """postings (gram, place, id) and counts (gram, n, rows) below a path; place is the number of the column."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], key: str = "id"):
        self.spark, self.path, self.columns, self.key = spark, path, list(columns), key

    def append(self, rows: DataFrame) -> None:
        """Add rows, of keys that the index doesn't hold; old postings stay as they are. Null texts have no trigrams."""
        texts = rows.select(F.col(self.key).alias("id"), F.posexplode(F.array(*[F.col(c) for c in self.columns])).alias("place", "_t")).where("_t is not null")
        signs = texts.select("id", "place", F.split(F.lower("_t"), "").alias("_c")).where(F.size("_c") >= 3)
        at = F.sequence(F.lit(0), F.size("_c") - 3)
        grams = F.array_distinct(F.transform(at, lambda i: F.concat(F.get("_c", i), F.get("_c", i + 1), F.get("_c", i + 2))))
        postings = signs.select(F.explode(grams).alias("gram"), "place", "id")
        # sorted by ranges, ids included: files hold few trigrams, and a very common one spreads over several
        postings.repartitionByRange("gram", "place", "id").sortWithinPartitions("gram", "place", "id").write.mode("append").parquet(f"{self.path}/postings")
        known = rows.agg(F.count("*").alias("rows")).select(F.lit(None).cast("string").alias("gram"), F.lit(0).cast("long").alias("n"), "rows")
        counted = postings.groupBy("gram").agg(F.count("*").alias("n")).withColumn("rows", F.lit(0).cast("long"))
        counted.unionByName(known).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{self.path}/counts")

    def candidates(self, pattern: str | None) -> DataFrame | None:
        """Keys (id) of rows that may match %pattern%, all that do among them; None where the index can't tell or a scan takes less."""
        if not pattern or not exists(self.spark, f"{self.path}/counts"):
            return None
        # lower case as the predicate makes it, of the whole pattern at once
        whole = self.spark.range(1).select(F.lower(F.lit(f"%{pattern}%"))).first()[0]
        grams = pattern_grams(whole)
        if not grams:
            return None
        counts = self.spark.read.parquet(f"{self.path}/counts")
        found = dict(counts.where(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n")).collect())  # as many as the pattern has
        total = counts.where("gram is null").agg(F.sum("rows")).first()[0] or 0
        rarest = sorted(grams, key=lambda g: (found.get(g, 0), g))[:LOOKED_UP]
        if found.get(rarest[0], 0) > WIDE * total:
            return None
        hits = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(rarest))
        return hits.groupBy("place", "id").agg(F.count("*").alias("n")).where(F.col("n") >= len(rarest)).select("id").distinct()

    def narrow(self, rows: DataFrame, pattern: str | None) -> DataFrame:
        """Rows among which all that match are; hold the predicate against these."""
        found = self.candidates(pattern)
        return rows if found is None else rows.join(found.withColumnRenamed("id", "_found"), F.col(self.key) == F.col("_found"), "left_semi")
