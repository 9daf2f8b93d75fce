"""Deep pages: a table sorted into ranges with the number of rows of each, so that a page reads the range it lies in.

Offsets over a plain table make each task hold all rows before the page. Here the counts of the ranges, one row for each, say where a
page starts. With a filter they are counted anew in one scan of the filter's columns, without sorting anything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

#: Rows of a range, on average; ranges, each a task and a folder that the driver hears of, up to which they are made as small as asked for; and the
#: rows up to which they grow in place of their number.
RANGE_ROWS, RANGES, RANGE_MOST = 200_000, 1024, 2_000_000


@dataclass(frozen=True)
class RankedTable:
    """Rows below path/rows in folders of their range, and path/counts (_range, _rows)."""

    spark: SparkSession
    path: str
    order: tuple[str, ...]
    schema: T.StructType
    descending: bool = True

    def _by(self) -> list[Column]:
        return [F.col(c).desc() if self.descending else F.col(c).asc() for c in self.order]

    @classmethod
    def build(cls, rows: DataFrame, path: str, order: tuple[str, ...], descending: bool = True, range_rows: int = RANGE_ROWS) -> RankedTable:
        """Write rows in order. The order should end with a unique column: rows alike in all of it stay in one range.

        range_rows is kept while that makes no more than RANGES ranges; beyond, ranges hold more rows, up to RANGE_MOST.
        """
        made = cls(rows.sparkSession, path, tuple(order), T.StructType([*rows.schema, T.StructField("_range", T.IntegerType())]), descending)
        count = rows.count()
        n = max(1, min(-(-count // range_rows), max(RANGES, -(-count // RANGE_MOST))))
        placed = rows.repartitionByRange(n, *made._by()).withColumn("_range", F.spark_partition_id())
        placed.sortWithinPartitions("_range", *made._by()).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
        made.rows().groupBy("_range").agg(F.count("*").alias("_rows")).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")
        return made

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def counts(self, where: Column | None = None) -> list[tuple[int, int]]:
        """(range, rows that the filter admits), in order: as many as ranges."""
        found = self.spark.read.schema("_range int, _rows long").parquet(f"{self.path}/counts") if where is None else self.rows().where(where).groupBy("_range").agg(F.count("*").alias("_rows"))
        return sorted((r[0], r[1]) for r in found.select("_range", "_rows").collect())

    def slice(self, offset: int, size: int, where: Column | None = None) -> DataFrame:
        """`size` rows from `offset` on, in order; only the ranges that hold them are read.

        Rows are numbered within their range, so that no more than the page leaves it.
        """
        before, read = 0, []
        for number, n in self.counts(where):
            if before + n > offset and before < offset + size:
                read.append((number, before))
            before += n
        rows = self.rows().where(F.col("_range").isin([r for r, _ in read]))
        if where is not None:
            rows = rows.where(where)
        before = F.coalesce(*[F.when(F.col("_range") == r, F.lit(n)) for r, n in read], F.lit(0))
        at = before + F.row_number().over(Window.partitionBy("_range").orderBy(*self._by()))
        return rows.withColumn("_at", at).where((F.col("_at") > offset) & (F.col("_at") <= offset + size)).drop("_range", "_at").orderBy(*self._by())
