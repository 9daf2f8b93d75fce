"""A sink that holds each batch of a stream once, however often it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import exists
from ..sources.versions import names


class BatchSink:
    """Batches of a stream in folders of their number: one that is written again takes the place of itself.

    `stream` names the stream's checkpoint: numbers of one checkpoint never come again for other rows, so a stream that starts anew
    must take another name. A batch counts once it is whole.
    """

    def __init__(self, spark: SparkSession, path: str, stream: str, schema: T.StructType | str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/stream={stream}"
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def batches(self) -> list[int]:
        found = [n.removeprefix("batch=") for n in names(self.spark, self.path)]
        return sorted(int(n) for n in found if n.isdigit() and exists(self.spark, f"{self.path}/batch={n}/_SUCCESS"))

    def read(self) -> DataFrame:
        """Rows of all whole batches, with the batch they came in."""
        whole = [f"{self.path}/batch={n}" for n in self.batches()]
        schema = T.StructType([*self.schema, T.StructField("batch", T.LongType())])
        if not whole:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*whole)

    def latest(self, key: str) -> DataFrame:
        """Of rows of one key, the one of the last batch."""
        rows = self.read()
        last = rows.groupBy(key).agg(F.max_by(F.struct(*self.schema.names), "batch").alias("_r"))
        return last.select("_r.*")
