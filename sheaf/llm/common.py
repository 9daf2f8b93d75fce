"""Helpers shared by the training-data operators: shared storage, reading, chunk exchange."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, BATCH_ROWS, small_batches  # noqa: F401  operators take them from here

#: SQL: a table `crc` of one row whose list `t` has the 256 remainders of CRC-32, for crc32_sql().
CRC32_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def crc32_sql(number: str) -> str:
    """SQL for the CRC-32 of an integer in decimals, where the table `crc` of CRC32_SQL is joined; null for null."""
    codes = f"list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"CASE WHEN {number} IS NOT NULL THEN xor(list_reduce(list_concat([4294967295], {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where it is unset in local mode, as in tests, a temporary folder is used and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sheaf-shared-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def write_table(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder, in folders of the columns `by`, and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sheaf-{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    free_shuffles(spark)
    return out


def discard(table: DataFrame, folder: str = "") -> None:
    """Delete a table of write_table(), or one of its folders, that no plan still to run reads."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.table_path}/{folder}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def parts(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: the session's setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def salted_lookup(rows: DataFrame, small: DataFrame, key: list[str], by: str, salts: int = 16) -> DataFrame:
    """Left join of rows with small (unique on key, null keys match), so that a hot key's rows go to `salts` tasks.

    small has a row for each key and is repeated `salts` times; rows are dealt by a hash of `by`. Neither side is broadcast: both may
    grow with the data.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = small.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    on = F.col("_salt") == F.col("_r_salt")
    for k in key:
        right = right.withColumnRenamed(k, f"_r_{k}")
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right.hint("merge"), on, "left").drop("_salt", "_r_salt", *[f"_r_{k}" for k in key])
