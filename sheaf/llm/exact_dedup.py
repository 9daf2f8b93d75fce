"""Exact deduplication by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Rows are counted by length and prefix hash with map-side aggregation; a length that occurs once is a group of one there already.
What survives goes back into the scan as a set of at most BUCKETS buckets, so texts are hashed where they are read and
never move: a row whose bucket holds no repeated group is unique, any other is hashed in full. Only ids and digests of those are
grouped, and results go back to them over a salted join, so that a group of any size spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, salted_lookup, write_table

#: Characters of a text that the second step hashes.
PREFIX_CHARS = 64
#: Buckets of repeated lengths and prefixes that are sent to all tasks; with more groups than that more rows are hashed.
BUCKETS = 1 << 20


def surviving(docs: DataFrame, text: Column, prefix_chars: int = PREFIX_CHARS) -> tuple[DataFrame, Column]:
    """Buckets (_bucket, _hit) of (length, prefix hash) that two rows or more share, at most BUCKETS rows; and the bucket of a row of docs."""
    length, prefix = F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix_chars))
    counted = docs.select(length.alias("_len"), prefix.alias("_pre")).groupBy("_len", "_pre").agg(F.count("*").alias("_n"))
    found = counted.where("_n > 1").select(F.pmod(F.xxhash64("_len", "_pre"), F.lit(BUCKETS)).cast("int").alias("_bucket")).distinct()
    return found.withColumn("_hit", F.lit(True)), F.pmod(F.xxhash64(length, prefix), F.lit(BUCKETS)).cast("int")


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, and the columns of `carry`.

    Of equal texts the row with the largest id stays. A null text counts as empty. Rows that repeat an id
    with the same text all count in group_size, and one of them is kept; a null id is below all others.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    carry: columns made from docs that are wanted in the result too.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    carry = carry or {}
    buckets, bucket = surviving(docs, text)
    rows = docs.select(F.col(id_col).alias("_doc"), text.alias("_text"), bucket.alias("_own"), *[c.alias(f"_c_{k}") for k, c in carry.items()])
    rows = rows.join(F.broadcast(buckets), F.col("_own") == F.col("_bucket"), "left")  # BUCKETS rows at most
    full = F.when(F.col("_hit"), F.sha2(F.col("_text").cast("binary"), 256))
    rows = rows.select("_doc", F.monotonically_increasing_id().alias("_row"), F.octet_length("_text").alias("_len"), full.alias("_full"), *[f"_c_{k}" for k in carry])
    rows = write_table(rows, "exact")  # without texts; read twice below
    hashed = rows.where("_full is not null")
    groups = hashed.groupBy("_len", "_full").agg(F.max(F.struct("_doc", "_row")).alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    found = salted_lookup(hashed, groups, ["_len", "_full"], "_row")
    alone = F.col("_size").isNull()
    names = [F.col(f"_c_{k}").alias(k) for k in carry]
    shared = found.select(F.col("_doc").alias(id_col), F.when(alone, F.col("_doc")).otherwise(F.col("_keep._doc")).alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("_keep._row") == F.col("_row"))).alias("kept"), *names)
    unique = rows.where("_full is null").select(F.col("_doc").alias(id_col), F.col("_doc").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *names)
    return unique.unionByName(shared)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return exact_dedup(docs, carry={"text_sha256": digest})


ORACLE = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
QUERIES = {"op7_exact_dedup": op7_exact_dedup}
