"""Continuous ingestion: files to chunks, and request logs to windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import normalize_text
from ..functions.values import file_kind
from ..operators.chunking import chunk_text
from ..sources.files import append_store, embed, extract_text


def to_chunks(texts: DataFrame, key: str = "path") -> DataFrame:
    """Chunks of normalised texts: chunk_id (a hash of file, place and content), content, metadata."""
    chunks = chunk_text(texts.select(key, normalize_text(F.col("text")).alias("text")))
    ident = F.xxhash64(F.col(key), F.col("chunk_at"), F.col("content"))
    return chunks.select(ident.alias("chunk_id"), "content", F.create_map(F.lit("dieu"), F.col("dieu"), F.lit("khoan"), F.col("khoan"), F.lit("path"), F.col(key)).alias("metadata"))


def ingest(files: DataFrame, readers: dict[str, Callable], encoder: Callable, store: str) -> None:
    """One batch: files to text, chunks and vectors, appended to the store. Nothing to add is no error."""
    chunks = to_chunks(extract_text(files, readers).where("error is null")).cache()
    try:
        if not chunks.isEmpty():
            append_store(chunks, embed(chunks, encoder), store)
    finally:
        chunks.unpersist()


def watch(spark: SparkSession, folder: str, readers: dict[str, Callable], encoder: Callable, store: str, checkpoint: str) -> StreamingQuery:
    """Ingest files as they come into a folder; a file is taken once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    files = files.select("path", "length", "modificationTime", file_kind(F.col("path")).alias("kind"), "content")
    return files.writeStream.foreachBatch(lambda batch, _: ingest(batch, readers, encoder, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def request_rates(logs: DataFrame, time: str = "created_at", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Requests and their mean elapsed time by window and action; works on a stream, where rows later than `late` are passed over."""
    elapsed = F.get_json_object("detail", "$.elapsed_ms").cast("double")
    rows = logs.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width), "action").agg(F.count("*").alias("requests"), F.avg(elapsed).alias("mean_elapsed_ms"))
