"""Files as sources: dispatch by kind, text by pluggable readers, pages, and the stores of chunks and of summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..functions.values import file_kind
from .schemas import CHUNKS, HISTORY, VECTORS

UNSUPPORTED = "unsupported file type"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by Spark's own file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Files with path, length, kind (null if unsupported) and content."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return rows.select("path", "length", "modificationTime", file_kind(F.col("path")).alias("kind"), "content")


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes below a folder; a folder that is missing has none."""
    if not exists(spark, path):
        return spark.range(1).select(F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def page_texts(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """A row for each page: path, kind, page_no (from 1), text, error. readers: from a kind of file to the texts of its pages.

    A file without pages gives one row without a page number, text and error.
    """
    rows = files.select("path", "kind", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, kind, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind not in readers:
                    out.append((path, kind, None, None, UNSUPPORTED))
                    continue
                try:
                    out += [(path, kind, i, t, None) for i, t in enumerate(readers[kind](content), 1)] or [(path, kind, None, None, None)]
                except Exception as e:  # noqa: BLE001  one bad file is a row, not a failed job
                    out.append((path, kind, None, None, str(e)))
            columns = zip(*out, strict=True) if out else ((),) * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "kind", "page_no", "text", "error"])

    return rows.mapInArrow(read, "path string, kind string, page_no int, text string, error string")


def extract_text(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]]) -> DataFrame:
    """A row for each file: path, text, error. Pages of a pdf are normalised and marked; an image is normalised.

    Each file is read once. A file without pages has an empty text; one that can't be read, a null text and an error.
    """
    pages = page_texts(files, readers).withColumn("text", normalize_text(F.col("text")))
    mark = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"))
    piece = F.when(F.col("page_no").isNotNull(), F.struct(F.col("page_no").alias("n"), F.concat(F.when(F.col("kind") == "pdf", mark).otherwise(F.lit("")), "text").alias("t")))
    found = pages.groupBy("path").agg(F.array_sort(F.collect_list(piece)).alias("_p"), F.max("error").alias("error"))
    return found.select("path", F.when(F.col("error").isNull(), F.array_join(F.transform("_p", lambda p: p["t"]), "\n\n")).alias("text"), "error")


def pdf_reader() -> Callable[[bytes], list[str]]:
    """A reader of the text layer of PDFs by pypdf, where it is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("pypdf is not installed; pass a reader of your own") from e
    import io

    return lambda content: [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and vectors; unless both are there, both are empty."""
    if exists(spark, f"{path}/chunks") and exists(spark, f"{path}/vectors"):
        return spark.read.schema(CHUNKS).parquet(f"{path}/chunks"), spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    return spark.createDataFrame([], CHUNKS), spark.createDataFrame([], VECTORS)


def unstored(rows: DataFrame, path: str, ddl: str, value: str | None = None) -> DataFrame:
    """Rows, one for each chunk_id, that a table does not hold; ids may be null, and such rows are all kept.

    value: an id that stands for two values of this column, among the rows or here and there, is an error: ids are
    hashes, and the later chunk would be lost without a word. Of the table the ids are read, and the values only where ids are there
    already, as after a batch that failed midway.
    """
    spark = rows.sparkSession
    keyed = rows.where("chunk_id is not null")
    mark = F.sha2(F.col(value).cast("binary"), 256).alias("_mark") if value else F.lit(None).alias("_mark")
    marked = keyed.select("chunk_id", mark)
    if exists(spark, path):
        own = keyed.select("chunk_id").distinct()
        held = spark.read.schema(ddl).parquet(path).join(own, "chunk_id", "left_semi")
        if value and not held.select("chunk_id").isEmpty():
            marked = marked.unionByName(held.select("chunk_id", mark))
        rows = rows.join(held.select("chunk_id"), "chunk_id", "left_anti")
    if value:
        torn = marked.groupBy("chunk_id").agg(F.min("_mark").alias("a"), F.max("_mark").alias("b")).where("a <> b").select("chunk_id").head(1)
        if torn:
            raise ValueError(f"a chunk_id stands for more than one {value}: {torn[0].chunk_id}")
    once = rows.where("chunk_id is not null").dropDuplicates(["chunk_id"])
    return once.unionByName(rows.where("chunk_id is null"))


def append_store(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """Append chunks and their vectors, each id once, but for those that are there, so that a batch that failed midway can be appended again.

    Ids may be null; such rows are always appended. Nothing is written if an id stands for two contents. Vectors aren't compared: an
    encoder may give a chunk another one each time, and the first stays. Derived term tables must be built anew afterwards.
    """
    chunks = unstored(chunks.select("chunk_id", "content", "metadata"), f"{path}/chunks", CHUNKS, "content")
    chunks.write.mode("append").parquet(f"{path}/chunks")
    vectors = vectors.select("chunk_id", F.col("vector").cast("array<float>").alias("vector"))
    unstored(vectors, f"{path}/vectors", VECTORS).write.mode("append").parquet(f"{path}/vectors")


def embed(chunks: DataFrame, encoder: Callable[[list[str]], list[list[float]]], key: str = "chunk_id", text: str = "content") -> DataFrame:
    """Vectors of chunks by an encoder that takes and gives lists, batch by batch."""
    rows = chunks.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoder(batch.column(1).to_pylist()), pa.list_(pa.float32()))], ["_key", "vector"])

    return rows.mapInArrow(encoded, f"_key {rows.schema['_key'].dataType.simpleString()}, vector array<float>").withColumnRenamed("_key", key)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Summaries from a JSON file; empty if it is missing or malformed."""
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).where("filename is not null")


def append_history(history: DataFrame, entries: DataFrame, keep: int = 20) -> DataFrame:
    """The newest entries of both, newest first."""
    return history.unionByName(entries).orderBy(F.desc("timestamp"), "filename", "summary").limit(keep)
