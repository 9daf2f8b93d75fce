"""A keyword index that follows appends and deletions: segments of postings with counts of their own, merged when they are read.

An append adds one segment and rewrites none. A segment of deletions holds the ids that go and the counts they take away, so the
statistics of all segments add up to those of a fresh build, exactly. Which segments count, and the three figures that every search
needs (chunks, tokens, mean idf), stand in one version file. compact() makes one segment of all.

Texts are counted where they are read and don't move. Their postings move once, as blocks: a row for a term and those of some
thousand chunks that hold it, so that fewer rows are sorted than there are postings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import small_batches
from ..functions.text import tokens
from ..sources.versions import Versions, delete
from .search import EPSILON, SHARDS, KeywordIndex, raw_idf, shard_of, token_rows

#: The tables of a segment: what they hold is said by the DDL of each, {id} being the type of the chunks' key. A block holds n chunks;
#: one without a term holds chunks with whatever terms or none, and lies in one of the CHUNK_FOLDERS that follow the folders of terms.
BLOCKS = "term string, n int, ids array<{id}>, lengths array<int>, tfs array<int>, shard int"
TERMS = "term string, df long"
GONE = "id {id}"
CHUNK_FOLDERS = 16
#: Tokens and chunks of which a task makes blocks at once; those of one more Arrow batch may join them.
BLOCK_TOKENS, BLOCK_CHUNKS = 1 << 21, 1 << 13
#: Removed ids up to which they are sent to all tasks; more meet the postings by a shuffle.
SENT_IDS = 1_000_000


def _blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, lengths, words = (rows.column(i).chunk(0) for i in range(3))
    owners, words = pc.list_parent_indices(words).to_numpy().astype(np.int64), words.flatten().dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    codes = place[words.indices.to_numpy(zero_copy_only=False)]
    found, tf = np.unique(codes * len(rows) + owners, return_counts=True)  # by term, and by chunk within it
    code, owner = np.divmod(found, len(rows))
    n = np.append(np.bincount(code, minlength=len(order)), len(rows)).astype(np.int32)
    ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
    owner, tf = pa.array(np.append(owner, np.arange(len(rows)))), np.append(tf, np.zeros(len(rows))).astype(np.int32)
    terms = pa.concat_arrays([words.dictionary.take(pa.array(order)), pa.nulls(1, words.dictionary.type)])  # the last block is that of the chunks
    lists = [pa.ListArray.from_arrays(ends, x) for x in (ids.take(owner), lengths.take(owner), pa.array(tf))]
    return pa.RecordBatch.from_arrays([terms, pa.array(n), *lists], ["term", "n", "ids", "lengths", "tfs"])


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows term, n, ids, lengths, tfs of rows id, length, tokens, in runs sorted by term."""
    held, words, chunks = [], 0, 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        words, chunks = words + pc.sum(batch.column(1)).as_py(), chunks + len(batch)
        if words >= BLOCK_TOKENS or chunks >= BLOCK_CHUNKS:
            yield _blocks(held)
            held, words, chunks = [], 0, 0
    if held:
        yield _blocks(held)


class SegmentedIndex:
    """An index of chunks at a path, by their key; appends and deletions are named by a batch, and one that was made is not made again."""

    def __init__(self, spark: SparkSession, path: str, tokenize: Callable[[Column], Column] = tokens):
        self.spark, self.versions, self.tokenize = spark, Versions(spark, path), tokenize

    def _read(self, segment: dict, table: str, ddl: str) -> DataFrame:
        return self.spark.read.schema(ddl.format(id=segment["key"])).parquet(f"{self.versions.path}/{segment['folder']}/{table}")

    def _held(self, segment: dict, *more: Column) -> DataFrame:
        """Rows of blocks: term, shard, id, length, tf; without a term, a row for each chunk."""
        rows = F.inline_outer(F.arrays_zip("ids", "lengths", "tfs")).alias("id", "length", "tf")  # an inner one would zip again, to ask for the size
        return self._read(segment, "blocks", BLOCKS).select("term", "shard", *more, rows)

    def _chunks(self, segment: dict) -> DataFrame:
        return self._held(segment).where(F.col("shard") >= SHARDS).select("id", "length")

    def _postings(self, segment: dict) -> DataFrame:
        return self._held(segment).where(F.col("shard") < SHARDS).select("id", "term", "length", F.col("tf").cast("long").alias("tf"), "shard")

    def _holders(self, segment: dict) -> DataFrame:
        """Rows term, id of the chunks that hold a term."""
        return self._read(segment, "blocks", BLOCKS).where(F.col("shard") < SHARDS).select("term", F.explode_outer("ids").alias("id"))

    def _gone(self, segment: dict) -> DataFrame:
        gone = self._read(segment, "gone", GONE)
        return F.broadcast(gone) if -segment["n"] <= SENT_IDS else gone

    def _alive(self, held: dict, rows_of: Callable[[dict], DataFrame]) -> DataFrame | None:
        """Rows of the adding segments whose id no later segment takes away."""
        found, segments = [], held.get("segments", [])
        for i, s in enumerate(segments):
            if s["kind"] != "add":
                continue
            rows = rows_of(s)
            for later in segments[i + 1 :]:
                if later["kind"] == "remove":
                    rows = rows.join(self._gone(later), "id", "left_anti")
            found.append(rows)
        return reduce(DataFrame.unionByName, found) if found else None

    def _terms(self, held: dict) -> DataFrame | None:
        """df of each term that is there, from the segments' own counts; postings aren't read."""
        found = [self._read(s, "terms", TERMS) for s in held.get("segments", [])]
        return reduce(DataFrame.unionByName, found).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0") if found else None

    def _commit(self, base: int, held: dict) -> int:
        """Commit segments with the figures of all of them."""
        n, length = (sum(s[x] for s in held["segments"]) for x in ("n", "tokens"))
        terms = self._terms(held)
        mean = terms.agg(F.avg(raw_idf(F.lit(n), F.col("df")))).first()[0] if terms is not None else None
        return self.versions.commit(base, held | {"n": n, "tokens": length, "mean_idf": mean})

    def append(self, chunks: DataFrame, batch: str, key: str = "chunk_id", text: str = "content") -> bool:
        """Add chunks that the index doesn't hold, one of each key; False if the batch was there already.

        A chunk with a null key is passed over. To replace a chunk, remove it first.
        """
        base, held = self.versions.current()
        if batch in held.get("batches", []):
            return False
        rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("_text"))
        made = {"kind": "add", "folder": self.versions.new_folder("segment"), "key": rows.schema["id"].dataType.simpleString()}
        self._invert(rows, made)
        # whether all are new is asked of the ids that were written; only if not, texts move to be told apart
        known, sent = self._alive(held, self._chunks), self._chunks(made)
        new = sent.select("id").distinct()
        if known is not None:
            new = new.join(known.select("id"), "id", "left_anti")
        if new.count() < sent.count():
            delete(self.spark, f"{self.versions.path}/{made['folder']}")
            made |= {"folder": self.versions.new_folder("segment")}
            rows = rows.dropDuplicates(["id"])
            self._invert(rows if known is None else rows.join(known.select("id"), "id", "left_anti"), made)
        self._finish(made, base, held.get("segments", []), [*held.get("batches", []), batch])
        return True

    def _invert(self, rows: DataFrame, made: dict) -> None:
        small_batches(self.spark)
        blocks = token_rows(rows, "id", "_text", self.tokenize).mapInArrow(_invert, f"term string, n int, ids array<{made['key']}>, lengths array<int>, tfs array<int>")
        of_chunks = SHARDS + F.pmod(F.spark_partition_id(), F.lit(CHUNK_FOLDERS))
        self._write(blocks.withColumn("shard", F.when(F.col("term").isNull(), of_chunks).otherwise(shard_of(F.col("term")))), made)

    def _write(self, blocks: DataFrame, made: dict) -> None:
        # a task for each folder: what it gets are sorted runs, which are merged with few comparisons
        blocks.repartitionById(SHARDS + CHUNK_FOLDERS, "shard").sortWithinPartitions("shard", "term").write.partitionBy("shard").parquet(f"{self.versions.path}/{made['folder']}/blocks")

    def _finish(self, made: dict, base: int, before: list[dict], batches: list[str]) -> None:
        """Count the terms of a segment whose blocks are written, and commit it after those before."""
        blocks = self._read(made, "blocks", BLOCKS)
        blocks.where(F.col("shard") < SHARDS).groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{self.versions.path}/{made['folder']}/terms")
        n, length = self._chunks(made).agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        self._commit(base, {"segments": [*before, made | {"n": n, "tokens": length}], "batches": batches})

    def remove(self, ids: DataFrame, batch: str, key: str = "chunk_id") -> bool:
        """Take chunks away by key; keys that the index doesn't hold are passed over. False if the batch was there already."""
        base, held = self.versions.current()
        if batch in held.get("batches", []):
            return False
        known = self._alive(held, self._chunks)
        if known is None:
            return True
        folder = self.versions.new_folder("segment")
        path = f"{self.versions.path}/{folder}"
        kind = known.schema["id"].dataType.simpleString()
        known.join(ids.select(F.col(key).alias("id")).distinct(), "id", "left_semi").write.parquet(f"{path}/gone")
        n, length = self.spark.read.schema(f"id {kind}, length int").parquet(f"{path}/gone").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        made = {"kind": "remove", "folder": folder, "key": kind, "n": -n, "tokens": -length}
        lost = self._alive(held, self._holders).join(self._gone(made), "id", "left_semi")
        lost.groupBy("term").agg((-F.count("*")).alias("df")).write.parquet(f"{path}/terms")
        self._commit(base, {"segments": [*held["segments"], made], "batches": [*held.get("batches", []), batch]})
        return True

    def index(self) -> KeywordIndex:
        """The tables that searches take; with few terms asked only their files of postings and terms are read."""
        held = self.versions.current()[1]
        postings, terms = self._alive(held, self._postings), self._terms(held)
        if postings is None:
            empty = self.spark.createDataFrame([], "id long, term string, length int, tf long, shard int")
            return KeywordIndex(empty, self.spark.createDataFrame([], "term string, df long, idf double"), self.spark.createDataFrame([(0, None)], "n long, avg_length double"))
        raw = raw_idf(F.lit(held["n"]), F.col("df"))
        terms = terms.select("term", "df", F.when(raw < 0, EPSILON * F.lit(held["mean_idf"])).otherwise(raw).alias("idf"))
        mean = held["tokens"] / held["n"] if held["n"] else None
        corpus = self.spark.range(1).select(F.lit(held["n"]).cast("long").alias("n"), F.lit(mean).cast("double").alias("avg_length"))
        return KeywordIndex(postings, terms, corpus)

    def compact(self) -> int:
        """Make one segment of what is there, and return how many there were; searches find the same before and after."""
        base, held = self.versions.current()
        segments = held.get("segments", [])
        if len(segments) < 2:
            return len(segments)
        # blocks stay apart, so that none grows; those of which all goes are left out
        rows = self._alive(held, lambda s: self._held(s, F.concat(F.lit(s["folder"]), F.lit("/"), F.monotonically_increasing_id()).alias("block")))
        kind = rows.schema["id"].dataType.simpleString()
        made = {"kind": "add", "folder": self.versions.new_folder("segment"), "key": kind}
        blocks = rows.groupBy("shard", "term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "length", "tf"))).alias("_r"))
        self._write(blocks.select("term", F.size("_r").alias("n"), F.col("_r.id").alias("ids"), F.col("_r.length").alias("lengths"), F.col("_r.tf").alias("tfs"), "shard"), made)
        self._finish(made, base, [], held.get("batches", []))
        return len(segments)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete segments that the last `keep` versions don't name; call it when no search reads older ones."""
        return self.versions.vacuum(keep, lambda held: {s["folder"] for s in held.get("segments", [])})


__all__ = ["SHARDS", "SegmentedIndex"]
