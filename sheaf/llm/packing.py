"""Best-fit packing of tokenised documents by minimum bin slack.

A bin takes the longest piece that is left and then the fullest combination of lengths that fits beside
it, found by bitset subset-sum dynamic programming. Only the number of pieces of each length matters for that,
so the driver plans on a histogram of at most `capacity` rows and repeats each combination as often as
the counts allow. Pieces are then numbered within their length, in buckets, and read their place off the plan.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import read_table, small_batches, write_table

CAPACITY = 1024
END_ID = 2
#: Splits text before the merges, as the tokenizer's file asks for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of one length that are numbered by one task, in the mean.
BUCKET_ROWS = 5_000


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in the tokenizer's file: itself if printable Latin-1, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class LibraryEncoder:
    """Ids that the tokenizers library gives for a file of byte-level BPE, by tiktoken, which is several times faster.

    Both merge the pair of the lowest rank first, and here a merge's rank is that of the entry it makes; tests hold
    them against each other. Added tokens' strings give their ids with added_tokens, as the library has it unless told
    otherwise (the leftmost and of these the longest first), else they are ordinary text.
    """

    def __init__(self, data: bytes, pattern: str, added_tokens: bool = False):
        import tiktoken

        told = json.loads(data)
        special, signs = {t["id"] for t in told["added_tokens"]}, byte_signs()
        ranks = {bytes(signs[c] for c in piece): i for piece, i in told["model"]["vocab"].items() if i not in special}
        self.library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]} if added_tokens else {}
        if added_tokens and any(t.get(k) for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take single words or strip spaces are not supported")
        self.split = re.compile("|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for text in texts:
            ids, at = [], 0
            for found in self.split.finditer(text) if self.split else ():
                ids += [*self.library.encode_ordinary(text[at : found.start()]), self.added[found[0]]]
                at = found.end()
            yield np.array(ids + self.library.encode_ordinary(text[at:]), np.uint32)


class LibrarySource:
    """A tokenizer file to send to executors, which load it once in each Python worker."""

    _built: dict[str, LibraryEncoder] = {}

    def __init__(self, spark: SparkSession, path: str, pattern: str, added_tokens: bool = False):
        with open(path, "rb") as f:  # the driver reads it; its size is that of a vocabulary
            data = f.read()
        self.digest, self.pattern, self.added_tokens = hashlib.sha256(data + pattern.encode() + bytes([added_tokens])).hexdigest(), pattern, added_tokens
        self.data = spark.sparkContext.broadcast(data)

    @cached_property
    def encoder(self) -> LibraryEncoder:
        if self.digest not in self._built:
            self._built[self.digest] = LibraryEncoder(self.data.value, self.pattern, self.added_tokens)
        return self._built[self.digest]

    def __getstate__(self) -> dict:
        return {"digest": self.digest, "pattern": self.pattern, "added_tokens": self.added_tokens, "data": self.data}


def cuts(n: int, capacity: int) -> list[int]:
    """Where the pieces of n ids start: longer documents are cut into full pieces, the first may be shorter."""
    return [0] if n <= capacity else sorted({0, *range(n % capacity, n, capacity)})


def pieces(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", pattern: str = PATTERN, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, added_tokens: bool = False) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, and with with_ids the ids (little-endian, unsigned 32 bits).

    A null text counts as empty and is one piece of the end id alone. Repeated rows are documents of their own; an
    empty table gives an empty result; other columns are ignored. path: a tokenizers file that the driver can read.
    added_tokens: give the file's added tokens their ids, as the library does by default; else their strings are ordinary text.
    """
    small_batches(docs.sparkSession)
    source = LibrarySource(docs.sparkSession, path, pattern, added_tokens)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [], []
            for row, ids in enumerate(source.encoder.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                at = cuts(len(ids), capacity)
                for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)], strict=True)):
                    of.append(row)
                    out.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tobytes() if with_ids else None))
            k, a, n, crc, ids = zip(*out, strict=True) if out else ((),) * 5
            columns = {"_id": batch.column(0).take(pa.array(of, pa.int64())), "piece": pa.array(k, pa.int32()), "start": pa.array(a, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(ids, pa.binary())} if with_ids else {}))

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take for the greatest sum that is at most room; longer ones are tried first."""
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        steps.append((length, reach))
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            reach |= reach << (k * length)
            left, k = left - k, k * 2
        reach &= (1 << (room + 1)) - 1
        if reach >> room:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> total & 1:
            taken[length] = taken.get(length, 0) + 1
            total -= length
    return taken


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Combinations of lengths and how many bins hold each; together they take all pieces."""
    left, plan = {x: n for x, n in counts.items() if n}, []
    while left:
        longest = max(left)
        taken = fullest(left | {longest: left[longest] - 1}, capacity - longest)
        taken[longest] = taken.get(longest, 0) + 1
        times = min(left[x] // k for x, k in taken.items())
        plan.append((times, taken))
        for x, k in taken.items():
            left[x] -= times * k
            if not left[x]:
                del left[x]
    return plan


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """Add sequence_id and offset to rows with a column `length` (long, 1 to capacity), packing each row into one sequence.

    order: columns that tell rows of one length apart; rows alike in them may change places. items is read three times
    and should be a written table. A row whose length is null or out of range raises an error.
    """
    spark = items.sparkSession
    histogram = {r[0]: r[1] for r in items.groupBy("length").count().collect()}  # a row for each length
    if any(x is None or not 0 < x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    # a length has a bucket for each BUCKET_ROWS of its pieces, so that full pieces, a large share of all, are spread as rare ones are not
    buckets = F.array(*[F.lit(-(-histogram.get(x, 1) // BUCKET_ROWS)).cast("long") for x in range(capacity + 1)])
    mixed = F.xxhash64(*order) if order else F.xxhash64("length", F.monotonically_increasing_id())
    rows = items.withColumn("_bucket", F.pmod(mixed, F.get(buckets, F.col("length").cast("int"))))
    counted = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    plan, first, used = [], 0, dict.fromkeys(histogram, 0)
    for times, taken in plan_bins(histogram, capacity):
        at = 0
        for length, k in sorted(taken.items(), reverse=True):
            plan.append((length, used[length], k, first, at))
            used[length] += times * k
            at += length * k
        first += times
    plan.sort()
    table = spark.sparkContext.broadcast(np.array(plan, np.int64).reshape(-1, 5))  # a few rows for each length
    window = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.withColumn("_base", F.coalesce(F.sum("_n").over(window), F.lit(0))).drop("_n")
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*(order or ("length",)))))
    ranked = ranked.join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") - 1 + F.col("_base"))
    ranked = ranked.select(*items.columns, "_rank")
    at, names = {c: i for i, c in enumerate(ranked.columns)}, [*items.columns, "sequence_id", "offset"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, start, k, bin_, offset = table.value.T
        bounds = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            n, rank = (np.asarray(batch.column(at[c])) for c in ("length", "_rank"))
            row = np.empty(len(n), np.int64)
            for x in np.unique(n):
                own = n == x
                a, b = bounds[x], bounds[x + 1]
                row[own] = a + np.searchsorted(start[a:b], rank[own], side="right") - 1
            place = rank - start[row] if len(n) else rank
            columns = [batch.column(i) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bin_[row] + place // k[row], pa.int64()), pa.array(offset[row] + place % k[row] * n, pa.int64())], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, **options) -> DataFrame:
    """Tokenise, cut and pack documents: the columns of pieces() with sequence_id and offset."""
    id_col = options.get("id_col", "doc_id")
    return pack(write_table(pieces(docs, path, **options), "pieces"), options.get("capacity", CAPACITY), (id_col, "piece", "ids_crc32", "start"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


QUERIES = {"op4_pack": op4_pack}
ORACLE: dict[str, str] = {}
