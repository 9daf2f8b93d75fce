"""Chunks of documents that ask other tasks about what they hold.

A chunk is a few megabytes of documents of one input partition, kept as one compressed row in a table in the
shared folder. Chunks send sorted keys, a blob for each receiving part, and get blobs back; so rows
between tasks are few and large, and a key that many documents share is sent once by each chunk.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _mixed, span_hashes
from .common import parts, small_batches

#: Bytes of text in a chunk; a longer text is a chunk of its own.
CHUNK = 3_000_000
#: Words hashed at once.
WORDS = 200_000
SCHEMA = "kind int, chunk long, part int, data binary"
TEXT, ASK, TELL, DONE = 9, 1, 2, 3
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def blob(*columns: np.ndarray) -> bytes:
    """Integer arrays as one compressed blob, byte planes apart, so that high bytes that are alike vanish."""
    out = [np.array([len(columns)] + [len(c) for c in columns], "<u8").tobytes()]
    for c in columns:
        out.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unblob(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    lengths, at, out = np.frombuffer(raw, "<u8", n, 8).astype(int), 8 * (n + 1), []
    for k in lengths.tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * k, at).reshape(8, k).T).view("<u8").reshape(-1))
        at += 8 * k
    return out


def sealed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue())


def opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_next_batch()


class Chunk:
    """Documents in the order of their ids (null last), with columns id (long), text (binary) and what is carried."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch
        self.ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
        self.texts = batch.column(1).to_pylist()

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word in a row, and where each document's words start (with the end)."""
        texts = [t.lower() for t in self.texts] if lower else self.texts
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, np.uint8)
        word = np.zeros(len(data) + 1, np.int8)
        word[:-1] = ~_BLANK[data]
        edge = np.diff(word, prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hashes = np.empty(len(starts), np.uint64)
        for i in range(0, len(starts), WORDS):
            a, b = starts[i : i + WORDS], ends[i : i + WORDS]
            hashes[i : i + WORDS] = span_hashes(data[a[0] : b[-1]], a - a[0], b - a[0])
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        return hashes, np.searchsorted(starts, at)


def gram_hashes(symbols: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n symbols in a row, at the first; none for the last n - 1."""
    if len(symbols) < n:
        return np.zeros(0, np.uint64)
    at = np.arange(len(symbols) - n + 1)
    return span_hashes(_mixed(symbols), at, at + n)


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    """A part from 0 to n - 1 for each 64-bit key, by its upper half; sorted keys have sorted parts."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def by_part(part: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """Parts that occur in a sorted array, each with its slice."""
    bounds = np.searchsorted(part, np.arange(n + 1))
    for p in range(n):
        if bounds[p] < bounds[p + 1]:
            yield p, slice(int(bounds[p]), int(bounds[p + 1]))


def trim() -> None:
    """Give memory that Python and Arrow have freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches without nulls, some `rows` rows at a time and all rows of equal first `keys` columns together."""
    held, n, most = [], 0, rows
    for batch in batches:
        held.append([np.asarray(c) for c in batch.columns])
        n += batch.num_rows
        if n < most:
            continue
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        other = np.any([c != c[-1] for c in columns[:keys]], axis=0)
        end = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if end:
            yield [c[:end] for c in columns]
        held, n = [[c[end:].copy() for c in columns]], n - end
        most = max(rows, 2 * n)
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


class Rows:
    """Collects rows of SCHEMA and gives them out in batches of some megabytes."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, kind: int, chunk: int, part: int, data: bytes) -> None:
        self.rows.append((kind, chunk, part, data))
        self.size += len(data)

    def flush(self, least: int = 4_000_000) -> Iterator[pa.RecordBatch]:
        if self.rows and self.size >= least:
            kind, chunk, part, data = zip(*self.rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()), pa.array(part, pa.int32()), pa.array(data, pa.binary())], ["kind", "chunk", "part", "data"])
            self.rows, self.size = [], 0


def cut(docs: DataFrame, text_col: str, id_col: str, carry: list[str], ask: Callable[[Chunk], Iterator[tuple[int, int, bytes]]]) -> DataFrame:
    """Rows of SCHEMA: each chunk's documents (TEXT), and what `ask` gives for it as (kind, part, data)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"), *[F.col(c).alias(f"_c_{i}") for i, c in enumerate(carry)])

    def done(held: list[pa.RecordBatch], chunk: int, out: Rows) -> None:
        table = pa.Table.from_batches(held)
        table = table.take(pc.sort_indices(table, sort_keys=[("_id", "ascending")])).combine_chunks()
        batch = table.to_batches()[0]
        for kind, part, data in ask(Chunk(batch)):
            out.add(kind, chunk, part, data)
        out.add(TEXT, chunk, -1, sealed(batch))
        trim()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, out, held, size = TaskContext.get().partitionId() << 32, Rows(), [], 0
        for batch in batches:
            lengths = [n + 64 for n in pc.binary_length(batch.column(1)).to_pylist()]  # a row takes space without a text too
            first = 0
            for i, n in enumerate(lengths):
                if size and size + n > CHUNK:
                    if i > first:
                        held.append(batch.slice(first, i - first))
                    done(held, chunk, out)
                    yield from out.flush()
                    chunk, held, size, first = chunk + 1, [], 0, i
                size += n
            if first < len(lengths):
                held.append(batch.slice(first))
        if held:
            done(held, chunk, out)
        yield from out.flush(0)

    return rows.mapInArrow(cut_up, SCHEMA)


def grouped(rows: DataFrame, key: str, reduce: Callable[[int, Iterator[tuple[int, int, int, bytes]]], Iterator[tuple]], schema: str | None = None) -> DataFrame:
    """Deal rows of SCHEMA by `key` (chunk or part) and hand each key's rows, by kind and part or chunk, to `reduce`.

    Keys are dealt by their numbers, not by a hash of them, so that as many parts as partitions go one to each.
    Without a schema `reduce` gives rows of SCHEMA; with one, record batches.
    """
    spark = rows.sparkSession
    column = 1 if key == "chunk" else 2
    n = parts(spark)
    # chunks are numbered within their input partition
    number = F.col("part").cast("long") if key == "part" else F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(F.lit((1 << 32) - 1)) * F.lit(0x9E3779B1)
    dealt = rows.repartitionById(n, F.pmod(number, F.lit(n)).cast("int")).sortWithinPartitions(key, "kind", "part", "chunk")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield tuple(batch.column(c)[r].as_py() for c in range(4))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows()
        for k, own in groupby(stream(batches), key=lambda r: r[column]):
            for made in reduce(k, own):
                if schema:
                    yield made
                else:
                    out.add(*made)
                    yield from out.flush()
            trim()
        yield from out.flush(0)

    return dealt.mapInArrow(reduced, schema or SCHEMA)
