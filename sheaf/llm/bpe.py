"""Byte-level BPE encoding and decoding in two tiers.

Pre-tokens are found for a slab of texts at once from character classes, as the public pattern would split
them. A minimal perfect hash resolves those that are entries of the vocabulary; each other distinct pre-token is
merged once by a heap over linked bytes. Every slab is decoded again and compared with its bytes, so a chance match
of 64-bit hashes is found out and its slab is encoded piece by piece instead.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, small_batches

#: Characters of a slab; a longer text is a slab of its own.
SLAB = 1_000_000
#: Merged pre-tokens that a Python worker keeps; beyond it starts anew.
KEPT = 150_000
#: Fixed values of the split pattern: white space, and the letters after an apostrophe that are pre-tokens with it.
SPACES = (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPACE, LETTER, NUMBER, OTHER = range(4)
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as many as are asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


_TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for bytes, or for 64-bit symbols that are mixed already."""
    up, down = Powers.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: a displacement for each bucket sends its keys to free slots.

    Buckets of one key point at a slot left over, so slots are as many as keys.
    """

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(bounds)
        self.shift, slot_of = np.zeros(self.buckets, np.int64), np.zeros(n, np.int64)
        free = bytearray(b"\1" * n)
        values = [int(k) for k in keys]
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[bounds[b] : bounds[b + 1]].tolist()
            if len(own) < 2:
                break
            d = 0
            while True:
                slots = [self._slot(values[i], d) for i in own]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(own, slots, strict=True):
                free[s], slot_of[i] = 0, s
        left = (s for s in range(n) if free[s])
        for b in np.flatnonzero(sizes == 1):
            i = order[bounds[b]]
            slot_of[i] = next(left)
            self.shift[b] = -1 - slot_of[i]
        self.order = np.empty(n, np.int64)
        self.order[slot_of] = np.arange(n)
        self.keys = keys[self.order]

    def _slot(self, key: int, d: int) -> int:
        return ((((key ^ (d * 0xD1342543DE82EF95)) * 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF) >> 33) % self.n

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key among those given first, or -1."""
        d = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        far = (((keys ^ (d.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(33)) % np.uint64(self.n)
        slot = np.where(d < 0, -1 - d, far.astype(np.int64))
        return np.where(self.keys[slot] == keys, self.order[slot], -1)


def char_classes() -> np.ndarray:
    """Class of each code point: white space, letter, number, other."""
    import unicodedata

    found = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        if (k := unicodedata.category(chr(c))[0]) in "LN":
            found[c] = LETTER if k == "L" else NUMBER
    found[list(SPACES)] = SPACE
    return found


class Classes:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = char_classes()
        return cls.table


def split_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points of several texts, given where the texts (not empty ones) start."""
    n = len(chars)
    kind = Classes.get()[chars]
    text = np.zeros(n + 1, bool)
    text[first] = text[n] = True
    start = text.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    run = start.copy()
    after_space = np.flatnonzero(start[1:n] & ~text[1:n] & (kind[:-1] == SPACE)) + 1
    start[after_space - 1] = True
    start[after_space[chars[after_space - 1] == 32]] = False
    quote = np.flatnonzero((chars == 39) & start[:n] & run[1:] & ~text[1:])
    if len(quote):
        quote = quote[kind[np.minimum(quote + 1, n - 1)] == LETTER]
        a = chars[quote + 1]
        b = np.where(quote + 2 < n, chars[np.minimum(quote + 2, n - 1)], 0)
        b = np.where(text[quote + 2], 0, b)
        length = np.zeros(len(quote), np.int64)
        for c in CONTRACTIONS:
            length[(a == ord(c[0])) & ((b == ord(c[-1])) if len(c) == 2 else True)] = len(c)
        quote, length = quote[length > 0], length[length > 0]
        start[quote + 1] = False
        start[quote + 1 + length] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Encodes and decodes by a list of entries, in rank order, each with all its bytes."""

    def __init__(self, entries: dict[bytes, int]):
        self.ranks = entries
        ordered = sorted(entries, key=entries.get)
        self.ids = np.array([entries[e] for e in ordered], np.uint32)
        lengths = np.array([len(e) for e in ordered], np.int64)
        self.blob = np.frombuffer(b"".join(ordered), np.uint8)
        top = int(self.ids.max()) + 1
        self.entry_start, self.entry_length = np.zeros(top, np.int64), np.zeros(top, np.int64)
        ends = np.cumsum(lengths)
        self.entry_start[self.ids], self.entry_length[self.ids] = ends - lengths, lengths
        self.index = PerfectHash(span_hashes(self.blob, ends - lengths, ends))
        self.kept: dict[bytes, list[int]] = {}

    @classmethod
    def from_tiktoken(cls, data: bytes) -> Encoder:
        """From a rank file: a line for each entry, its bytes in base64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of the lowest rank is merged first, the leftmost of equal ones."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, mid, end = heappop(heap)
            if after[i] != mid or after[mid] != end:
                continue
            after[i], after[mid], before[end] = end, -1, i
            if end < n and (r := ranks.get(piece[i : after[end]])) is not None:
                heappush(heap, (r, i, end, after[end]))
            if i and (r := ranks.get(piece[(p := before[i]) : end])) is not None:
                heappush(heap, (r, p, i, end))
        found, i = [], 0
        while i < n:
            found.append(ranks[piece[i : after[i]]])
            i = after[i]
        return found

    def merged(self, piece: bytes) -> list[int]:
        found = self.kept.get(piece)
        if found is None:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            found = self.kept[piece] = self.merge(piece)
        return found

    def merged_all(self, pieces: list[bytes]) -> list[list[int]]:
        return [self.merged(p) for p in pieces]

    def slab(self, texts: list[str], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has. exact: without hashes."""
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(chars):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first = np.cumsum(sizes) - sizes
        starts = split_starts(chars, first[sizes > 0])
        width = 1 + (chars > 0x7F).astype(np.int64) + (chars > 0x7FF) + (chars > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width)])
        data = "".join(texts).encode()
        begin = at[starts]
        end = np.append(begin[1:], len(data))
        if exact:
            found = [self.merged(data[a:b]) if data[a:b] not in self.ranks else [self.ranks[data[a:b]]] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            count = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter((i for f in found for i in f), np.uint32, int(count.sum()))
        else:
            hashes = span_hashes(np.frombuffer(data, np.uint8), begin, end)
            entry = self.index.find(hashes)
            miss = np.flatnonzero(entry < 0)
            _, one, which = np.unique(hashes[miss], return_index=True, return_inverse=True)
            own = self.merged_all([data[a:b] for a, b in zip(begin[miss[one]].tolist(), end[miss[one]].tolist(), strict=True)])
            own_count = np.fromiter(map(len, own), np.int64, len(own))
            own_ids = np.fromiter((i for f in own for i in f), np.uint32, int(own_count.sum()))
            count = np.ones(len(starts), np.int64)
            count[miss] = own_count[which]
            place = np.cumsum(count) - count
            ids = np.empty(int(count.sum()), np.uint32)
            ids[place[entry >= 0]] = self.ids[entry[entry >= 0]]
            reps = count[miss]
            within = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            ids[np.repeat(place[miss], reps) + within] = own_ids[np.repeat((np.cumsum(own_count) - own_count)[which], reps) + within]
            if self.decode(ids) != data:
                return self.slab(texts, exact=True)
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = total[np.searchsorted(starts, np.append(first, len(chars)))]
        return ids, np.diff(bounds)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids; each must be in the vocabulary."""
        length = self.entry_length[ids]
        shift = self.entry_start[ids] - (np.cumsum(length) - length)
        return self.blob[np.repeat(shift, length) + np.arange(int(length.sum()))].tobytes()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, slab by slab."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLAB):
                size += len(texts[j])
                j += 1
            ids, counts = self.slab(texts[i:j])
            yield from np.split(ids, np.cumsum(counts)[:-1])
            i = j


class Source:
    """A vocabulary to send to executors, which build its encoder once in each Python worker."""

    _built: dict[str, Encoder] = {}

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:  # the driver reads it; its size is that of a vocabulary
            data = f.read()
        self.digest, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    @cached_property
    def encoder(self) -> Encoder:
        if self.digest not in self._built:
            self._built[self.digest] = Encoder.from_tiktoken(self.data.value)
        return self._built[self.digest]

    def __getstate__(self) -> dict:
        return {"digest": self.digest, "data": self.data}


def encode(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", decode: bool = False) -> DataFrame:
    """Columns: id, ids (little-endian unsigned 32-bit integers), n_tokens, and with `decode` also decoded (bytes).

    A null or empty text has no ids. Special tokens' strings are ordinary text. Repeated rows are rows of their own;
    an empty table gives an empty result; other columns are ignored. path: a rank file that the driver can read.
    """
    small_batches(docs.sparkSession)
    source = Source(docs.sparkSession, path)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(source.encoder.encode(batch.column(1).to_pylist()))
            columns = {"_id": batch.column(0), "ids": pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()), "n_tokens": pa.array([len(i) for i in ids], pa.int64())}
            if decode:
                columns["decoded"] = pa.array([source.encoder.decode(i) for i in ids], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, ids binary, n_tokens long" + ", decoded binary" * decode
    return rows.mapInArrow(encoded, schema).withColumnRenamed("_id", id_col)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """Columns: id, decoded (bytes of the ids; null for null)."""
    small_batches(tokens.sparkSession)
    source = Source(tokens.sparkSession, path)
    rows = tokens.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if x is None else source.encoder.decode(np.frombuffer(x, "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["_id", "decoded"])

    return rows.mapInArrow(decoded, f"_id {rows.schema['_id'].dataType.simpleString()}, decoded binary").withColumnRenamed("_id", id_col)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), decode=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
