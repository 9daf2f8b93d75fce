"""Removal of passages that repeat, by prefix-partitioned suffix trees over words.

1. Each chunk samples its word positions: of the short word sequences in a window of min_words, the one of the
   smallest hash. Equal windows choose equal samples, so a window whose sample occurs once has no copy and
   its suffix needs no place in a tree. Samples are counted over all chunks.
2. The suffixes that are left are cut to min_words and dealt by a prefix of their words. A prefix is SHORT words; where too
   many suffixes share it, LONG words, and then the whole path, so that groups fit in memory. Of a chunk's suffixes with
   one path only the first is sent; the others repeat it.
3. In a group the suffixes are sorted by their words, and the words that neighbours have in common are the depths of the suffix
   tree's internal nodes. Nodes of min_words or more are the repeats; all their leaves but the first go back to their
   chunks, which drop the words below them; words in a row that go make up the maximal repeats.

A path is the first ORDERED words, a byte of each word's hash, by which suffixes are sorted, and a 64-bit hash of all
min_words words. Two paths are one if both agree. Sequences that differ in one word alone never have one hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ASK, DONE, TELL, TEXT, Chunk, blob, by_part, cut, gram_hashes, grouped, opened, part_of, unblob
from .common import discard, parts, read_table, write_table

MIN_WORDS = 20
#: Words by which suffixes are sorted, and words of a short and of a long prefix.
ORDERED = 8
SHORT, LONG = 3, 6
#: Buckets in which prefixes are counted, and how many times the mean a bucket may hold before its prefix grows.
BUCKETS = 4096
FULL = 4


def sliding(values: np.ndarray, n: int, pick: np.ufunc) -> np.ndarray:
    """pick (minimum or maximum) over each n values in a row, at the first."""
    done = 1
    while done < n:
        step = min(done, n - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


class Windows:
    """Windows of n words of a chunk: where they start, their samples, and their paths."""

    def __init__(self, chunk: Chunk, n: int):
        self.n, self.chunk = n, chunk
        self.words, self.at = chunk.words()
        left = np.repeat(self.at[1:], np.diff(self.at)) - np.arange(len(self.words))
        self.valid = left[: max(0, len(self.words) - n + 1)] >= n

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each window's sample (48 bits), the samples that occur, sorted, and how often."""
        size = max(1, self.n // 2)
        grams, span = gram_hashes(self.words, size) >> np.uint64(16), self.n - size + 1
        if not len(self.valid):
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
        least = sliding(grams, span, np.minimum)
        # a position is a sample if it is the least of some window that holds it
        padded = np.concatenate([np.zeros(span - 1, np.uint64), np.where(self.valid, least + np.uint64(1), np.uint64(0)), np.zeros(span - 1, np.uint64)])
        chosen = sliding(padded, span, np.maximum) == grams + np.uint64(1)
        values, counts = np.unique(grams[chosen], return_counts=True)
        return least, values, counts

    def paths(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each suffix's first words, a byte of each, and the hash of all its words."""
        high = np.zeros(len(starts), np.uint64)
        for k in range(min(ORDERED, self.n)):
            high |= self.words[starts + k] >> np.uint64(56) << np.uint64(8 * (ORDERED - 1 - k))
        return high, gram_hashes(self.words, self.n)[starts]


def prefixes(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The short and the long prefix of paths."""
    return high >> np.uint64(8 * (ORDERED - SHORT)), high >> np.uint64(8 * (ORDERED - LONG))


def prefix_buckets(high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of short and of long prefixes."""
    return tuple((p * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)).astype(np.int64) for p in prefixes(high))


def common_prefixes(high: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Words that each of the sorted paths has in common with the one before: n if all, else up to ORDERED; 0 for the first."""
    depth = np.zeros(len(high), np.int64)
    differ = high[1:] ^ high[:-1]
    _, bits = np.frexp((differ >> np.uint64(8 * (ORDERED // 2))).astype(float))
    _, rest = np.frexp((differ & np.uint64((1 << 8 * (ORDERED // 2)) - 1)).astype(float))
    bits = np.where(bits > 0, bits + 8 * (ORDERED // 2), rest)
    depth[1:] = np.where((differ == 0) & (low[1:] == low[:-1]), n, ORDERED - (bits + 7) // 8)
    return depth


def deep_nodes(high: np.ndarray, low: np.ndarray, ids: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Leaves below internal nodes of n words, but for each node's first: neighbours below a node share n words or more."""
    order = np.lexsort((place, ids, low, high))
    if not len(order):
        return order
    i, p = ids[order], place[order]
    first = np.maximum.accumulate(np.where(common_prefixes(high[order], low[order], n) < n, np.arange(len(order)), 0))
    return order[(i != i[first]) | (p != p[first])]


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS, carry: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """One row for each row of docs: id (long), n_words, n_removed, kept (words left, joined by one space), and `carry`.

    keep_text: the text as it was comes along too, as column original (null counts as empty).

    A word goes if a window of min_words words that holds it has the same words as one that starts earlier: in
    a document of a smaller id, or earlier in the same one. Windows are judged on the input. Words lie between ASCII
    white space and are compared as they are. A null text has no words; a null id counts as the largest. Rows that
    repeat an id count as copies of one document, so none is earlier than another at the same place. An empty table gives an
    empty result; other columns are ignored unless carried, whatever their names.
    """
    spark, carry = docs.sparkSession, carry or []
    n_parts = parts(spark)
    wanted = [f.dataType.simpleString() for f in docs.select(*carry).schema]

    def ask(chunk: Chunk) -> Iterator[tuple[int, int, bytes]]:
        windows = Windows(chunk, min_words)
        _, values, _ = windows.samples()
        for p, s in by_part(part_of(values << np.uint64(16), n_parts), n_parts):
            yield ASK, p, blob(np.diff(values[s], prepend=np.uint64(0)))
        # how many suffixes share the prefixes of each bucket
        starts = np.flatnonzero(windows.valid)
        if len(starts):
            high, _ = windows.paths(starts)
            yield DONE, -2, blob(*(np.bincount(b, minlength=BUCKETS) for b in prefix_buckets(high)))

    cuts = write_table(cut(docs, text_col, id_col, carry, ask), "substring-chunks", "kind")
    texts = cuts.where(F.col("kind") == TEXT).select("kind", "chunk", "part", "data")

    def counted(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        held = [(chunk, np.cumsum(unblob(data)[0], dtype=np.uint64)) for _, chunk, _, data in rows]
        values, counts = np.unique(np.concatenate([v for _, v in held]), return_counts=True)
        more = values[counts > 1]
        for chunk, own in held:
            yield TELL, chunk, part, blob(np.packbits(np.isin(own, more, assume_unique=True)))

    asked = cuts.where(F.col("kind") == ASK).select("kind", "chunk", "part", "data")
    told = write_table(grouped(asked, "part", counted), "substring-samples")
    discard(cuts, f"kind={ASK}")
    full = spark.sparkContext.broadcast(_over_full(cuts))  # two flags for each of BUCKETS buckets

    def sent(chunk_id: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        more: dict[int, bytes] = {}
        for kind, _, part, data in rows:
            if kind != TEXT:
                more[part] = data
                continue
            chunk = Chunk(opened(data))
            windows = Windows(chunk, min_words)
            least, values, counts = windows.samples()
            repeated = counts > 1
            for p, s in by_part(part_of(values << np.uint64(16), n_parts), n_parts):
                repeated[s] |= np.unpackbits(unblob(more[p])[0].astype(np.uint8), count=s.stop - s.start).astype(bool)
            starts = np.flatnonzero(windows.valid)
            starts = starts[repeated[np.searchsorted(values, least[starts])]]
            high, low = windows.paths(starts)
            doc = np.searchsorted(windows.at, starts, side="right") - 1
            ids, place = chunk.ids[doc], starts - windows.at[doc]
            # documents stand in the order of ids, so the first of equal paths is the earliest
            order = np.lexsort((low, high))
            h, l = high[order], low[order]
            node = np.concatenate([[True], (h[1:] != h[:-1]) | (l[1:] != l[:-1])])[: len(h)]
            first = order[np.maximum.accumulate(np.where(node, np.arange(len(h)), 0))]
            again = (ids[order] != ids[first]) | (place[order] != place[first])
            yield DONE, chunk_id, int(part_of(np.array([chunk_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1], np.uint64), n_parts)[0]), blob(starts[order[again]])
            order = order[~again]
            high, low = high[order], low[order]
            one, two = prefix_buckets(high)
            over_one, over_two = full.value
            short, long = prefixes(high)
            prefix = np.where(~over_one[one], short, np.where(~over_two[two], long, high * np.uint64(31) + low))
            part = part_of((prefix + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), n_parts)
            turn = np.argsort(part, kind="stable")
            base = int(chunk.ids[0]) if len(chunk.ids) else 0
            for p, s in by_part(part[turn], n_parts):
                own, k = turn[s], order[turn[s]]
                yield ASK, chunk_id, p, blob(np.diff(high[own], prepend=np.uint64(0)), low[own], (ids[k] - base).astype(np.uint64), place[k], starts[k], np.array([base], np.int64))
            more = {}

    def subtree(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        chunks, held = [], []
        for kind, chunk, _, data in rows:
            if kind == DONE:
                yield TELL, chunk, part, data
                continue
            high, low, ids, place, starts, base = unblob(data)
            chunks.append(chunk)
            held.append((np.cumsum(high, dtype=np.uint64), low, (ids.view(np.int64) + base.view(np.int64)[0]), place, starts))
        if held:
            of = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            high, low, ids, place, starts = (np.concatenate(c) for c in zip(*held, strict=True))
            again = np.sort(deep_nodes(high, low, ids, place, min_words))
            for p, s in by_part(of[again], len(chunks)):
                yield TELL, chunks[p], part, blob(starts[again[s]])

    gone = write_table(grouped(grouped(texts.unionByName(told), "chunk", sent), "part", subtree), "substring-repeats")
    discard(told)

    def finished(_: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        starts: list[np.ndarray] = []
        for kind, _, _, data in rows:
            if kind != TEXT:
                starts.append(unblob(data)[0].astype(np.int64))
                continue
            chunk = Chunk(opened(data))
            words = [t.split() for t in chunk.texts]
            at = np.cumsum([0] + [len(w) for w in words])
            cover = np.zeros(int(at[-1]) + 1, np.int32)
            for s in starts:
                np.add.at(cover, s, 1)
                np.add.at(cover, s + min_words, -1)
            drop = np.cumsum(cover)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(drop)])
            removed = np.diff(total[at])
            kept = [b" ".join([x for x, d in zip(w, drop[a:].tolist(), strict=False) if not d] if r else w) for w, r, a in zip(words, removed.tolist(), at.tolist(), strict=False)]
            columns = [chunk.batch.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())]
            columns += [chunk.batch.column(1).cast(pa.string())] * keep_text
            for i in range(0, len(words), 256):
                yield pa.RecordBatch.from_arrays([c.slice(i, 256) for c in [*columns, *(chunk.batch.column(2 + j) for j in range(len(carry)))]], names)
            starts = []

    names = ["_id", "n_words", "n_removed", "kept", *["original"] * keep_text, *[f"_c_{i}" for i in range(len(carry))]]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, ["long", "long", "long", "string", *["string"] * keep_text, *wanted], strict=True))
    out = grouped(texts.unionByName(gone), "chunk", finished, schema)
    return out.select(F.col("_id").alias(id_col), "n_words", "n_removed", "kept", *["original"] * keep_text, *[F.col(f"_c_{i}").alias(c) for i, c in enumerate(carry)])


def _over_full(cuts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets of short and of long prefixes hold FULL times the mean or more."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.stack(unblob(data.as_py())).astype(np.int64)
        if total.any():
            which, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(bucket), pa.array(total[which, bucket])], ["w", "b", "n"])

    found = cuts.where(F.col("kind") == DONE).select("data").mapInArrow(summed, "w long, b long, n long").groupBy("w", "b").agg(F.sum("n")).collect()
    total = np.zeros((2, BUCKETS), np.int64)
    for w, b, n in found:
        total[w, b] = n
    return tuple(t > FULL * max(1, t.sum() / BUCKETS) for t in total)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op1_substring_dedup": r"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20),
        h AS (SELECT doc_id, i, row_number() OVER (PARTITION BY sha256(array_to_string(ws[i:i + 19], ' ')) ORDER BY doc_id, i) AS nth FROM p),
        g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM h WHERE nth > 1),
        r AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id)
        SELECT w.doc_id, len(ws) AS n_words, coalesce(len(js), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN r ON w.doc_id = r.doc_id
    """
}
QUERIES = {"op1_substring_dedup": op1_substring_dedup}
