"""Context-tree weighting over bytes: each byte is eight binary decisions, and in each the estimates of all context depths are mixed.

A node of the tree is a context of up to `depth` bytes and the bits of the next byte so far. It holds a
Krichevsky-Trofimov estimate from its counts, and a weight: how probable it is, by what was learned, that no longer
context is needed there. The weights come bottom up from the code lengths of a node and of its longer contexts.
The model is then fixed; texts are scored by it, whether it has learned from them or not.

Counts of (context, byte) leave each chunk as sorted blobs and meet in parts of the tree that hold whole subtrees below
two bytes of context. What lies above is at most 256 x 255 nodes, which the driver sums up and sends to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import TEXT, Chunk, blob, by_part, cut, grouped, opened, part_of, unblob
from .common import discard, parts, read_table, write_table

#: Bytes of context.
DEPTH = 5
#: Byte that ends a text and stands before its start; UTF-8 does not hold it.
END = 255
#: Bytes of context above which the tree is split into parts.
SPLIT = 2
WORDS, GRAMS, TOTALS = 1, 2, 3
HALF = np.log(0.5)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0, by Stirling's series from 10 on."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    while (small := x < 10).any():
        low[small] *= x[small]
        x = np.where(small, x + 1, x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - np.log(low)


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - np.log(np.pi) - log_gamma(n0 + n1 + 1.0)


class Level:
    """Nodes of one depth and one bit: which node each gram passes, the counts, and sums over what lies below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int):
        self.ids, self.of = np.unique(keys >> np.uint64(8 - bit), return_inverse=True)
        one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
        n = len(self.ids)
        self.n0, self.n1 = np.bincount(self.of, counts * ~one, n), np.bincount(self.of, counts * one, n)
        self.one = one

    def estimate(self) -> np.ndarray:
        """Estimated probability of each gram's bit."""
        p1 = (self.n1 + 0.5) / (self.n0 + self.n1 + 1)
        return np.where(self.one, p1[self.of], 1 - p1[self.of])


def weights(n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node's weight for its own estimate, and the log probability that it gives, given the sum of those below."""
    own = kt_log(n0, n1)
    total = np.logaddexp(HALF + own, HALF + below)
    return np.exp(HALF + own - total), total


def keys_at(codes: np.ndarray, depth: int, d: int) -> np.ndarray:
    """(last d bytes of context, byte) of grams coded as context, latest byte first, and byte."""
    return (codes >> np.uint64(8 * (depth - d) + 8) << np.uint64(8)) | (codes & np.uint64(255))


class Subtrees:
    """Nodes from depth `top` on for sorted grams, among which each node's grams are whole."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, top: int):
        self.probability, self.below = [], []
        for bit in range(8):
            p = np.full(len(codes), 0.5)
            total = deeper = None
            for d in range(depth, top - 1, -1):
                level = Level(keys_at(codes, depth, d), counts, bit)
                if total is None:
                    weight, log_p = np.ones(len(level.ids)), kt_log(level.n0, level.n1)
                else:
                    first = np.empty(len(deeper.ids), np.int64)
                    first[deeper.of] = level.of
                    up = np.bincount(first, total, len(level.ids))
                    weight, log_p = weights(level.n0, level.n1, up)
                w = weight[level.of]
                p = w * level.estimate() + (1 - w) * p
                total, deeper = log_p, level
            self.probability.append(p)
            self.below.append((deeper, total))


def upper_weights(nodes: dict[int, tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, ...]]:
    """For each bit, from sorted depth-1 nodes (ids, n0, n1, below): ids, weights and P(1) at depth 1, then at depth 0."""
    out = []
    for bit in range(8):
        ids, n0, n1, below = nodes[bit]
        weight, log_p = weights(n0, n1, below)
        root, of = np.unique(ids & np.uint64((1 << bit) - 1), return_inverse=True)
        r0, r1 = np.bincount(of, n0, len(root)), np.bincount(of, n1, len(root))
        root_weight, _ = weights(r0, r1, np.bincount(of, log_p, len(root)))
        out.append((ids, weight, (n1 + 0.5) / (n0 + n1 + 1), root, root_weight, (r1 + 0.5) / (r0 + r1 + 1)))
    return out


def log10_probabilities(tree: Subtrees, codes: np.ndarray, depth: int, upper: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of each gram's probability, given what lies above the subtrees."""
    total = np.zeros(len(codes))
    keys = keys_at(codes, depth, 1)
    for bit in range(8):
        p = tree.probability[bit]
        one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
        node = keys >> np.uint64(8 - bit)
        ids, weight, p1, root, root_weight, root_p1 = upper[bit]
        for at, w, q in ((np.searchsorted(ids, node), weight, p1), (np.searchsorted(root, node & np.uint64((1 << bit) - 1)), root_weight, root_p1)):
            p = w[at] * np.where(one, q[at], 1 - q[at]) + (1 - w[at]) * p
        total += np.log10(p)
    return total


def grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Coded grams of all texts with their ends, and where each text's start (with the end)."""
    data = np.frombuffer(b"".join(bytes([END]) * depth + t + bytes([END]) for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    scored = np.ones(len(data), bool)
    for j in range(depth):
        scored[at[:-1] + np.arange(len(texts)) * depth + j] = False
    codes = data[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        part = data[depth - j : len(data) - j].astype(np.uint64)
        part <<= np.uint64(8 * (depth - j) + 8)
        codes |= part
    return codes[scored[depth:]], at


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and where each value is among them; in less memory and time than numpy's."""
    order = np.argsort(values)
    found = values[order]
    head = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=head[1:])
    of = np.empty(len(found), np.int32)
    of[order] = np.cumsum(head, dtype=np.int32) - 1
    return found[head], of


def gram_part(codes: np.ndarray, depth: int, n: int) -> np.ndarray:
    top = codes >> np.uint64(8 * (depth - SPLIT) + 8)
    return part_of((top + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), n)


class Asked:
    """What a chunk asks: distinct words and grams, in the order in which answers come back."""

    def __init__(self, chunk: Chunk, depth: int, n_parts: int):
        texts = [t.lower() for t in chunk.texts]
        words, self.word_at = chunk.words(lower=True)
        self.words, self.word_of = distinct(words)
        self.word_part = part_of(self.words, n_parts)
        codes, self.gram_at = grams(texts, depth)
        codes, of = distinct(codes)
        part = gram_part(codes, depth, n_parts)
        turn = np.argsort(part, kind="stable")
        self.grams, self.gram_part = codes[turn], part[turn]
        back = np.empty(len(turn), np.int32)
        back[turn] = np.arange(len(turn), dtype=np.int32)
        self.gram_of = back[of]


def merged(rows: Iterator[tuple]) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """Of blobs of (steps of sorted keys, counts): chunks, their keys, and all distinct keys with summed counts."""
    chunks, keys, counts = [], [], []
    for _, chunk, _, data in rows:
        step, n = unblob(data)
        chunks.append(chunk)
        keys.append(np.cumsum(step, dtype=np.uint64))
        counts.append(n.astype(float))
    every, of = distinct(np.concatenate(keys))
    return chunks, keys, every, np.bincount(of, np.concatenate(counts), len(every))


def score_texts(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: id (long), learned, n_tokens, n_known, train_tokens, base_score, score.

    A-Z is lower-cased. score: log10 of the model's probability of the text's bytes and its end; code length per byte is
    -score * log2(10) / bytes. base_score: by add-one counts of words between ASCII white space, and one end a text. `learn` says
    which rows the model and the counts learn from (null: not). A null text counts as empty; rows that repeat are learned
    from and scored as often; null ids are kept. An empty table gives an empty result, and a table without rows to learn from
    an even distribution. Other columns are ignored.
    """
    spark = docs.sparkSession
    n_parts = parts(spark)
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(learn, F.lit(False)).alias("_learn"))

    def ask(chunk: Chunk) -> Iterator[tuple[int, int, bytes]]:
        asked = Asked(chunk, depth, n_parts)
        learned = np.array(chunk.batch.column(2).to_pylist(), bool)
        own = np.repeat(learned, np.diff(asked.word_at))
        counts = np.bincount(asked.word_of, own, len(asked.words)).astype(np.int64)
        for p, s in by_part(asked.word_part, n_parts):
            yield WORDS, p, blob(np.diff(asked.words[s], prepend=np.uint64(0)), counts[s])
        counts = np.bincount(asked.gram_of, np.repeat(learned, np.diff(asked.gram_at)), len(asked.grams)).astype(np.int64)
        for p, s in by_part(asked.gram_part, n_parts):
            yield GRAMS, p, blob(np.diff(asked.grams[s], prepend=np.uint64(0)), counts[s])
        yield TOTALS, -2, blob(np.array([int(own.sum()), int(learned.sum())]))

    cuts = write_table(cut(marked, "_text", "_id", ["_learn"], ask), "scoring-chunks", "kind")
    of_kind = lambda k: cuts.where(F.col("kind") == k).select("kind", "chunk", "part", "data")

    def count_words(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        chunks, keys, every, counts = merged(rows)
        yield TOTALS, -1, part, blob(np.array([int((counts > 0).sum()), 0, 0]))
        for chunk, own in zip(chunks, keys, strict=True):
            yield WORDS, chunk, part, blob(counts[np.searchsorted(every, own)].astype(np.int64))

    word_replies = write_table(grouped(of_kind(WORDS), "part", count_words), "scoring-words", "kind")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3, np.int64)
        for batch in batches:
            for data in batch.column(0):
                found = unblob(data.as_py())[0].astype(np.int64)
                total += found if len(found) == 3 else np.array([0, *found])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], ["v", "w", "d"])

    totals = of_kind(TOTALS).select("data").union(word_replies.where(F.col("kind") == TOTALS).select("data"))
    vocabulary, words_learned, docs_learned = (x or 0 for x in totals.mapInArrow(sums, "v long, w long, d long").agg(F.sum("v"), F.sum("w"), F.sum("d")).first())
    train_tokens, vocabulary = words_learned + docs_learned, vocabulary + (docs_learned > 0)

    def summit(_: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        _, _, codes, counts = merged(rows)
        tree = Subtrees(codes, counts, depth, SPLIT)
        for bit, (level, total) in enumerate(tree.below):
            # (last byte, bits so far) of nodes of two bytes
            up = (level.ids >> np.uint64(bit + 8) << np.uint64(bit)) | (level.ids & np.uint64((1 << bit) - 1))
            ids, of = np.unique(up, return_inverse=True)
            values = (np.bincount(of, x, len(ids)) for x in (level.n0, level.n1, total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), bit)), pa.array(ids.astype(np.int64)), *map(pa.array, values)], ["bit", "id", "n0", "n1", "below"])

    top = grouped(of_kind(GRAMS), "part", summit, "bit long, id long, n0 double, n1 double, below double")
    # at most 256 x 255 rows
    found = top.groupBy("bit", "id").agg(F.sum("n0"), F.sum("n1"), F.sum("below")).toPandas().to_numpy()
    found = found[np.lexsort((found[:, 1], found[:, 0]))] if len(found) else found.reshape(0, 5).astype(float)
    upper = spark.sparkContext.broadcast(upper_weights({bit: (own[:, 1].astype(np.uint64), *own[:, 2:].T.astype(float)) for bit in range(8) for own in [found[found[:, 0] == bit]]}))

    def score_grams(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        chunks, keys, every, counts = merged(rows)
        value = log10_probabilities(Subtrees(every, counts, depth, SPLIT), every, depth, upper.value).astype(np.float32).view(np.uint32)
        for chunk, own in zip(chunks, keys, strict=True):
            yield GRAMS, chunk, part, blob(value[np.searchsorted(every, own)])

    gram_replies = write_table(grouped(of_kind(GRAMS), "part", score_grams), "scoring-grams")
    for kind in (WORDS, GRAMS):  # answered
        discard(cuts, f"kind={kind}")

    def scored(_: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        counts, values = {}, {}
        for kind, _, part, data in rows:
            if kind != TEXT:
                (counts if kind == WORDS else values)[part] = unblob(data)[0]
                continue
            chunk = Chunk(opened(data))
            asked = Asked(chunk, depth, n_parts)
            whole = lambda found: np.concatenate([found[p] for p in sorted(found)] or [np.zeros(0, np.uint64)])
            count = whole(counts).astype(float)
            logs = np.log10((count + 1) / (train_tokens + vocabulary + 1))
            end = np.log10((docs_learned + 1) / (train_tokens + vocabulary + 1))
            add = lambda x, at: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
            value = whole(values).astype(np.uint32).view(np.float32).astype(float)
            n = np.diff(asked.word_at)
            base = np.array([logs[asked.word_of[a:b]].sum() for a, b in zip(asked.word_at[:-1], asked.word_at[1:], strict=True)]) + end
            score = np.array([value[asked.gram_of[a:b]].sum() for a, b in zip(asked.gram_at[:-1], asked.gram_at[1:], strict=True)])
            known = add(count[asked.word_of] > 0, asked.word_at) + (docs_learned > 0)
            yield pa.RecordBatch.from_arrays([chunk.batch.column(0), chunk.batch.column(2), pa.array(n + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)], names)
            counts, values = {}, {}

    names = ["_id", "learned", "n_tokens", "n_known", "base_score", "score"]
    rows = of_kind(TEXT).union(word_replies.where(F.col("kind") == WORDS).select("kind", "chunk", "part", "data")).union(gram_replies)
    out = grouped(rows, "chunk", scored, "_id long, learned boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("_id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 7 != 2)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLE: dict[str, str] = {}
