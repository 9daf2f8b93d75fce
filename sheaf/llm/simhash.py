"""SimHash near-duplicates: fingerprints, links of few differing bits, connected groups.

Fingerprints that repeat are joined first, so the search sees each value once. Values are dealt into wide groups by
a few bits of every choice of blocks that must agree by the pigeonhole rule (of max_bits + 1 blocks, one at least agrees
between linked values), so no link is lost; more bits, and then more blocks, are taken only as the values grow in number.
Each group is searched by a Gray-order hierarchical index: values are sorted by Gray rank, leaves and upper nodes hold the
bits that all values below share, and pairs of nodes whose shared bits differ too much are pruned together, adding
differences level by level. A task returns a spanning forest of its links, never all pairs. Groups then come
from large-star and small-star rounds over tables in the shared folder.

Where linked texts must share a part of their shingles too, candidates of the index are verified, and similar.py finds
those that fingerprints miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar
from .chunks import trim, whole_groups
from .common import discard, parts, read_table, salted_lookup, small_batches, write_table

SEED = 42
LEAF = 32
FAN = 8
#: Pairs of nodes, and pairs of leaves, handled at once.
FRONT = 200_000
LEAF_PAIRS = 1_000
#: Shingles whose bits are counted at once.
COUNTED = 100_000
#: Rows of keys handled at once.
ROWS = 500_000
#: Values of one key of the index, on average, and from which on a key is cut into blocks.
GROUP = 4096
BLOCK = 200_000
#: Differing bits up to which the index brings candidates, where linked texts must share shingles too.
INDEX_BITS = 4


def shingle_hashes(text: bytes, ngram: int) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z in lower case, words between ASCII white space."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= ngram:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - ngram + 1].tolist()
    return np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[ngram - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: 0."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[i : i + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ngram: int = 4) -> DataFrame:
    """Columns: id, fp (the fingerprint's bits as a signed long). A null text has no words, hence fingerprint 0."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("_text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([majority(shingle_hashes(t.as_py(), ngram)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["_id", "fp"])

    return rows.mapInArrow(signed, f"_id {rows.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Place of each value in the order of the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def components(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest index in each index's group, for links u-v added to the groups in label."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v = u[differ], v[differ]
        np.minimum.at(label, np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ]))
        while not np.array_equal(nxt := label[label], label):
            label = nxt


class GrayIndex:
    """Hierarchy over values sorted by Gray rank; a level holds each node's shared bits (mask) and their values."""

    def __init__(self, values: np.ndarray):
        self.values = values
        starts = np.arange(0, len(values), LEAF)
        all_and, all_or = np.bitwise_and.reduceat(values, starts), np.bitwise_or.reduceat(values, starts)
        self.levels = [(mask := ~(all_and ^ all_or), all_and & mask)]
        while len(self.levels[-1][0]) > 1:
            mask, bits = self.levels[-1]
            starts = np.arange(0, len(mask), FAN)
            ones, zeros = np.bitwise_and.reduceat(bits, starts), np.bitwise_and.reduceat(mask & ~bits, starts)
            self.levels.append((ones | zeros, ones))

    def groups(self, max_bits: int) -> np.ndarray:
        """The smallest index of each value's group, where values of max_bits differing bits or fewer are linked."""
        values, n = self.values, len(self.values)
        label = np.arange(n)
        spans = [np.minimum(np.arange(len(mask) + 1) * LEAF * FAN**level, n) for level, (mask, _) in enumerate(self.levels)]
        top = len(self.levels) - 1
        zero = np.zeros(1, np.int64)
        stack = [(top, zero, zero, np.bitwise_count((self.levels[top][1] ^ self.levels[top][1]) & self.levels[top][0]).astype(np.int64))]
        while stack:
            level, x, y, seen = stack.pop()
            if len(x) > (most := FRONT if level else LEAF_PAIRS):
                stack.append((level, x[most:], y[most:], seen[most:]))
                x, y, seen = x[:most], y[:most], seen[:most]
            # nodes that lie in one group already bring nothing new
            low, high = np.minimum.reduceat(label, spans[level][:-1]), np.maximum.reduceat(label, spans[level][:-1])
            fresh = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
            x, y, seen = x[fresh], y[fresh], seen[fresh]
            if not len(x):
                continue
            if level == 0:
                i = np.minimum(x[:, None] * LEAF + np.arange(LEAF), n - 1)
                j = np.minimum(y[:, None] * LEAF + np.arange(LEAF), n - 1)
                p, a, b = np.nonzero(np.bitwise_count(values[i][:, :, None] ^ values[j][:, None, :]) <= max_bits)
                label = components(n, i[p, a], j[p, b], label)
                continue
            mask, bits = self.levels[level - 1]
            above = self.levels[level][0]
            cx = np.repeat(x, FAN * FAN) * FAN + np.tile(np.repeat(np.arange(FAN), FAN), len(x))
            cy = np.repeat(y, FAN * FAN) * FAN + np.tile(np.arange(FAN), len(x) * FAN)
            own, told = np.repeat(above[x] & above[y], FAN * FAN), np.repeat(seen, FAN * FAN)
            real = (cx < len(mask)) & (cy < len(mask)) & (cx <= cy)
            cx, cy, own, told = cx[real], cy[real], own[real], told[real]
            told = told + np.bitwise_count((bits[cx] ^ bits[cy]) & mask[cx] & mask[cy] & ~own)
            near = told <= max_bits
            stack.append((level - 1, cx[near], cy[near], told[near]))
        return label


def spanning_links(keys: list[np.ndarray], values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each key, just what values of max_bits differing bits connect."""
    order = np.lexsort((gray_rank(values), *keys))
    keys, values = [k[order] for k in keys], values[order]
    if not len(values):
        return values, values
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([starts, [len(values)]]))
    root = np.arange(len(values))
    for k in np.flatnonzero(sizes > 1):
        s = slice(starts[k], starts[k] + sizes[k])
        if sizes[k] > LEAF:
            root[s] = starts[k] + GrayIndex(values[s]).groups(max_bits)
        else:
            near = np.nonzero(np.bitwise_count(values[s][:, None] ^ values[s]) <= max_bits)
            root[s] = starts[k] + components(int(sizes[k]), *near)
    linked = root != np.arange(len(values))
    pairs = np.unique(np.stack([values[linked], values[root[linked]]]), axis=1)
    return pairs[0], pairs[1]


def key_masks(n: int, max_bits: int, group: int) -> list[int]:
    """Masks of which one at least agrees between any values of max_bits differing bits; n even values share a mask's bits with `group` others."""
    wanted = max(0, math.ceil(math.log2(max(n, 1) / group)))
    if not wanted:
        return [0]
    agree = 1
    while 64 * agree // (max_bits + agree) < wanted and agree < 4:
        agree += 1
    blocks = max_bits + agree
    edges, each = [64 * i // blocks for i in range(blocks + 1)], -(-wanted // agree)
    low = [((1 << min(each, edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    return [sum(low[i] for i in chosen) for chosen in combinations(range(blocks), agree)]


def links(values: DataFrame, max_bits: int, group: int | None = None) -> DataFrame:
    """Links (u, v) between the distinct longs in column fp that connect all values of max_bits differing bits or fewer.

    group: values that share a key, if they were even (GROUP). A key of more than BLOCK values is cut into blocks, each two of which meet.
    """
    masks = key_masks(values.count(), max_bits, group or GROUP)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = values.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("choice", "masked"))
    full = write_table(keyed.groupBy("choice", "masked").agg(F.count("*").alias("_n")).where(F.col("_n") > BLOCK), "full-keys")
    none = F.lit(0)
    if full.isEmpty():
        keyed = keyed.select("choice", "masked", none.alias("i"), none.alias("j"), "fp")
    else:
        blocks = F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK).cast("int")
        keyed = salted_lookup(keyed, full, ["choice", "masked"], "fp").select("choice", "masked", "fp", blocks.alias("_blocks"))
        keyed = keyed.withColumn("_b", F.pmod(F.xxhash64("fp"), F.col("_blocks")).cast("int"))
        keyed = keyed.select("*", F.explode(F.sequence(none, F.col("_blocks") - 1)).alias("_o")).select("choice", "masked", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"), "fp")
    key = ["choice", "masked", "i", "j"]
    dealt = keyed.repartition(parts(values.sparkSession), *key).sortWithinPartitions(*key)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *keys, fp in whole_groups(batches, len(key), ROWS):
            u, v = spanning_links(keys, fp.view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(linked, "u long, v long").distinct()


def each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """Rows (u, v) of the named pairs of columns, all made of each row: a union would have the plan of rows once for each pair."""
    made = F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    return rows.select(F.explode(made).alias("_e")).select("_e.*")


def stars(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Columns u, root: each linked value but the smallest of its group, with that smallest value.

    Large-star and small-star rounds until nothing changes; each writes a table in the shared folder.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def state(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    pairs = write_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = state(pairs)
    for _ in range(rounds):
        both = each(pairs, ("u", "v"), ("v", "u"))
        large = salted_lookup(both, least(both), ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        found = salted_lookup(large, least(large), ["u"], "v")
        small = each(found, ("v", "m"), ("u", "m")).where("u <> v").distinct()
        done, pairs = pairs, write_table(small, "stars")
        after = state(pairs)
        discard(done)
        if after == before:
            return pairs.select("u", F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def shingle_sets(ngram: int, by_bits: bool):
    """A function from a column of texts (binary) to each one's distinct shingles' hashes and its unit, a hash of these.

    A text without words has no shingles. by_bits: units hold one fingerprint each.
    """

    def sets(column: pa.Array) -> Iterator[tuple[np.ndarray, int]]:
        from xxhash import xxh64_intdigest

        for t in column:
            hashes = shingle_hashes(t.as_py(), ngram)
            held = np.unique(hashes)
            unit = xxh64_intdigest(held.tobytes(), majority(hashes) if by_bits else 0)
            yield held.view(np.int64), unit - (unit >> 63 << 64)

    return sets


def unit_rows(docs: DataFrame, ngram: int, by_bits: bool) -> DataFrame:
    """Of rows _id, _text (binary), _h: _id, _h, fp, _unit (as by shingle_sets()), _size."""
    small_batches(docs.sparkSession)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fp, unit, size = [], [], []
            for t in batch.column(1):
                hashes = shingle_hashes(t.as_py(), ngram)
                held = np.unique(hashes)
                fp.append(majority(hashes))
                unit.append(xxh64_intdigest(held.tobytes(), fp[-1] if by_bits else 0))
                size.append(len(held))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, unit, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *longs], ["_id", "_h", "fp", "_unit", "_size"])
        trim()

    return docs.select("_id", "_text", "_h").mapInArrow(marked, f"_id {docs.schema['_id'].dataType.simpleString()}, _h long, fp long, _unit long, _size long")


def indexed_clusters(rows: DataFrame, max_bits: int) -> DataFrame:
    """Clusters (_unit, _hub, _size) of units whose fingerprints are equal or linked by the Gray index."""
    units = rows.select("fp", "_unit", "_size").distinct()
    first = units.groupBy("fp").agg(F.min("_unit").alias("_hub"), F.count("*").alias("_m"))
    own = salted_lookup(units, first.where("_m > 1"), ["fp"], "_unit").where("_hub is not null").select("_unit", "_hub", "_size")
    pairs = write_table(links(write_table(rows.select("fp").distinct(), "near-values"), max_bits).where("u <> v"), "near-indexed")
    to = pairs.join(first.select(F.col("fp").alias("v"), "_hub"), "v").select("u", "_hub")
    ends = pairs.select("v").distinct().join(first.select(F.col("fp").alias("v"), "_hub"), "v").select(F.col("v").alias("u"), "_hub")
    near = to.union(ends).distinct()  # as many hubs as keys of the index at most for each value
    return own.union(units.join(near, units["fp"] == near["u"]).select("_unit", "_hub", "_size"))


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ngram: int = 4, max_bits: int = 4, min_similarity: float | None = None) -> DataFrame:
    """One row for each row of docs: id, fingerprint (16 hex digits), component_id, kept, text_hash.

    Fingerprints of max_bits differing bits or fewer are linked; component_id is the smallest id that links
    reach, its own included. Null and empty texts have fingerprint 0 and are linked like any other. A null id
    is passed over in component_id, unless its group has no other. Rows that repeat an id are one row each.
    An empty table gives an empty result; other columns are ignored.
    kept: true for the document of the smallest id in each group (null last); rows alike in id and text stay or go together, and
    so do, without min_similarity, all rows of one id. text_hash: with min_similarity the xxhash64 of the text, else 0.
    min_similarity: linked texts must also share this part, above 0, of the distinct shingles that either holds. The Gray index brings
    candidates of up to INDEX_BITS; an exact search by shingles brings all others, so that no such pair is passed over, with
    max_bits of 64 whatever their fingerprints.
    """
    if min_similarity is None:
        rows = write_table(fingerprints(docs, text_col, id_col, ngram).withColumnRenamed(id_col, "_id"), "fingerprints").withColumn("_unit", F.col("fp"))
        edges = links(rows.select("fp").distinct(), max_bits)
    else:
        text = F.coalesce(F.col(text_col), F.lit(""))
        own = docs.select(F.col(id_col).alias("_id"), text.cast("binary").alias("_text"), F.xxhash64(text).alias("_h"))
        by_bits = max_bits < 64
        rows = write_table(unit_rows(own, ngram, by_bits), "fingerprints")
        edges = similar.similar_links(own, rows, indexed_clusters(rows, min(INDEX_BITS, max_bits)), shingle_sets(ngram, by_bits), max_bits, min_similarity)
    mark = F.col("_h") if "_h" in rows.columns else F.lit(0).cast("long")
    out = grouped(rows, edges, mark)
    kept = F.col("_shared").isNull() | (F.col("_least.id").eqNullSafe(F.col("_id")) & (F.col("_least.mark") == mark))
    group = F.when(F.col("_shared"), F.col("_least.id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), group.alias("component_id"), kept.alias("kept"), mark.alias("text_hash"))


def grouped(rows: DataFrame, edges: DataFrame, mark: Column) -> DataFrame:
    """Adds to rows (_id, _unit, …) of linked units, or of one that several have, _shared and _least (none, id, mark): the smallest of its group."""
    root = stars(edges)
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), mark.alias("mark")))
    values = rows.groupBy("_unit").agg(first.alias("_first"), F.count("*").alias("_n"))
    ends = each(root, ("u", "root"), ("root", "root")).select(F.col("u").alias("_unit"), F.col("v").alias("root")).distinct()
    found = values.join(ends.hint("merge"), "_unit", "left").where("root is not null or _n > 1").withColumn("root", F.coalesce("root", "_unit"))
    found = write_table(found, "groups")  # read twice
    least = found.groupBy("root").agg(F.min("_first").alias("_least"))
    shared = salted_lookup(found, least, ["root"], "_unit").select("_unit", "_least", F.lit(True).alias("_shared"))
    return salted_lookup(rows, shared, ["_unit"], "_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


QUERIES = {"op10_simhash": op10_simhash}
ORACLE: dict[str, str] = {}
