"""Set similarity join by PartEnum signatures: documents that share nearly all of their word shingles.

Documents of equal shingle sets are one unit. Sizes are cut into bands; two sets whose Jaccard similarity reaches the share lie in one
band or in two that are next to each other, and differ in k shingles at most, which the band's largest size gives. The domain of
shingles is partitioned by a hash into (k + 1) / 2 parts, so that linked sets differ in one shingle at most in some part, and each part
into SUBPARTS, so that all but one of these are equal there: a signature is the hash of what a set has in all but one subpart of a
part. So linked sets share a signature, whatever they hold.

Units under one signature become members of the cluster of the smallest of them, and similar.py compares clusters exactly, the hub
first, in blocks of bounded size; what leaves a task is a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import similar
from .bpe import _mixed
from .chunks import trim
from .common import discard, parts, read_table, small_batches, write_table
from .simhash import grouped, shingle_sets

#: How much larger the largest size of a band is than its smallest; a linked set may not be larger by more.
GROWTH = 1.25
#: Subparts of a part, of which a signature leaves one out.
SUBPARTS = 3
#: Shingles of a set that are summed at once, so that sums of half a hash stay exact.
SUMMED = 1 << 20
#: Units that a task remembers in order not to sign them again.
SEEN = 200_000


@cache
def band(number: int) -> tuple[int, int]:
    """The smallest and largest size of a band."""
    low = band(number - 1)[1] + 1 if number else 1
    return low, max(low, int(low * GROWTH))


def tags(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, differing shingles) under which a set of a size is signed: its own band, and the next if a linked set can be in it.

    Where linked sets can't differ there is nothing to sign: equal sets are one unit.
    """
    own = 0
    while band(own)[1] < size:
        own += 1
    found = [own] + [own + 1] * (size * 100 // percent >= band(own + 1)[0])
    differ = [(b, 2 * band(b)[1] * (100 - percent) // (100 + percent)) for b in found]
    return [(b, k) for b, k in differ if k]


def signatures(held: np.ndarray, percent: int) -> np.ndarray:
    """Signatures (64 bits) of a set of distinct shingle hashes."""
    out = [np.zeros(0, np.uint64)]
    value = _mixed(held + np.uint64(0x9E3779B97F4A7C15))
    low, high = (value & np.uint64(0xFFFFFFFF)).astype(np.float64), (value >> np.uint64(32)).astype(np.float64)
    for number, k in tags(len(held), percent):
        n = (k + 2) // 2
        cell = ((held >> np.uint64(32)) % np.uint64(n)).astype(np.int64) * SUBPARTS + ((held & np.uint64(0xFFFFFFFF)) % np.uint64(SUBPARTS)).astype(np.int64)
        sums = np.zeros(n * SUBPARTS, np.uint64)
        for i in range(0, len(held), SUMMED):
            s = slice(i, i + SUMMED)
            a, b = (np.bincount(cell[s], weights=w[s], minlength=len(sums)).astype(np.uint64) for w in (low, high))
            sums += a + (b << np.uint64(32))
        cells = sums.reshape(n, SUBPARTS)
        label = _mixed((np.uint64(number << 40) + np.arange(n * SUBPARTS, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15))
        out.append(_mixed((cells.sum(1, dtype=np.uint64)[:, None] - cells).reshape(-1) + label))
    return np.concatenate(out)


def set_rows(docs: DataFrame, ngram: int) -> DataFrame:
    """Of rows _id, _text (binary), _h: _id, _h, _unit (a hash of the set of shingles), _size."""
    sets = shingle_sets(ngram, False)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(unit, len(held)) for held, unit in sets(batch.column(1))]
            unit, size = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(unit, pa.int64()), pa.array(size, pa.int64())], ["_id", "_h", "_unit", "_size"])
        trim()

    return docs.select("_id", "_text", "_h").mapInArrow(counted, f"_id {docs.schema['_id'].dataType.simpleString()}, _h long, _unit long, _size long")


def signed(docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """Rows _s, _unit, _size: each unit's signatures; a unit that several tasks have comes from each of them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets = shingle_sets(ngram, False)
        for batch in batches:
            keys, units, sizes = [np.zeros(0, np.uint64)], [], []
            for held, unit in sets(batch.column(0)):
                if unit not in seen:
                    seen.add(unit)
                    keys.append(signatures(held.view(np.uint64), percent))
                    units.append(unit)
                    sizes.append(len(held))
            if len(seen) > SEEN:
                seen.clear()
            n = np.array([len(k) for k in keys[1:]], np.int64)
            columns = [np.concatenate(keys).view(np.int64), *(np.repeat(np.array(x, np.int64), n) for x in (units, sizes))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["_s", "_unit", "_size"])
        trim()

    return docs.select("_text").mapInArrow(sign, "_s long, _unit long, _size int")


def clusters(rows: DataFrame) -> DataFrame:
    """Rows _unit, _hub, _size: units that share a signature, under the smallest of them.

    Rows of a signature come sorted, so its hub is the first, and no group is held, however large.
    """
    names = ["_unit", "_hub", "_size"]

    def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = last = size = None
        fresh = False  # whether the hub is still to be told
        for batch in batches:
            s, unit, sizes = (np.asarray(c) for c in batch.columns)
            if not len(s):
                continue
            starts = np.concatenate([[key is None or s[0] != key], s[1:] != s[:-1]])
            first = np.maximum.accumulate(np.where(starts, np.arange(len(s)), -1))
            of = np.where(first >= 0, unit[first], hub if hub is not None else 0)
            before = np.concatenate([[last if last is not None and not starts[0] else unit[0]], unit[:-1]])
            other = ~starts & (unit != before)  # a unit that comes again is passed over
            out = [unit[other], of[other], sizes[other].astype(np.int64)]
            heads = np.unique(first[other & (first >= 0)])
            out = [np.concatenate([a, b]) for a, b in zip(out, (unit[heads], unit[heads], sizes[heads].astype(np.int64)), strict=True)]
            if fresh and (other & (first < 0)).any():  # the hub came in an earlier batch
                out = [np.append(a, b) for a, b in zip(out, (hub, hub, size), strict=True)]
                fresh = False
            if starts.any():
                at = int(np.flatnonzero(starts)[-1])
                hub, size = int(unit[at]), int(sizes[at])
                fresh = not bool((other & (first == at)).any())
            key, last = s[-1], unit[-1]
            pair = np.unique(np.stack(out), axis=1)  # several signatures lead to one hub
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in pair], names)

    dealt = rows.repartition(parts(rows.sparkSession), "_s").sortWithinPartitions("_s", "_unit")
    return dealt.mapInArrow(hubs, "_unit long, _hub long, _size long").groupBy("_unit", "_hub").agg(F.max("_size").alias("_size"))


def jaccard_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", ngram: int = 3, percent: int = 90) -> DataFrame:
    """One row for each row of docs: id, n_shingles, component_id (the smallest id that links reach, its own included).

    Two rows are linked if 100 x shared shingles >= percent x shingles of either. A text of fewer words than a shingle is one shingle; one
    without words, null ones too, has none and is linked with nothing. Rows that repeat an id are one row each; a null id is passed
    over in component_id unless its group has no other. An empty table gives no rows; extra columns are passed over.
    """
    if not 100 <= GROWTH * percent <= GROWTH * 100:
        raise ValueError(f"percent must be {100 / GROWTH:g} to 100")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), text.cast("binary").alias("_text"), F.xxhash64(text).alias("_h"))
    rows = write_table(set_rows(own, ngram), "jaccard-rows")
    held = rows.where("_size > 0").withColumn("fp", F.lit(0).cast("long"))
    found = write_table(clusters(signed(own, ngram, percent)), "jaccard-clusters")
    links = similar.cluster_links(own, held, found, shingle_sets(ngram, False), 64, percent / 100)
    discard(found)
    groups = grouped(held, links, F.lit(0).cast("long"))
    linked = groups.select("_id", "_size", F.when(F.col("_shared"), F.col("_least.id")).otherwise(F.col("_id")).alias("component_id"))
    out = linked.unionByName(rows.where("_size = 0").select("_id", "_size", F.col("_id").alias("component_id")))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("n_shingles"), "component_id")


def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"))


ORACLE = {
    "op11_jaccard": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
        units AS MATERIALIZED (SELECT min(doc_id) AS u, list(doc_id) AS ids, any_value(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
        flat AS MATERIALIZED (SELECT u, len(s) AS n, unnest(s) AS x FROM units),
        links AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM flat AS a JOIN flat AS b ON a.x = b.x AND a.u <> b.u AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.u, b.u, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (SELECT u AS a, u AS b FROM units UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON r.b = l.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
        known AS (SELECT unnest(ids) AS doc_id, m FROM units JOIN least ON u = a)
        SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(k.m, s.doc_id) AS component_id FROM sets AS s LEFT JOIN known AS k ON s.doc_id = k.doc_id
    """
}
QUERIES = {"op11_jaccard": op11_jaccard}
