"""Links between documents that share a part of their word shingles, found exactly and without all pairs of a group leaving a task.

1. Documents of equal shingles and fingerprint are one unit. Shingles have one order for all units, common ones last. Two sets
   that share `least` of what either holds have some shingles, in proportion to their sizes, in common among the first of each
   (prefix filter), so each unit is listed under its first shingles alone, and needs that many that others are listed under too.
2. Of the units under one shingle the one that has it earliest is the hub: the text with the least of its own, such as the
   original of edited copies. All of them become members of the hub's cluster, so linked units share a cluster. Fingerprints that
   the Gray index links bring clusters too.
   Members that no other is near in size leave it.
3. A cluster is cut into blocks of bounded size. A task holds the sets of a block and links members to the hub first; only those
   still apart, and only if enough of their shingles occur elsewhere in the block, are compared with the holders of their rarest
   shingles. Those of a block that stay apart then meet the other blocks. A task gives a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .chunks import trim, whole_groups
from .common import discard, parts, salted_lookup, write_table

#: A document in so many is sampled for common shingles, of which at most so many are told to all tasks.
SAMPLED = 8
COMMON = 200_000
#: Shingles that a pair must have in common among the first of each: one for so many in a set, up to FEW; in longer sets one for so many.
PER_FEW, FEW, PER_SHARED = 8, 8, 16
#: Units listed under one shingle, by the sample, from which on its hub is found by aggregation instead of in one task.
HOT = 20_000
#: Shingles of a block of a cluster, on average, and rows under shingles handled at once.
LOAD = 1_000_000
ROWS = 200_000
#: Bits of the filter that tells all tasks which texts have a part in a cluster, a power of two; the fuller it is, the more sets move.
FILTER_BITS = 1 << 24
#: Bytes of sets in a tile from which on freed memory is given back after it.
TRIMMED = 1_000_000
#: Units that a task remembers in order not to list them again.
SEEN = 200_000
#: Allowed below a bound that is computed in floating point.
ROUNDING = 1e-9


def needed(n: int) -> int:
    """Shingles that sets of n shingles or more must have in common among their first ones."""
    return max(1, min(n // PER_FEW, FEW), n // PER_SHARED)


def prefix_length(n: int, least: float) -> int:
    return min(n, n - math.ceil(least * n - ROUNDING) + needed(n)) if n else 0


class Order:
    """The order of shingles: by how often a sample has them, unknown ones first, then by value."""

    def __init__(self, values: np.ndarray, times: np.ndarray):
        turn = np.argsort(values)
        self.values, self.times = (np.concatenate([x[turn], np.zeros(1, np.int64)]) for x in (values, times))
        self.hot = np.zeros(0, np.int64)

    def first(self, held: np.ndarray, least: float) -> np.ndarray:
        at = np.searchsorted(self.values[:-1], held)
        times = np.where(self.values[at] == held, self.times[at], 0)
        return held[np.lexsort((held, times))[: prefix_length(len(held), least)]]


def common_order(docs: DataFrame, sets, least: float, hot: int) -> Order:
    """The order from a sample of docs, a column of texts, and the shingles that list `hot` units or more by that sample.

    sets: from a column of texts to the shingle set and unit of each.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, times = np.unique(np.concatenate([np.zeros(0, np.int64), *(held for held, _ in sets(batch.column(0)))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(times)], ["_s", "_n"])
        trim()

    sample = docs.where(F.pmod(F.xxhash64("_text", F.lit("sample")), F.lit(SAMPLED)) == 0).select("_text")
    seen = write_table(sample.mapInArrow(counted, "_s long, _n long").groupBy("_s").agg(F.sum("_n").alias("_n")).where("_n > 1"), "near-common")
    cut, known = None, 0
    for n, shingles in seen.groupBy("_n").count().orderBy(F.desc("_n")).limit(COMMON).collect():  # a row for each count that occurs
        if (known := known + shingles) > COMMON:
            break
        cut = n
    found = seen.where(F.col("_n") >= cut).toArrow() if cut else None  # COMMON rows at most
    discard(seen)
    columns = [np.asarray(found.column(c).combine_chunks()) for c in ("_s", "_n")] if found and found.num_rows else [np.zeros(0, np.int64)] * 2
    order = Order(*columns)
    if (columns[1] * SAMPLED >= hot).any():
        order.hot = np.sort(columns[0][columns[1] * SAMPLED >= hot])  # of these, those that list units
        rows = listed(sample, sets, docs.sparkSession.sparkContext.broadcast(order), least, only_hot=True)
        found = rows.groupBy("_s").agg(F.count("*").alias("_n")).where(F.col("_n") * SAMPLED >= hot).toArrow()
        order.hot = np.sort(np.asarray(found.column("_s").combine_chunks())) if found.num_rows else np.zeros(0, np.int64)
    return order


def listed(docs: DataFrame, sets, order, least: float, only_hot: bool, heads=None) -> DataFrame:
    """Rows _s, _place, _unit, _size, _hub: units under their first shingles. _hub is null but for hot shingles, whose hubs are in `heads`."""

    def under(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, seen = order.value, set()
        hot = told.hot
        hubs = heads.value if heads is not None else None
        for batch in batches:
            keys, rows, sizes, units = [np.zeros(0, np.int64)], [], [], []
            for i, (held, unit) in enumerate(sets(batch.column(0))):
                sizes.append(len(held))
                units.append(unit)
                if unit not in seen:
                    seen.add(unit)
                    rows.append(i)
                    keys.append(told.first(held, least))
            if len(seen) > SEEN:
                seen.clear()
            taken = np.array([len(k) for k in keys[1:]], np.int64)
            of = np.repeat(np.array(rows, np.int64), taken)
            key = np.concatenate(keys)
            place = np.arange(len(of)) - np.repeat(np.cumsum(taken) - taken, taken)
            unit, size = np.array(units, np.int64)[of], np.array(sizes, np.int64)[of]
            hub, known = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                known = hot[at] == key
                hub = np.where(known, hubs[at] if hubs is not None else 0, 0)
            keep = known if only_hot else np.ones(len(key), bool)
            columns = [np.where(known & (not only_hot), unit, key), place, unit, size]
            yield pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in columns), pa.array(hub[keep], mask=~known[keep])], ["_s", "_place", "_unit", "_size", "_hub"])
        trim()

    return docs.select("_text").mapInArrow(under, "_s long, _place long, _unit long, _size long, _hub long")


def hot_heads(docs: DataFrame, sets, order, least: float):
    """The hub of each hot shingle, in the order of Order.hot; there are COMMON of them at most."""
    hot = order.value.hot
    if not len(hot):
        return None
    rows = listed(docs, sets, order, least, only_hot=True)
    found = rows.groupBy("_s").agg(F.min(F.struct("_place", "_unit")).alias("_h")).select("_s", "_h._unit").toArrow()
    heads = np.zeros(len(hot), np.int64)
    heads[np.searchsorted(hot, np.asarray(found.column("_s").combine_chunks()))] = np.asarray(found.column("_unit").combine_chunks())
    return docs.sparkSession.sparkContext.broadcast(heads)


def hubs_of(s: np.ndarray, place: np.ndarray, unit: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """(unit, hub, shingles, size) of whole groups of rows with one shingle, sorted by shingle, place and unit."""
    once = np.concatenate([[True], (s[1:] != s[:-1]) | (unit[1:] != unit[:-1])])[: len(s)]
    s, unit, size = s[once], unit[once], size[once]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])[: len(s)])
    lengths = np.diff(np.concatenate([starts, [len(s)]]))
    many = np.repeat(lengths > 1, lengths)
    return summed(unit[many], np.repeat(unit[starts], lengths)[many], np.ones(many.sum(), np.int64), size[many])


def summed(unit: np.ndarray, hub: np.ndarray, n: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    turn = np.lexsort((unit, hub))
    unit, hub, n, size = unit[turn], hub[turn], n[turn], size[turn]
    heads = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (hub[1:] != hub[:-1])])[: len(unit)])
    return [unit[heads], hub[heads], np.add.reduceat(n, heads) if len(heads) else n, size[heads]]


def members(docs: DataFrame, sets, order, least: float) -> DataFrame:
    """Rows _unit, _hub, _size: which units are in which clusters."""
    spark = docs.sparkSession
    rows = listed(docs, sets, order, least, only_hot=False, heads=hot_heads(docs, sets, order, least))
    names = ["_unit", "_hub", "_n", "_size"]

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[list[np.ndarray]] = []

        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hot = batch.column(4).is_valid()
                if pc.any(hot).as_py():
                    own = batch.filter(hot)
                    known.append(summed(*(np.asarray(own.column(i)) for i in (2, 4)), np.ones(len(own), np.int64), np.asarray(own.column(3))))
                    batch = batch.filter(pc.invert(hot))
                yield batch.select(["_s", "_place", "_unit", "_size"])

        for columns in whole_groups(others(), 1, ROWS):
            known.append(hubs_of(*columns))
            yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in x], names) for x in known)
            known.clear()
        yield from (pa.RecordBatch.from_arrays([pa.array(c) for c in x], names) for x in known)
        trim()

    dealt = rows.repartition(parts(spark), "_s").sortWithinPartitions("_s", "_place", "_unit")
    found = dealt.mapInArrow(clustered, "_unit long, _hub long, _n long, _size long").groupBy("_unit", "_hub").agg(F.sum("_n").alias("_n"), F.max("_size").alias("_size"))
    # a unit with too few shared shingles among its first has no partner, not even the smallest that its size allows
    small = F.ceil(least * F.col("_size") - ROUNDING)
    least_shared = F.greatest(F.lit(1), F.least(F.floor(small / PER_FEW), F.lit(FEW)), F.floor(small / PER_SHARED))
    # as many rows as a unit's first shingles at most
    own = Window.partitionBy("_unit")
    found = found.withColumn("_all", F.sum("_n").over(own)).withColumn("_few", F.sum("_n").over(own.orderBy("_n", "_hub").rowsBetween(Window.unboundedPreceding, 0)))
    # what two units leave out of their smallest clusters is less than what they need in common, so a cluster of both is left
    return found.where((F.col("_all") >= least_shared) & (F.col("_few") * 2 >= least_shared)).select("_unit", "_hub", "_size")


def with_blocks(clusters: DataFrame, least: float) -> DataFrame:
    """Rows _hub, _unit, _size, _blocks, _b: members that others are near in size to, and the block of its cluster that each is in."""
    # sizes of linked units lie in one class or in two that are next to each other
    width = -math.log(least) * 1.001 if least < 1 else 1e-6
    sized = clusters.withColumn("_k", F.floor(F.log(F.greatest(F.col("_size"), F.lit(1)).cast("double")) / width))
    per = sized.groupBy("_hub", "_k").agg(F.sum("_size").alias("_load"), F.count("*").alias("_m"))
    around = F.explode(F.array(F.col("_k") - 1, F.col("_k"), F.col("_k") + 1))
    near = per.select("_hub", around.alias("_k"), "_m").groupBy("_hub", "_k").agg(F.sum("_m").alias("_m")).where("_m > 1")
    loads = per.groupBy("_hub").agg(F.sum("_load").alias("_load"))
    near = near.join(loads.hint("merge"), "_hub").select("_hub", "_k", blocks_of("_load").alias("_blocks"))
    rows = salted_lookup(sized, near, ["_hub", "_k"], "_unit").where("_blocks is not null")
    return rows.select("_hub", "_unit", "_size", "_blocks", F.pmod(F.xxhash64("_unit"), F.col("_blocks")).cast("int").alias("_b"))


def blocks_of(load: str) -> Column:
    return F.ceil(F.greatest(F.col(load), F.lit(1)) / LOAD).cast("int")


TILE = "struct<hub:bigint,i:int,j:int,asks:boolean,linked:boolean,blocks:int>"


def tile(hub: Column, i: Column, j: Column, asks: bool | Column, linked: bool | Column, blocks: Column) -> Column:
    """asks: the unit is compared with all of the tile; linked: its links lead to the hub, as is known; blocks: of the cluster."""
    flags = [x if isinstance(x, Column) else F.lit(x) for x in (asks, linked)]
    return F.struct(hub.alias("hub"), i.cast("int").alias("i"), j.cast("int").alias("j"), flags[0].alias("asks"), flags[1].alias("linked"), blocks.alias("blocks")).cast(TILE)


def own_tiles(members: DataFrame) -> DataFrame:
    """Rows _unit, _tile: each member goes to its block, and the hub to all blocks."""
    mine = tile(F.col("_hub"), F.col("_b"), F.col("_b"), True, False, F.col("_blocks"))
    every = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda k: tile(F.col("_hub"), k, k, True, False, F.col("_blocks")))
    return members.select("_unit", F.explode(F.when(F.col("_unit") == F.col("_hub"), every).otherwise(F.array(mine))).alias("_tile"))


def crossing_tiles(members: DataFrame, apart: DataFrame) -> DataFrame:
    """Rows _unit, _tile: units that are apart from their hub, in blocks of their own, meet each block of their cluster.

    A member goes to as many tiles as there are blocks of such units, one for most clusters; only these go to each block.
    """
    loads = apart.groupBy("_hub").agg(F.sum("_size").alias("_load")).select("_hub", blocks_of("_load").alias("_asking"))
    asking = salted_lookup(apart, loads, ["_hub"], "_unit").withColumn("_a", F.pmod(F.xxhash64("_unit", F.lit("apart")), F.col("_asking")))
    ask = F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: tile(F.col("_hub"), F.col("_a"), j, True, False, F.col("_blocks")))
    known = apart.select(F.col("_hub").alias("_h"), F.col("_unit").alias("_u"), F.lit(False).alias("_linked"))
    rest = salted_lookup(members, loads, ["_hub"], "_unit").where("_asking is not null")
    rest = rest.join(known.hint("merge"), (F.col("_hub") == F.col("_h")) & (F.col("_unit") == F.col("_u")), "left")
    linked = F.coalesce("_linked", F.lit(True))
    answer = F.transform(F.sequence(F.lit(0), F.col("_asking") - 1), lambda a: tile(F.col("_hub"), a, F.col("_b"), False, linked, F.col("_blocks")))
    return asking.select("_unit", F.explode(ask).alias("_tile")).unionByName(rest.select("_unit", F.explode(answer).alias("_tile")))


class Tile:
    """Sets that meet in a task, and which of them share a shingle."""

    def __init__(self, fp: np.ndarray, sets: list[np.ndarray], max_bits: int, least: float):
        self.fp, self.max_bits, self.least, self.m = fp, max_bits, least, len(sets)
        self.sizes = np.array([len(x) for x in sets], np.int64)
        values = np.concatenate(sets)
        # a tile holds far fewer than 2^31 shingles; what is spent is freed at once, as several tasks share a machine's memory
        turn = np.argsort(values, kind="stable").astype(np.int32)
        values = values[turn]
        self.starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(turn)]).astype(np.int32)
        del values
        self.lengths = np.diff(self.starts, append=np.int32(len(turn)))
        self.group = np.empty(len(turn), np.int32)
        self.group[turn] = np.repeat(np.arange(len(self.starts), dtype=np.int32), self.lengths)
        self.owner, self.at = np.repeat(np.arange(self.m, dtype=np.int32), self.sizes)[turn], np.concatenate([[0], np.cumsum(self.sizes)])
        self.common = np.bincount(self.owner, weights=np.repeat(self.lengths > 1, self.lengths), minlength=self.m)

    def may_link(self, x: int) -> bool:
        """Whether so many of a set's shingles occur elsewhere in the tile that it can have a partner here."""
        return self.sizes[x] > 0 and self.common[x] >= self.least * self.sizes[x] - ROUNDING

    def holders(self, groups: np.ndarray) -> np.ndarray:
        n = self.lengths[groups]
        where = np.repeat(self.starts[groups] - (np.cumsum(n, dtype=np.int32) - n), n)
        where += np.arange(len(where), dtype=np.int32)
        return self.owner[where]

    def partners(self, x: int, of: np.ndarray) -> np.ndarray:
        """Members linked to x, of those in the mask `of`."""
        own = self.group[self.at[x] : self.at[x + 1]]
        shared = own[self.lengths[own] > 1]
        n = int(self.sizes[x])
        # a partner has all but so few of x's shingles, so it has one of any so many and one: the rarest here
        some = n - math.ceil(self.least * n - ROUNDING) + 1 - (n - len(shared))
        if some <= 0:
            return np.zeros(0, np.int64)
        rare = shared[np.argsort(self.lengths[shared], kind="stable")[:some]]
        near = np.zeros(self.m, bool)
        near[self.holders(rare)] = True
        near &= of & (self.sizes >= self.least * n - ROUNDING) & (n >= self.least * self.sizes - ROUNDING)
        near &= np.bitwise_count(self.fp ^ self.fp[x]) <= self.max_bits
        near[x] = False
        asked = np.flatnonzero(near)
        if not len(asked):
            return asked
        sizes = self.sizes[asked]
        if sizes.sum() < self.lengths[shared].sum():
            mine = np.zeros(len(self.starts), bool)
            mine[own] = True
            where = np.repeat(self.at[asked] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            both = np.add.reduceat(mine[self.group[where]].astype(np.int64), np.cumsum(sizes) - sizes)
        else:
            both = np.bincount(self.holders(shared), minlength=self.m)[asked]
        return asked[both >= self.least * (sizes + n - both) - ROUNDING]


def tile_links(unit: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], hub: int, max_bits: int, least: float, asks: np.ndarray | None = None, linked: np.ndarray | None = None) -> tuple[list[int], list[int], np.ndarray]:
    """(u, v, label): links (indices) that connect what the members of a tile link, and each member's group by then.

    Two members are linked if they share `least` of the shingles that either holds and differ in max_bits or fewer. The hub's links come
    first; with asks, only those of its mask are compared with all, and those of the mask linked are one group already.
    """
    held = Tile(fp, sets, max_bits, least)
    label, u, v = np.arange(held.m), [], []
    if linked is not None and linked.any():
        label[linked] = np.flatnonzero(linked)[0]
    k = np.flatnonzero(unit == hub)
    if len(k) and asks is None and held.may_link(k[0]):
        near = held.partners(int(k[0]), np.ones(held.m, bool))
        label[near] = label[k[0]]
        u, v = near.tolist(), [int(k[0])] * len(near)
    main = int(np.bincount(label).argmax())
    for x in range(held.m) if asks is None else np.flatnonzero(asks).tolist():
        if label[x] == main or not held.may_link(x):
            continue
        for y in held.partners(x, label != label[x]).tolist():
            a, b = label[x], label[y]
            if a != b:
                u.append(x)
                v.append(y)
                label[label == (b if a == main else a)] = a if a == main else b
    return u, v, label


def likely_sets(docs: DataFrame, asked: DataFrame, sets) -> DataFrame:
    """Rows _id, _h, _set of docs whose _h may be among the values asked for, by a filter of FILTER_BITS."""
    bit = F.col("_key").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = asked.groupBy(F.shiftright(bit, 6).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("_b"))
    told = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[np.asarray(told.column("_w").combine_chunks())] = np.asarray(told.column("_b").combine_chunks())
    sent = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))  # FILTER_BITS
    last = np.int64(FILTER_BITS - 1)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            at = np.asarray(batch.column(2)) & last
            own = batch.filter(pa.array((bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            held = pa.array([x.tobytes() for x, _ in sets(own.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), held], ["_id", "_h", "_set"])
        trim()

    return docs.select("_id", "_text", "_h").mapInArrow(kept, f"_id {docs.schema['_id'].dataType.simpleString()}, _h long, _set binary")


def similar_links(docs: DataFrame, rows: DataFrame, extra: DataFrame | None, sets, max_bits: int, least: float) -> DataFrame:
    """Links (u, v) between units that connect all that are linked: `least` of the shingles in common and max_bits differing bits or fewer.

    docs: _id, _text (binary), _h (a hash of the text). rows: _id, _h, fp, _unit of each. extra: more members of clusters (_unit, _hub,
    _size). sets: from a column of texts to the shingle set and unit of each.
    """
    order = docs.sparkSession.sparkContext.broadcast(common_order(docs, sets, least, HOT))  # COMMON shingles at most
    clusters = members(docs, sets, order, least)
    if extra is not None:
        clusters = clusters.unionByName(extra).groupBy("_unit", "_hub").agg(F.max("_size").alias("_size"))
    held = write_table(clusters, "near-members")  # read several times, and each time its whole plan would be in the reader's
    out = cluster_links(docs, rows, held, sets, max_bits, least)
    discard(held)
    return out


COMPARED = "u long, v long, _hub long, _blocks int, _size long"


def compared(docs: DataFrame, units: DataFrame, tiles: DataFrame, sets, max_bits: int, least: float) -> DataFrame:
    """Rows of COMPARED: links (u, v) of each tile; of units that are not linked to their hub in one of several blocks, u, hub, blocks and size."""
    spark = docs.sparkSession
    tiles = tiles.groupBy("_unit").agg(F.collect_list("_tile").alias("_tiles"))
    asked = write_table(tiles.join(units, "_unit").select("_unit", "fp", "_tiles", F.col("_rep._h").alias("_key"), F.col("_rep._id").alias("_of")), "near-asked")
    found = likely_sets(docs, asked.select("_key"), sets).join(asked, (F.col("_h") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_of")))
    rows = found.select("_unit", "fp", F.explode("_tiles").alias("_t"), "_set").select("_t.hub", "_t.i", "_t.j", "_t.asks", "_t.linked", "_t.blocks", "_unit", "fp", "_set")
    rows = rows.repartition(parts(spark), "hub", "i", "j").sortWithinPartitions("hub", "i", "j", "_unit", F.desc("asks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def done() -> None:
            if len(held) > 1:
                asks, linked, blocks, unit, fp, data = zip(*held, strict=True)
                held.clear()
                unit, asks = np.array(unit, np.int64), np.array(asks)
                sets, own = [np.frombuffer(d, np.int64) for d in data], bool(asks.all())
                u, v, label = tile_links(unit, np.array(fp, np.int64).view(np.uint64), sets, now[0], max_bits, least, None if own else asks, None if own else np.array(linked))
                out.extend((a, b, None, None, None) for a, b in zip(unit[u].tolist(), unit[v].tolist(), strict=True))
                if now[1] == now[2] and own and blocks[0] > 1:
                    hub = label[np.flatnonzero(unit == now[0])]
                    out.extend((int(unit[x]), None, now[0], blocks[0], len(sets[x])) for x in (np.flatnonzero(label != hub[0]) if len(hub) else range(len(unit))))
                if sum(map(len, data)) > TRIMMED:
                    del sets, data
                    trim()
            held.clear()

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["u", "v", "_hub", "_blocks", "_size"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(9)]
            for hub, i, j, asks, linked, blocks, unit, fp, data in zip(*columns, strict=True):
                if (hub, i, j) != now:
                    done()
                    now = (hub, i, j)
                if not held or held[-1][3] != unit:  # a text that is there twice, or both asks and answers, comes twice
                    held.append((asks, linked, blocks, unit, fp, data))
            if len(out) > 10_000:
                yield made()
        done()
        yield made()
        trim()

    out = write_table(rows.mapInArrow(compare, COMPARED).distinct(), "near-compared")
    discard(asked)
    return out


def cluster_links(docs: DataFrame, rows: DataFrame, clusters: DataFrame, sets, max_bits: int, least: float) -> DataFrame:
    """similar_links() by given clusters (_unit, _hub, _size), of which linked units share one.

    Each block of a cluster is compared in itself, its hub's links first. Of clusters of several blocks, units that are still apart from
    the hub then meet the other blocks: what is linked to the hub moves once more, however many blocks there are.
    """
    units = rows.groupBy("_unit").agg(F.first("fp").alias("fp"), F.min(F.struct("_h", "_id")).alias("_rep"))
    held = write_table(with_blocks(clusters, least), "near-clusters")
    first = compared(docs, units, own_tiles(held), sets, max_bits, least)
    links = first.where("v is not null").select("u", "v")
    apart = write_table(first.where("v is null").select("_hub", F.col("u").alias("_unit"), "_size", "_blocks"), "near-apart")
    if not apart.isEmpty():
        links = links.unionByName(compared(docs, units, crossing_tiles(held, apart), sets, max_bits, least).where("v is not null").select("u", "v"))
    out = write_table(links.distinct(), "near-links")
    for table in (held, first, apart):
        discard(table)
    return out
