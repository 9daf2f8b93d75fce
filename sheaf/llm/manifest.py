"""Merkle manifests: a leaf for each row, a tree of runs for each group, a tree over the groups, and proofs by coordinates.

Leaves are hashed where rows are read, so texts never move. They get their place in their group by a range sort and counts for each
partition, never by one task for a group. The node table holds runs: the nodes of one level that become one node of the next. A
leaf's place and the size of its group say which runs its proof needs; these coordinates are exploded, joined to the runs, ordered by
level, concatenated and folded. A run is repeated once for every COPY leaves below it, each copy with a number that the leaves'
places give too, so that the top of a tree, which all leaves need, is no hot key and is not broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import CRC32_SQL, crc32_sql, discard, parts, read_table, write_table

#: Nodes of a run, and its power of two.
RUN, BITS = 8, 3
#: Bytes of a hash.
BYTES = 32
#: Leaves that share one copy of a run.
COPY = 512


def part(value: Column) -> Column:
    """A value as it goes into a leaf: its bytes counted before it, or - for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*inputs: Column) -> Column:
    """The hash of texts that follow each other, as its 32 bytes; shown() gives its digits."""
    return F.unhex(F.sha2(F.concat(*inputs).cast("binary"), 256))


def shown(digests: Column) -> Column:
    """Bytes of hashes as their digits, which is how they go into other hashes."""
    return F.lower(F.hex(digests))


def height(n: Column) -> Column:
    """Levels between n nodes and one."""
    return F.when(n <= 1, 0).otherwise(F.ceil(F.length(F.bin(n - 1)) / BITS)).cast("int")


def ranked(rows: DataFrame, label: str) -> DataFrame:
    """Adds _i, the place from 0 of each row in its group _g by _id (null first), _h and _row, and _n, the rows of the group.

    Rows are sorted by ranges over all groups; a group's counts for each partition, not its rows, meet in one task.
    """
    n = parts(rows.sparkSession)
    order = ["_g", F.asc_nulls_first("_id"), "_h", "_row"]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = write_table(placed, f"{label}-sorted")
    pid = F.shiftright("_at", 33)
    counts = placed.groupBy(pid.alias("_pid"), "_g").agg(F.count("*").alias("_c"), F.min("_at").alias("_first"))
    own = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_c").over(own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spots = write_table(counts.select("_pid", F.col("_g").alias("_of"), (before - F.col("_first")).alias("_shift"), F.sum("_c").over(own).alias("_n")), f"{label}-spots")
    # Spark sends the spots to all tasks if they are small, and else joins on keys that hold a partition's rows at most
    found = placed.join(spots, (pid == F.col("_pid")) & (F.col("_g") == F.col("_of")))
    out = write_table(found.withColumn("_i", F.col("_at") + F.col("_shift")).drop("_pid", "_of", "_shift"), label)
    discard(placed)
    discard(spots)
    return out


def tree(leaves: DataFrame, label: str) -> tuple[DataFrame | None, DataFrame, list[DataFrame]]:
    """(runs, roots, tables to discard) of leaves (_g, _i, _n, _h).

    runs: _g, _level (0: of leaves), _run, _n (leaves of the group), _hs (the bytes of its nodes in order); none where each group has one leaf. roots:
    _g, _n, _root. While a group has several nodes, every RUN in a row become one; a last run may hold fewer, even one.
    """
    levels = leaves.agg(F.max(height(F.col("_n")))).first()[0] or 0
    nodes, found, roots = leaves.select("_g", "_i", "_n", "_h", F.col("_n").alias("_m")), [], []
    for level in range(levels + 1):
        roots.append(nodes.where("_m = 1").select("_g", "_n", F.col("_h").alias("_root")))
        if level == levels:
            break
        held = F.array_sort(F.collect_list(F.struct("_i", "_h")))  # RUN nodes at most
        runs = nodes.where("_m > 1").groupBy("_g", F.shiftright("_i", BITS).alias("_run"), "_n", "_m").agg(F.unhex(F.array_join(F.transform(held, lambda x: F.hex(x["_h"])), "")).alias("_hs"))
        found.append(write_table(runs, f"{label}-runs"))
        nodes = found[-1].select("_g", F.col("_run").alias("_i"), "_n", digest(shown(F.col("_hs"))).alias("_h"), F.ceil(F.col("_m") / RUN).alias("_m"))
    runs = [r.select("_g", F.lit(k).alias("_level"), "_run", "_n", "_hs") for k, r in enumerate(found)]
    return reduce(DataFrame.unionByName, runs) if runs else None, reduce(DataFrame.unionByName, roots), found


def copies(runs: DataFrame) -> DataFrame:
    """runs once for every COPY leaves below them, numbered in column _copy."""
    width = F.call_function("shiftleft", F.lit(1).cast("long"), (BITS * (F.col("_level") + 1)).cast("int"))
    first, last = F.col("_run") * width, F.least((F.col("_run") + 1) * width, F.col("_n")) - 1
    return runs.withColumn("_copy", F.explode(F.sequence(F.floor(first / COPY), F.floor(last / COPY))))


def siblings(rows: DataFrame, runs: DataFrame, levels: Column, once: tuple[str, ...] = ()) -> DataFrame:
    """rows (_g, _i, …) once for each level, with _level, _left and _right: the nodes of its run before and behind its own, joined.

    levels: an array of the levels of a row, of which -1 alone keeps the columns of `once`. runs: with _copy and _own, the row's place in a run where its leaves agree on it, else null.
    """
    asked = rows.withColumn("_level", F.explode(levels)).withColumn("_copy", F.floor(F.col("_i") / COPY))
    asked = asked.withColumns({c: F.when(F.col("_level") < 0, F.col(c)) for c in once})
    own = (F.col("_level") >= 0) & (F.col("_level") < height(F.col("_n")))
    asked = asked.withColumn("_run", F.when(own, F.expr(f"shiftright(_i, {BITS} * (_level + 1))")).otherwise(F.lit(0).cast("long")))
    nodes = runs.select("_g", "_level", "_run", "_copy", "_hs", "_own")
    found = asked.join(nodes, ["_g", "_level", "_run", "_copy"])
    at = F.coalesce("_own", F.expr(f"CAST(shiftright(_i, {BITS} * _level) & {RUN - 1} AS INT)"))
    left, right = F.substring("_hs", F.lit(1), BYTES * at), F.substring("_hs", BYTES * (at + 1) + 1, F.lit(BYTES * RUN))
    return found.select(*rows.columns, "_level", left.alias("_left"), right.alias("_right"), "_hs")


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """One row for each row of docs: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf hashes the fields in their order, each with its length, so no two rows of unlike fields have one. Leaves of a group ascend by
    id (null first; of equal ids by leaf, so that rows repeated in full have leaves of their own); groups ascend by their bytes, null
    first. tampered: new values of fields in the rows where `when` holds; folded_root comes from the leaf of these, or the original
    where there are none, and the original siblings. An empty table gives no rows; a group of one row is its own subroot, and one of
    one group is the root. Columns that aren't fields are passed over, whatever their names.
    """
    spark = docs.sparkSession
    group = F.when(F.col(group_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))  # - sorts before =
    leaf = digest(*[part(F.col(f)) for f in fields])
    told = digest(*[part((tampered or {}).get(f, F.col(f))) for f in fields])
    told = F.when(F.coalesce(when, F.lit(False)), told) if tampered and when is not None else F.lit(None).cast("binary")
    hashed = write_table(docs.select(group.alias("_g"), F.col(id_col).alias("_id"), leaf.alias("_h"), told.alias("_told")).withColumn("_row", F.monotonically_increasing_id()), "manifest-leaves")
    leaves = ranked(hashed, "manifest")
    runs, roots, spent = tree(leaves, "manifest")

    groups = write_table(roots.select("_g", F.col("_root").alias("_h"), F.col("_n").alias("_leaves")), "manifest-groups")
    one = groups.select(F.lit("").alias("_g"), F.col("_g").alias("_id"), "_h", "_leaves", F.lit(0).cast("long").alias("_row"))
    top = ranked(one, "manifest-top")
    top_runs, top_root, top_spent = tree(top, "manifest-top")
    found = top_root.select(shown(F.col("_root"))).first()
    root = found[0] if found else None
    levels = top.agg(F.max(height(F.col("_n")))).first()[0] or 0

    # a group's way to the root, and its subroot at level -1, are runs that all of its leaves ask for
    tops = top.select(F.lit(-1).alias("_level"), F.col("_id").alias("_g"), "_leaves", F.col("_h").alias("_hs"), F.lit(0).alias("_own"))
    if levels:
        near = siblings(top, copies(top_runs).withColumn("_own", F.lit(None).cast("int")), F.sequence(F.lit(0), F.lit(levels - 1)))
        at = F.expr(f"CAST(shiftright(_i, {BITS} * _level) & {RUN - 1} AS INT)")
        tops = tops.unionByName(near.select((F.col("_level") + height(F.col("_leaves"))).alias("_level"), F.col("_id").alias("_g"), "_leaves", "_hs", at.alias("_own")))
    last = F.floor((F.col("_leaves") - 1) / COPY)
    tops = tops.select("_g", "_level", F.lit(0).cast("long").alias("_run"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_copy"), "_hs", "_own")
    every = tops
    if runs is not None:
        every = copies(runs).select("_g", "_level", "_run", "_copy", "_hs", F.lit(None).cast("int").alias("_own")).unionByName(tops)
    # what a leaf is goes with its coordinate of level -1 alone
    steps = siblings(leaves.select("_g", "_i", "_n", "_at", "_id", "_h", "_told"), write_table(every, "manifest-nodes"), F.sequence(F.lit(-1), height(F.col("_n")) + levels - 1), ("_id", "_h", "_told"))
    for table in (hashed, *spent, *top_spent, groups, top):
        discard(table)

    first = F.col("_level") < 0
    own = F.max(F.when(first, F.struct("_id", "_h", "_told", "_hs"))).alias("_own")
    step = F.when(~first, F.struct("_level", F.col("_left").alias("l"), F.col("_right").alias("r")))
    proofs = steps.groupBy("_at").agg(own, F.array_sort(F.collect_list(step)).alias("_steps")).select("_own.*", "_steps")
    proof = F.sha2(F.array_join(F.transform("_steps", lambda s: F.concat(shown(s["l"]), shown(s["r"]))), "").cast("binary"), 256)
    folded = F.aggregate("_steps", F.coalesce("_told", "_h"), lambda h, s: digest(shown(s["l"]), shown(h), shown(s["r"])))
    out = proofs.select(F.col("_id").alias(id_col), shown(F.col("_h")).alias("leaf"), shown(F.col("_hs")).alias("subroot"), F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), shown(folded).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(docs, FIELDS, tampered={"text": F.translate("text", UPPER, LOWER)}, when=third)


#: Levels that the SQL writes out: enough for RUN ** LEVELS leaves.
LEVELS = 9
_PART = lambda f: f"CASE WHEN {f} IS NULL THEN '-' ELSE concat(strlen(CAST({f} AS VARCHAR)), ':', CAST({f} AS VARCHAR)) END"
_LEAF = lambda text: f"sha256(concat({', '.join(_PART(f) for f in FIELDS[:-1])}, {_PART(text)}))"


def _tree_sql(prefix: str, start: str) -> str:
    """CTEs {prefix}0 … of nodes (g, i, h, m) and their runs; start gives the leaves."""
    out = [f"{prefix}0 AS MATERIALIZED ({start})"]
    for k in range(LEVELS):
        out.append(f"{prefix}r{k} AS MATERIALIZED (SELECT g, i // {RUN} AS run, list(h ORDER BY i) AS hs, m FROM {prefix}{k} WHERE m > 1 GROUP BY ALL)")
        out.append(f"{prefix}{k + 1} AS MATERIALIZED (SELECT g, run AS i, sha256(array_to_string(hs, '')) AS h, CAST(ceil(m / {RUN}) AS BIGINT) AS m FROM {prefix}r{k})")
    return ", ".join(out)


def _steps_sql(prefix: str, i: str, g: str) -> tuple[str, str]:
    """(lefts and rights of each level as a list, joins that bring them) for rows with place i in group g."""
    joins = " ".join(f"LEFT JOIN {prefix}r{k} ON {prefix}r{k}.g = {g} AND {prefix}r{k}.run = {i} // {RUN ** (k + 1)}" for k in range(LEVELS))
    at = [f"({i} // {RUN**k}) % {RUN}" for k in range(LEVELS)]
    steps = ", ".join(f"CASE WHEN {prefix}r{k}.hs IS NOT NULL THEN [array_to_string({prefix}r{k}.hs[:{a}], ''), array_to_string({prefix}r{k}.hs[{a} + 2:], '')] END" for k, a in enumerate(at))
    return f"list_filter([{steps}], lambda s: s IS NOT NULL)", joins


def _oracle() -> str:
    low, low_joins = _steps_sql("n", "l.i", "l.g")
    high, high_joins = _steps_sql("t", "t.i", "t.g")
    start = "SELECT g, i, leaf AS h, m FROM leaves"
    top = "SELECT 0 AS g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, h, count(*) OVER () AS m FROM roots"
    roots = " UNION ALL ".join(f"SELECT g, h FROM n{k} WHERE m = 1" for k in range(LEVELS + 1))
    root = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE m = 1" for k in range(LEVELS + 1))
    fold = "list_reduce(list_concat([['', coalesce(told, leaf)]], steps), lambda a, s: ['', sha256(concat(s[1], a[2], s[2]))])[2]"
    return f"""
        WITH {CRC32_SQL},
        hashed AS MATERIALIZED (SELECT doc_id, lang, {_LEAF("text")} AS leaf, CASE WHEN {crc32_sql("doc_id")} % 3 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS told FROM documents, crc),
        leaves AS MATERIALIZED (SELECT *, coalesce('=' || lang, '-') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM hashed),
        {_tree_sql("n", start)},
        roots AS MATERIALIZED (SELECT r.g, r.h, any_value(lang) AS lang FROM ({roots}) AS r JOIN leaves USING (g) GROUP BY ALL),
        {_tree_sql("t", top)},
        ways AS MATERIALIZED (SELECT t.h AS subroot, r.g AS of, {high} AS tail FROM t0 AS t JOIN (SELECT g, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM roots) AS r ON r.i = t.i {high_joins}),
        proofs AS (SELECT l.doc_id, l.leaf, l.told, subroot, list_concat({low}, tail) AS steps FROM leaves AS l JOIN ways ON ways.of = l.g {low_joins}),
        folded AS (SELECT doc_id, leaf, subroot, (SELECT h FROM ({root})) AS root, sha256(array_to_string(list_transform(steps, lambda s: s[1] || s[2]), '')) AS proof_sha256, {fold} AS folded_root FROM proofs)
        SELECT *, folded_root = root AS verified FROM folded
    """


ORACLE = {"op12_manifest": _oracle()}
QUERIES = {"op12_manifest": op12_manifest}
