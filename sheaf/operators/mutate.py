"""Batch inserts, updates and deletes: a table and changes give the new table and the changes that were refused."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import collated


@dataclass(frozen=True)
class Rules:
    """Constraints of a table: its key, unique columns, and references as {column: (table, key)}."""

    key: str = "id"
    unique: tuple[str, ...] = ()
    refs: tuple[tuple[str, DataFrame, str], ...] = ()
    parent: str | None = None  # a reference to the table itself that may not name the row


def _refuse(changes: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    marked = changes.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _refuse_marked(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def _lost(changes: DataFrame, rules: Rules, own: bool, late: str | None) -> DataFrame:
    """Adds _lost: the first reference that leads nowhere, in the order of the rules; own: a parent may not be the row itself. Then `late`."""
    reasons, parent = [], rules.parent if own and rules.parent in changes.columns else None
    for i, (column, table, key) in enumerate(rules.refs):
        changes = changes.join(table.select(F.col(key).alias(f"_ref{i}")).distinct(), F.col(column) == F.col(f"_ref{i}"), "left")
        if column == parent:
            reasons.append(F.when(F.col(parent) == F.col(rules.key), f"400 {parent}"))
            parent = None
        reasons.append(F.when(F.col(column).isNotNull() & F.col(f"_ref{i}").isNull(), f"404 {column}"))
    if parent:
        reasons.append(F.when(F.col(parent) == F.col(rules.key), f"400 {parent}"))
    if late:
        reasons.append(F.col(late))
    return changes.withColumn("_lost", F.coalesce(*reasons, F.lit(None).cast("string"))).drop(*[f"_ref{i}" for i in range(len(rules.refs))])


def _first(changes: DataFrame, key: str) -> DataFrame:
    """Marks all but one change of a key in column _again; changes of one key are ordered by their columns."""
    order = [F.col(c) for c in changes.columns if c != key] or [F.col(key)]
    return changes.withColumn("_again", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def _taken(changes: DataFrame, table: DataFrame, rules: Rules) -> DataFrame:
    """Adds to `reason` where a unique value is another row's, or that of a change that is made and has a smaller key; a null is free.

    Values are compared as the tables' collation does. Columns are settled in turn, so a change that is refused holds no value. Rows
    without a value are not dealt by it.
    """
    for column in rules.unique:
        if column not in changes.columns:
            continue
        own = table.where(F.col(column).isNotNull()).groupBy(collated(table, column).alias("_u")).agg(F.min(rules.key).alias("_owner"), F.max(rules.key).alias("_other"))
        value = F.when(F.col("reason").isNull(), collated(changes, column))
        rows = changes.withColumn("_value", value).join(own, F.col("_value") == F.col("_u"), "left")
        clash = F.coalesce((F.col("_owner") != F.col(rules.key)) | (F.col("_other") != F.col(rules.key)), F.lit(False))
        rows = rows.withColumn("_clash", clash)
        alone = F.when(F.col("_value").isNull(), F.col(rules.key))
        winner = F.min(F.when(~F.col("_clash") & F.col("_lost").isNull(), F.col(rules.key))).over(Window.partitionBy("_value", alone))
        second = F.col("_value").isNotNull() & F.coalesce(F.col(rules.key) > winner, F.lit(False))
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("_clash") | second, f"409 {column}")))
        changes = rows.select(*changes.columns)
    return changes


def _judged(table: DataFrame, changes: DataFrame, rules: Rules, new: bool, late: str | None) -> tuple[DataFrame, DataFrame]:
    """(changes that can be made, refused ones)."""
    shown = [c for c in changes.columns if c != late]
    held = table.select(F.col(rules.key).alias("_held")).distinct()
    checked = _lost(_first(changes, rules.key).join(held, F.col(rules.key) == F.col("_held"), "left"), rules, not new, late)
    there = F.col("_held").isNotNull()
    early = [F.when(F.col(rules.key).isNull(), f"400 {rules.key}"), F.when(there, f"409 {rules.key}") if new else F.when(~there, f"404 {rules.key}"), F.when(F.col("_again"), f"409 {rules.key}")]
    judged = _taken(checked.select(*shown, "_lost", F.coalesce(*early).alias("reason")), table, rules)
    return _refuse_marked(judged.select(*shown, F.coalesce("reason", "_lost").alias("reason")))


def insert(table: DataFrame, changes: DataFrame, rules: Rules, late: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new table, refused changes with a reason).

    A change is refused if its key is null, is there already or comes again, if a unique value is taken, if a reference leads nowhere, or
    for what the column `late` says; the first that applies is the reason. Refused changes hold no value: of the others with one value
    the smallest key wins.
    """
    ok, refused = _judged(table, changes, rules, True, late)
    return table.unionByName(ok.select(*table.columns)), refused


def update(table: DataFrame, changes: DataFrame, rules: Rules, clears: tuple[str, ...] = (), late: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Changes hold the key and new values; null leaves a value as it is, but for the columns in `clears`.

    One change of a key is made; others of that key, changes of rows that are not there, of unique values that are taken, of references
    that lead nowhere, and those with a reason in the column `late` are refused, for the first of these. A value that a change gives up
    is free only afterwards.
    """
    rules = Rules(rules.key, tuple(c for c in rules.unique if c in changes.columns), tuple(r for r in rules.refs if r[0] in changes.columns), rules.parent)
    ok, refused = _judged(table, changes, rules, False, late)
    names = [c for c in changes.columns if c not in (rules.key, late)]
    new = ok.select(F.col(rules.key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in names])
    rows = table.join(new, F.col(rules.key) == F.col("_key"), "left")
    for c in names:
        rows = rows.withColumn(c, F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in clears else F.coalesce(f"_new_{c}", c))
    return rows.select(*table.columns), refused


def delete(table: DataFrame, keys: DataFrame, key: str = "id", guards: tuple[tuple[DataFrame, str], ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows go unless a guard (table, column) refers to them; keys: one column, named as the key."""
    checked = keys.distinct().join(table.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left")
    reasons = [F.when(F.col("_key").isNull(), f"404 {key}")]
    for i, (other, column) in enumerate(guards):
        checked = checked.join(other.select(F.col(column).alias(f"_g{i}")).distinct(), F.col(key) == F.col(f"_g{i}"), "left")
        reasons.append(F.when(F.col(f"_g{i}").isNotNull(), "400 in use"))
    ok, refused = _refuse(checked, F.coalesce(*reasons))
    return table.join(ok.select(F.col(key)), key, "left_anti").select(*table.columns), refused.select(key, "reason")


def cascade(children: DataFrame, parents: DataFrame, ref: str, key: str = "id") -> DataFrame:
    """Children whose parent is still there, or who have none."""
    return children.join(parents.select(F.col(key).alias("_key")), F.col(ref) == F.col("_key"), "left_semi").unionByName(children.where(F.col(ref).isNull()))


def without_children(children: DataFrame, removed: DataFrame, ref: str, key: str = "id") -> DataFrame:
    """Children but for those of the removed parents; what hung on no parent before stays, and isn't dealt by its null."""
    hung = children.where(F.col(ref).isNotNull())
    return hung.join(removed.select(F.col(key).alias("_key")), F.col(ref) == F.col("_key"), "left_anti").unionByName(children.where(F.col(ref).isNull()))


def replace_links(links: DataFrame, changes: DataFrame, owner: str) -> DataFrame:
    """All links of the owners in changes give way to theirs."""
    return links.join(changes.select(owner).distinct(), owner, "left_anti").select(*links.columns).unionByName(changes.select(*links.columns))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes take the place of rows of the same key; of several changes of a key one is made, the first by its columns."""
    new = _first(changes, key).where("not _again").select(*table.columns)
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new)


def toggle(table: DataFrame, keys: DataFrame, flag: str, key: str = "id", own: int | None = None) -> DataFrame:
    """Flip a flag of the rows named, except the acting user's own row."""
    named = keys.select(F.col(key).alias("_key")).distinct()
    rows = table.join(named, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull() & (F.col(key) != own if own is not None else F.lit(True))
    return rows.withColumn(flag, F.when(hit, ~F.col(flag)).otherwise(F.col(flag))).select(*table.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
