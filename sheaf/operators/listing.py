"""Filtered, counted and paged listings with labels of related rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import matches_any, matches_any_accentless, same_text
from .ranks import RankedTable
from .trigrams import TrigramIndex

MAX_PAGE = 100
DEFAULT_PAGE = 20


@dataclass(frozen=True)
class Label:
    """A column of a related table, found by key: rows without a match get null."""

    table: str
    key: str  # of the listed table
    name: str  # of the new column
    ref: str = "id"
    column: str = "name"


@dataclass(frozen=True)
class ListSpec:
    """What a listing searches, filters, ranges over and labels."""

    table: str
    search: tuple[str, ...] = ()
    equal: tuple[str, ...] = ()  # ids and flags: null means no filter
    equal_text: tuple[str, ...] = ()  # texts, by the tables' collation: null and empty mean no filter
    like: tuple[str, ...] = ()
    span: str | None = None
    labels: tuple[Label, ...] = ()
    order: tuple[str, ...] = ("id",)
    columns: tuple[str, ...] = field(default=())


def predicate(spec: ListSpec, search: str | None = None, since: Any = None, until: Any = None, accents: bool = True, **filters: Any) -> Column:
    """All filters that are set; the time range includes both ends."""
    unknown = set(filters) - {*spec.equal, *spec.equal_text, *spec.like}
    if unknown:
        raise ValueError(f"no such filter: {sorted(unknown)}")
    find = matches_any if accents else matches_any_accentless
    found = [find(search, *[F.col(c) for c in spec.search]) if spec.search else None]
    found += [F.col(c) == filters[c] for c in spec.equal if filters.get(c) is not None]
    found += [same_text(F.col(c), F.lit(filters[c])) for c in spec.equal_text if filters.get(c)]
    found += [find(filters[c], F.col(c)) for c in spec.like if filters.get(c)]
    if spec.span:
        found += [F.col(spec.span) >= since if since is not None else None, F.col(spec.span) <= until if until is not None else None]
    return reduce(lambda a, b: a & b, [f for f in found if f is not None], F.lit(True))


def page(tables: dict[str, DataFrame], spec: ListSpec, number: int = 1, size: int = DEFAULT_PAGE, trigrams: TrigramIndex | None = None, ranked: RankedTable | None = None, **filters: Any) -> DataFrame:
    """One page, largest order keys first; related rows are joined to the page alone.

    trigrams: an index over the table's searched columns, which brings the rows that `search` is held against. ranked: the table in the
    listing's order, for pages far behind the first.
    """
    if number < 1 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"pages count from 1 and hold 1 to {MAX_PAGE} rows")
    if ranked is not None:
        if ranked.order != spec.order or not ranked.descending:
            raise ValueError(f"the ranked table must be in the order of {spec.order}, largest first")
        return label(ranked.slice((number - 1) * size, size, predicate(spec, **filters) if filters else None), tables, spec, few=True)
    rows = tables[spec.table] if trigrams is None else trigrams.narrow(tables[spec.table], filters.get("search"))
    rows = rows.where(predicate(spec, **filters)).orderBy(*[F.col(c).desc() for c in spec.order]).offset((number - 1) * size).limit(size)
    return label(rows, tables, spec, few=True)


def label(rows: DataFrame, tables: dict[str, DataFrame], spec: ListSpec, few: bool = False) -> DataFrame:
    """Add the columns of related rows by left joins on their keys.

    few: rows are a page at most, so their keys are sent to the related table, which is scanned but never moves.
    """
    keys = rows
    for x in spec.labels:
        other = tables[x.table].select(F.col(x.ref).alias("_ref"), F.col(x.column).alias(x.name))
        if few:
            wanted = keys.select(F.col(x.key).alias("_key"))  # MAX_PAGE rows at most
            other = F.broadcast(other.join(F.broadcast(wanted), F.col("_ref") == F.col("_key"), "left_semi"))
        rows = rows.join(other, F.col(x.key) == F.col("_ref"), "left").drop("_ref")
    return rows.select(*spec.columns) if spec.columns else rows


def total(tables: dict[str, DataFrame], spec: ListSpec, trigrams: TrigramIndex | None = None, **filters: Any) -> DataFrame:
    """How many rows the filters admit: one row, one column."""
    rows = tables[spec.table] if trigrams is None else trigrams.narrow(tables[spec.table], filters.get("search"))
    return rows.where(predicate(spec, **filters)).agg(F.count("*").alias("total"))


def child_counts(parents: DataFrame, children: DataFrame, key: str, ref: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 where there are none."""
    counts = children.groupBy(F.col(ref).alias("_ref")).agg(F.count("*").alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_ref"), "left").withColumn(name, F.coalesce("_n", F.lit(0))).drop("_ref", "_n")


def nest_children(parents: DataFrame, children: DataFrame, key: str, ref: str, columns: list[str], name: str) -> DataFrame:
    """Parents with an array of their children, in order of the columns; empty where there are none."""
    nested = children.groupBy(F.col(ref).alias("_ref")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
    rows = parents.join(nested, F.col(key) == F.col("_ref"), "left").drop("_ref")
    empty = F.array().cast(nested.schema[name].dataType)
    return rows.withColumn(name, F.coalesce(F.col(name), empty))


def status(**tables: DataFrame) -> DataFrame:
    """How many rows each table has: one row."""
    counts = [t.agg(F.count("*").alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), counts)  # of one row each


#: Listings of the back office over its own tables.
LISTINGS = {
    "users": ListSpec("users", ("username", "email"), labels=(Label("permission_groups", "permission_group_id", "permission_group_name"), Label("departments", "department_id", "department_name"), Label("positions", "position_id", "position_name"))),
    "system_logs": ListSpec("system_logs", equal=("user_id",), like=("action",), span="created_at"),
    "login_history": ListSpec("login_history", ("username_snapshot",), equal=("user_id",), equal_text=("login_type", "status"), span="login_at", labels=(Label("users", "user_id", "username", column="username"),)),
    "system_configs": ListSpec("system_configs", ("config_key", "description"), equal_text=("category",)),
    "api_keys": ListSpec("api_keys", ("name", "description"), labels=(Label("users", "created_by", "creator_username", column="username"),)),
    "permission_groups": ListSpec("permission_groups", ("name", "code")),
    "system_functions": ListSpec("system_functions", ("name", "code", "module")),
    "issuing_units": ListSpec("issuing_units", ("code", "name", "short_name"), equal=("is_active",), labels=(Label("issuing_units", "parent_id", "parent_name"),)),
    "departments": ListSpec("departments", ("code", "name"), equal=("issuing_unit_id", "is_active"), labels=(Label("issuing_units", "issuing_unit_id", "issuing_unit_name"), Label("departments", "parent_id", "parent_name"))),
    "positions": ListSpec("positions", ("code", "name"), equal=("department_id", "is_active"), labels=(Label("departments", "department_id", "department_name"),)),
    "work_assignment_documents": ListSpec("work_assignment_documents", ("document_code", "title"), equal=("issuing_unit_id", "department_id", "assigned_department_id"), equal_text=("status",), labels=(Label("issuing_units", "issuing_unit_id", "issuing_unit_name"), Label("departments", "department_id", "department_name"), Label("departments", "assigned_department_id", "assigned_department_name"), Label("users", "assigned_by_user_id", "assigned_by_username", column="username"))),
    "work_items": ListSpec("work_items", ("title", "description"), equal=("work_document_id", "assignee_user_id", "department_id"), equal_text=("status",), labels=(Label("work_assignment_documents", "work_document_id", "work_document_title", column="title"), Label("users", "assignee_user_id", "assignee_username", column="username"), Label("departments", "department_id", "department_name"), Label("positions", "position_id", "position_name"))),
    "notice_documents": ListSpec("notice_documents", ("notice_code", "title"), equal=("issuing_unit_id", "department_id"), equal_text=("status",), labels=(Label("issuing_units", "issuing_unit_id", "issuing_unit_name"), Label("departments", "department_id", "department_name"), Label("users", "posted_by_user_id", "posted_by_username", column="username"))),
}
