"""Rules of the back office's tables for batches of new, changed and deleted rows.

Each step takes all tables and gives them anew, those that changed replaced, with the refused rows and their reasons.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import mutate
from .integrity import position_conflicts

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Entity:
    """What a table asks of its rows."""

    unique: tuple[str, ...] = ()
    refs: tuple[tuple[str, str], ...] = ()  # (column, table)
    parent: str | None = None  # a reference to the table itself that may not name the row
    defaults: dict[str, Any] = field(default_factory=dict)
    guards: tuple[tuple[str, str], ...] = ()  # (table, column) that may not refer to a deleted row
    children: tuple[tuple[str, str], ...] = ()  # (table, column) whose rows go with it
    clears: tuple[str, ...] = ()  # a change without a value takes the old one away
    actor: str | None = None  # column of the acting user, at creation
    actor_on_change: bool = False
    creates: bool = True
    deletes: bool = True


_ACTIVE = {"is_active": True}
_PLACES = (("issuing_unit_id", "issuing_units"), ("department_id", "departments"))
#: Unique columns, references, defaults and guards of the tables.
ENTITIES = {
    "users": Entity(("username", "email"), (("permission_group_id", "permission_groups"), ("department_id", "departments"), ("position_id", "positions")), defaults=_ACTIVE | {"role": "user", "auth_source": "local"}, clears=("email",), deletes=False),
    "system_configs": Entity(("config_key",), defaults=_ACTIVE | {"category": "general", "data_type": "string"}, actor="updated_by", actor_on_change=True),
    "api_keys": Entity(defaults=_ACTIVE, actor="created_by"),
    "permission_groups": Entity(("name", "code"), defaults=_ACTIVE, guards=(("users", "permission_group_id"),), children=(("permission_group_functions", "group_id"),)),
    "system_functions": Entity(("code",), defaults=_ACTIVE, children=(("permission_group_functions", "function_id"),)),
    "issuing_units": Entity(("code",), (("parent_id", "issuing_units"),), "parent_id", _ACTIVE, (("issuing_units", "parent_id"), ("departments", "issuing_unit_id"), ("work_assignment_documents", "issuing_unit_id"), ("notice_documents", "issuing_unit_id"))),
    "departments": Entity(("code",), (("issuing_unit_id", "issuing_units"), ("parent_id", "departments")), "parent_id", _ACTIVE, (("departments", "parent_id"), ("positions", "department_id"), ("users", "department_id"), ("work_items", "department_id"), ("work_assignment_documents", "department_id"), ("work_assignment_documents", "assigned_department_id"), ("notice_documents", "department_id"))),
    "positions": Entity(("code",), (("department_id", "departments"),), defaults=_ACTIVE, guards=(("users", "position_id"), ("work_items", "position_id"))),
    "work_assignment_documents": Entity(("document_code",), (*_PLACES, ("assigned_department_id", "departments"), ("assigned_by_user_id", "users")), defaults={"status": "draft"}, children=(("work_items", "work_document_id"),)),
    "work_items": Entity((), (("work_document_id", "work_assignment_documents"), ("assignee_user_id", "users"), ("department_id", "departments"), ("position_id", "positions")), defaults={"priority": "normal", "status": "pending"}),
    "notice_documents": Entity(("notice_code",), (*_PLACES, ("posted_by_user_id", "users")), defaults={"status": "draft"}),
}
#: Rights of a link between a group and a function that are not named.
RIGHTS = {"can_view": True, "can_create": False, "can_update": False, "can_delete": False}


def _rules(tables: Tables, name: str) -> mutate.Rules:
    e = ENTITIES[name]
    have = tables[name].columns
    return mutate.Rules("id", tuple(c for c in e.unique if c in have), tuple((c, tables[t], "id") for c, t in e.refs if c in have), e.parent if e.parent in have else None)




def _mismatched(tables: Tables, changes: DataFrame, judged: DataFrame) -> DataFrame:
    """Adds _late: the reason of users whose position belongs to another department than theirs, by the rows of `judged`."""
    wrong = position_conflicts(judged.select("id", "position_id", "department_id"), tables["positions"], "position_id", "department_id", "id", "department_id")
    marked = changes.join(wrong.select(F.col("id").alias("_wrong")).distinct(), F.col("id") == F.col("_wrong"), "left")
    return marked.withColumn("_late", F.when(F.col("_wrong").isNotNull(), F.lit("400 position_id"))).drop("_wrong")


def create(tables: Tables, name: str, rows: DataFrame, now: Column, actor: int | None = None) -> tuple[Tables, DataFrame]:
    """New rows of a table; columns that are absent or null take their defaults. A raw_key is kept as its digest alone."""
    e, table = ENTITIES[name], tables[name]
    if "raw_key" in rows.columns:
        rows = rows.withColumn("key_hash", F.sha2(F.col("raw_key"), 256)).drop("raw_key")
    defaults = {c: F.lit(v) for c, v in e.defaults.items()} | {"created_at": now}
    for f in table.schema:
        value = F.col(f.name) if f.name in rows.columns else F.lit(None)
        if e.actor == f.name:
            value = F.lit(actor)
        elif f.name in defaults:
            value = F.coalesce(value, defaults[f.name])
        rows = rows.withColumn(f.name, value.cast(f.dataType))
    rows, late = rows.select(*table.columns), None
    if name == "users" and {"position_id", "department_id"} <= set(table.columns):
        rows, late = _mismatched(tables, rows, rows), "_late"
    out, refused = mutate.insert(table, rows, _rules(tables, name), late)
    return tables | {name: out}, refused


def change(tables: Tables, name: str, changes: DataFrame, now: Column, actor: int | None = None) -> tuple[Tables, DataFrame]:
    """New values by id; null leaves a value as it is, but for the columns that a table clears. Rows that change get the time."""
    e, table = ENTITIES[name], tables[name]
    late = None
    if name == "users" and {"position_id", "department_id"} & set(changes.columns):
        # judged with the values that stay
        old = table.select(F.col("id").alias("_key"), F.col("position_id").alias("_p"), F.col("department_id").alias("_d"))
        both = changes.join(old, F.col("id") == F.col("_key"), "left")
        for c, kept in (("position_id", "_p"), ("department_id", "_d")):
            both = both.withColumn(c, F.coalesce(F.col(c), F.col(kept)) if c in changes.columns else F.col(kept))
        changes, late = _mismatched(tables, changes, both), "_late"
    stamps = {"updated_at": now} if "updated_at" in table.columns else {}
    if e.actor_on_change and e.actor in table.columns:
        stamps[e.actor] = F.lit(actor)
    for c, v in stamps.items():
        changes = changes.withColumn(c, v.cast(table.schema[c].dataType))
    out, refused = mutate.update(table, changes, _rules(tables, name), tuple(c for c in e.clears if c in changes.columns), late)
    return tables | {name: out}, refused.drop(*stamps)


def remove(tables: Tables, name: str, keys: DataFrame) -> tuple[Tables, DataFrame]:
    """Rows go by id unless a row of the tables as given refers to them; rows that hang on them go too."""
    e = ENTITIES[name]
    if not e.deletes:
        raise ValueError(f"rows of {name} are never deleted")
    guards = tuple((tables[t], c) for t, c in e.guards if t in tables and c in tables[t].columns)
    out, refused = mutate.delete(tables[name], keys, "id", guards)
    removed = tables[name].select("id").join(out.select("id"), "id", "left_anti")
    changed = {name: out}
    for t, c in e.children:
        if t in tables:
            changed[t] = mutate.without_children(changed.get(t, tables[t]), removed, c)
    return tables | changed, refused


def set_permissions(tables: Tables, links: DataFrame) -> tuple[Tables, DataFrame]:
    """The links (group_id, function_id, rights) of each group named give way to these, unless one leads nowhere.

    A group with a link to a function that is not there keeps all it has.
    """
    for c, v in RIGHTS.items():
        links = links.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in links.columns else F.lit(v))
    known = tables["system_functions"].select(F.col("id").alias("_f"))
    lost = links.join(known, F.col("function_id") == F.col("_f"), "left_anti").select(F.col("group_id").alias("_bad")).distinct()
    good = links.join(lost, F.col("group_id") == F.col("_bad"), "left_anti")
    table = tables["permission_group_functions"]
    for f in table.schema:
        if f.name not in good.columns:
            good = good.withColumn(f.name, F.lit(None).cast(f.dataType))
    refused = lost.select(F.col("_bad").alias("group_id"), F.lit("404 function_id").alias("reason"))
    return tables | {"permission_group_functions": mutate.replace_links(table, good, "group_id")}, refused


def login_rows(attempts: DataFrame) -> DataFrame:
    """Rows of login_history but for their ids, from attempts (user_id, username, login_type, session_id, at, ip_address, reason).

    An attempt with a reason has failed and is nobody's.
    """
    failed = F.col("reason").isNotNull()
    return attempts.select(
        F.when(~failed, F.col("user_id")).alias("user_id"), F.col("username").alias("username_snapshot"), F.coalesce("login_type", F.lit("local")).alias("login_type"), "session_id",
        F.col("at").alias("login_at"), F.lit(None).cast("timestamp_ntz").alias("logout_at"), F.when(failed, "failed").otherwise("success").alias("status"), "ip_address", F.col("reason").alias("detail"))
