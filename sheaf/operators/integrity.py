"""Referential integrity, uniqueness and identity resolution over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import collated
from ..functions.values import keep_or_replace


def in_use(parents: DataFrame, key: str, *uses: tuple[DataFrame, str]) -> DataFrame:
    """Parents that at least one row of a table refers to; uses: (table, column)."""
    return parents.join(_referred(uses), F.col(key) == F.col("_ref"), "left_semi")


def deletable(parents: DataFrame, key: str, *uses: tuple[DataFrame, str]) -> DataFrame:
    """Parents that no row refers to."""
    return parents.join(_referred(uses), F.col(key) == F.col("_ref"), "left_anti")


def _referred(uses) -> DataFrame:
    refs = [t.select(F.col(c).alias("_ref")) for t, c in uses]
    out = refs[0]
    for r in refs[1:]:
        out = out.unionByName(r)
    return out


def missing_refs(rows: DataFrame, fk: str, parents: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is set but leads nowhere."""
    return rows.where(F.col(fk).isNotNull()).join(parents.select(F.col(key).alias("_key")), F.col(fk) == F.col("_key"), "left_anti")


def position_conflicts(users: DataFrame, positions: DataFrame, position: str, department: str, key: str, position_department: str) -> DataFrame:
    """Users whose position belongs to another department than theirs; a position or user without one agrees with all."""
    own = positions.select(F.col(key).alias("_key"), F.col(position_department).alias("_department"))
    rows = users.where(F.col(position).isNotNull() & F.col(department).isNotNull())
    return rows.join(own, (F.col(position) == F.col("_key")) & (F.col("_department") != F.col(department))).drop("_key", "_department")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once by the tables' collation, with how often; keys with a null part are free. Of twins the least is shown."""
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    found = rows.groupBy(*[collated(rows, k).alias(f"_k_{k}") for k in keys]).agg(*[F.min(k).alias(k) for k in keys], F.count("*").alias("n"))
    return found.where("n > 1").select(*keys, "n")


def taken(changes: DataFrame, rows: DataFrame, value: str, key: str) -> DataFrame:
    """Changes whose value another row (of another key) has already, by the tables' collation."""
    other = rows.select(collated(rows, value).alias("_value"), F.col(key).alias("_key"))
    return changes.join(other, (collated(changes, value) == F.col("_value")) & (~F.col(key).eqNullSafe(F.col("_key"))), "left_semi")


def resolve_identities(claims: DataFrame, users: DataFrame) -> DataFrame:
    """Claims (claim_id, sso_subject, username, email) with the user each names: by subject, else by user name, else by email.

    Adds user_id (null: not provisioned), matched_by and the email to store: the claim's unless empty, else the user's. The
    three columns are unique in users but may be null.
    """
    out = claims.withColumn("_row", F.monotonically_increasing_id())
    for by in ("sso_subject", "username", "email"):
        found = users.where(F.col(by).isNotNull() & (F.col(by) != "")).select(F.col(by).alias(f"_{by}"), F.lit(0).cast("long").alias(f"_salt_{by}"), F.col("user_id").alias(f"_id_{by}"), F.col("email").alias(f"_email_{by}"))
        # a claim without a value is dealt by its number, so that such claims don't meet in the task of a null key
        asked = F.nullif(F.col(by), F.lit(""))
        out = out.withColumn("_asked", F.coalesce(asked, F.lit(""))).withColumn("_salt", F.when(asked.isNull(), F.col("_row") + 1).otherwise(0))
        out = out.join(found, (F.col("_asked") == F.col(f"_{by}")) & (F.col("_salt") == F.col(f"_salt_{by}")), "left")
    ids = [F.col(f"_id_{by}") for by in ("sso_subject", "username", "email")]
    how = F.when(ids[0].isNotNull(), "sso_subject").when(ids[1].isNotNull(), "username").when(ids[2].isNotNull(), "email")
    old = F.when(ids[0].isNotNull(), F.col("_email_sso_subject")).when(ids[1].isNotNull(), F.col("_email_username")).otherwise(F.col("_email_email"))
    return out.select(*claims.columns, F.coalesce(*ids).alias("user_id"), how.alias("matched_by"), keep_or_replace(F.col("email"), old).alias("stored_email"))


def close_sessions(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """Login rows with the time of their session's close, if any; closes of unknown sessions are passed over."""
    ends = closed.groupBy(F.col("session_id").alias("_session")).agg(F.max("closed_at").alias("logout_at"))
    return opened.join(ends, F.col("session_id") == F.col("_session"), "left").drop("_session")
