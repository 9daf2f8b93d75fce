"""Integrity, uniqueness and identity queries, and batch changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities, integrity, mutate
from ..streaming.sessions import SESSIONS, follow_sessions, login_rows_of
from ..streaming.sinks import BatchSink
from .base import query, scratch, standin, standins, table


@query("q_in_use_units", "SELECT id, name FROM issuing_units AS u WHERE EXISTS (SELECT 1 FROM issuing_units AS c WHERE c.parent_id = u.id)")
def q_in_use_units(spark, sf_dir):
    """Units that other units hang on."""
    t = standins(spark, sf_dir, "issuing_units")
    return integrity.in_use(t["issuing_units"], "id", (t["issuing_units"], "parent_id")).select("id", "name")


@query("q_deletable_units", "SELECT id, name FROM departments AS u WHERE NOT EXISTS (SELECT 1 FROM departments AS d WHERE d.parent_id = u.id) AND NOT EXISTS (SELECT 1 FROM positions AS p WHERE p.department_id = u.id AND NOT p.is_active)")
def q_deletable_units(spark, sf_dir):
    """Departments without children and without positions that were given up."""
    t = standins(spark, sf_dir, "departments", "positions")
    return integrity.deletable(t["departments"], "id", (t["departments"], "parent_id"), (t["positions"].where("not is_active"), "department_id")).select("id", "name")


@query("q_deletable_functions", "SELECT id, name FROM system_functions AS f WHERE NOT EXISTS (SELECT 1 FROM permission_group_functions AS p WHERE p.function_id = f.id)")
def q_deletable_functions(spark, sf_dir):
    """Functions that no group may use."""
    t = standins(spark, sf_dir, "system_functions", "permission_group_functions")
    return integrity.deletable(t["system_functions"], "id", (t["permission_group_functions"], "function_id")).select("id", "name")


@query("q_missing_refs", """
    SELECT id, user_ref FROM (SELECT id, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 10 = 3 THEN assigned_by_user_id + 1000000 ELSE assigned_by_user_id END AS user_ref FROM work_assignment_documents) AS r
    WHERE user_ref IS NOT NULL AND user_ref NOT IN (SELECT id FROM users)""")
def q_missing_refs(spark, sf_dir):
    t = standins(spark, sf_dir, "work_assignment_documents", "users")
    ref = F.expr("CASE WHEN id % 13 = 0 THEN NULL WHEN id % 10 = 3 THEN assigned_by_user_id + 1000000 ELSE assigned_by_user_id END")
    return integrity.missing_refs(t["work_assignment_documents"].select("id", ref.alias("user_ref")), "user_ref", t["users"], "id")


@query("q_position_conflicts", "SELECT u.id, u.position_id, u.department_id FROM users AS u JOIN positions AS p ON u.position_id = p.id WHERE p.department_id IS NOT NULL AND p.department_id <> u.department_id")
def q_position_conflicts(spark, sf_dir):
    t = standins(spark, sf_dir, "users", "positions")
    return integrity.position_conflicts(t["users"], t["positions"], "position_id", "department_id", "id", "department_id").select("id", "position_id", "department_id")


@query("q_unique_conflicts", "SELECT email, count(*) AS n FROM users WHERE email IS NOT NULL GROUP BY email HAVING count(*) > 1")
def q_unique_conflicts(spark, sf_dir):
    return integrity.duplicates(standin(spark, sf_dir, "users"), "email")


_CLAIMS = """SELECT id AS claim_id, CASE WHEN id % 2 = 0 THEN concat('sub-', CAST(id AS STRING)) ELSE concat('none-', CAST(id AS STRING)) END AS sso_subject,
    CASE WHEN id % 5 = 0 THEN username ELSE concat('new', CAST(id AS STRING)) END AS username, CASE WHEN id % 4 = 0 THEN '' ELSE concat('c', CAST(id % 40 AS STRING), '@mail.org') END AS email"""
_PEOPLE = "SELECT id AS user_id, sso_subject, username, CASE WHEN id < 40 THEN concat('c', CAST(id AS STRING), '@mail.org') END AS email"


@query("q_sso_resolve", f"""
    WITH claims AS ({_CLAIMS} FROM users), people AS ({_PEOPLE} FROM users)
    SELECT c.claim_id, c.sso_subject, c.username, c.email, coalesce(s.user_id, n.user_id, m.user_id) AS user_id,
           CASE WHEN s.user_id IS NOT NULL THEN 'sso_subject' WHEN n.user_id IS NOT NULL THEN 'username' WHEN m.user_id IS NOT NULL THEN 'email' END AS matched_by,
           coalesce(nullif(c.email, ''), CASE WHEN s.user_id IS NOT NULL THEN s.email WHEN n.user_id IS NOT NULL THEN n.email ELSE m.email END) AS stored_email
    FROM claims AS c LEFT JOIN people AS s ON c.sso_subject = s.sso_subject LEFT JOIN people AS n ON c.username = n.username LEFT JOIN people AS m ON c.email = m.email AND m.email <> ''""")
def q_sso_resolve(spark, sf_dir):
    users = standin(spark, sf_dir, "users")
    claims, people = (spark.sql(f"{s} FROM {{users}}", users=users) for s in (_CLAIMS, _PEOPLE))
    return integrity.resolve_identities(claims, people)


@query("q_login_sessions", """
    SELECT o.id, o.session_id, o.login_at, c.logout_at FROM (SELECT * FROM login_history WHERE id % 2 = 0) AS o
    LEFT JOIN (SELECT concat('s', CAST(id - id % 3 AS STRING)) AS session_id, max(login_at) AS logout_at FROM login_history WHERE id % 2 = 1 GROUP BY ALL) AS c ON o.session_id = c.session_id""")
def q_login_sessions(spark, sf_dir):
    rows = standin(spark, sf_dir, "login_history")
    closed = rows.where("id % 2 = 1").select(F.expr("concat('s', CAST(id - id % 3 AS STRING))").alias("session_id"), F.col("login_at").alias("closed_at"))
    return integrity.close_sessions(rows.where("id % 2 = 0").select("id", "session_id", "login_at"), closed)


_OPEN_AND_CLOSED = """
    SELECT o.id, o.session_id, o.login_at, c.logout_at FROM (SELECT * FROM login_history WHERE id % 2 = 0) AS o
    LEFT JOIN (SELECT concat('s', CAST(id - id % 3 AS STRING)) AS session_id, max(login_at) AS logout_at FROM login_history WHERE id % 2 = 1 GROUP BY ALL) AS c ON o.session_id = c.session_id"""


@query("q_login_sessions_stream", _OPEN_AND_CLOSED)
def q_login_sessions_stream(spark, sf_dir):
    """The rows of q_login_sessions from a stream of opens and closes, by keyed state."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")
    shut = F.col("event_id") % 2 == 1
    named = F.when(shut, F.col("event_id") - F.col("event_id") % 3).otherwise(F.col("event_id"))
    rows = stream.select(F.concat(F.lit("s"), named.cast("string")).alias("session_id"), F.when(shut, "close").otherwise("open").alias("event"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    folder = scratch(spark, "sessions")
    sink = BatchSink(spark, f"{folder}/rows", "all", SESSIONS)
    follow_sessions(rows, sink, f"{folder}/checkpoint").awaitTermination()
    return login_rows_of(sink).select("id", "session_id", "login_at", "logout_at")


def _new_departments(spark, sf_dir):
    d = standin(spark, sf_dir, "departments")
    return d, d.select((F.col("id") + 20).alias("id"), F.expr("CASE WHEN id % 6 = 0 THEN code ELSE concat('X', CAST(id % 9 AS STRING)) END").alias("code"), "name", F.expr("CASE WHEN id % 5 = 1 THEN 77 ELSE issuing_unit_id END").alias("issuing_unit_id"), F.lit(None).cast("long").alias("parent_id"), "is_active")


_NEW = """SELECT id + 20 AS id, CASE WHEN id % 6 = 0 THEN code ELSE concat('X', CAST(id % 9 AS STRING)) END AS code, CASE WHEN id % 5 = 1 THEN 77 ELSE issuing_unit_id END AS issuing_unit_id FROM departments"""


def _rejects(new: str, table: str, unique: str, refs: str) -> str:
    """SQL for the refused rows (id, reason) of new rows; refs: a CASE for references that lead nowhere, or for what comes after them."""
    same = lambda c: f"lower(strip_accents(rtrim({c})))"  # noqa: E731  what the tables' collation compares
    return f"""SELECT id, coalesce(early, CASE WHEN clash OR id > min(id) FILTER (early IS NULL AND NOT clash AND lost IS NULL) OVER (PARTITION BY u, early IS NULL) THEN '409 {unique}' END, lost) AS reason FROM (
        SELECT n.id, {same(f"n.{unique}")} AS u, CASE WHEN n.id IN (SELECT id FROM {table}) THEN '409 id' END AS early, {same(f"n.{unique}")} IN (SELECT {same(unique)} FROM {table}) AS clash, {refs} AS lost FROM ({new}) AS n) AS r
        QUALIFY reason IS NOT NULL"""


@query("q_insert_rejects", "SELECT r.id, n.code, reason FROM (" + _rejects(_NEW, "departments", "code", "CASE WHEN n.issuing_unit_id NOT IN (SELECT id FROM issuing_units) THEN '404 issuing_unit_id' END") + f") AS r JOIN ({_NEW}) AS n ON r.id = n.id")
def q_insert_rejects(spark, sf_dir):
    d, new = _new_departments(spark, sf_dir)
    rules = mutate.Rules(unique=("code",), refs=(("issuing_unit_id", standin(spark, sf_dir, "issuing_units"), "id"),))
    return mutate.insert(d, new, rules)[1].select("id", "code", "reason")


@query("q_update_rows", """
    SELECT id, name, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN parent_id ELSE parent_id END AS parent_id, CASE WHEN id % 3 = 0 AND id <> 6 THEN concat('n', CAST(id AS STRING)) ELSE code END AS code
    FROM (SELECT id, name, code, CASE WHEN id = 6 THEN parent_id + 0 ELSE parent_id END AS parent_id FROM departments) AS d WHERE id % 3 <> 0
    UNION ALL SELECT id, name, CASE WHEN id = 6 THEN parent_id END AS parent_id, CASE WHEN id = 6 THEN code ELSE concat('n', CAST(id AS STRING)) END AS code FROM departments WHERE id % 3 = 0""")
def q_update_rows(spark, sf_dir):
    d = standin(spark, sf_dir, "departments").select("id", "name", "parent_id", "code")
    changes = d.where("id % 3 = 0").select("id", F.expr("CASE WHEN id = 6 THEN 6 END").cast("long").alias("parent_id"), F.expr("concat('n', CAST(id AS STRING))").alias("code"))
    return mutate.update(d, changes, mutate.Rules(parent="parent_id"), clears=("parent_id",))[0]


@query("q_delete_rejects", """
    SELECT k.id, CASE WHEN d.id IS NULL THEN '404 id' ELSE '400 in use' END AS reason FROM (SELECT id * 2 AS id FROM departments) AS k LEFT JOIN departments AS d ON k.id = d.id
    WHERE d.id IS NULL OR k.id IN (SELECT parent_id FROM departments WHERE parent_id IS NOT NULL)""")
def q_delete_rejects(spark, sf_dir):
    d = standin(spark, sf_dir, "departments")
    return mutate.delete(d, d.select((F.col("id") * 2).alias("id")), guards=((d, "parent_id"),))[1]


@query("q_cascade", "SELECT count(*) AS n, CAST(sum(part_id) AS BIGINT) AS parts FROM work_items WHERE work_document_id NOT IN (SELECT id FROM work_assignment_documents WHERE status = 'F')")
def q_cascade(spark, sf_dir):
    t = standins(spark, sf_dir, "work_items", "work_assignment_documents")
    left = t["work_assignment_documents"].where("status <> 'F'")
    return mutate.cascade(t["work_items"], left, "work_document_id").agg(F.count("*").alias("n"), F.sum("part_id").alias("parts"))


@query("q_upsert", "SELECT id, name, code FROM permission_groups WHERE id % 2 = 0 UNION ALL SELECT id, concat(name, '*') AS name, code FROM permission_groups WHERE id % 2 = 1 UNION ALL SELECT 99, 'new', 'G99'")
def q_upsert(spark, sf_dir):
    g = standin(spark, sf_dir, "permission_groups")
    new = g.where("id % 2 = 1").withColumn("name", F.concat("name", F.lit("*"))).unionByName(spark.range(1).select(F.lit(99).cast("long").alias("id"), F.lit("new").alias("name"), F.lit("G99").alias("code")))
    return mutate.upsert(g, new, "id")


@query("q_replace_links", "SELECT group_id, function_id, can_create FROM permission_group_functions WHERE group_id <> 1 UNION ALL SELECT 1, 500, true")
def q_replace_links(spark, sf_dir):
    links = standin(spark, sf_dir, "permission_group_functions")
    new = spark.range(1).select(F.lit(1).cast("long").alias("group_id"), F.lit(500).cast("long").alias("function_id"), F.lit(True).alias("can_create"))
    return mutate.replace_links(links, new, "group_id")


@query("q_toggle", "SELECT id, CASE WHEN id % 4 = 0 AND id <> 8 THEN NOT is_active ELSE is_active END AS is_active FROM users")
def q_toggle(spark, sf_dir):
    users = standin(spark, sf_dir, "users").select("id", "is_active")
    return mutate.toggle(users, users.where("id % 4 = 0").select("id"), "is_active", own=8)


#: New rows with twins by case, accent and trailing blank among themselves and in the table, references that lead nowhere, and ids that are there.
_NEW_POSITIONS = """SELECT CASE WHEN id % 17 = 0 THEN id ELSE id + 100000 END AS id, CASE id % 4 WHEN 0 THEN concat(lower(code), '  ') WHEN 1 THEN concat('É', CAST(id % 50 AS STRING)) WHEN 2 THEN concat('e', CAST(id % 50 AS STRING), ' ') ELSE concat('n', CAST(id AS STRING)) END AS code,
    name, CASE WHEN id % 5 = 0 THEN 777 ELSE department_id END AS department_id FROM positions"""
_NEW_USERS = """SELECT id + 1000000 AS id, CASE WHEN id % 9 = 0 THEN upper(username) ELSE concat('new', CAST(id % 700 AS STRING)) END AS username, permission_group_id,
    CASE WHEN id % 8 = 0 THEN 99 ELSE department_id END AS department_id, CASE WHEN id % 6 = 0 THEN 5000 WHEN id % 2 = 0 THEN NULL ELSE position_id END AS position_id FROM users"""
_USER_REFS = """CASE WHEN n.department_id NOT IN (SELECT id FROM departments) THEN '404 department_id' WHEN n.position_id NOT IN (SELECT id FROM positions) THEN '404 position_id'
    WHEN n.department_id <> (SELECT p.department_id FROM positions AS p WHERE p.id = n.position_id) THEN '400 position_id' END"""


@query("q_entity_create", "SELECT 'positions' AS entity, id, reason FROM (" + _rejects(_NEW_POSITIONS.replace("STRING", "VARCHAR"), "positions", "code", "CASE WHEN n.department_id NOT IN (SELECT id FROM departments) THEN '404 department_id' END")
       + ") AS p UNION ALL SELECT 'users', id, reason FROM (" + _rejects(_NEW_USERS.replace("STRING", "VARCHAR"), "users", "username", _USER_REFS) + ") AS u")
def q_entity_create(spark, sf_dir):
    """Refused new positions and users, by the rules of their tables."""
    t = standins(spark, sf_dir, "positions", "users", "departments", "permission_groups")
    t["users"] = t["users"].select("id", "username", "permission_group_id", "department_id", "position_id")
    out = []
    for name, sql in (("positions", _NEW_POSITIONS), ("users", _NEW_USERS)):
        new = spark.sql(sql.replace(f"FROM {name}", "FROM {rows}"), rows=t[name])
        out.append(entities.create(t, name, new, F.lit("2026-01-01").cast("timestamp_ntz"))[1].select(F.lit(name).alias("entity"), "id", "reason"))
    return out[0].unionByName(out[1])


@query("q_entity_remove", """
    SELECT 'departments' AS what, id, CASE WHEN id > 24 THEN '404 id' ELSE '400 in use' END AS reason FROM (SELECT id FROM departments UNION ALL SELECT id + 20 FROM departments WHERE id + 20 > 24) AS d
    WHERE id > 24 OR id IN (SELECT parent_id FROM departments WHERE parent_id IS NOT NULL) OR id IN (SELECT department_id FROM positions) OR id IN (SELECT department_id FROM users)
    UNION ALL SELECT 'items left', count(*), CAST(sum(part_id) AS VARCHAR) FROM (SELECT *, CASE WHEN id % 10 = 3 THEN NULL ELSE work_document_id END AS w FROM work_items) AS i
    WHERE w IS NULL OR w NOT IN (SELECT id FROM work_assignment_documents WHERE status = 'F')""")
def q_entity_remove(spark, sf_dir):
    """Departments that may not go, and the items that are left when documents go: those of others, and those of none."""
    t = standins(spark, sf_dir, "departments", "positions", "users", "work_assignment_documents", "work_items")
    t["work_items"] = t["work_items"].withColumn("work_document_id", F.expr("CASE WHEN id % 10 <> 3 THEN work_document_id END"))
    asked = t["departments"].select("id").unionByName(t["departments"].where("id + 20 > 24").select((F.col("id") + 20).alias("id")))
    alone = {n: t[n] for n in ("departments", "positions", "users")}
    refused = entities.remove(alone, "departments", asked)[1].select(F.lit("departments").alias("what"), "id", "reason")
    left = entities.remove({n: t[n] for n in ("work_assignment_documents", "work_items")}, "work_assignment_documents", t["work_assignment_documents"].where("status = 'F'").select("id"))[0]["work_items"]
    return refused.unionByName(left.agg(F.lit("items left").alias("what"), F.count("*").alias("id"), F.sum("part_id").cast("string").alias("reason")))


@query("q_taken", f"""
    WITH claims AS ({_CLAIMS} FROM users) SELECT c.claim_id, c.username FROM claims AS c WHERE EXISTS (SELECT 1 FROM users AS u WHERE lower(rtrim(u.username)) = lower(rtrim(c.username)) AND u.id <> c.claim_id)
    UNION ALL SELECT id, concat(username, ' ') FROM users WHERE id % 4 = 1""")
def q_taken(spark, sf_dir):
    """Names of other users, among claims and among names that differ by a trailing blank from another's."""
    users = standin(spark, sf_dir, "users")
    claims = spark.sql(f"{_CLAIMS} FROM {{users}}", users=users).select("claim_id", "username")
    late = users.where("id % 4 = 1").select((F.col("id") + 5_000_000).alias("claim_id"), F.concat(F.lower("username"), F.lit(" ")).alias("username"))
    found = integrity.taken(claims.unionByName(late), users.withColumnRenamed("id", "claim_id"), "username", "claim_id")
    small = F.col("claim_id") >= 5_000_000
    return found.select(F.when(small, F.col("claim_id") - 5_000_000).otherwise(F.col("claim_id")).alias("claim_id"), F.when(small, F.replace("username", F.lit("customer"), F.lit("Customer"))).otherwise(F.col("username")).alias("username"))
