"""Listings, their counts, exports and status."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import functions as F

from ..functions import values
from ..operators import listing
from ..operators.listing import LISTINGS
from ..operators.ranks import RankedTable
from ..operators.trigrams import TrigramIndex
from ..sources.snapshot import export_logs, from_lines, to_lines
from ..streaming.requests import RequestLog
from .base import query, scratch, standin, standins, table

SINCE, UNTIL = "2024-01-05 00:00:00", "2024-12-31 00:00:00"


def _times():
    return {"since": F.lit(SINCE).cast("timestamp_ntz"), "until": F.lit(UNTIL).cast("timestamp_ntz")}


_RANGE = "created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at <= TIMESTAMP '2024-12-31 00:00:00'"


#: Patterns with and without wildcards, one of them without three signs in a row.
_PATTERNS = ("Brass", "st__l", "BRAND#1%x", "dd%ed", "1", "no such thing")


@query("q_trigram_search", " UNION ALL ".join(f"SELECT '{x}' AS pattern, id FROM system_functions WHERE name ILIKE '%{x}%' OR code ILIKE '%{x}%' OR module ILIKE '%{x}%'" for x in _PATTERNS))
def q_trigram_search(spark, sf_dir):
    """Substring search over three columns by an index of trigrams, which took the table in two batches."""
    rows = standin(spark, sf_dir, "system_functions")
    spec = LISTINGS["system_functions"]
    index = TrigramIndex(spark, scratch(spark, "trigrams"), spec.search)
    for part in (0, 1):
        index.append(rows.where(F.col("id") % 2 == part))
    found = [index.narrow(rows, x).where(listing.predicate(spec, search=x)).select(F.lit(x).alias("pattern"), "id") for x in _PATTERNS]
    return reduce(lambda a, b: a.unionByName(b), found)


RANGE = 1000  # rows of a range, so that there are several at each size


def _deep(where: str) -> str:
    """The page that starts three quarters down."""
    return f"""SELECT id, status, title FROM (SELECT *, row_number() OVER (ORDER BY id DESC) AS r, count(*) OVER () AS n FROM work_assignment_documents WHERE {where}) AS t
        WHERE r > n * 3 // 4 // 20 * 20 AND r <= n * 3 // 4 // 20 * 20 + 20"""


def _deep_page(spark, sf_dir, **filters):
    spec = replace(LISTINGS["work_assignment_documents"], columns=("id", "status", "title"), labels=())
    rows = standin(spark, sf_dir, "work_assignment_documents")
    ranked = RankedTable.build(rows, scratch(spark, "ranked"), spec.order, range_rows=RANGE)
    n = sum(c for _, c in ranked.counts(listing.predicate(spec, **filters) if filters else None))
    return listing.page({}, spec, n * 3 // 4 // 20 + 1, 20, ranked=ranked, **filters)


@query("q_deep_page", _deep("TRUE"))
def q_deep_page(spark, sf_dir):
    return _deep_page(spark, sf_dir)


@query("q_deep_page_filtered", _deep("status = 'O'"))
def q_deep_page_filtered(spark, sf_dir):
    return _deep_page(spark, sf_dir, status="O")


def _lists(name: str, stem: str, tables: tuple[str, ...], columns: tuple[str, ...], filters, page_sql: str, where_sql: str, order: tuple[str, ...] = ("id",), number: int = 2, size: int = 10):
    """A listing's page and count under q_list_<stem> and q_count_<stem>."""
    spec = replace(LISTINGS[name], columns=columns, order=order)

    @query(f"q_list_{stem}", page_sql.format(where=where_sql, page=f"ORDER BY {', '.join(f't.{c} DESC' for c in order)} LIMIT {size} OFFSET {(number - 1) * size}"))
    def _page(spark, sf_dir):
        return listing.page(standins(spark, sf_dir, *tables), spec, number, size, **filters())

    @query(f"q_count_{stem}", f"SELECT count(*) AS total FROM {name} AS t WHERE {where_sql}")
    def _total(spark, sf_dir):
        return listing.total(standins(spark, sf_dir, name), spec, **filters())


_lists(
    "system_logs", "logs", ("system_logs",), ("id", "user_id", "action", "detail", "ip_address", "status_code", "created_at"), lambda: {"action": "c", **_times()},
    "SELECT id, user_id, action, detail, ip_address, status_code, created_at FROM system_logs AS t WHERE {where} {page}", f"action ILIKE '%c%' AND {_RANGE}",
)
_lists(
    "login_history", "login_history", ("login_history", "users"), ("id", "user_id", "username_snapshot", "login_type", "status", "login_at", "username"), lambda: {"search": "User_1", "login_type": "sso", "status": "success"},
    "SELECT t.id, user_id, username_snapshot, login_type, status, login_at, u.username FROM login_history AS t LEFT JOIN users AS u ON t.user_id = u.id WHERE {where} {page}",
    "username_snapshot ILIKE '%User_1%' AND login_type = 'sso' AND status = 'success'",
)
_lists(
    "users", "users", ("users", "permission_groups", "departments", "positions"), ("id", "username", "email", "permission_group_name", "department_name", "position_name"), lambda: {"search": "1@b"},
    """SELECT t.id, username, email, g.name AS permission_group_name, d.name AS department_name, p.name AS position_name FROM (SELECT * FROM users AS t WHERE {where}) AS t
       LEFT JOIN permission_groups AS g ON t.permission_group_id = g.id LEFT JOIN departments AS d ON t.department_id = d.id LEFT JOIN positions AS p ON t.position_id = p.id {page}""",
    "(username ILIKE '%1@b%' OR email ILIKE '%1@b%')",
)
_lists(
    "system_configs", "configs", ("system_configs",), ("id", "config_key", "description", "category"), lambda: {"search": "e", "category": "Brand#1"},
    "SELECT id, config_key, description, category FROM system_configs AS t WHERE {where} {page}", "(config_key ILIKE '%e%' OR description ILIKE '%e%') AND category = 'Brand#1'", number=1,
)
_lists(
    "system_functions", "functions", ("system_functions",), ("id", "name", "code", "module"), lambda: {"search": "1"},
    "SELECT id, name, code, module FROM system_functions AS t WHERE {where} {page}", "(name ILIKE '%1%' OR code ILIKE '%1%' OR module ILIKE '%1%')",
)
_lists(
    "api_keys", "api_keys", ("api_keys", "users"), ("id", "name", "description", "creator_username"), lambda: {"search": "KEY OF"},
    "SELECT t.id, name, description, u.username AS creator_username FROM api_keys AS t LEFT JOIN users AS u ON t.created_by = u.id WHERE {where} {page}", "(name ILIKE '%KEY OF%' OR description ILIKE '%KEY OF%')", number=1,
)
_lists(
    "issuing_units", "issuing_units", ("issuing_units",), ("id", "code", "name", "short_name", "parent_name"), lambda: {"search": "a", "is_active": True},
    "SELECT t.id, t.code, t.name, t.short_name, p.name AS parent_name FROM (SELECT * FROM issuing_units AS t WHERE {where}) AS t LEFT JOIN issuing_units AS p ON t.parent_id = p.id {page}",
    "(code ILIKE '%a%' OR name ILIKE '%a%' OR short_name ILIKE '%a%') AND is_active = true", number=1,
)
_lists(
    "departments", "departments", ("departments", "issuing_units"), ("id", "code", "name", "issuing_unit_name", "parent_name"), lambda: {"is_active": True},
    """SELECT t.id, t.code, t.name, u.name AS issuing_unit_name, p.name AS parent_name FROM (SELECT * FROM departments AS t WHERE {where}) AS t
       LEFT JOIN issuing_units AS u ON t.issuing_unit_id = u.id LEFT JOIN departments AS p ON t.parent_id = p.id {page}""", "is_active = true", number=1,
)
_lists(
    "positions", "positions", ("positions", "departments"), ("id", "code", "name", "department_name"), lambda: {"is_active": False},
    "SELECT t.id, t.code, t.name, d.name AS department_name FROM (SELECT * FROM positions AS t WHERE {where}) AS t LEFT JOIN departments AS d ON t.department_id = d.id {page}", "is_active = false", number=1,
)
_lists(
    "work_items", "work_items", ("work_items", "work_assignment_documents", "users", "departments", "positions"),
    ("id", "title", "status", "part_id", "work_document_title", "assignee_username", "department_name", "position_name"), lambda: {"search": "r", "status": "R"},
    """SELECT t.id, t.title, t.status, t.part_id, w.title AS work_document_title, u.username AS assignee_username, d.name AS department_name, p.name AS position_name
       FROM (SELECT * FROM work_items AS t WHERE {where}) AS t LEFT JOIN work_assignment_documents AS w ON t.work_document_id = w.id LEFT JOIN users AS u ON t.assignee_user_id = u.id
       LEFT JOIN departments AS d ON t.department_id = d.id LEFT JOIN positions AS p ON t.position_id = p.id {page}""",
    "(title ILIKE '%r%' OR description ILIKE '%r%') AND status = 'R'", order=("id", "assignee_user_id", "part_id", "title"),
)
_lists(
    "notice_documents", "notice_documents", ("notice_documents", "issuing_units", "departments", "users"),
    ("id", "notice_code", "title", "status", "issuing_unit_name", "department_name", "posted_by_username"), lambda: {"status": "O", "issuing_unit_id": 0},
    """SELECT t.id, t.notice_code, t.title, t.status, i.name AS issuing_unit_name, d.name AS department_name, u.username AS posted_by_username
       FROM (SELECT * FROM notice_documents AS t WHERE {where}) AS t LEFT JOIN issuing_units AS i ON t.issuing_unit_id = i.id LEFT JOIN departments AS d ON t.department_id = d.id LEFT JOIN users AS u ON t.posted_by_user_id = u.id {page}""",
    "status = 'O' AND issuing_unit_id = 0",
)

_WORK_DOCS = replace(LISTINGS["work_assignment_documents"], columns=())


@query("q_list_work_documents", """
    SELECT t.id, t.document_code, t.title, t.status, i.name AS issuing_unit_name, d.name AS department_name, a.name AS assigned_department_name, u.username AS assigned_by_username,
           (SELECT count(*) FROM work_items AS w WHERE w.work_document_id = t.id) AS work_item_count
    FROM (SELECT * FROM work_assignment_documents WHERE title ILIKE '%urgent%' AND status = 'F' ORDER BY id DESC LIMIT 20 OFFSET 20) AS t
    LEFT JOIN issuing_units AS i ON t.issuing_unit_id = i.id LEFT JOIN departments AS d ON t.department_id = d.id LEFT JOIN departments AS a ON t.assigned_department_id = a.id LEFT JOIN users AS u ON t.assigned_by_user_id = u.id""")
def q_list_work_documents(spark, sf_dir):
    tables = standins(spark, sf_dir, "work_assignment_documents", "issuing_units", "departments", "users", "work_items")
    rows = listing.page(tables, _WORK_DOCS, 2, 20, search="urgent", status="F")
    items = tables["work_items"].join(F.broadcast(rows.select(F.col("id").alias("_d"))), F.col("work_document_id") == F.col("_d"), "left_semi")  # a page
    rows = listing.child_counts(rows, items, "id", "work_document_id", "work_item_count")
    return rows.select("id", "document_code", "title", "status", "issuing_unit_name", "department_name", "assigned_department_name", "assigned_by_username", "work_item_count")


@query("q_count_work_documents", "SELECT count(*) AS total FROM work_assignment_documents WHERE (document_code ILIKE '%urgent%' OR title ILIKE '%urgent%') AND status = 'F'")
def q_count_work_documents(spark, sf_dir):
    return listing.total(standins(spark, sf_dir, "work_assignment_documents"), _WORK_DOCS, search="urgent", status="F")


@query("q_list_permission_groups", """
    SELECT g.id, g.name, g.code, l.function_id, l.can_create, f.name AS function_name
    FROM permission_groups AS g LEFT JOIN permission_group_functions AS l ON g.id = l.group_id LEFT JOIN system_functions AS f ON l.function_id = f.id WHERE g.name ILIKE '%a%'""")
def q_list_permission_groups(spark, sf_dir):
    tables = standins(spark, sf_dir, "permission_groups", "permission_group_functions", "system_functions")
    groups = listing.page(tables, LISTINGS["permission_groups"], size=100, search="a")
    links = tables["permission_group_functions"].join(tables["system_functions"].select(F.col("id").alias("_f"), F.col("name").alias("function_name")), F.col("function_id") == F.col("_f"), "left")
    nested = listing.nest_children(groups, links, "id", "group_id", ["function_id", "can_create", "function_name"], "functions")
    return nested.select("id", "name", "code", F.explode_outer("functions").alias("f")).select("id", "name", "code", "f.*")


@query("q_count_permission_groups", "SELECT count(*) AS total FROM permission_groups WHERE name ILIKE '%a%' OR code ILIKE '%a%'")
def q_count_permission_groups(spark, sf_dir):
    return listing.total(standins(spark, sf_dir, "permission_groups"), LISTINGS["permission_groups"], search="a")


@query("q_logs_export", """
    SELECT id, user_id, action, detail, ip_address, status_code,
           CASE WHEN date_part('microsecond', created_at) % 1000000 = 0 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%S') ELSE strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') END AS created_at
    FROM system_logs ORDER BY id DESC LIMIT 100000""")
def q_logs_export(spark, sf_dir):
    return export_logs(standin(spark, sf_dir, "system_logs"))


@query("q_log_elapsed", "SELECT action, count(*) AS requests, avg(CAST(json_extract_string(detail, '$.k') AS DOUBLE)) AS mean_elapsed_ms, max(CAST(json_extract_string(detail, '$.k') AS DOUBLE)) AS max_elapsed_ms FROM system_logs GROUP BY action")
def q_log_elapsed(spark, sf_dir):
    rows = standin(spark, sf_dir, "system_logs").withColumn("_e", F.from_json("detail", "k double")["k"])
    return rows.groupBy("action").agg(F.count("*").alias("requests"), F.avg("_e").alias("mean_elapsed_ms"), F.max("_e").alias("max_elapsed_ms"))


@query("q_request_log", """
    SELECT action, user_id % 5 AS who, count(*) AS requests, sum(round(value * 1000, 2)) AS total_ms, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS asked FROM (
        SELECT *, concat('GET /', event_type) AS action FROM events WHERE event_id % 10 <> 0 AND event_id % 17 <> 3) AS r GROUP BY ALL""")
def q_request_log(spark, sf_dir):
    """What the log says of requests that a stream wrote, one batch of it twice; a tenth is quiet, and a seventeenth can't be logged."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events*.parquet")

    def requests(rows):
        path = F.when(F.col("event_id") % 10 == 0, "/health").otherwise(F.concat(F.lit("/"), "event_type"))
        query_text = F.when(F.col("event_id") % 17 == 3, F.lit("{no")).otherwise(F.col("props"))
        return rows.select(F.col("event_id").alias("id"), F.lit("GET").alias("method"), path.alias("path"), query_text.alias("query"), F.col("user_id").cast("string").alias("subject"), F.lit("10.0.0.1").alias("ip_address"), F.lit(200).alias("status_code"), F.col("value").alias("elapsed"), F.col("ts").alias("at"))

    folder = scratch(spark, "requests")
    log = RequestLog(spark, folder)
    log.start(requests(stream), f"{folder}/checkpoint").awaitTermination()
    log.write(requests(events), 0)  # the first batch, which held all, comes again
    detail = F.from_json("detail", "query_params map<string,string>, elapsed_ms double")
    rows = log.logs().select("action", (F.col("user_id") % 5).alias("who"), detail.alias("d"))
    return rows.groupBy("action", "who").agg(F.count("*").alias("requests"), F.sum("d.elapsed_ms").alias("total_ms"), F.sum(F.col("d.query_params")["k"].cast("long")).alias("asked"))


@query("q_api_key_preview", "SELECT s_suppkey AS id, sha256(s_name) AS key_hash, concat(substr(sha256(s_name), 1, 8), '...') AS key_preview FROM supplier")
def q_api_key_preview(spark, sf_dir):
    rows = standin(spark, sf_dir, "api_keys").select("id", values.sha256_hex(F.col("name")).alias("key_hash"))
    return rows.withColumn("key_preview", values.key_preview(F.col("key_hash")))


@query("q_typed_config", """
    SELECT id, config_key, CASE WHEN lower(data_type) = 'int' THEN TRY_CAST(trim(config_value) AS BIGINT) END AS int_value,
           CASE WHEN lower(data_type) = 'bool' THEN lower(config_value) IN ('1', 'true', 'yes', 'on') END AS bool_value,
           CASE WHEN lower(data_type) NOT IN ('int', 'bool') THEN config_value END AS text_value FROM system_configs""")
def q_typed_config(spark, sf_dir):
    value, kind = F.col("config_value"), F.col("data_type")
    text = F.when(~F.lower(kind).isin("int", "bool"), value)
    return standin(spark, sf_dir, "system_configs").select("id", "config_key", values.typed_int(value, kind).alias("int_value"), values.typed_bool(value, kind).alias("bool_value"), text.alias("text_value"))


@query("q_system_status", "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM conversations) AS summaries")
def q_system_status(spark, sf_dir):
    return listing.status(users=table(spark, sf_dir, "customer"), documents=table(spark, sf_dir, "documents"), summaries=table(spark, sf_dir, "conversations"))


@query("q_snapshot_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS ordered_at, CAST(NULL AS BIGINT) AS not_there FROM orders")
def q_snapshot_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
    back = from_lines(to_lines(rows), "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, not_there long")
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ordered_at"), "not_there")
