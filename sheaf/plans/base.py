"""Registering queries, and the back office's tables as views over the standard tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.versions import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: What stands in for each table of the back office; {name} is a standard table.
STANDINS = {
    "users": """SELECT c_custkey AS id, c_name AS username,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('u', CAST(c_custkey % 500 AS STRING), '@', lower(c_mktsegment), '.org') END AS email,
        CASE WHEN c_custkey % 3 = 0 THEN concat('sub-', CAST(c_custkey AS STRING)) END AS sso_subject,
        CAST(c_nationkey % 5 AS BIGINT) AS permission_group_id, CAST(c_nationkey AS BIGINT) AS department_id,
        CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 10 + 1 END AS position_id, c_acctbal >= 0 AS is_active FROM {customer}""",
    "system_logs": """SELECT event_id AS id, user_id, event_type AS action, props AS detail, concat('10.0.0.', CAST(event_id % 256 AS STRING)) AS ip_address,
        CAST(200 + event_id % 3 * 100 AS INT) AS status_code, ts AS created_at FROM {events}""",
    "login_history": """SELECT event_id AS id, user_id, concat('user', CAST(user_id AS STRING)) AS username_snapshot,
        CASE WHEN event_id % 2 = 0 THEN 'local' ELSE 'sso' END AS login_type, concat('s', CAST(event_id AS STRING)) AS session_id, ts AS login_at,
        CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM {events}""",
    "system_configs": """SELECT p_partkey AS id, p_name AS config_key, p_type AS description, p_brand AS category,
        CASE p_partkey % 3 WHEN 0 THEN 'int' WHEN 1 THEN 'BOOL' ELSE 'string' END AS data_type,
        CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) WHEN 1 THEN CASE p_partkey % 4 WHEN 0 THEN 'ON' WHEN 1 THEN 'yes' WHEN 2 THEN '0' ELSE 'False' END ELSE p_name END AS config_value FROM {part}""",
    "api_keys": "SELECT s_suppkey AS id, s_name AS name, concat('key of ', s_name) AS description, CAST(s_nationkey + 1 AS BIGINT) AS created_by FROM {supplier}",
    "permission_groups": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, concat('G', CAST(r_regionkey AS STRING)) AS code FROM {region}",
    "permission_group_functions": "SELECT CAST(n_regionkey AS BIGINT) AS group_id, CAST(n_nationkey AS BIGINT) AS function_id, n_nationkey % 2 = 0 AS can_create FROM {nation}",
    "system_functions": "SELECT p_partkey AS id, p_name AS name, p_brand AS code, p_type AS module FROM {part}",
    "issuing_units": """SELECT CAST(r_regionkey AS BIGINT) AS id, concat('U', CAST(r_regionkey AS STRING)) AS code, r_name AS name, substr(r_name, 1, 3) AS short_name,
        CASE WHEN r_regionkey > 0 THEN CAST(r_regionkey - 1 AS BIGINT) END AS parent_id, r_regionkey % 2 = 0 AS is_active FROM {region}""",
    "departments": """SELECT CAST(n_nationkey AS BIGINT) AS id, concat('D', CAST(n_nationkey AS STRING)) AS code, n_name AS name, CAST(n_regionkey AS BIGINT) AS issuing_unit_id,
        CASE WHEN n_nationkey >= 5 THEN CAST(n_nationkey % 5 AS BIGINT) END AS parent_id, n_nationkey % 4 <> 1 AS is_active FROM {nation}""",
    "positions": "SELECT s_suppkey AS id, concat('P', CAST(s_suppkey AS STRING)) AS code, s_name AS name, CAST(s_nationkey AS BIGINT) AS department_id, s_acctbal >= 0 AS is_active FROM {supplier}",
    "work_assignment_documents": """SELECT o_orderkey AS id, concat('W', CAST(o_orderkey AS STRING)) AS document_code, concat(o_orderpriority, ' ', CAST(o_orderkey AS STRING)) AS title,
        o_orderstatus AS status, o_custkey % 5 AS issuing_unit_id, o_custkey % 25 AS department_id, o_orderkey % 25 AS assigned_department_id, o_custkey AS assigned_by_user_id FROM {orders}""",
    "work_items": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS work_document_id, concat(l_returnflag, l_linestatus) AS title, l_linestatus AS description, l_returnflag AS status,
        l_suppkey AS assignee_user_id, l_partkey % 25 AS department_id, l_suppkey AS position_id, l_partkey AS part_id FROM {lineitem}""",
    "notice_documents": """SELECT o_orderkey AS id, concat('N', CAST(o_orderkey AS STRING)) AS notice_code, o_orderpriority AS title, o_orderstatus AS status,
        o_custkey % 5 AS issuing_unit_id, o_custkey % 25 AS department_id, o_custkey AS posted_by_user_id FROM {orders}""",
}


def query(name: str, sql: str | None = None):
    """Register a query; in its SQL, names of STANDINS become views."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    used = [n for n in STANDINS if re.search(rf"\b(FROM|JOIN)\s+{n}\b", sql)]
    views = [f"{n} AS ({re.sub(r'[{}]', '', STANDINS[n])})" for n in used]
    if not views:
        return sql
    body = sql.strip()
    if body.upper().startswith("WITH"):
        return f"WITH {', '.join(views)}, {body[4:]}"
    return f"WITH {', '.join(views)} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = set(re.findall(r"{(\w+)}", STANDINS[name]))
    return spark.sql(STANDINS[name], **{t: table(spark, sf_dir, t) for t in used})


def standins(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: standin(spark, sf_dir, n) for n in names}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the one that all executors share; only in local mode, where none is set, a temporary one."""
    root = shared_dir(spark)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sheaf-scratch-")
        atexit.register(shutil.rmtree, root, True)
    return f"{root}/{label}-{uuid.uuid4().hex}"
