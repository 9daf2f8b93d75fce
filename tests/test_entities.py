import hashlib

import pytest
from pyspark.sql import functions as F

from sheaf.operators import entities, mutate
from sheaf.sources.schemas import schema


def now():
    return F.expr("TIMESTAMP_NTZ'2026-01-02 03:04:05'")


@pytest.fixture
def tables(spark):
    names = [*entities.ENTITIES, "permission_group_functions"]
    return {n: spark.createDataFrame([], schema(n)) for n in names}


def filled(spark, tables, name, rows):
    return tables | {name: spark.createDataFrame([{f.name: r.get(f.name) for f in schema(name)} for r in rows], schema(name))}


def reasons(refused):
    return sorted((r.id, r.reason) for r in refused.select("id", "reason").collect())


def test_rules_name_columns_that_are_there(spark):
    for name, e in entities.ENTITIES.items():
        own = set(schema(name).names)
        assert own >= {*e.unique, *(c for c, _ in e.refs), *e.defaults, *e.clears, *([e.actor] if e.actor else [])}
        assert all(c in schema(t).names for t, c in e.guards + e.children)


def test_new_rows_take_defaults(spark, tables):
    tables = filled(spark, tables, "departments", [{"id": 1, "code": "D"}])
    out, refused = entities.create(tables, "work_items", spark.createDataFrame([(1, "a", None, 1), (2, "b", "high", 9)], "id long, title string, priority string, department_id long"), now())
    assert [(r.id, r.priority, r.status, str(r.created_at)) for r in out["work_items"].collect()] == [(1, "normal", "pending", "2026-01-02 03:04:05")]
    assert reasons(refused) == [(2, "404 department_id")]
    out, _ = entities.create(tables, "api_keys", spark.createDataFrame([(5, "k", "secret")], "id long, name string, raw_key string"), now(), actor=3)
    [row] = out["api_keys"].collect()
    assert (row.key_hash, row.created_by, row.is_active) == (hashlib.sha256(b"secret").hexdigest(), 3, True)


def test_users(spark, tables):
    tables = filled(spark, filled(spark, tables, "departments", [{"id": 1}, {"id": 2}]), "positions", [{"id": 7, "department_id": 1}, {"id": 8}])
    new = spark.createDataFrame([(1, "ann", "a@x", 1, 7), (2, "bob", "a@x", 1, 8), (3, "cy", None, 2, 7), (4, "di", None, None, 7), (5, "ed", None, 9, None)], "id long, username string, email string, department_id long, position_id long")
    out, refused = entities.create(tables, "users", new, now())
    assert sorted((r.id, r.role, r.auth_source) for r in out["users"].collect()) == [(1, "user", "local"), (4, "user", "local")]
    assert reasons(refused) == [(2, "409 email"), (3, "400 position_id"), (5, "404 department_id")]
    moved = spark.createDataFrame([(1, None, 2), (4, "d@x", 1)], "id long, email string, department_id long")
    out, refused = entities.change(out, "users", moved, now())
    assert sorted((r.id, r.email, r.department_id) for r in out["users"].collect()) == [(1, "a@x", 1), (4, "d@x", 1)]
    assert reasons(refused) == [(1, "400 position_id")]
    out, _ = entities.change(out, "users", spark.createDataFrame([(4, None)], "id long, email string"), now())
    assert {r.id: r.email for r in out["users"].collect()} == {1: "a@x", 4: None}
    with pytest.raises(ValueError):
        entities.remove(out, "users", new.select("id"))


def test_changes_are_stamped(spark, tables):
    tables = filled(spark, tables, "system_configs", [{"id": 1, "config_key": "A", "updated_by": 1}, {"id": 2, "config_key": "B", "updated_by": 1}])
    out, refused = entities.change(tables, "system_configs", spark.createDataFrame([(1, "B"), (2, "C")], "id long, config_key string"), now(), actor=9)
    assert sorted((r.id, r.config_key, r.updated_by, r.updated_at is None) for r in out["system_configs"].collect()) == [(1, "A", 1, True), (2, "C", 9, False)]
    assert reasons(refused) == [(1, "409 config_key")]


def test_own_parent_and_guards(spark, tables):
    tables = filled(spark, tables, "issuing_units", [{"id": 1, "code": "A"}, {"id": 2, "code": "B", "parent_id": 1}])
    _, refused = entities.change(tables, "issuing_units", spark.createDataFrame([(1, 1), (2, 5)], "id long, parent_id long"), now())
    assert reasons(refused) == [(1, "400 parent_id"), (2, "404 parent_id")]
    out, refused = entities.remove(tables, "issuing_units", spark.createDataFrame([(1,), (2,), (3,)], "id long"))
    assert [r.id for r in out["issuing_units"].collect()] == [1]
    assert reasons(refused) == [(1, "400 in use"), (3, "404 id")]


def test_items_go_with_their_document(spark, tables):
    tables = filled(spark, filled(spark, tables, "work_assignment_documents", [{"id": 1}, {"id": 2}]), "work_items", [{"id": 1, "work_document_id": 1}, {"id": 2, "work_document_id": 2}])
    out, refused = entities.remove(tables, "work_assignment_documents", spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in out["work_items"].collect()] == [2]
    assert reasons(refused) == []


def test_permissions_of_a_group(spark, tables):
    tables = filled(spark, filled(spark, tables, "system_functions", [{"id": 1}]), "permission_group_functions", [{"id": 1, "group_id": 1, "function_id": 1}, {"id": 2, "group_id": 2, "function_id": 1}])
    out, refused = entities.set_permissions(tables, spark.createDataFrame([(1, 1, True), (2, 5, None)], "group_id long, function_id long, can_create boolean"))
    found = sorted((r.group_id, r.can_view, r.can_create, r.can_delete) for r in out["permission_group_functions"].collect())
    assert found == [(1, True, True, False), (2, None, None, None)]
    assert [tuple(r) for r in refused.collect()] == [(2, "404 function_id")]


def test_login_rows(spark):
    attempts = spark.createDataFrame([(1, "a", None, "s", None), (2, "b", "sso", "t", "inactive")], "user_id long, username string, login_type string, session_id string, reason string")
    rows = entities.login_rows(attempts.withColumn("at", now()).withColumn("ip_address", F.lit("::1"))).collect()
    assert [(r.user_id, r.login_type, r.status, r.detail) for r in rows] == [(1, "local", "success", None), (None, "sso", "failed", "inactive")]


def units(spark, rows):
    return spark.createDataFrame(rows, "id long, code string, name string, parent_id long")


def test_reasons_come_in_order_and_twins_are_refused(spark):
    """Key, then taken values, then references; refused changes hold no value; values are compared as the tables' collation does."""
    table = units(spark, [(1, "Aé", "x", None), (2, "B", "y", 1)])
    rules = mutate.Rules(unique=("code",), refs=(("parent_id", table, "id"),), parent="parent_id")
    new = units(spark, [(None, "q", "n", None), (None, "r", "n", None), (1, "z", "n", None), (3, "aE ", "n", 99), (4, "new", "n", 99), (5, "NEW", "n", 1), (6, "new ", "n", None), (7, "néw", "n", 99), (8, None, "n", None), (9, None, "n", 99)])
    out, refused = mutate.insert(table, new, rules)
    assert sorted((r.id or 0, r.reason) for r in refused.collect()) == [(0, "400 id"), (0, "400 id"), (1, "409 id"), (3, "409 code"), (4, "404 parent_id"), (6, "409 code"), (7, "409 code"), (9, "404 parent_id")]
    assert sorted(r.id for r in out.collect()) == [1, 2, 5, 8]
    changes = units(spark, [(1, "b", None, 1), (2, "b ", None, 2), (50, "k", None, None)])
    refused = {r.id: r.reason for r in mutate.update(table, changes, rules)[1].collect()}
    assert refused == {1: "409 code", 2: "400 parent_id", 50: "404 id"}


def test_parents_are_judged_after_earlier_references(spark):
    table = spark.createDataFrame([(1, "a", 1, None)], "id long, code string, unit_id long, parent_id long")
    rules = mutate.Rules(refs=(("unit_id", spark.range(1, 2).toDF("id"), "id"), ("parent_id", table, "id")), parent="parent_id")
    changes = spark.createDataFrame([(1, None, 9, 1)], table.schema)
    assert [r.reason for r in mutate.update(table, changes, rules)[1].collect()] == ["404 unit_id"]


def test_children_of_none_and_of_others_stay(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id long, document_code string")
    items = spark.createDataFrame([(1, 1), (2, 2), (3, None), (4, 77)], "id long, work_document_id long")
    tables, refused = entities.remove({"work_assignment_documents": docs, "work_items": items}, "work_assignment_documents", spark.range(1, 2).toDF("id"))
    assert sorted(r.id for r in tables["work_items"].collect()) == [2, 3, 4] and refused.count() == 0


def test_plans_do_not_double_with_unique_columns(spark, tmp_path):
    """One scan of the changes for all unique columns, one of the claims for all ways to a user."""
    from sheaf.operators.integrity import resolve_identities

    spark.range(5).selectExpr("id", "'a' AS a", "'b' AS b", "'c' AS c").write.parquet(str(tmp_path / "changes"))
    spark.range(5).selectExpr("id + 9 AS id", "'x' AS a", "'y' AS b", "'z' AS c").write.parquet(str(tmp_path / "rows"))
    changes, rows = spark.read.parquet(str(tmp_path / "changes")), spark.read.parquet(str(tmp_path / "rows"))
    _, refused = mutate.insert(rows, changes, mutate.Rules(unique=("a", "b", "c")))
    plan = refused._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 + 1 + 3  # the changes, the table's keys, and its values of each column
    claims = changes.selectExpr("id AS claim_id", "a AS sso_subject", "b AS username", "c AS email")
    people = rows.selectExpr("id AS user_id", "a AS sso_subject", "b AS username", "c AS email")
    plan = resolve_identities(claims, people)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 + 3


def test_children_of_none_are_not_dealt_by_their_null(spark):
    """They would all go to one task."""
    children = spark.range(0, 400, 1, 4).select("id", F.expr("CASE WHEN id % 10 = 0 THEN id END").alias("p"))
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    left = mutate.without_children(children, spark.range(0, 200, 20), "p")
    assert sorted(r.id for r in left.collect()) == [i for i in range(400) if not (i % 20 == 0 and i < 200)]
    assert plan(left).startswith("Union")  # those of none pass by the join
