"""Scans and listings of a database, with the embedded one whose driver Spark ships."""

import uuid

import pytest
from pyspark.sql import functions as F

from sheaf.operators.listing import LISTINGS, page, total
from sheaf.sources.database import Database

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"


@pytest.fixture(scope="module")
def office(spark):
    """Logs with clustered ids, one far away, one without an id; departments and units."""
    url = f"jdbc:derby:memory:office{uuid.uuid4().hex};create=true"
    logs = spark.range(3000).select(
        F.when(F.col("id") < 2800, F.col("id")).when(F.col("id") < 2999, F.col("id") * 1_000_000_007).otherwise(F.lit(None)).alias("id"),
        (F.col("id") % 7).alias("user_id"),
        F.concat(F.lit("Action "), (F.col("id") % 3).cast("string")).alias("action"),
        F.lit(200).cast("int").alias("status_code"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("created_at"),
    )
    departments = spark.range(50).select("id", F.concat(F.lit("d"), "id").alias("code"), F.concat(F.lit("Name "), "id").alias("name"), (F.col("id") % 4).alias("issuing_unit_id"), F.lit(None).cast("long").alias("parent_id"), (F.col("id") % 2 == 0).alias("is_active"))
    units = spark.range(3).select("id", F.concat(F.lit("Unit "), "id").alias("name"))
    for name, rows, types in (("system_logs", logs, "action VARCHAR(40)"), ("departments", departments, "code VARCHAR(9), name VARCHAR(40)"), ("issuing_units", units, "name VARCHAR(40)"), ("nothing", spark.range(0), "id BIGINT")):
        rows.coalesce(1).write.option("createTableColumnTypes", types).jdbc(url, f'"{name}"', properties={"driver": DRIVER})
    database = Database(url, DRIVER, "APP")
    database.attach(spark, "office")
    return database


def plan(rows):
    return rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")


def test_ranges_hold_alike_many_rows_whatever_the_ids(spark, office):
    ranges = office.ranges(spark, "system_logs", "id", 6)
    assert ranges[0][0] is None and ranges[-1][1] is None
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    rows = office.scan(spark, "system_logs", parts=6)
    sizes = [r.n for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    # 2,999 rows with ids; ranges of equal width would put 2,800 into one
    assert sum(sizes) == 3000 and len(sizes) <= 7 and max(sizes) <= 2 * 500
    assert rows.where("id is null").count() == 1
    assert rows.select("id").distinct().count() == 3000


@pytest.mark.parametrize("parts", [1, 2, 5000])
def test_scans_are_whole_for_any_number_of_parts(spark, office, parts):
    if parts == 5000:  # more ranges than rows: one for each row at most
        ranges = office.ranges(spark, "departments", "id", parts)
        assert len(ranges) == 50
    else:
        assert office.scan(spark, "departments", parts=parts).count() == 50
    assert office.scan(spark, "nothing", parts=parts).count() == 0


def test_filters_and_columns_of_a_scan_reach_the_database(spark, office):
    rows = office.scan(spark, "system_logs", parts=4).where("user_id = 3 and created_at >= timestamp_ntz'1970-01-01 00:10:00'").select("action")
    text = plan(rows)
    assert "EqualTo(user_id,3)" in text and "GreaterThanOrEqual(created_at" in text
    assert "ReadSchema: struct<action:string>" in text
    assert rows.count() == sum(1 for i in range(600, 3000) if i % 7 == 3)


def test_a_table_has_the_columns_and_types_of_its_schema(spark, office):
    rows = office.scan(spark, "system_logs", parts=2)
    assert rows.columns == ["id", "user_id", "action", "detail", "ip_address", "status_code", "created_at"]
    assert rows.schema["created_at"].dataType.simpleString() == "timestamp_ntz"
    assert rows.where("detail is not null").count() == 0


def test_a_page_and_a_count_are_the_databases_work(spark, office):
    tables = office.tables(spark, "office", "departments", "issuing_units")
    spec = LISTINGS["departments"]
    found = page(tables, spec, 2, 5, is_active=True)
    text = plan(found)
    assert "PushedFilters: [IS_ACTIVE" in text.upper() or "IS_ACTIVE = TRUE" in text.upper()
    assert [(r.id, r.issuing_unit_name) for r in found.orderBy(F.desc("id")).collect()] == [(i, f"Unit {i % 4}" if i % 4 < 3 else None) for i in (38, 36, 34, 32, 30)]
    counted = total(tables, spec, issuing_unit_id=1)
    assert "PushedAggregates: [COUNT(*)]" in plan(counted)
    assert counted.first().total == 13


def test_a_search_text_is_held_against_what_the_filters_left(spark, office):
    tables = office.tables(spark, "office", "departments", "issuing_units")
    found = page(tables, LISTINGS["departments"], search="NAME 4", issuing_unit_id=0)
    assert sorted(r.id for r in found.collect()) == [4, 40, 44, 48]
    assert "ISSUING_UNIT_ID = 0" in plan(found).upper()


def test_a_key_of_texts_is_refused(spark, office):
    with pytest.raises(Exception):
        office.ranges(spark, "departments", "code", 4)
