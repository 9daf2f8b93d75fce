import random
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest
from oracle import SMALL, assert_same, rows
from pyspark.sql import functions as F

from sheaf.llm import retention

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, city string, client string, _b int, segment string"
T0 = datetime(2024, 2, 1)


def test_op13_gives_what_sql_gives(spark):
    assert_same(spark, retention.op13_retention, retention.ORACLE["op13_retention"], SMALL)


def made(seed=5, n=900, hot=0.4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ts = T0 + timedelta(microseconds=rng.randrange(40 * 86_400_000_000))
        out.append((i if rng.random() > 0.03 else None, ts if rng.random() > 0.03 else None, ts + timedelta(days=rng.choice([0, 0, 1, 40])) if rng.random() > 0.05 else None, 7 if rng.random() < hot else rng.choice([None, *range(30)]), rng.choice(["purchase", "view", None]), rng.choice([None, 1.005, -2.5, float("nan"), float("inf"), 1e300, 7.0]), rng.choice([None, "{}", '{"a": 1}'])))
    return out + out[:100] + [out[0]] * 5


def run(spark, clicks, clients):
    """Rows of the query's SQL and of the operator on made tables."""
    con = duckdb.connect()
    con.execute("CREATE TABLE clicks (click_id BIGINT, ts TIMESTAMP, arrived_at TIMESTAMP, client_id BIGINT, kind VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO clicks VALUES (?, ?, ?, ?, ?, ?, ?)", clicks) if clicks else None
    con.execute("CREATE TABLE clients (client_id BIGINT, city VARCHAR)")
    con.executemany("INSERT INTO clients VALUES (?, ?)", [c[:2] for c in clients]) if clients else None
    con.execute(f"UPDATE clicks SET value = 0 WHERE NOT isfinite(value) OR abs(value) >= {retention.MOST}")
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.coalesce(F.when(h % 3 == 0, h % 100).otherwise(0).cast("int"), F.lit(0))
    found = retention.retention_matrix(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS), datetime(2024, 3, 1), late=late)
    return rows(con.sql(retention.ORACLE["op13_retention"]).df()), rows(found.toPandas())


HOMES = [(i, [None, "Aa", "Bb"][i % 3], "x", 1, "y") for i in range(20)] + [(7, "Zz", "x", 1, "y"), (None, "Q", "x", 1, "y")]


@pytest.mark.parametrize("share", [1, 3, 1024])
def test_hot_clients_nulls_and_repeated_rows(spark, monkeypatch, share):
    """share 1: no client is hot; 3: one is; 1024: nearly all are."""
    monkeypatch.setattr(retention, "HOT_SHARE", share)
    clicks = made()
    expected, found = run(spark, clicks, HOMES)
    assert found == expected and len(found[1]) > 20


def test_a_hot_client_is_dealt_over_all_buckets(spark, monkeypatch):
    monkeypatch.setattr(retention, "BUCKET_ROWS", 100)

    def sizes(*_):
        def counted(batches):
            from pyspark import TaskContext

            n = sum(len(b) for b in batches)
            yield pd.DataFrame([(TaskContext.get().partitionId(), "", 0, 0, None, n, 0, 0, 0)], columns=[c.split()[0] for c in retention.CELLS.split(", ")])

        return counted

    monkeypatch.setattr(retention, "spooled", sizes)
    clicks = spark.createDataFrame(made(hot=0.9), CLICKS)
    found = [r.users for r in retention.retention_matrix(clicks, spark.createDataFrame([], CLIENTS), datetime(2024, 3, 1)).collect()]
    assert len(found) == 10 and sum(found) > 900 and max(found) < 250  # the largest client alone has over 800


def test_empty_tables_and_extra_columns(spark):
    clicks = made(n=60)
    assert retention.retention_matrix(spark.createDataFrame([], CLICKS), spark.createDataFrame(HOMES, CLIENTS), datetime(2024, 3, 1)).count() == 0
    expected, found = run(spark, clicks, [])
    assert found == expected and found[1]
    extra = spark.createDataFrame(clicks, CLICKS).withColumns({"client": F.lit("z"), "hot": F.lit(1), "start0": F.lit(None).cast("long"), "_hot": F.lit(3)})
    again = retention.retention_matrix(extra, spark.createDataFrame([], CLIENTS), datetime(2024, 3, 1))
    plain = retention.retention_matrix(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame([], CLIENTS), datetime(2024, 3, 1))
    assert rows(again.toPandas()) == rows(plain.toPandas())


def test_micros_are_those_of_the_clock_in_any_zone(spark):
    times = [datetime(1969, 12, 31, 23, 59, 59, 999999), datetime(2024, 3, 31, 2, 30, 0, 1), None]
    rows_ = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz").select(retention.micros(F.col("t")).alias("m"))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        found = [r.m for r in rows_.collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert found == [-1, int((times[1] - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 + 1, retention.NONE]
