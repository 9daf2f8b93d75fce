from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sheaf.operators.integrity import close_sessions
from sheaf.streaming import requests, sessions, sinks

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes, microseconds=minutes)


def feed(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{number}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


BATCHES = [
    [("a", "open", 1, at(0)), ("b", "close", None, at(5)), ("a", "open", 1, at(0)), (None, "open", 9, at(1)), ("q", "open", None, at(1)), ("x", "open", 8, None)],
    [("b", "open", 2, at(1)), ("c", "open", 3, at(2)), ("zz", "close", None, at(2)), ("a", "close", None, at(9))],
    [("a", "close", None, at(7)), ("a", "close", None, at(11)), ("d", "open", 4, at(12)), ("d", "open", 5, at(13))],
    [("c", "close", None, at(14)), ("e", "open", 6, at(15))],
]


def expected(spark, batches):
    rows = spark.createDataFrame([r for b in batches for r in b if r[0] and r[3] and (r[1] == "close" or r[2])], sessions.EVENTS)
    opened = rows.where("event = 'open'").select("id", "session_id", F.col("at").alias("login_at")).distinct()
    return sorted(map(tuple, close_sessions(opened, rows.where("event = 'close'").select("session_id", F.col("at").alias("closed_at"))).collect()))


def run(spark, folder, sink, **settings):
    sessions.follow_sessions(stream(spark, folder, sessions.EVENTS), sink, f"{folder}/checkpoint", **settings).awaitTermination()
    return sorted((r.id, r.session_id, r.login_at, r.logout_at) for r in sessions.login_rows_of(sink).collect())


def test_sessions_in_any_order_and_over_restarts(spark, tmp_path):
    """Closes before their open, of unknown sessions and several of one; the stream ends and starts again after each batch."""
    sink = sinks.BatchSink(spark, str(tmp_path / "out"), "s", sessions.SESSIONS)
    for n, rows in enumerate(BATCHES):
        feed(spark, tmp_path, n, rows, sessions.EVENTS)
        assert run(spark, tmp_path, sink) == expected(spark, BATCHES[: n + 1])
    assert not any(r.expired for r in sessions.login_rows_of(sink).collect())


def test_sessions_run_out(spark, tmp_path):
    sink = sinks.BatchSink(spark, str(tmp_path / "out"), "s", sessions.SESSIONS)
    minute = 60_000
    for n, rows in enumerate([[("a", "open", 1, at(0)), ("b", "open", 2, at(0)), ("b", "close", None, at(1))], [("c", "open", 3, at(500))], [("d", "open", 4, at(501))]]):
        feed(spark, tmp_path, n, rows, sessions.EVENTS)
        run(spark, tmp_path, sink, late="1 minute", idle_ms=30 * minute)
    found = {r.id: (r.logout_at, r.expired) for r in sessions.login_rows_of(sink).collect()}
    assert found == {1: (None, True), 2: (at(1), False), 3: (None, False), 4: (None, False)}


def request(i, path="/x", **more):
    base = {"id": i, "method": "GET", "path": path, "query": None, "subject": "5", "ip_address": "10.0.0.1", "status_code": 200, "elapsed": 0.0123456, "at": at(i or 0)}
    return tuple((base | more).values())


def test_each_request_is_logged_once(spark, tmp_path):
    folder, log = str(tmp_path), requests.RequestLog(spark, str(tmp_path / "log"))
    feed(spark, folder, 0, [request(1), request(2, "/health"), request(3, query='{"a": "ü"}'), request(4, subject="x1")], requests.REQUESTS)
    log.start(stream(spark, folder, requests.REQUESTS), f"{folder}/checkpoint").awaitTermination()
    feed(spark, folder, 1, [request(5, query="{}"), request(6, query="[oops"), request(None), request(7, None), request(8, elapsed=None), request(9, "/docs", query="[oops")], requests.REQUESTS)
    for _ in range(2):
        log.start(stream(spark, folder, requests.REQUESTS), f"{folder}/checkpoint").awaitTermination()
    found = {r.id: (r.user_id, r.action, r.detail, r.created_at) for r in log.logs().collect()}
    assert found[1] == (5, "GET /x", '{"query_params":null,"elapsed_ms":12.35}', at(1))
    assert found[3][2] == '{"query_params":{"a":"ü"},"elapsed_ms":12.35}' and found[4][0] is None
    assert set(found) == {1, 3, 4, 5} and log.logs().count() == 4
    assert sorted((r.id or 0, r.reason) for r in log.failed.read().collect()) == [(0, "no id"), (6, "query is no JSON object"), (7, "no action"), (8, "no time")]


def test_a_replayed_batch_adds_nothing_and_a_partial_one_is_not_read(spark, tmp_path):
    log = requests.RequestLog(spark, str(tmp_path))
    rows = spark.createDataFrame([request(1), request(2)], requests.REQUESTS)
    assert log.logs().count() == 0
    log.write(rows, 0)
    log.write(rows, 0)
    log.write(rows.withColumn("id", F.col("id") + 10), 1)
    assert sorted(r.id for r in log.logs().collect()) == [1, 2, 11, 12]
    (tmp_path / "rows" / "stream=requests" / "batch=1" / "_SUCCESS").unlink()
    assert sorted(r.id for r in log.logs().collect()) == [1, 2] and log.rows.batches() == [0]
    broken = rows.withColumn("elapsed", F.when(F.col("id") == 2, F.raise_error(F.lit("down")).cast("double")).otherwise(F.col("elapsed")))
    with pytest.raises(Exception, match="down"):
        log.write(broken, 2)
    assert log.logs().count() == 2


def test_sessions_are_kept_in_a_bounded_number_of_groups(spark, tmp_path):
    """Python is called for each group, not for each session."""
    rows = [(f"s{i}", e, i if e == "open" else None, at(i % 50 + (e == "close"))) for i in range(1, sessions.BUCKETS * 4) for e in ("open", "close")[: 1 + i % 2]]
    sink = sinks.BatchSink(spark, str(tmp_path / "out"), "s", sessions.SESSIONS)
    feed(spark, tmp_path, 0, rows, sessions.EVENTS)
    followed = sessions.follow_sessions(stream(spark, tmp_path, sessions.EVENTS), sink, f"{tmp_path}/checkpoint")
    followed.awaitTermination()
    assert sorted((r.id, r.session_id, r.login_at, r.logout_at) for r in sessions.login_rows_of(sink).collect()) == expected(spark, [rows])
    assert 0 < max(o["numRowsTotal"] for p in followed.recentProgress for o in p["stateOperators"]) <= sessions.BUCKETS
