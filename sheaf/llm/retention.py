"""Cohort retention by embedded engine shards.

Rows are dealt to buckets by a hash of their client, each bucket is spooled to a file of an embedded SQL engine in the task that
got it, one statement is run there with spill to disk, and the additive cells of all buckets are summed in Spark. A client with over
1 / HOT_SHARE of all rows (there are HOT_SHARE of them at most) is dealt over all buckets by a hash of the whole row, so equal rows
still meet; its start is found by aggregation beforehand, and its share of a cell goes back under its own name.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC32_SQL, crc32_sql, discard, parts, read_table, write_table

#: A client with more than one row in so many of all is dealt over all buckets.
HOT_SHARE = 1024
#: Rows of a bucket on average, rows that go to the engine's file at once, and the engine's memory, beyond which it spills.
BUCKET_ROWS = 500_000
SPOOLED = 50_000
ENGINE_MEMORY = "256MB"
#: Stands for a time that is not there.
NONE = -(1 << 63)
#: Values of which a hundredfold is no exact number of cents count as nothing, as do those that are not finite.
MOST = 9e13
#: Microseconds of a day.
DAY = 86_400_000_000

ROWS = "client string, click string, ts long, arrived long, kind string, value double, rest string, known boolean, crc long, hot boolean, start0 long, start1 long, city string"
CELLS = "state int, segment string, cohort long, period long, client string, users long, users_crc32 long, moved long, cents long"
#: {width}: microseconds of a period. Rows without a click hold a client's city.
SHARD_SQL = """
    WITH seen AS (SELECT DISTINCT client, click, ts, arrived, kind, value, rest, known FROM bucket WHERE click_row),
    facts AS (SELECT client, bool_or(hot) FILTER (click_row) AS hot, max(crc) FILTER (click_row) AS crc, max(city) AS segment,
        CASE WHEN bool_or(hot) FILTER (click_row) THEN max(start0) FILTER (click_row) ELSE coalesce(min(ts) FILTER (click_row AND starting AND known), {none}) END AS s0,
        CASE WHEN bool_or(hot) FILTER (click_row) THEN max(start1) FILTER (click_row) ELSE coalesce(min(ts) FILTER (click_row AND starting), {none}) END AS s1
        FROM bucket GROUP BY client),
    starts AS (SELECT *, CASE WHEN s0 <> {none} THEN (s0 - ((s0 % {width}) + {width}) % {width}) // {width} END AS c0,
        (s1 - ((s1 % {width}) + {width}) % {width}) // {width} AS c1 FROM facts WHERE s1 <> {none}),
    states AS (SELECT 0 AS state, client, hot, crc, segment, s0 AS start, c0 AS cohort, c0 <> c1 AS moved FROM starts WHERE s0 <> {none}
        UNION ALL SELECT 1, client, hot, crc, segment, s1, c1, coalesce(c0 <> c1, false) FROM starts),
    own AS (SELECT state, client, any_value(hot) AS hot, any_value(crc) AS crc, any_value(segment) AS segment, any_value(cohort) AS cohort, any_value(moved) AS moved, (ts - start) // {width} AS period,
        sum(CASE WHEN isfinite(value) AND abs(value) < {most} THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END) AS cents
        FROM states JOIN seen USING (client) WHERE ts >= start AND (state = 1 OR known) GROUP BY state, client, period)
    SELECT CAST(state AS INTEGER) AS state, coalesce(segment, '') AS segment, cohort, period, CASE WHEN hot THEN client END AS client, count(*) AS users,
        CAST(sum(crc) AS BIGINT) AS users_crc32, CAST(sum(CAST(moved AS BIGINT)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents FROM own GROUP BY ALL"""


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone; NONE for null."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    found = day * F.lit(DAY) + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return F.coalesce(found, F.lit(NONE))


def spooled(width_days: int, purchase: str):
    """A function for mapInPandas: a bucket's rows go to a file of the engine, piece by piece; its cells come back."""
    sql = SHARD_SQL.format(width=width_days * DAY, none=NONE, most=MOST)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import duckdb

        with tempfile.TemporaryDirectory(prefix="sheaf-bucket-") as folder:
            con = duckdb.connect(f"{folder}/bucket.db", config={"threads": 1, "memory_limit": ENGINE_MEMORY, "temp_directory": f"{folder}/spill", "preserve_insertion_order": False})
            try:
                con.execute("CREATE TABLE bucket (client VARCHAR, click VARCHAR, ts BIGINT, arrived BIGINT, kind VARCHAR, value DOUBLE, rest VARCHAR, known BOOLEAN, crc BIGINT, hot BOOLEAN, start0 BIGINT, start1 BIGINT, city VARCHAR, click_row BOOLEAN, starting BOOLEAN)")
                held: list[pd.DataFrame] = []
                rows = 0

                def store() -> None:
                    piece = pd.concat(held, ignore_index=True)  # noqa: F841  the engine reads it by its name
                    con.execute(f"INSERT INTO bucket SELECT *, ts <> {NONE}, coalesce(kind = ?, false) FROM piece", [purchase])
                    held.clear()

                for batch in batches:
                    held.append(batch)
                    rows += len(batch)
                    if rows >= SPOOLED:
                        store()
                        rows = 0
                if held:
                    store()
                found = con.execute(sql)
                while len(piece := found.fetch_df_chunk(16)):
                    yield piece
            finally:
                con.close()

    return run


def retention_matrix(clicks: DataFrame, clients: DataFrame, cutoff: datetime, width_days: int = 3, purchase: str = "purchase", late: Column | None = None) -> DataFrame:
    """Cells (state, segment, cohort, period, users, users_crc32, moved, cents) of clicks as known before `cutoff` (0) and in the end (1).

    Rows alike in all columns count once, extra ones included; rows without ts or client_id are passed over. A click is known from arrived_at, or `late`
    days after it; one without arrived_at only in the end. A null click_id is a value like any other. A client's start is its earliest
    known `purchase`; its known clicks from then on count, by periods of width_days from it. Cohorts are spans of width_days since 1970.
    segment: the client's city, of several rows the last by its letters, '' where there is none. cents: of values that are null, not
    finite or over MOST none. Empty tables give no cells; extra columns of clients are passed over.
    """
    spark = clicks.sparkSession
    own = ("click_id", "ts", "arrived_at", "client_id", "kind", "value")
    others = [c for c in clicks.columns if c not in own]
    rest = F.col(others[0]).cast("string") if len(others) == 1 else F.to_json(F.struct(*others)) if others else F.lit(None).cast("string")
    stamp = F.col("arrived_at").cast("timestamp_ntz")
    arrives = stamp if late is None else stamp + F.make_dt_interval(late)
    rows = clicks.where("ts is not null and client_id is not null").select(
        F.col("client_id").cast("string").alias("client"), F.col("click_id").cast("string").alias("click"), F.col("ts").cast("timestamp_ntz").alias("ts"), stamp.alias("arrived"), "kind",
        F.col("value").cast("double").alias("value"), rest.alias("rest"), F.coalesce(arrives < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False)).alias("known"))

    # counts and starts of all clients are written; only those of hot ones are sent to tasks
    begun = F.col("kind") == purchase
    counted = rows.groupBy("client").agg(F.count("*").alias("n"), F.min(F.when(begun & F.col("known"), F.col("ts"))).alias("start0"), F.min(F.when(begun, F.col("ts"))).alias("start1"))
    profile = write_table(counted, "retention-clients")
    total = profile.agg(F.sum("n")).first()[0] or 0
    hot = write_table(profile.where(F.col("n") * HOT_SHARE > total).select(F.col("client").alias("_hot"), micros(F.col("start0")).alias("start0"), micros(F.col("start1")).alias("start1")), "retention-hot")
    cities = clients.where("client_id is not null").select(F.col("client_id").cast("string").alias("client"), F.col("city").cast("string").alias("city")).groupBy("client").agg(F.max("city").alias("city"))
    told = write_table(hot.join(cities.join(F.broadcast(hot.select("_hot")), F.col("client") == F.col("_hot"), "left_semi"), F.col("_hot") == F.col("client"), "left").drop("client"), "retention-told")  # HOT_SHARE rows at most

    n = max(parts(spark), -(-total // BUCKET_ROWS))
    marked = rows.join(F.broadcast(told), F.col("client") == F.col("_hot"), "left")  # HOT_SHARE rows at most
    one = F.xxhash64("client")
    bucket = F.when(F.col("_hot").isNotNull(), F.xxhash64("client", "click", "ts", "arrived", "kind", "value", "rest")).otherwise(one)
    dealt = marked.select(
        "client", "click", micros(F.col("ts")).alias("ts"), micros(F.col("arrived")).alias("arrived"), "kind", "value", "rest", "known", F.crc32(F.col("client").cast("binary")).alias("crc"),
        F.col("_hot").isNotNull().alias("hot"), F.coalesce("start0", F.lit(NONE)).alias("start0"), F.coalesce("start1", F.lit(NONE)).alias("start1"), "city", F.pmod(bucket, F.lit(n)).cast("int").alias("_b"))
    blank = {"ts": F.lit(NONE), "arrived": F.lit(NONE), "known": F.lit(False), "crc": F.lit(0).cast("long"), "hot": F.lit(False), "start0": F.lit(NONE), "start1": F.lit(NONE), "_b": F.pmod(one, F.lit(n)).cast("int")}
    homes = cities.select("client", *[(blank.get(f.name, F.lit(None)) if f.name != "city" else F.col("city")).cast(f.dataType).alias(f.name) for f in dealt.schema if f.name != "client"])
    cells = dealt.unionByName(homes).repartitionById(n, "_b").drop("_b").mapInPandas(spooled(width_days, purchase), CELLS)

    # a hot client has parts of a cell in many buckets: it is one user there, whose cents are summed
    key = ["state", "segment", "cohort", "period"]
    alone = F.col("client").isNotNull()
    whole = cells.groupBy(*key, "client").agg(*[F.sum(c).alias(f"_s_{c}") for c in ("users", "users_crc32", "moved", "cents")], *[F.max(c).alias(f"_m_{c}") for c in ("users", "users_crc32", "moved")])
    whole = whole.select(*key, *[F.when(alone, F.col(f"_m_{c}")).otherwise(F.col(f"_s_{c}")).alias(c) for c in ("users", "users_crc32", "moved")], F.col("_s_cents").alias("cents"))
    discard(profile)
    discard(hot)
    return whole.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("users", "users_crc32", "moved", "cents")])


def op13_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    late = F.when(h % 3 == 0, h % 100).otherwise(0).cast("int")
    return retention_matrix(read_table(spark, sf_dir, "clicks"), read_table(spark, sf_dir, "clients"), datetime(2024, 3, 1), late=F.coalesce(late, F.lit(0)))


ORACLE = {
    "op13_retention": f"""
        WITH {CRC32_SQL},
        seen AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
        late AS (SELECT *, {crc32_sql("click_id")} AS h FROM seen, crc),
        known AS (SELECT * EXCLUDE (h, t), coalesce(arrived_at + to_days(CAST(CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END AS INTEGER)) < TIMESTAMP '2024-03-01', false) AS early FROM late),
        views AS (SELECT 0 AS state, * FROM known WHERE early UNION ALL SELECT 1, * FROM known),
        starts AS (SELECT state, client_id, min(ts) AS start, CAST(floor((epoch_us(min(ts)) // 86400000000) / 3) AS BIGINT) AS cohort FROM views WHERE kind = 'purchase' GROUP BY ALL),
        people AS (SELECT s.*, coalesce(o.cohort <> s.cohort, false) AS moved FROM starts AS s LEFT JOIN starts AS o ON s.client_id = o.client_id AND s.state <> o.state),
        homes AS (SELECT client_id, max(city) AS city FROM clients GROUP BY client_id),
        own AS (SELECT p.state, p.client_id, cohort, moved, (epoch_us(ts) - epoch_us(start)) // 259200000000 AS period, sum(coalesce(floor(100 * value + 0.5), 0)) AS cents
            FROM people AS p JOIN views AS b ON p.state = b.state AND p.client_id = b.client_id AND b.ts >= p.start GROUP BY ALL)
        SELECT state, coalesce(city, '') AS segment, cohort, period, count(*) AS users, CAST(sum({crc32_sql("o.client_id")}) AS BIGINT) AS users_crc32,
            CAST(sum(CAST(moved AS INTEGER)) AS BIGINT) AS moved, CAST(sum(cents) AS BIGINT) AS cents
        FROM own AS o LEFT JOIN homes AS h ON o.client_id = h.client_id, crc GROUP BY ALL
    """
}
QUERIES = {"op13_retention": op13_retention}
