"""Login sessions over a stream: opens and closes in any order, with a timeout."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .sinks import BatchSink

#: What the stream brings: event is open or close, id that of the login row (of an open).
EVENTS = "session_id string, event string, id long, at timestamp_ntz"
#: What comes out: a row for each open, again when its close changes or its time is over. expired: no close came in time.
SESSIONS = "id long, session_id string, login_us long, logout_us long, expired boolean"
#: Groups of sessions by a hash of their id, each kept as one state and stepped at once; a checkpoint holds their number.
BUCKETS = 256
#: A group's sessions (session_id, logout, until) and opens (session_id, id, us) as Arrow tables.
_STATE = "sessions binary, opens binary"
#: In place of a logout that has not come.
_NONE = -(2**63)


def _packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _held(state: GroupState) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Sessions, indexed by session_id, and opens of a group."""
    if not state.exists:
        return pd.DataFrame({"logout": np.zeros(0, np.int64), "until": np.zeros(0, np.int64)}, index=pd.Index([], dtype=object, name="session_id")), pd.DataFrame({"session_id": pd.Series([], dtype=object), "id": np.zeros(0, np.int64), "us": np.zeros(0, np.int64)})
    known, opens = (pa.ipc.open_stream(bytes(x)).read_all().to_pandas() for x in state.get)
    return known.set_index("session_id"), opens


def _sessions(idle_ms: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, opens = _held(state)
        now, old = state.getCurrentWatermarkMs(), len(opens)

        def rows(of: pd.DataFrame, expired: bool) -> pd.DataFrame:
            ends = known["logout"].reindex(of["session_id"]).to_numpy()
            return pd.DataFrame({"id": of["id"].to_numpy(), "session_id": of["session_id"].to_numpy(), "login_us": of["us"].to_numpy(), "logout_us": pd.arrays.IntegerArray(ends.copy(), ends == _NONE), "expired": expired})

        touched = pd.Index([], dtype=object)
        if not state.hasTimedOut:
            events = pd.concat([b[["session_id", "event", "_id", "_us"]] for b in batches])
            latest = events.groupby("session_id")["_us"].max()
            touched = latest.index
            closes = events[events["event"] == "close"].groupby("session_id")["_us"].max()
            known = known.reindex(known.index.union(touched, sort=False)).fillna({"logout": _NONE, "until": 0}).astype("int64") if not touched.isin(known.index).all() else known.copy()
            before = known["logout"].loc[touched].copy()
            known.loc[closes.index, "logout"] = np.maximum(known["logout"].loc[closes.index], closes)
            known.loc[touched, "until"] = np.maximum(known["until"].loc[touched], np.maximum(now + 1, latest // 1000 + idle_ms))
            fresh = events[events["event"] == "open"].rename(columns={"_id": "id", "_us": "us"})[["session_id", "id", "us"]]
            opens = pd.concat([opens, fresh]).drop_duplicates(ignore_index=True)  # those that were there come first, once each
            moved = touched[(known["logout"].loc[touched] != before).to_numpy()]
            changed = opens["session_id"].isin(moved).to_numpy() | (np.arange(len(opens)) >= old)
            if changed.any():
                yield rows(opens[changed], False)
        over = known.index[(known["until"] < now).to_numpy()].difference(touched)
        if len(over):
            gone = opens["session_id"].isin(over)
            if len(late := opens[gone & (known["logout"].reindex(opens["session_id"]) == _NONE).to_numpy()]):
                yield rows(late, True)
            known, opens = known.drop(over), opens[~gone]
        if known.empty:
            state.remove()
            return
        state.update((_packed(known.reset_index()), _packed(opens)))
        state.setTimeoutTimestamp(max(now + 1, int(known["until"].min())))

    return step


def login_sessions(events: DataFrame, late: str = "1 hour", idle_ms: int = 12 * 3_600_000) -> DataFrame:
    """Changes of login rows (SESSIONS) from a stream of EVENTS.

    A close that comes before its open waits for it; of several the last counts; one of an unknown session goes when its time is
    over. A session is kept until the watermark, `late` behind the latest event, is idle_ms past its last event; opens without a close
    then come out once more as expired, and events that come for it later begin anew. Events without session_id, event or time,
    and opens without id, are passed over.

    Sessions are kept in BUCKETS groups, and a micro-batch writes the state of the groups that it touches: a call of Python for each session
    costs far more than its work. A checkpoint can't be read with another number of groups.
    """
    at = F.col("at").cast("timestamp")
    rows = events.where("session_id is not null and at is not null and (event = 'close' or event = 'open' and id is not null)")
    rows = rows.select("session_id", "event", F.coalesce("id", F.lit(-1)).alias("_id"), at.alias("_at"), F.unix_micros(at).alias("_us")).withWatermark("_at", late)
    return rows.withColumn("_bucket", F.pmod(F.hash("session_id"), F.lit(BUCKETS))).groupBy("_bucket").applyInPandasWithState(_sessions(idle_ms), SESSIONS, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def follow_sessions(events: DataFrame, sink: BatchSink, checkpoint: str, **settings: Any) -> StreamingQuery:
    """Keep a sink of SESSIONS up to date as far as the stream goes now."""
    return login_sessions(events, **settings).writeStream.outputMode("update").foreachBatch(lambda rows, number: sink.write(rows.groupBy("id", "session_id").agg(F.max_by(F.struct("login_us", "logout_us", "expired"), F.coalesce("logout_us", F.lit(-1))).alias("_r")).select("id", "session_id", "_r.*"), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def login_rows_of(sink: BatchSink) -> DataFrame:
    """The latest state of each login row: id, session_id, login_at, logout_at, expired."""
    stamp = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return sink.latest("id").select("id", "session_id", stamp("login_us").alias("login_at"), stamp("logout_us").alias("logout_at"), "expired")
