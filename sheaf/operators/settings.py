"""Settings from configuration rows, and rows of the request log."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_setting, typed_bool, typed_int


def settings(configs: DataFrame, defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults with the values of active rows whose key names a setting; at most one row a setting is read."""
    value, kind = F.col("config_value"), F.col("data_type")
    rows = configs.where(is_setting(F.col("config_key")) & F.coalesce("is_active", F.lit(True)))
    rows = rows.select(F.upper("config_key").alias("k"), F.lower(kind).alias("t"), typed_int(value, kind).alias("i"), typed_bool(value, kind).alias("b"), value.alias("s"), "id")
    latest = rows.groupBy("k").agg(F.max_by(F.struct("t", "i", "b", "s"), "id").alias("v")).select("k", "v.*")
    found = {r.k: r.i if r.t == "int" else r.b if r.t == "bool" else r.s for r in latest.collect()}
    return defaults | found


#: The settings that may change while the service runs.
RUNTIME = ("MODEL_NAME", "CHUNK_SIZE", "CHUNK_OVERLAP")


def changed_settings(now: dict[str, Any], changes: dict[str, Any]) -> dict[str, Any]:
    """Settings with changes of those that may change at run time, named in any case; other names are passed over."""
    return now | {k.upper(): v for k, v in changes.items() if k.upper() in RUNTIME}


def log_detail(query_params: Column, elapsed_ms: Column) -> Column:
    """Detail of a request log row as JSON; null parts stay."""
    return F.to_json(F.struct(query_params.alias("query_params"), elapsed_ms.alias("elapsed_ms")), {"ignoreNullFields": "false"})


def logged(requests: DataFrame, quiet: tuple[str, ...]) -> DataFrame:
    """Requests that are logged: all but those of quiet paths."""
    return requests.where(~F.coalesce(F.col("path").isin(*quiet), F.lit(False))) if quiet else requests
