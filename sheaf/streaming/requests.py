"""The request log: requests become rows of system_logs, each once, without those of quiet paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.settings import log_detail, logged
from ..sources.schemas import TABLES
from .sinks import BatchSink

#: Paths that are not logged.
QUIET = ("/docs", "/redoc", "/openapi.json", "/health")
#: What a request is: query is JSON text or null, subject the user id of its token as text, elapsed in seconds.
REQUESTS = "id long, method string, path string, query string, subject string, ip_address string, status_code int, elapsed double, at timestamp_ntz"
FAILED = f"{REQUESTS}, reason string"


def log_rows(requests: DataFrame, quiet: tuple[str, ...] = QUIET) -> tuple[DataFrame, DataFrame]:
    """(rows of system_logs, requests that can't be logged with a reason). A subject that is no number is nobody; no query is null."""
    params = F.from_json("query", "map<string,string>")
    marked = logged(requests, quiet).withColumn("_params", F.when(F.size(params) > 0, params))
    broken = F.col("query").isNotNull() & (F.trim("query") != "") & params.isNull()
    reason = F.when(F.col("id").isNull(), "no id").when(F.col("method").isNull() | F.col("path").isNull(), "no action").when(F.coalesce(F.col("elapsed"), F.lit(-1)) < 0, "no time").when(broken, "query is no JSON object")
    marked = marked.withColumn("reason", reason)
    rows = marked.where("reason is null").select(
        "id", F.col("subject").try_cast("long").alias("user_id"), F.concat("method", F.lit(" "), "path").alias("action"), log_detail(F.col("_params"), F.round(F.col("elapsed") * 1000, 2)).alias("detail"),
        "ip_address", "status_code", F.col("at").alias("created_at"))
    return rows, marked.where("reason is not null").drop("_params")


class RequestLog:
    """The log at a path: rows and failed requests, by batch of a stream."""

    def __init__(self, spark: SparkSession, path: str, stream: str = "requests", quiet: tuple[str, ...] = QUIET):
        self.spark, self.quiet = spark, quiet
        self.rows = BatchSink(spark, f"{path}/rows", stream, TABLES["system_logs"])
        self.failed = BatchSink(spark, f"{path}/failed", stream, FAILED)

    def write(self, requests: DataFrame, batch: int) -> None:
        """One batch; a request that can't be logged is set aside and keeps none from being logged. A batch that comes again adds nothing."""
        good, bad = log_rows(requests, self.quiet)
        self.failed.write(bad, batch)
        self.rows.write(good, batch)

    def start(self, requests: DataFrame, checkpoint: str) -> StreamingQuery:
        """Log a stream of requests as far as it goes now; the checkpoint belongs to the name of the stream."""
        return requests.writeStream.foreachBatch(lambda batch, number: self.write(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def logs(self) -> DataFrame:
        """The rows of system_logs."""
        return self.rows.read().drop("batch")
