"""Snapshots of tables as JSON, and exports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import iso_text, kilobytes
from .files import exists, folder_size
from .schemas import CHUNKS, TABLES, VECTORS, schema
from .versions import Warehouse, delete, rename

EXPORT_ROWS = 100_000
#: The folder of a snapshot's copy of the store, and the tables of a store.
STORE = "store"
STORE_PARTS = {"chunks": CHUNKS, "vectors": VECTORS}
MANIFEST = "name string, created_at timestamp, tables string, size_kb double, created_by long, has_store boolean"
LISTING = "name string, path string, created_at timestamp, tables string, size_kb double, created_by long, has_store boolean, has_manifest boolean"


def to_lines(rows: DataFrame) -> DataFrame:
    """Each row as JSON with all its fields, null ones too; times in ISO 8601."""
    shown = [iso_text(F.col(f.name)).alias(f.name) if "timestamp" in f.dataType.simpleString() else F.col(f.name) for f in rows.schema]
    return rows.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"}).alias("line"))


def from_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """Rows of a schema from JSON; unknown fields are passed over and missing ones are null."""
    return lines.select(F.from_json("line", ddl).alias("_r")).select("_r.*")


def backup(tables: dict[str, DataFrame], path: str, name: str | None = None, store: str | None = None, by: int | None = None) -> str:
    """Write each table as JSON below path/name, a copy of the store of chunks, if any, then a manifest; returns the folder."""
    spark = next(iter(tables.values())).sparkSession
    name = name or datetime.now(timezone.utc).strftime("backup_%Y%m%d_%H%M%S")
    for table, rows in tables.items():
        to_lines(rows).write.mode("overwrite").text(f"{path}/{name}/{table}")
    stored = bool(store) and _copy_store(spark, store, f"{path}/{name}/{STORE}")
    size = folder_size(spark, f"{path}/{name}")
    size.select(F.lit(name).alias("name"), F.current_timestamp().alias("created_at"), F.lit(",".join(tables)).alias("tables"), kilobytes(F.col("bytes")).alias("size_kb"), F.lit(by).cast("long").alias("created_by"), F.lit(stored).alias("has_store")).coalesce(1).write.mode("overwrite").json(f"{path}/{name}/_manifest_json")
    return f"{path}/{name}"


def _copy_store(spark: SparkSession, store: str, path: str) -> bool:
    """Copy both tables of a store; a store that lacks one is not copied."""
    if not all(exists(spark, f"{store}/{part}") for part in STORE_PARTS):
        return False
    for part, ddl in STORE_PARTS.items():
        spark.read.schema(ddl).parquet(f"{store}/{part}").write.mode("overwrite").parquet(f"{path}/{part}")
    return True


def restore_store(spark: SparkSession, folder: str, store: str) -> bool:
    """Put a snapshot's copy in a store's place; without one, the store stays and the result is False.

    The copy is written beside the store. The store is set aside, the copy takes its name, and only then the old one is deleted; if the
    copy can't take it, the old one gets it back. Between the two renames the store is missing: for a change that readers see at
    once, and for tables, use restore_into().
    """
    if not (exists(spark, folder) and _copy_store(spark, f"{folder}/{STORE}", f"{store}.restored")):
        return False
    aside = f"{store}.replaced"
    if not exists(spark, store) and exists(spark, aside):  # an earlier call ended between its renames
        rename(spark, aside, store)
    delete(spark, aside)
    there = exists(spark, store)
    if there:
        rename(spark, store, aside)
    try:
        rename(spark, f"{store}.restored", store)
    except OSError:
        if there:
            rename(spark, aside, store)
        raise
    delete(spark, aside)
    return True


def restore_into(warehouse: Warehouse, folder: str, tables: list[str] | None = None) -> int:
    """Put a snapshot's tables, and its store where it holds one, in the place of a warehouse's, all in one version; returns it.

    A failure before the last step leaves the version that was current whole.
    """
    spark = warehouse.spark
    made = restore(spark, folder, tables)
    if all(exists(spark, f"{folder}/{STORE}/{part}") for part in STORE_PARTS):
        made |= {part: spark.read.schema(ddl).parquet(f"{folder}/{STORE}/{part}") for part, ddl in STORE_PARTS.items()}
    return warehouse.replace(made)


def restore(spark: SparkSession, folder: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of a snapshot, parents before children; a table that is missing is empty. Swap them in once all are read.

    A folder that is not there raises an error.
    """
    if not exists(spark, folder):
        raise FileNotFoundError(f"no snapshot at {folder}")
    out = {}
    for table in tables or list(TABLES):
        path = f"{folder}/{table}"
        out[table] = from_lines(spark.read.text(path).withColumnRenamed("value", "line"), TABLES[table]) if exists(spark, path) else spark.createDataFrame([], schema(table))
    return out


def list_backups(spark: SparkSession, path: str) -> list[str]:
    """Names of snapshots, latest name first."""
    if not exists(spark, path):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((s.getPath().getName() for s in found if s.isDirectory()), reverse=True)


def backup_listing(spark: SparkSession, path: str) -> DataFrame:
    """A row for each snapshot, latest name first: what its manifest says, or, without one, what its folder shows."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for name in list_backups(spark, path):  # folders of one level
        folder = f"{path}/{name}"
        if exists(spark, f"{folder}/_manifest_json"):
            m = spark.read.schema(MANIFEST).json(f"{folder}/_manifest_json").first()
            rows.append((m.name, folder, m.created_at, m.tables, m.size_kb, m.created_by, m.has_store, True))
        else:
            made = datetime.fromtimestamp(fs.getFileStatus(p(folder)).getModificationTime() / 1000, timezone.utc)
            found = ",".join(t for t in TABLES if exists(spark, f"{folder}/{t}"))
            rows.append((name, folder, made, found, None, None, exists(spark, f"{folder}/{STORE}"), False))
    return spark.createDataFrame(rows, LISTING)


def export_logs(logs: DataFrame, limit: int = EXPORT_ROWS) -> DataFrame:
    """The latest logs in the seven columns of an export, with times as text."""
    rows = logs.orderBy(F.desc("id")).limit(limit)
    return rows.select("id", "user_id", "action", "detail", "ip_address", "status_code", iso_text(F.col("created_at")).alias("created_at"))


def write_workbook(rows: DataFrame, path: str, title: str = "system_logs") -> None:
    """A workbook of up to EXPORT_ROWS rows, where openpyxl is installed; else use rows.write.csv."""
    try:
        from openpyxl import Workbook
    except ImportError as e:
        raise RuntimeError("openpyxl is not installed; write the rows as CSV or Parquet") from e
    book = Workbook(write_only=True)
    sheet = book.create_sheet(title)
    sheet.append(rows.columns)
    for r in rows.limit(EXPORT_ROWS).toLocalIterator():
        sheet.append(list(r))
    book.save(path)
