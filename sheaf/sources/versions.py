"""Folders of tables with one pointer: which data is current changes in one step, or not at all.

A commit writes its data to folders that nothing names yet, then a new version file that names all of them. Readers take the latest
version file that is whole. So a failure at any step leaves what was current, and of two writers that start from one version
the second is refused. What no version names any more is deleted by vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .files import exists

VERSIONS = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit starts from."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir, which all executors share; None if it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an error if it is there."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    source = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """An error if `new` is there or the file system refuses."""
    fs, p = _fs(spark, old)
    if exists(spark, new) or not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"{old} could not be renamed to {new}")


def names(spark: SparkSession, path: str) -> list[str]:
    if not exists(spark, path):
        return []
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


class Versions:
    """The version files of a folder: each holds a JSON object."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> tuple[int, dict]:
        """The latest version that is whole, and what it holds; 0 and nothing before the first."""
        for name in reversed([n for n in names(self.spark, f"{self.path}/{VERSIONS}") if n.endswith(".json")]):
            return int(name.removesuffix(".json")), json.loads(read_text(self.spark, f"{self.path}/{VERSIONS}/{name}"))
        return 0, {}

    def commit(self, base: int, held: dict) -> int:
        """Make `held` current after version `base`; Conflict if another version has followed it."""
        if self.current()[0] != base:
            raise Conflict(f"{self.path} is at version {self.current()[0]}, not {base}")
        draft = f"{self.path}/{VERSIONS}/.{uuid.uuid4().hex}.draft"
        write_text(self.spark, draft, json.dumps(held))
        try:
            rename(self.spark, draft, f"{self.path}/{VERSIONS}/{base + 1:012d}.json")  # whole once it has its name
        except OSError as e:
            delete(self.spark, draft)
            raise Conflict(str(e)) from e
        return base + 1

    def new_folder(self, label: str) -> str:
        """A path, relative to this folder, that nothing has yet."""
        return f"data/{label}-{uuid.uuid4().hex}"

    def vacuum(self, keep: int = 1, named: Callable[[dict], set[str]] = lambda held: set(held.values())) -> list[str]:
        """Delete version files but the last `keep`, and data that none of these name, and return what went.

        Drafts of commits that are under way are data too: call it when no writer is.
        """
        files = [n for n in names(self.spark, f"{self.path}/{VERSIONS}") if n.endswith(".json")]
        gone = files[:-keep] if keep else files
        used = {x for n in files[len(gone) :] for x in named(json.loads(read_text(self.spark, f"{self.path}/{VERSIONS}/{n}")))}
        for name in gone:
            delete(self.spark, f"{self.path}/{VERSIONS}/{name}")
        old = [f"data/{n}" for n in names(self.spark, f"{self.path}/data") if f"data/{n}" not in used]
        for path in old:
            delete(self.spark, f"{self.path}/{path}")
        return old


class Warehouse:
    """Tables whose current state is one version: {table: folder}."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.versions = spark, Versions(spark, path)

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version, the current one if none is named; they stay as they are while others commit."""
        if version is None:
            held = self.versions.current()[1]
        else:
            held = json.loads(read_text(self.spark, f"{self.versions.path}/{VERSIONS}/{version:012d}.json"))
        return {name: self.spark.read.parquet(f"{self.versions.path}/{folder}") for name, folder in held.items()}

    def replace(self, tables: dict[str, DataFrame], drop: tuple[str, ...] = ()) -> int:
        """Put new contents in the place of some tables, all at once; the others stay. Returns the version.

        The new contents may be made from the old ones. An unfinished call leaves folders that vacuum() deletes.
        """
        base, held = self.versions.current()
        made = {}
        for name, rows in tables.items():
            made[name] = self.versions.new_folder(name)
            rows.write.parquet(f"{self.versions.path}/{made[name]}")
        return self.versions.commit(base, {k: v for k, v in (held | made).items() if k not in drop})

    def vacuum(self, keep: int = 1) -> list[str]:
        return self.versions.vacuum(keep)
