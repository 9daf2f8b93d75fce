"""Tables of a database: whole scans in ranges of equal rows, and listings that the database filters, counts and pages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES, schema

#: Buckets of one histogram for each range that is wanted; so many rows at most come to the driver from one statement.
FINE = 8
CATALOG = "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"
#: Databases whose dialect in Spark has no LIMIT: pushed there, a page's end would be lost, so Spark cuts pages itself.
NO_LIMIT = ("jdbc:derby:",)
Range = tuple[int | None, int | None]


@dataclass(frozen=True)
class Database:
    """A database that Spark reaches by JDBC; `options` are those of Spark's reader, such as user, password, fetchsize."""

    url: str
    driver: str
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def _reader_options(self) -> dict[str, str]:
        limits = {k: "false" for k in ("pushDownLimit", "pushDownOffset")} if self.url.startswith(NO_LIMIT) else {}
        return {"url": self.url, "driver": self.driver, "preferTimestampNTZ": "true", **self.options, **limits}

    def _quoted(self, spark: SparkSession, name: str) -> str:
        return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def _name(self, spark: SparkSession, table: str) -> str:
        return ".".join(self._quoted(spark, n) for n in (self.schema, table) if n)

    def query(self, spark: SparkSession, sql: str) -> DataFrame:
        """Rows of a statement that the database runs."""
        return spark.read.format("jdbc").options(**self._reader_options()).option("query", sql).load()

    def scan(self, spark: SparkSession, table: str, key: str = "id", parts: int | None = None) -> DataFrame:
        """A whole table, read by `parts` tasks (the session's shuffle width, if not given) of about as many rows each.

        Each task reads a range of the key, a column of integers, best one with an index. Ranges leave no gap and are open at both
        ends, and rows without a key are a range of their own, so none is lost or read twice where rows come and go
        between the statements; each task sees the table as it is when it reads. Filters and columns reach the database.
        """
        ranges = self.ranges(spark, table, key, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
        column = self._quoted(spark, key)
        spans = [" AND ".join([f"{column} >= {low}"] * (low is not None) + [f"{column} < {high}"] * (high is not None)) or f"{column} IS NOT NULL" for low, high in ranges]
        rows = spark.read.jdbc(self.url, self._name(spark, table), predicates=[*spans, f"{column} IS NULL"], properties={k: v for k, v in self._reader_options().items() if k != "url"})
        return typed(rows, table)

    def ranges(self, spark: SparkSession, table: str, key: str, parts: int) -> list[Range]:
        """At most `parts` ranges [low, high) of the key that hold about as many rows each.

        The database counts rows in buckets of equal width; buckets with more than a range's share are counted again, all in one
        statement, until none is left or they have one value. A level divides a width by FINE times `parts`.
        """
        column, name = self._quoted(spark, key), self._name(spark, table)
        low, high, n = self.query(spark, f"SELECT MIN({column}) AS a, MAX({column}) AS b, COUNT({column}) AS n FROM {name}").first()
        if not n or parts < 2:
            return [(None, None)]
        if int(low) != low:
            raise ValueError(f"{key} must be a column of integers")
        share = max(1, -(-n // parts))
        wide, fine = [(int(low), int(high) + 1)], []
        while wide:
            # the first level has FINE buckets for each range, later ones share them out among the heavy buckets
            each = max(2, FINE * parts // len(wide))
            steps = [-(-(b - a) // each) for a, b in wide]
            inner = [f"SELECT {i} AS w, FLOOR(({column} - {a}) / {step}) AS b FROM {name} WHERE {column} >= {a} AND {column} < {b}" for i, ((a, b), step) in enumerate(zip(wide, steps, strict=True))]
            counted = self.query(spark, f"SELECT w, b, COUNT(*) AS n FROM ({' UNION ALL '.join(inner)}) x GROUP BY w, b").collect()
            heavy = []
            for w, b, n_rows in counted:
                start = wide[w][0] + int(b) * steps[w]
                end = min(start + steps[w], wide[w][1])
                if n_rows > share and end - start > 1:
                    heavy.append((start, end))
                else:
                    fine.append((start, n_rows))
            wide = heavy
        cuts, held = [], 0
        for start, n_rows in sorted(fine):
            if held and held + n_rows > share and len(cuts) < parts - 1:
                cuts.append(start)
                held = 0
            held += n_rows
        return list(zip([None, *cuts], [*cuts, None], strict=True))

    def attach(self, spark: SparkSession, catalog: str) -> None:
        """Name the database as a catalog of the session, so that SQL reads it and filters, counts and pages are pushed to it."""
        spark.conf.set(f"spark.sql.catalog.{catalog}", CATALOG)
        for k, v in self._reader_options().items():
            spark.conf.set(f"spark.sql.catalog.{catalog}.{k}", v)

    def tables(self, spark: SparkSession, catalog: str, *names: str) -> dict[str, DataFrame]:
        """Tables of an attached database, for listings: a page or a count that has no search text is the database's work.

        Search texts and texts compared by collation stay with Spark, over the rows that the other filters left.
        """
        path = ".".join(f"`{n}`" for n in (catalog, self.schema) if n)
        return {n: typed(spark.table(f"{path}.`{n}`"), n) for n in names}


def typed(rows: DataFrame, table: str) -> DataFrame:
    """Columns in lower case, and of a table of the back office those of its schema, with its types; columns it lacks are null.

    A column that has its type already isn't touched, so that filters on it reach the database.
    """
    rows = rows.toDF(*[c.lower() for c in rows.columns])
    if table.lower() not in TABLES:
        return rows
    held = {f.name: f.dataType for f in rows.schema}
    columns = []
    for f in schema(table.lower()):
        if f.name not in held:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            columns.append(F.col(f.name) if held[f.name] == f.dataType else F.col(f.name).cast(f.dataType).alias(f.name))
    return rows.select(*columns)
