"""Readers and writers of database stores: SQLite files, and JDBC databases.

SQLite comes as a Python data source, read in ranges of rows with simple filters sent to the
database; its file has to lie where all executors see it. JDBC needs the database's driver on
the class path. Other stores (MongoDB, Elasticsearch) are read with their own Spark connectors,
by ``scan_connector``, where those are installed. Derby has no server here: the driver alone fills and
changes a database of its own, and executors read what it published.
"""

from __future__ import annotations

import json
import shutil
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from quillon.cluster import ship

#: Rows that are sent to a database at once.
BATCH = 1000
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    """A name for SQL."""
    return '"' + name.replace('"', '""') + '"'


def literal(value) -> str:
    """A text or number for SQL."""
    return str(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else "'" + str(value).replace("'", "''") + "'"


class SqliteSource(DataSource):
    """Options: path, table, and partitions (4 by default)."""

    @classmethod
    def name(cls) -> str:
        return "quillon_sqlite"

    def schema(self) -> T.StructType:
        with sqlite3.connect(self.options["path"]) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        kinds = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "BLOB": T.BinaryType()}
        return T.StructType([T.StructField(c[1], kinds.get(c[2].upper(), T.StringType())) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else SqliteReader)(schema, dict(self.options))


class SqliteReader(DataSourceReader):
    """Reads ranges of rows; equalities of the option ``wanted`` are tested by the database."""

    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.columns, self.options = schema.names, options
        wanted = json.loads(options.get("wanted", "{}"))
        self.where, self.values = [f"{quoted(c)} = ?" for c in wanted], list(wanted.values())

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.options["path"]) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
        if low is None:
            return [InputPartition((0, 0))]
        n = int(self.options.get("partitions", 4))
        cuts = [low + (high + 1 - low) * i // n for i in range(n + 1)]
        return [InputPartition(x) for x in zip(cuts, cuts[1:], strict=False) if x[0] < x[1]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        where = " AND ".join(["rowid >= ?", "rowid < ?", *self.where])
        with sqlite3.connect(self.options["path"]) as db:
            yield from db.execute(f"SELECT {', '.join(map(quoted, self.columns))} FROM {quoted(self.options['table'])} WHERE {where}", [*partition.value, *self.values])


class PushingReader(SqliteReader):
    """The same for sessions in which Spark hands filters to Python data sources."""

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        """Comparisons of root columns go to the database; the rest is left to Spark."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if len(name) != 1:
                yield f
            elif type(f) in _SIGNS:
                self.where.append(f"{quoted(name[0])} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif isinstance(f, In):
                self.where.append(f"{quoted(name[0])} IN ({', '.join('?' * len(f.value))})")
                self.values += f.value
            elif isinstance(f, IsNotNull):
                self.where.append(f"{quoted(name[0])} IS NOT NULL")
            else:
                yield f


def scan_sqlite(spark: SparkSession, path: str, table: str, wanted: dict | None = None, schema: str | None = None, partitions: int = 4) -> DataFrame:
    """A table of an SQLite file, or its rows with some values; the schema is the database's unless it is given."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(SqliteSource.name()).options(path=path, table=table, partitions=str(partitions), wanted=json.dumps(wanted or {}), pushdown=push)
    return (reader.schema(schema) if schema else reader).load()


def write_sqlite(df: DataFrame, path: str, table: str, key: str | None = None, replace: bool = False) -> int:
    """Rows into a table, which is made if it is not there; a taken key is an error, or is replaced.

    The file has one writer: rows come to the driver partition by partition, never all at once.
    """
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}
    columns = ", ".join(f"{quoted(c)} {kinds.get(t, 'TEXT')}{' PRIMARY KEY' if c == key else ''}" for c, t in df.dtypes)
    n, batch = 0, []
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns})")
        sql = f"INSERT {'OR REPLACE ' if replace else ''}INTO {quoted(table)} VALUES ({', '.join('?' * len(df.columns))})"
        for row in df.toLocalIterator():
            batch.append(tuple(row))
            if len(batch) == BATCH:
                n += db.executemany(sql, batch).rowcount
                batch = []
        if batch:
            n += db.executemany(sql, batch).rowcount
    return n


def delete_rows(path: str, table: str, key: str, ids: DataFrame) -> int:
    """Removes the rows of listed ids (the first column) from a table of an SQLite file."""
    n = 0
    with sqlite3.connect(path) as db:
        for row in ids.toLocalIterator():
            n += db.execute(f"DELETE FROM {quoted(table)} WHERE {quoted(key)} = ?", [row[0]]).rowcount
    return n


def rename_table(path: str, table: str, name: str) -> None:
    with sqlite3.connect(path) as db:
        db.execute(f"ALTER TABLE {quoted(table)} RENAME TO {quoted(name)}")


def run_jdbc(spark: SparkSession, url: str, sql: str) -> int:
    """A statement that returns no rows, on the driver's connection; the number of rows it changed."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        return connection.createStatement().executeUpdate(sql)
    finally:
        connection.close()


def scan_jdbc(spark: SparkSession, url: str, table: str, wanted: dict | None = None, **options: str) -> DataFrame:
    """A table of a database; equalities, and what is filtered later, reach it as predicates."""
    out = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    for column, value in (wanted or {}).items():
        out = out.filter(F.col(column) == F.lit(value))
    return out


def json_query(table: str, wanted: dict, document: str = "document") -> str:
    """The query of a table of JSON documents in PostgreSQL: all values agree as text."""
    tests = [f"{quoted(document)} ->> {literal(str(k))} = {literal(str(v))}" for k, v in wanted.items()]
    return f"SELECT * FROM {quoted(table)}" + (" WHERE " + " AND ".join(tests) if tests else "")


def write_jdbc(df: DataFrame, url: str, table: str, types: str, mode: str = "append", **options: str) -> None:
    """Rows into a table of a database; ``types`` are types of its columns, where not Spark's own."""
    made = {"createTableColumnTypes": types} if types else {}
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=table, batchsize=str(BATCH), **made, **options).save()


DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_DERBY_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "REAL", "date": "DATE", "string": "VARCHAR(32672)"}


def create_derby(df: DataFrame, path: str, table: str) -> str:
    """The URL of a new Derby database in the folder ``path`` whose table has the rows.

    An embedded database is open in one process at a time, so it is the driver that fills it: executors
    write files beside it, on a file system that the driver has mounted, and the database imports them one
    by one. Texts are up to 32,672 characters, numbers finite; others are an error.
    """
    spark, lines = df.sparkSession, f"{path}-lines"
    quote = F.lit('"')
    fields = [F.concat(quote, F.replace(c, quote, F.lit('""')), quote) if t == "string" else F.col(c).cast("string") for c, t in df.dtypes]
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    spark._jvm.java.lang.Class.forName(DERBY)
    url = f"jdbc:derby:{path}"
    columns = ", ".join(f"{quoted(c)} {_DERBY_TYPES[t]}" for c, t in df.dtypes)
    try:
        df.select(F.concat_ws(",", *(F.coalesce(f, F.lit("")) for f in fields)).alias("value")).write.text(f"file://{lines}")
        run_jdbc(spark, f"{url};create=true", "CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.pageSize', '4096')")  # else 32 KB for long texts, a thousand pages in memory
        run_jdbc(spark, url, f"CREATE TABLE {table} ({columns})")
        for part in sorted(Path(lines).glob("part-*")):
            if part.stat().st_size:
                run_jdbc(spark, url, f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, {literal(table.upper())}, {literal(part)}, ',', '\"', 'UTF-8', 0)")
    finally:
        shutil.rmtree(lines, ignore_errors=True)
    return url


def publish_derby(spark: SparkSession, url: str) -> str:
    """Closes a database of ``create_derby`` for good; the URL of a copy that any number of processes read at once."""
    path = Path(url.removeprefix("jdbc:derby:"))
    try:
        spark._jvm.java.sql.DriverManager.getConnection(f"{url};shutdown=true")
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # a database says so when it has shut down
            raise
    with zipfile.ZipFile(f"{path}.jar", "w") as archive:  # stored, not deflated: pages are read from their places
        for file in sorted(x for x in path.rglob("*") if x.is_file() and x.relative_to(path).parts[0] != "tmp"):
            archive.write(file, f"db/{file.relative_to(path)}")
    shutil.rmtree(path)
    return f"jdbc:derby:jar:({path}.jar)db"


def scan_connector(spark: SparkSession, connector: str, **options: str) -> DataFrame:
    """A store by its Spark connector, such as ``mongodb`` or ``es``."""
    return spark.read.format(connector).options(**options).load()
