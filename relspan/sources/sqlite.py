"""SQLite files as a Spark data source ("relspan_sqlite"), and as relations whose selections SQLite evaluates.

Stored values: NULL is the blob ``NULL``; blobs begin with ``BLOB``. A table is a set: unique over all its columns. A file has one writer, and
the driver is it; files lie where driver and executors see them.
"""

from __future__ import annotations

import os
import sqlite3
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith, WriterCommitMessage,
)

from relspan.functions import values as V
from relspan.functions.predicates import And, Attr, Compare, Const, Glob, Not, Or, Predicate, Types, truth
from relspan.plans import relation as R
from relspan.plans.delta import Change
from relspan.sources.shipping import ship

BUSY_MS = 10
_NULL, _BLOB = b"NULL", b"BLOB"


def encode(v: object) -> object:
    if v is None:
        return _NULL
    if isinstance(v, bytes | bytearray):
        return _BLOB + bytes(v)
    return int(v) if isinstance(v, bool) else v


def decode(v: object) -> object:
    if isinstance(v, bytes):
        if v == _NULL:
            return None
        return v.removeprefix(_BLOB)
    return v


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(path, timeout=BUSY_MS / 1000, isolation_level=None)


def is_busy(e: Exception) -> bool:
    """Whether a transaction should be tried again."""
    return isinstance(e, sqlite3.OperationalError) and ("locked" in str(e) or "busy" in str(e))


def transaction(path: str, action: Callable[[sqlite3.Connection], object], most: int = 10, pause: float = 0.01) -> object:
    """An action's statements in one transaction; all or none. While the file is busy it is tried again from the start."""
    for turn in range(most):
        with closing(connect(path)) as db:
            try:
                db.execute("BEGIN IMMEDIATE")
                got = action(db)
                db.execute("COMMIT")
                return got
            except Exception as e:
                if db.in_transaction:
                    db.execute("ROLLBACK")
                if turn == most - 1 or not is_busy(e):
                    raise
        time.sleep(pause)
    return None


def create_table(path: str, name: str, columns: Iterable[str]) -> None:
    names = ", ".join(quote(c) for c in sorted(columns))
    with closing(connect(path)) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS {quote(name)} ({names}, UNIQUE ({names}) ON CONFLICT REPLACE)")


def tables(path: str) -> dict[str, list[str]]:
    """Tables of a file and their columns."""
    with closing(connect(path)) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
        return {n: [r[1] for r in db.execute(f"PRAGMA table_info({quote(n)})")] for n in names}


# predicates as SQL


def literal(v: object) -> str:
    """An encoded value as SQL text."""
    v = encode(v)
    if isinstance(v, bytes):
        return f"x'{v.hex()}'"
    if isinstance(v, str):
        return f"CAST(x'{v.encode().hex()}' AS TEXT)" if "\0" in v else "'" + v.replace("'", "''") + "'"
    return repr(v)


def _plain(v: object) -> bool:
    """Whether SQLite holds the value as it is."""
    return v is None or isinstance(v, str | bytes | bytearray | bool) or (isinstance(v, int) and -(2**63) <= v < 2**63) or (isinstance(v, float) and abs(v) < float("inf"))


def _is_null(c: str) -> str:
    return f"({c} IS NULL OR {c} = x'{_NULL.hex()}')"


def to_sql(p: Predicate, types: Types) -> tuple[str, bool]:
    """(SQL, whether it is exact). What can't be said in SQL is 1, which lets rows through that must be tested again."""
    anything = ("1", False)
    match p:
        case Const():
            return ("1" if truth(p) else "0"), True
        case Attr(name=n) if n in types:
            return (f"NOT ({quote(n)} = 0 AND typeof({quote(n)}) = 'integer')" if V.kind(types[n]) == 1 else "1"), True
        case Not(inner=x):
            sql, exact = to_sql(x, types)
            return (f"NOT {sql}", True) if exact else anything
        case And() | Or():
            (a, exact_a), (b, exact_b) = to_sql(p.left, types), to_sql(p.right, types)
            return f"({a} {'AND' if isinstance(p, And) else 'OR'} {b})", exact_a and exact_b
        case Glob(inner=Attr(name=n)) if n in types:
            c = quote(n)
            return (f"(typeof({c}) = 'text' AND {c} GLOB {literal(p.pattern)})" if V.kind(types[n]) == 3 else "0"), True
        case Compare(left=Attr(name=n), right=Const(constant=v)) if n in types and _plain(v):
            return _compared(quote(n), p.op, v, V.kind(types[n])), True
        case Compare(left=Const(constant=v), right=Attr(name=n)) if n in types and _plain(v):
            turned = {"lt": "gt", "gt": "lt", "le": "ge", "ge": "le"}.get(p.op, p.op)
            return _compared(quote(n), turned, v, V.kind(types[n])), True
    return anything


def _compared(c: str, op: str, v: object, kind: int) -> str:
    """A column against a constant, in the total order of values: NULL is least, then kinds in their order."""
    own = {type(None): 0, bool: 1, int: 1, float: 2, str: 3}.get(type(v), 4)
    x, null = literal(v), _is_null(c)
    eq = null if own == 0 else f"({c} IS NOT NULL AND {c} = {x})" if kind == own else "0"
    lt = "0" if own == 0 else f"({null} OR {c} < {x})" if kind == own else "1" if kind < own else null
    return {"eq": eq, "ne": f"NOT {eq}", "lt": lt, "le": f"({lt} OR {eq})", "gt": f"NOT ({lt} OR {eq})", "ge": f"NOT {lt}"}[op]


def _filter_sql(f: Filter) -> str | None:
    """What SQLite can test of a filter of Spark's. It may let too much through, as Spark tests again."""
    if len(f.attribute) != 1:
        return None
    c = quote(f.attribute[0])
    if isinstance(f, IsNull):
        return _is_null(c)
    if isinstance(f, IsNotNull):
        return f"NOT {_is_null(c)}"
    if isinstance(f, In):
        if not all(map(_plain, f.value)):
            return None
        return f"({c} IN ({', '.join(literal(v) for v in f.value if v is not None) or 'NULL'}){' OR ' + _is_null(c) if None in f.value else ''})"
    if not _plain(f.value):
        return None
    if isinstance(f, EqualTo | EqualNullSafe):
        return _is_null(c) if f.value is None else f"{c} = {literal(f.value)}"
    if isinstance(f, StringStartsWith):
        return f"substr({c}, 1, {len(f.value)}) = {literal(f.value)}"
    if isinstance(f, StringContains):
        return f"instr({c}, {literal(f.value)}) > 0"
    for kind, op in ((GreaterThan, ">"), (GreaterThanOrEqual, ">="), (LessThan, "<"), (LessThanOrEqual, "<=")):
        if isinstance(f, kind):
            return f"{c} {op} {literal(f.value)}"
    return None


# the data source


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    """Ranges of rowid are read in parallel."""

    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.parts = int(options.get("partitions", 4))
        self.where: list[str] = [options["where"]] if "where" in options else []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            sql = _filter_sql(f)
            if sql is not None:
                self.where.append(sql)
            yield f

    def partitions(self) -> list[InputPartition]:
        with closing(connect(self.path)) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quote(self.table)}").fetchone()
        if low is None:
            return [_Rows(0, -1)]
        step = -(-(high - low + 1) // self.parts)
        return [_Rows(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, part: _Rows) -> Iterator[tuple]:
        tests = " AND ".join(["rowid BETWEEN ? AND ?", *(f"({w})" for w in self.where)])
        names = ", ".join(quote(f.name) for f in self.schema.fields)
        with closing(connect(self.path)) as db:
            for row in db.execute(f"SELECT {names} FROM {quote(self.table)} WHERE {tests}", [part.low, part.high]):
                yield tuple(map(decode, row))


class SqliteWriter(DataSourceWriter):
    """A task writes its rows to a file of its own beside the target; at commit the driver takes the rows of those files over, row by row and in
    one transaction, so a failed job leaves nothing and no rows travel in messages."""

    def __init__(self, schema: T.StructType, options: dict, overwrite: bool) -> None:
        self.schema, self.options, self.overwrite = schema, options, overwrite

    def _insert(self) -> str:
        names = self.schema.names
        return f"INSERT INTO {quote(self.options['table'])} ({', '.join(map(quote, names))}) VALUES ({', '.join('?' * len(names))})"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        m = WriterCommitMessage()
        m.part = f"{self.options['path']}.part-{uuid.uuid4().hex}"
        create_table(m.part, self.options["table"], self.schema.names)
        with closing(connect(m.part)) as db:
            db.execute("BEGIN")
            db.executemany(self._insert(), (tuple(encode(v) for v in r) for r in rows))
            db.execute("COMMIT")
        return m

    def commit(self, messages: list) -> None:
        path, table, names = self.options["path"], self.options["table"], self.schema.names
        create_table(path, table, names)

        def take(db: sqlite3.Connection) -> None:
            if self.overwrite:
                db.execute(f"DELETE FROM {quote(table)}")
            for m in messages:
                with closing(connect(m.part)) as part:
                    db.executemany(self._insert(), part.execute(f"SELECT {', '.join(map(quote, names))} FROM {quote(table)}"))

        transaction(path, take)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.part):
                os.remove(m.part)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "relspan_sqlite"

    def schema(self) -> T.StructType:
        columns = tables(self.options["path"])[self.options["table"]]
        kinds = {}
        with closing(connect(self.options["path"])) as db:
            for c in columns:  # one type a column, from what it holds
                got = {r[0] for r in db.execute(f"SELECT DISTINCT typeof({quote(c)}) FROM {quote(self.options['table'])} WHERE {quote(c)} IS NOT NULL AND {quote(c)} <> ?", [_NULL])}
                if len(got) > 1:
                    raise ValueError(f"column {c} holds values of {sorted(got)}; give a schema")
                kinds[c] = {"integer": T.LongType(), "real": T.DoubleType(), "blob": T.BinaryType()}.get(next(iter(got), ""), T.StringType())
        return T.StructType([T.StructField(c, kinds[c]) for c in columns])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> SqliteWriter:
        return SqliteWriter(schema, self.options, overwrite)


def read(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None, where: str | None = None) -> DataFrame:
    """A table's rows; ``where`` is SQL that SQLite tests besides."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("relspan_sqlite").option("table", table)
    reader = reader if where is None else reader.option("where", where)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, table: str, overwrite: bool = False) -> None:
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(SqliteSource)
    df.write.format("relspan_sqlite").option("table", table).mode("overwrite" if overwrite else "append").save(path)


def execute(path: str, sql: str, params: Iterable[object] = (), raw_blobs: bool = False) -> list[tuple]:
    """Raw SQL on the driver."""
    with closing(connect(path)) as db:
        got = db.execute(sql, [p if raw_blobs and isinstance(p, bytes) else encode(p) for p in params])
        return [tuple(map(decode, r)) for r in got]


# relations


class SqliteTable(R.Relation):
    """A table of a file as a relation: selections go to SQLite, mutations are transactions there and are told to observers."""

    def __init__(self, spark: SparkSession, path: str, table: str, schema: T.StructType | None = None) -> None:
        self.spark, self.path, self.table, self.name = spark, path, table, table
        fields = (schema or read(spark, path, table).schema).fields
        self.schema = T.StructType(sorted(fields, key=lambda f: f.name))
        self.types = {f.name: f.dataType for f in self.schema.fields}
        self._observers: list[Callable[[Change], None]] = []

    def build(self, c: R._Compiling) -> DataFrame:
        return c.env.get(id(self)) or read(self.spark, self.path, self.table, self.schema)

    def rebuilt(self, children: tuple[R.Relation, ...]) -> R.Relation:
        return self

    def select(self, where: object) -> R.Relation:
        return _SqliteSelect(self, R._predicate(where))

    def observe(self, call: Callable[[Change], None]) -> Callable[[], None]:
        """call(change) after each mutation through this object; returns what ends it."""
        self._observers.append(call)
        return lambda: self._observers.remove(call)

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame([tuple(map(decode, r)) for r in rows], self.schema)

    def _tell(self, added: list[tuple], removed: list[tuple]) -> None:
        plus, less = [r for r in added if r not in set(removed)], [r for r in removed if r not in set(added)]
        if plus or less:
            for call in list(self._observers):
                call(Change(self._rows(plus), self._rows(less)))

    def _found(self, db: sqlite3.Connection, sql: str, params: Iterable[object] = ()) -> list[tuple]:
        return db.execute(f"SELECT {', '.join(map(quote, self.schema.names))} FROM {quote(self.table)} WHERE {sql}", list(params)).fetchall()

    def _where(self, where: object) -> str:
        p = R._predicate(where)
        if unknown := p.attributes() - set(self.types):
            raise ValueError(f"{self.table} has no {sorted(unknown)}")
        sql, exact = to_sql(p, self.types)
        if not exact:
            raise ValueError("SQLite can't evaluate this predicate")
        return sql

    def add(self, row: dict[str, object]) -> int | None:
        """Insert a row; returns its rowid, or None if it was there."""
        values = [encode(row[n]) for n in self.schema.names]
        names, marks = ", ".join(map(quote, self.schema.names)), ", ".join("?" * len(values))
        same = " AND ".join(f"{quote(n)} IS ?" for n in self.schema.names)

        def insert(db: sqlite3.Connection) -> int | None:
            if self._found(db, same, values):
                return None
            return db.execute(f"INSERT INTO {quote(self.table)} ({names}) VALUES ({marks})", values).lastrowid

        rowid = transaction(self.path, insert)
        if rowid is not None:
            self._tell([tuple(values)], [])
        return rowid

    def delete(self, where: object) -> int:
        """Delete what holds ``where``, which SQLite must be able to evaluate; returns the number of rows."""
        sql = self._where(where)

        def run(db: sqlite3.Connection) -> list[tuple]:
            gone = self._found(db, sql) if self._observers else []
            n = db.execute(f"DELETE FROM {quote(self.table)} WHERE {sql}").rowcount
            return [gone, n]

        gone, n = transaction(self.path, run)
        self._tell([], gone)
        return n

    def update(self, where: object, new: dict[str, object]) -> int:
        """Set constants in what holds ``where``; rows that become equal are one. Returns the number of rows that held it."""
        if unknown := set(new) - set(self.types):
            raise ValueError(f"{self.table} has no {sorted(unknown)}")
        sql = self._where(where)
        sets, values = ", ".join(f"{quote(n)} = ?" for n in new), [encode(v) for v in new.values()]

        def run(db: sqlite3.Connection) -> list:
            if not self._observers:
                return [[], [], db.execute(f"UPDATE OR REPLACE {quote(self.table)} SET {sets} WHERE {sql}", values).rowcount]
            old = self._found(db, sql)
            made = list(dict.fromkeys(tuple(encode(new[c]) if c in new else v for c, v in zip(self.schema.names, r)) for r in old))
            same = " AND ".join(f"{quote(n)} IS ?" for n in self.schema.names)
            plus = [r for r in made if not self._found(db, same, r)]
            n = db.execute(f"UPDATE OR REPLACE {quote(self.table)} SET {sets} WHERE {sql}", values).rowcount
            return [plus, [r for r in old if r not in set(made)], n]

        plus, less, n = transaction(self.path, run)
        self._tell(plus, less)
        return n


class _SqliteSelect(R.Select):
    def build(self, c: R._Compiling) -> DataFrame:
        table = self.children[0]
        if id(table) in c.env:
            return super().build(c)
        sql, _ = to_sql(self.where, table.types)
        return read(table.spark, table.path, table.table, table.schema, sql).where(self.where.holds(table.types))

    def select(self, where: object) -> R.Relation:
        return _SqliteSelect(self.children[0], self.where & R._predicate(where))

    def rebuilt(self, children: tuple[R.Relation, ...]) -> R.Relation:
        return R.Select(children[0], self.where)
