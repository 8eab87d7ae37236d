"""Tables in property-list files: one file, or a folder with a file a row, found by the hash of the row's key.

Values: NULL is an empty array, integers ["integer", n], reals ["real", x], text and bytes as they are. Bytes of a file go
through a codec if one is given (encryption, compression).
"""

from __future__ import annotations

import hashlib
import plistlib
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.plans.delta import Change
from relspan.plans.relation import minus
from relspan.sources.scratch import staged
from relspan.sources.shipping import ship
from relspan.sources.tables import Database, Snapshot

#: Rows that a PropertyListDatabase remembers from look-ups.
CACHED = 256
Codec = tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]  # encode, decode
PLAIN: Codec = (bytes, bytes)


def encode_value(v: object) -> object:
    if v is None:
        return []
    if isinstance(v, bool):
        return ["integer", int(v)]
    if isinstance(v, int):
        return ["integer", v]
    if isinstance(v, float):
        return ["real", v]
    return bytes(v) if isinstance(v, bytearray) else v


def decode_value(x: object) -> object:
    if isinstance(x, list):
        if not x:
            return None
        kind, v = x
        return {"integer": int, "real": float}[kind](v)
    if not isinstance(x, str | bytes):
        raise ValueError(f"not a value: {x!r}")
    return x


def encode_row(row: dict[str, object]) -> bytes:
    return plistlib.dumps({k: encode_value(v) for k, v in row.items()}, fmt=plistlib.FMT_BINARY, sort_keys=True)


def decode_row(data: bytes) -> dict[str, object]:
    return {k: decode_value(v) for k, v in plistlib.loads(data).items()}


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _write(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Beside the old file, then in its place."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{hashlib.sha256(data).hexdigest()[:16]}.tmp"
    with fs.open_output_stream(own) as f:
        f.write(data)
    fs.move(own, path)


def write_file(df: DataFrame, uri: str, codec: Codec = PLAIN) -> None:
    """All rows of a small table in one file. It passes through the driver, as one file has one writer."""
    names = sorted(df.columns)
    rows = [[encode_value(r[n]) for n in names] for r in df.toLocalIterator()]
    fs, path = _fs(uri)
    _write(fs, path, codec[0](plistlib.dumps({"attributes": names, "values": rows}, fmt=plistlib.FMT_XML)))


def read_file(spark: SparkSession, uri: str, schema: T.StructType, codec: Codec = PLAIN, create: bool = False) -> DataFrame:
    """The table of one file; with create, a missing file is an empty table. The schema's names must be those stored."""
    fs, path = _fs(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        if not create:
            raise FileNotFoundError(uri)
        return spark.createDataFrame([], schema)
    with fs.open_input_stream(path, compression=None) as f:
        got = plistlib.loads(codec[1](f.read()))
    if set(got["attributes"]) != set(schema.names):
        raise ValueError(f"{uri} has the attributes {got['attributes']}")
    at = [got["attributes"].index(n) for n in schema.names]
    return spark.createDataFrame([tuple(decode_value(r[k]) for k in at) for r in got["values"]], schema)


def row_path(row: dict[str, object], key: list[str]) -> str:
    """<first two digits>/<sha256 of the key>.rowplist"""
    h = hashlib.sha256(encode_row({k: row[k] for k in key})).hexdigest()
    return f"{h[:2]}/{h}.rowplist"


def write_directory(df: DataFrame, uri: str, key: list[str], codec: Codec = PLAIN) -> None:
    """A file a row, written by the tasks; a row with a stored key replaces that row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n = 0
        fs, root = _fs(uri)
        for b in batches:
            for row in b.to_pylist():
                _write(fs, f"{root}/{row_path(row, key)}", codec[0](encode_row(row)))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ship(df.sparkSession)
    df.select(*sorted(df.columns)).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def read_directory(spark: SparkSession, uri: str, schema: T.StructType, codec: Codec = PLAIN) -> DataFrame:
    """All rows, files read in parallel."""
    names = schema.names

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [decode_row(codec[1](bytes(x))) for x in pdf.content]
            yield pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in names})

    fs, root = _fs(uri)
    if fs.get_file_info(root).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.rowplist").option("recursiveFileLookup", "true").load(uri)
    ship(spark)
    return files.select("content").mapInPandas(run, schema)


def look_up(spark: SparkSession, uri: str, key: dict[str, object], schema: T.StructType, codec: Codec = PLAIN) -> DataFrame:
    """The row of one key: one file is read, or none."""
    fs, root = _fs(uri)
    path = f"{root}/{row_path(key, list(key))}"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    with fs.open_input_stream(path, compression=None) as f:
        row = decode_row(codec[1](f.read()))
    return spark.createDataFrame([tuple(row[n] for n in schema.names)], schema)


def delete_rows(df: DataFrame, uri: str, key: list[str]) -> None:
    """Remove the files of these rows' keys."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, root = _fs(uri)
        n = 0
        for b in batches:
            for row in b.to_pylist():
                path = f"{root}/{row_path(row, key)}"
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    fs.delete_file(path)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    ship(df.sparkSession)
    df.select(*key).mapInArrow(run, "n long").agg(F.sum("n")).collect()


def replaced(before: DataFrame, after: DataFrame) -> Change:
    """What replacing a file from outside has added and removed; for a deleted file, after is empty."""
    return Change(minus(after, before), minus(before, after))


@dataclass
class Spec:
    """How a table of a PropertyListDatabase is kept: "transient" not at all, "file" in NAME.plist, "directory" in the folder NAME, a file a
    row, by its key."""

    kind: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    codec: Codec = PLAIN

    def __post_init__(self) -> None:
        if self.kind not in ("transient", "file", "directory") or (self.kind == "directory" and not self.key):
            raise ValueError(f"cannot keep a table as {self.kind} with the key {self.key}")


class PropertyListDatabase:
    """Tables in a folder of property lists. ``tables`` is a Database over them, with all it offers; what it changes is written by save()."""

    def __init__(self, spark: SparkSession, root: str, specs: dict[str, Spec]) -> None:
        self.spark, self.root, self.specs = spark, root.rstrip("/"), specs
        self.tables = Database(spark)
        self._saved: Snapshot = {}
        self._observers: list[Callable[[str, Change], None]] = []
        self._looked_up: OrderedDict[tuple, dict | None] = OrderedDict()

    @classmethod
    def create(cls, spark: SparkSession, root: str, specs: dict[str, Spec]) -> PropertyListDatabase:
        """A new one, with empty tables; raises if there is one."""
        db = cls(spark, root, specs)
        for n, s in specs.items():
            if s.kind != "transient" and db._there(n):
                raise FileExistsError(db._uri(n))
            db.tables.create(n, spark.createDataFrame([], s.schema), s.key)
        db.save()
        return db

    @classmethod
    def open(cls, spark: SparkSession, root: str, specs: dict[str, Spec]) -> PropertyListDatabase:
        db = cls(spark, root, specs)
        if wrong := db.validate():
            raise ValueError("; ".join(wrong))
        for n, s in specs.items():
            db.tables.create(n, db._read(n, db._uri(n)), s.key)
        db._saved = db.tables.snapshot()
        return db

    def _uri(self, name: str) -> str:
        return f"{self.root}/{name}.plist" if self.specs[name].kind == "file" else f"{self.root}/{name}"

    def _there(self, name: str) -> bool:
        fs, path = _fs(self._uri(name))
        return fs.get_file_info(path).type != pafs.FileType.NotFound

    def _read(self, name: str, uri: str) -> DataFrame:
        s = self.specs[name]
        if s.kind == "transient":
            return self.spark.createDataFrame([], s.schema)
        if s.kind == "file":
            return read_file(self.spark, uri, s.schema, s.codec)
        return staged(read_directory(self.spark, uri, s.schema, s.codec), name)

    def validate(self) -> list[str]:
        """What is missing or can't be read under the specs; nothing if all is well."""
        wrong = []
        for n, s in self.specs.items():
            if s.kind == "transient":
                continue
            if not self._there(n):
                wrong.append(f"{n} is missing")
                continue
            try:
                (read_file if s.kind == "file" else read_directory)(self.spark, self._uri(n), s.schema, s.codec).limit(1).collect()
            except Exception as e:  # noqa: BLE001  whatever the file holds
                wrong.append(f"{n} can't be read: {str(e).splitlines()[0][:100]}")
        return wrong

    def observe_save(self, call: Callable[[str, Change], None]) -> Callable[[], None]:
        """call(table, what was written) for each table that save() writes; returns what ends it."""
        self._observers.append(call)
        return lambda: self._observers.remove(call)

    def save(self) -> list[str]:
        """Write the tables that have changed since; a directory gets its changed rows alone. Returns their names."""
        now, written = self.tables.snapshot(), []
        for n, s in self.specs.items():
            fs, path = _fs(self._uri(n))
            if s.kind == "transient" or (n in self._saved and now[n] is self._saved[n]):
                continue
            before = self._saved.get(n, now[n].limit(0))
            change = Change(staged(minus(now[n], before), "written"), staged(minus(before, now[n]), "unwritten"))
            if change.is_empty() and n in self._saved:
                continue
            if s.kind == "file":
                write_file(now[n], self._uri(n), s.codec)
            else:
                fs.create_dir(path, recursive=True)
                delete_rows(change.removed, self._uri(n), list(s.key))
                write_directory(change.added, self._uri(n), list(s.key), s.codec)
            written.append(n)
            for call in list(self._observers):
                call(n, change)
        self._saved = now
        self._looked_up.clear()
        return written

    def look_up(self, name: str, key: dict[str, object]) -> dict[str, object] | None:
        """A stored row of a directory by its key, from its file or from the last CACHED look-ups; None if there is none."""
        s, at = self.specs[name], (name, *sorted(key.items()))
        if at not in self._looked_up:
            row = look_up(self.spark, self._uri(name), {k: key[k] for k in s.key}, s.schema, s.codec).first()
            self._looked_up[at] = None if row is None else row.asDict()
            if len(self._looked_up) > CACHED:
                self._looked_up.popitem(last=False)
        self._looked_up.move_to_end(at)
        return self._looked_up[at]

    def replace_stored(self, name: str, uri: str | None) -> Change:
        """What others have stored at uri takes the table's place, or nothing does (None): the table follows, its observers are told,
        and it is saved. Returns the change."""
        before = self.tables[name].current()
        self.tables[name].replace_all(before.limit(0) if uri is None else self._read(name, uri))
        change = replaced(before, self.tables[name].current())
        self.save()
        return change
