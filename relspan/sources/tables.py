"""Mutable tables over immutable versions: transactions, snapshots, deltas, undo and observers.

A version of a table is a stored base and the rows added to it and removed from it since. Every mutation makes the rows that it
adds and removes, by joins of these with the table; a commit stores those alone and composes them with what stood before, so its cost follows
the change. Once the overlay is large against the base, a commit writes a new base. Snapshots and isolation of readers follow from
versions never changing. Everything stored is Parquet in the shared folder, so plans stay short and a lost executor costs a re-read.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.predicates import Predicate, exclusive, weakened
from relspan.plans import relation as R
from relspan.plans.delta import Change, LeafChange, derivative
from relspan.plans.relation import Relation, cols, quoted
from relspan.sources.scratch import staged, staged_counted

Snapshot = dict[str, DataFrame]
Delta = dict[str, Change]

#: An overlay of so many rows, and so large a share of the base's, is written into a new base.
COMPACT_ROWS, COMPACT_SHARE = 10_000, 0.125
#: Mutations of a table within one transaction after which what they add and remove is stored together.
FLAT = 4


@dataclass
class _Version:
    """A table's rows: those of base but ``removed``, and ``added``. n: rows of base, once counted."""

    base: DataFrame
    added: DataFrame | None = None
    removed: DataFrame | None = None
    n: int | None = None

    def rows(self) -> DataFrame:
        out = self.base if self.removed is None else R.minus(self.base, self.removed)
        return out if self.added is None else out.unionByName(self.added)


@dataclass
class _Work:
    """What a transaction has done to a table so far: its own change, the rows that it sees, and the predicates of what it touched
    (None once something else was)."""

    change: Change
    rows: DataFrame
    touched: list[Predicate] | None
    depth: int = 0


class Table(Relation):
    """A named base relation of a database. ``key`` is unique: adding a row replaces that with the same key."""

    def __init__(self, db: Database, name: str, data: DataFrame, key: Iterable[str] = ()) -> None:
        self.db, self.name, self.key = db, name, tuple(key)
        self.keys = frozenset([frozenset(self.key)]) if self.key else frozenset()
        self.schema = T.StructType(sorted(data.schema.fields, key=lambda f: f.name))
        self.types = {f.name: f.dataType for f in self.schema.fields}
        self._version = _Version(cols(data if self.key else data.distinct(), self.schema.names))
        self._rows = self._version.rows()

    def build(self, c: R._Compiling) -> DataFrame:
        return c.env.get(id(self), self.current())

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return self

    def label(self) -> str:
        return f"Table {self.name}"

    def current(self) -> DataFrame:
        """Committed rows, or this thread's own within its transaction."""
        own = self.db._working().get(self.name)
        return self._rows if own is None else own.rows

    # mutations; outside a transaction each is one of its own

    def add(self, *rows: dict[str, object]) -> None:
        for r in rows:
            if set(r) != set(self.schema.names):
                raise ValueError(f"a row of {self.name} has {self.schema.names}, not {sorted(r)}")
        made = self.db.spark.createDataFrame([tuple(r[n] for n in self.schema.names) for r in rows], self.schema)
        self.add_all(made)

    def add_all(self, rows: DataFrame) -> None:
        rows = cols(rows, self.schema.names).distinct()
        with self.db.transaction():
            if self.key:
                old = self.db._some(R.null_safe(self.current(), cols(rows, self.key), [(k, k) for k in self.key], "left_semi"), "same-key")
                if old is None:
                    self.db._do(self, rows, None, None)
                else:
                    self.db._do(self, R.minus(rows, old), R.minus(old, rows), None)
            else:
                self.db._do(self, R.minus(rows, R.meet(self.current(), rows)), None, None)

    def delete(self, where: object, rows: DataFrame | None = None) -> None:
        p = R._predicate(where)
        with self.db.transaction():
            hit = self.current().where(p.holds(self.types))
            self.db._do(self, None, hit if rows is None else R.null_safe(hit, rows, [(c, c) for c in rows.columns], "left_semi"), p)

    def remove_all(self, rows: DataFrame) -> None:
        """Remove these rows."""
        with self.db.transaction():
            self.db._do(self, None, R.meet(self.current(), cols(rows, self.schema.names)), None)

    def update(self, where: object, new: dict[str, object]) -> None:
        self.update_rows(R._predicate(where), None, new)

    def update_rows(self, where: Predicate, rows: DataFrame | None, new: dict[str, object]) -> None:
        """Set constants in the rows that hold the predicate and (if given) match a row of rows on its columns."""
        if unknown := set(new) - set(self.schema.names):
            raise ValueError(f"{self.name} has no {sorted(unknown)}")
        with self.db.transaction():
            hit = self.current().where(where.holds(self.types))
            hit = hit if rows is None else R.null_safe(hit, rows, [(c, c) for c in rows.columns], "left_semi")
            hit = self.db._some(hit, "hit")
            if hit is None:
                return
            fixed = hit.select(*(F.lit(new[c]).cast(self.types[c]).alias(c) if c in new else quoted(c) for c in hit.columns)).distinct()
            became = weakened(where, set(new)) & R.row_matches(new)
            self.db._do(self, R.minus(fixed, R.meet(self.current(), fixed)), R.minus(hit, fixed), where | became)

    def replace_all(self, rows: DataFrame) -> None:
        """The table's rows become these."""
        rows = cols(rows, self.schema.names)
        with self.db.transaction():
            now = self.current()
            if rows is not now:
                self.db._do(self, R.minus(rows, now), R.minus(now, rows), None)


@dataclass
class _Observer:
    relation: Relation
    call: Callable
    content: bool
    alive: bool = True


@dataclass
class _Queued:
    run: Callable[[], object]
    tag: object = None
    tables: dict[str, Predicate | None] = field(default_factory=dict)


class Database:
    """Tables with one writer at a time; readers see the last commit."""

    def __init__(self, spark: SparkSession, stored: bool = True) -> None:
        self.spark, self.stored = spark, stored
        self.tables: dict[str, Table] = {}
        self.version = 0
        self._lock = threading.RLock()
        self._own = threading.local()
        self._observers: list[_Observer] = []
        self._queue: list[_Queued] = []
        self._done: list[tuple[str, Delta, Delta]] = []
        self._undone: list[tuple[str, Delta, Delta]] = []
        self._watchers: list[Callable[[str], None]] = []
        self._committed: Delta = {}  # what the last commit has changed
        self._state = "idle"
        self.save_to: str | None = None  # a folder to save to after each commit
        self.skipped = 0  # observers that a proof of irrelevance has spared

    def __getitem__(self, name: str) -> Table:
        return self.tables[name]

    def create(self, name: str, data: DataFrame, key: Iterable[str] = ()) -> Table:
        if name in self.tables:
            raise ValueError(f"{name} exists")
        self.tables[name] = Table(self, name, data, key)
        return self.tables[name]

    def get_or_create(self, name: str, data: DataFrame, key: Iterable[str] = ()) -> Table:
        have = self.tables.get(name)
        if have is None:
            return self.create(name, data, key)
        if set(have.schema.names) != set(data.columns):
            raise ValueError(f"{name} has the attributes {have.schema.names}")
        return have

    def sql(self, query: str, **args: object) -> DataFrame:
        """SQL over the tables by name."""
        for n, t in self.tables.items():
            t.current().createOrReplaceTempView(n)
        return self.spark.sql(query, args=args or None)

    # transactions

    @property
    def state(self) -> str:
        """idle, pending (something is queued), running (a flush) or stopping (more was queued meanwhile)."""
        return self._state

    @state.setter
    def state(self, now: str) -> None:
        if now != self._state:
            self._state = now
            for call in list(self._watchers):
                call(now)

    def observe_state(self, call: Callable[[str], None]) -> Callable[[], None]:
        self._watchers.append(call)
        return lambda: self._watchers.remove(call)

    def _working(self) -> dict[str, _Work]:
        return getattr(self._own, "work", None) or {}

    def _some(self, df: DataFrame | None, label: str) -> DataFrame | None:
        """df, stored, or None if it has no rows."""
        if df is None:
            return None
        if not self.stored:
            return None if df.isEmpty() else df
        df, n = staged_counted(df, label)
        return df if n else None

    def _do(self, table: Table, plus: DataFrame | None, less: DataFrame | None, touched: Predicate | None) -> None:
        """A mutation within a transaction: plus has rows that aren't there yet, less has rows that are. touched holds for all of both, if known."""
        change = Change(self._some(plus, "plus"), self._some(less, "less"))
        if change.added is None and change.removed is None:
            return
        work = self._own.work
        before = work.get(table.name)
        depth = 1 if before is None else before.depth + 1
        if before is not None:
            change = before.change.then(change)
            if depth > FLAT:
                change, depth = Change(self._some(change.added, "added"), self._some(change.removed, "removed")), 0
        rows = _Version(table._rows, change.added, change.removed).rows()
        known = touched is not None and (before is None or before.touched is not None)
        work[table.name] = _Work(change, rows, [*(before.touched if before else []), touched] if known else None, depth)

    @contextmanager
    def transaction(self, tags: Iterable[object] = ()) -> Iterator[Database]:
        """Changes within are committed together, or not at all if it raises. Inner transactions join the outer one."""
        if getattr(self._own, "work", None) is not None:
            yield self
            return
        with self._lock:
            self._own.work = {}
            try:
                yield self
                done = self._own.work
            finally:
                self._own.work = None
            self._commit(done, set(tags))

    def transaction_with_snapshots(self, action: Callable[[Database], object], tags: Iterable[object] = ()) -> tuple[Snapshot, Snapshot]:
        """Snapshots of before and after an action in one transaction, with no other commit between them."""
        with self._lock:
            before = self.snapshot()
            with self.transaction(tags):
                action(self)
            return before, self.snapshot()

    def run(self, action: Callable[[Database], object], retry: Callable[[Exception], bool] = lambda e: False, most: int = 10, pause: float = 0.01) -> object:
        """An action in a transaction, again from the start while ``retry`` accepts what it raises."""
        for turn in range(most):
            try:
                with self.transaction():
                    return action(self)
            except Exception as e:
                if turn == most - 1 or not retry(e):
                    raise
                time.sleep(pause)
        return None

    def _commit(self, done: dict[str, _Work], tags: set) -> None:
        changes: dict[Relation, LeafChange] = {}
        touched: dict[Relation, list[Predicate] | None] = {}
        for name, w in done.items():
            t = self.tables[name]
            change = w.change if w.depth == 1 else Change(self._some(w.change.added, "added"), self._some(w.change.removed, "removed"))
            if change.added is None and change.removed is None:
                continue
            before = t._rows
            t._version = self._next(t._version, change, name)
            t._rows = t._version.rows()
            changes[t] = LeafChange(change.added, change.removed, before, t._rows)
            touched[t] = w.touched
        self.version += bool(changes)
        if changes:
            self._notify(changes, touched, tags)
            self._committed = {t.name: Change(c.added, c.removed) for t, c in changes.items()}  # after what observers may have committed
            if self.save_to is not None:
                self.save(self.save_to)

    def _next(self, v: _Version, change: Change, name: str) -> _Version:
        """The version after a change: an overlay on the same base, or a new base if that is large."""
        if not self.stored:
            return _Version(_Version(v.rows(), change.added, change.removed).rows())
        whole = Change(v.added, v.removed).then(change)
        first = v.added is None and v.removed is None
        whole = change if first else Change(self._some(whole.added, f"{name}-added"), self._some(whole.removed, f"{name}-removed"))
        size = sum(x.count() for x in (whole.added, whole.removed) if x is not None)
        n = v.base.count() if v.n is None else v.n
        made = _Version(v.base, whole.added, whole.removed, n)
        if size > COMPACT_ROWS and size > COMPACT_SHARE * n or (size and n == 0):
            return _Version(staged(made.rows(), name))
        return made

    def _notify(self, changes: dict[Relation, LeafChange], touched: dict[Relation, list[Predicate] | None], tags: set) -> None:
        for o in [o for o in self._observers if o.alive]:
            below = [t for t in changes if t in o.relation.leaves()]
            if not below:
                continue
            if all(touched[t] is not None and all(unaffected(o.relation, t, p) for p in touched[t]) for t in below):
                self.skipped += 1
                continue
            change = derivative(o.relation, changes)
            if self.stored and o.relation not in changes:  # computed once, for the test and for the observer
                change = Change(self._some(change.added, "seen-added"), self._some(change.removed, "seen-removed"))
            if change.is_empty():
                continue
            none = o.relation.df().limit(0)
            if o.content:
                o.call(o.relation.df(), tags)
            else:
                o.call(Change(*(none if x is None else x for x in (change.added, change.removed))), tags)

    # observers

    def observe(self, relation: Relation, call: Callable[[Change, set], None]) -> Callable[[], None]:
        """call(change, tags) after each commit that changes the relation; returns what ends it."""
        return self._observe(_Observer(relation, call, False))

    def observe_content(self, relation: Relation, call: Callable[[DataFrame, set], None]) -> Callable[[], None]:
        return self._observe(_Observer(relation, call, True))

    def _observe(self, o: _Observer) -> Callable[[], None]:
        self._observers.append(o)

        def end() -> None:
            o.alive = False
            self._observers.remove(o)

        return end

    # queued actions: one flush is one transaction

    def later(self, run: Callable[[], object], tag: object = None, touches: dict[str, Predicate | None] | None = None) -> None:
        self._queue.append(_Queued(run, tag, touches or {}))
        self.state = "pending"

    def add_later(self, table: str, *rows: dict, tag: object = None) -> None:
        self.later(lambda: self[table].add(*rows), tag, {table: None})

    def delete_later(self, table: str, where: object, tag: object = None) -> None:
        self.later(lambda: self[table].delete(where), tag, {table: R._predicate(where)})

    def update_later(self, relation: Relation, where: object, new: dict[str, object], tag: object = None) -> None:
        from relspan.operators.viewupdate import update

        self.later(lambda: update(relation, where, new), tag, {t.name: None for t in relation.leaves() if isinstance(t, Table)})

    def restore_later(self, snapshot: Snapshot, tag: object = None) -> None:
        self.later(lambda: self.restore(snapshot), tag)

    def apply_later(self, delta: Delta, tag: object = None) -> None:
        self.later(lambda: self.apply(delta), tag)

    def flush(self) -> None:
        """Run what is queued, in order and in one transaction; what is queued meanwhile follows in another."""
        while self._queue:
            batch, self._queue = self._queue, []
            self.state = "running"
            try:
                with self.transaction(q.tag for q in batch):
                    for q in batch:
                        q.run()
            finally:
                self.state = "stopping" if self._queue else "idle"
        self.state = "idle"

    # snapshots, deltas, undo

    def snapshot(self) -> Snapshot:
        return {n: t.current() for n, t in self.tables.items()}

    def restore(self, snapshot: Snapshot) -> None:
        with self.transaction():
            for n, rows in snapshot.items():
                self[n].replace_all(rows)

    @staticmethod
    def delta(before: Snapshot, after: Snapshot) -> Delta:
        return {n: Change(R.minus(after[n], before[n]), R.minus(before[n], after[n])) for n in after if n in before and after[n] is not before[n]}

    @staticmethod
    def reversed(delta: Delta) -> Delta:
        return {n: c.reversed() for n, c in delta.items()}

    def apply(self, delta: Delta) -> None:
        with self.transaction():
            for n, c in delta.items():
                t = self[n]
                plus, less = c.added, None if c.removed is None else R.meet(t.current(), c.removed)
                less = less if less is None or plus is None else R.minus(less, plus)
                self._do(t, None if plus is None else R.minus(plus, R.meet(t.current(), plus)), less, None)

    def undoable(self, name: str, action: Callable[[Database], object]) -> None:
        before = self.snapshot() if self._working() or getattr(self._own, "work", None) is not None else None
        self._committed = {}
        with self.transaction():
            action(self)
        forth = self._committed if before is None else self.delta(before, self.snapshot())  # within another transaction nothing is committed yet
        self._done.append((name, forth, self.reversed(forth)))
        self._undone.clear()

    def undo(self) -> str | None:
        if not self._done:
            return None
        self._undone.append(self._done.pop())
        self.apply(self._undone[-1][2])
        return self._undone[-1][0]

    def redo(self) -> str | None:
        if not self._undone:
            return None
        self._done.append(self._undone.pop())
        self.apply(self._done[-1][1])
        return self._done[-1][0]

    # durable form: a folder of Parquet, a new version beside the old, then the pointer

    def save(self, folder: str, retry: Callable[[Exception], bool] = lambda e: False, most: int = 10, pause: float = 0.01) -> None:
        """Write all tables as a new version in folder, and point to it last, with no commit meanwhile; again while ``retry`` accepts what
        that raises. A version that wasn't finished is never pointed to."""
        for turn in range(most):
            try:
                with self._lock:
                    return self._save(folder)
            except Exception as e:
                if turn == most - 1 or not retry(e):
                    raise
                time.sleep(pause)

    def _save(self, folder: str) -> None:
        version = f"v{self.version}-{int(time.time() * 1000)}"
        for n, t in self.tables.items():
            t.current().write.parquet(f"{folder}/{version}/{n}")
        meta = [(version, n, list(t.key)) for n, t in self.tables.items()]
        self.spark.createDataFrame(meta, "version string, name string, key array<string>").coalesce(1).write.mode("append").parquet(f"{folder}/versions")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: str | None = None) -> Database:
        db = cls(spark)
        listed = spark.read.parquet(f"{folder}/versions")
        last = version or listed.agg(F.max_by("version", F.substring_index("version", "-", -1).cast("long"))).first()[0]
        for r in listed.where(F.col("version") == last).collect():  # a row a table
            db.create(r.name, spark.read.parquet(f"{folder}/{last}/{r.name}"), r.key)
        return db


def unaffected(view: Relation, table: Table, where: Predicate) -> bool:
    """Whether changing the table's rows that hold ``where`` provably leaves the view as it is: all ways from the view to the
    table go through selections that exclude it."""
    if view is table:
        return False
    if table not in view.leaves():
        return True
    if isinstance(view, R.Select) and view.children[0] is table:
        return exclusive(view.where, where)
    return all(unaffected(c, table, where) for c in view.children)
