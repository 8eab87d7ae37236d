"""Fixpoints over relations: recursive selection, cascading deletion, tree deletion, and paths of a tree.

Each round joins a frontier with the relations and drops what has been visited, so cycles end. Rounds are stored, not nested; a frontier that
a count has shown to be small is broadcast, so that a round scans the relations without shuffling them. What decides by the
row where to go on is a callback (``recursive_fold``, ``cascading_delete_by``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.functions.predicates import Attr, Or, Predicate, combined
from relspan.plans import relation as R
from relspan.plans.relation import Relation, quoted
from relspan.sources.scratch import staged, staged_counted
from relspan.sources.tables import Database, Table


#: Rows of a frontier up to which it is broadcast; rounds after which what has been visited is stored as one table.
FEW, FLAT = 100_000, 16


@dataclass(frozen=True)
class Edge:
    """Rows of ``source`` lead, by their value of source_attribute, to rows of ``target`` with that value."""

    source: str
    source_attribute: str
    target: str
    target_attribute: str


def reach(relations: dict[str, DataFrame], start: dict[str, DataFrame], edges: list[Edge], most_rounds: int = 1000) -> dict[str, DataFrame]:
    """All rows reached from the start rows, by relation; the start is included. A NULL leads nowhere."""
    visited, count = {}, {}
    for n, rows in start.items():
        visited[n], count[n] = staged_counted(rows.distinct(), f"start-{n}")
    frontier = dict(visited)
    for turn in range(most_rounds):
        found: dict[str, list[DataFrame]] = {}
        for e in edges:
            if e.source not in frontier:
                continue
            values = frontier[e.source].select(quoted(e.source_attribute).alias("__value")).where("__value IS NOT NULL").distinct()
            values = F.broadcast(values) if count[e.source] <= FEW else values
            rows = relations[e.target]
            found.setdefault(e.target, []).append(rows.join(values, rows[f"`{e.target_attribute}`"] == values["__value"], "left_semi"))
        frontier = {}
        for n, parts in found.items():
            fresh = parts[0]
            for p in parts[1:]:
                fresh = fresh.unionByName(p)
            fresh, count[n] = staged_counted((R.minus(fresh, visited[n]) if n in visited else fresh).distinct(), f"frontier-{n}")
            if count[n]:
                frontier[n] = fresh
                visited[n] = fresh if n not in visited else visited[n].unionByName(fresh)
                if turn % FLAT == FLAT - 1:
                    visited[n] = staged(visited[n], f"visited-{n}")
        if not frontier:
            return visited
    raise RuntimeError(f"not ended after {most_rounds} rounds")


def recursive_select(relations: dict[str, Relation], start: str, where: object, edges: list[Edge]) -> dict[str, Relation]:
    """Rows of several relations reached by edges from those of ``start`` that hold ``where``."""
    rows = {n: r.df() for n, r in relations.items()}
    got = reach(rows, {start: relations[start].select(where).df()}, edges)
    return {n: R.Leaf(df, clean=True, name=n) for n, df in got.items()}


Asked = tuple[str, str, object]  # rows of a relation with a value of an attribute


def recursive_fold(relations: dict[str, Relation], start: Asked, initial: object, row: Callable[[object, str, dict], tuple[object, list[Asked]]], keep: Callable[[object, list[Asked]], list[Asked]] | None = None, most_rounds: int = 1000) -> object:
    """Breadth-first search that decides row by row: row(state, relation, row) returns the next state and what to ask for then.

    keep(state, asked) may drop some of it; what has been asked before is dropped anyway, so cycles end. A round asks each relation once
    for all values of an attribute. The rows found pass through the driver one by one, as the callback's state does; where edges are enough,
    recursive_select does the same in the executors.
    """
    state, asked, done = initial, [start], set()
    for _ in range(most_rounds):
        asked = [q for q in dict.fromkeys(asked) if q not in done]
        asked = keep(state, asked) if keep is not None else asked
        if not asked:
            return state
        done.update(asked)
        together: defaultdict[tuple[str, str], list] = defaultdict(list)
        for n, attribute, value in asked:
            together[n, attribute].append(value)
        asked = []
        for (n, attribute), values in together.items():
            for r in _with_values(relations[n], attribute, values).rows():
                state, more = row(state, n, r)
                asked += more
    raise RuntimeError(f"not ended after {most_rounds} rounds")


def _with_values(relation: Relation, attribute: str, values: list) -> Relation:
    if len(values) <= 100:
        return relation.select(combined([Attr(attribute) == v for v in values], Or))
    df = relation.df()
    own = df.sparkSession.createDataFrame([(v,) for v in values], df.select(quoted(attribute).alias("__value")).schema)
    return R.Leaf(R.null_safe(df, own, [(attribute, "__value")], "left_semi"), clean=True)


@dataclass
class CascadingUpdate:
    """After a deletion: set attributes of a table's rows from the only row of ``source``; none if it has no or several."""

    table: str
    where: Predicate | dict
    source: Relation
    attributes: dict[str, str] = field(default_factory=dict)  # of the table to those of source


def cascading_delete(db: Database, start: str, where: object, edges: list[Edge], updates: list[CascadingUpdate] = ()) -> dict[str, DataFrame]:
    """Delete the rows that hold ``where`` and all that edges lead to, in one transaction; returns the rows deleted."""
    with db.transaction():
        rows = {n: t.current() for n, t in db.tables.items()}
        gone = reach(rows, {start: rows[start].where(R._predicate(where).holds(db[start].types))}, edges)
        for n, df in gone.items():
            db[n].remove_all(df)
        _after(db, updates)
    return gone


def cascading_delete_by(db: Database, start: str, where: object, cascade: Callable[[str, DataFrame], tuple[list[tuple[str, object]], list[CascadingUpdate]]], most_rounds: int = 1000) -> dict[str, DataFrame]:
    """Delete rows and what follows from them, in one transaction: cascade(table, deleted rows) returns further (table, predicate) deletions, and
    updates that are made after all deletions. Rounds end when a deletion finds nothing. Returns the rows deleted."""
    gone: dict[str, DataFrame] = {}
    updates: list[CascadingUpdate] = []
    with db.transaction():
        asked = [(start, where)]
        for _ in range(most_rounds):
            if not asked:
                break
            following = []
            for n, p in asked:
                t = db[n]
                rows, found = staged_counted(t.current().where(R._predicate(p).holds(t.types)), f"gone-{n}")
                if not found:
                    continue
                t.remove_all(rows)
                gone[n] = rows if n not in gone else gone[n].unionByName(rows)
                more, then = cascade(n, rows)
                following += more
                updates += then
            asked = following
        else:
            raise RuntimeError(f"not ended after {most_rounds} rounds")
        _after(db, updates)
    return gone


def _after(db: Database, updates: list[CascadingUpdate]) -> None:
    for u in updates:
        only = u.source.one_row()
        if only is not None:
            db[u.table].update(u.where, {a: only[b] for a, b in u.attributes.items()})


def tree_delete(table: Table, where: object, parent: str, child: str) -> DataFrame:
    """Delete rows and all their descendants: rows whose ``child`` attribute has a deleted row's ``parent`` value."""
    return cascading_delete(table.db, table.name, where, [Edge(table.name, parent, table.name, child)])[table.name]


def tree_paths(nodes: Relation, ident: str, parent: str, order: str | None = None, most_depth: int = 1000) -> DataFrame:
    """(ident, depth, path) of every node under a root (a NULL parent); path orders siblings by ``order``, then ident."""
    own = nodes.df().select(quoted(ident).alias("__id"), quoted(parent).alias("__parent"), F.array(F.struct(quoted(order or ident).cast("string").alias("o"), quoted(ident).cast("string").alias("i"))).alias("__step"))
    level = staged(own.where("__parent IS NULL").select("__id", F.lit(0).alias("depth"), F.col("__step").alias("path")), "level")
    out = level
    for _ in range(most_depth):
        above = level.withColumnRenamed("__id", "__above")
        below = own.where("__parent IS NOT NULL").join(above, F.col("__parent") == F.col("__above"))
        level, found = staged_counted(below.select("__id", (F.col("depth") + 1).alias("depth"), F.concat("path", "__step").alias("path")), "level")
        if not found:
            return out.withColumnRenamed("__id", ident)
        out = out.unionByName(level)
    raise RuntimeError(f"deeper than {most_depth}; is there a cycle?")
