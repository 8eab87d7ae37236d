"""Relations: lazy expression trees over sets of rows that compile to DataFrames.

A relation has attributes (its scheme) and no duplicate rows. Trees stay symbolic, so that changes can be derived
and updates pushed down; compiling gives one declarative DataFrame plan for Catalyst. distinct() is added only where an operator
can make duplicates and no known key rules them out.
"""

from __future__ import annotations

import itertools
import math
import re
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions import values as V
from relspan.functions.predicates import FALSE, TRUE, And, Attr, Compare, Or, Predicate, Types, as_predicate, combined, row_matches
from relspan.sources.shipping import ship

_POOL = ThreadPoolExecutor(4, "relspan")
#: While it is a list: (node, seconds) of each node compiled, children before parents. See ``watched``.
ACTIVITY: list[tuple[str, float]] | None = None
#: Of a join without keys: bytes times bytes from which its rows are dealt evenly, rows of a side that goes to all tasks, bytes that stand for no estimate.
PRODUCT, SMALL, UNKNOWN = 1 << 34, 500_000, 1 << 60
#: Of a join by order: pairs for which there is a task, such tasks at most, rows in a range of values, ranges at most.
PAIRS, TASKS, RANGE, RANGES = 1 << 28, 10_000, 512, 1024
Env = dict[int, DataFrame]  # a leaf's id() to the rows it stands for


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def cols(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.select(*map(quoted, names))


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], how: str) -> DataFrame:
    """Join on pairs of columns, NULL meeting NULL; both sides keep their columns, whose names must differ but for semi and anti."""
    if not pairs:
        return left.join(right, F.lit(True), how) if how != "inner" else left.crossJoin(right)
    a, b = left.alias("a"), right.alias("b")
    q = lambda side, n: F.col(f"{side}.`{n.replace('`', '``')}`")
    return a.join(b, reduce(lambda x, y: x & y, (q("a", m).eqNullSafe(q("b", n)) for m, n in pairs)), how)


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of set a that b lacks. One anti-join: a has no duplicates, so none are removed again."""
    return null_safe(a, b, [(c, c) for c in a.columns], "left_anti")


def meet(a: DataFrame, b: DataFrame) -> DataFrame:
    return null_safe(a, b, [(c, c) for c in a.columns], "left_semi")


def estimated(df: DataFrame) -> int:
    """Bytes as Spark's optimizer estimates them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of a join that may make far more rows than they have, as neither is known to have a key among what is matched. Left to their own
    bytes, few tasks would make them all: where the sides aren't small, one of at most SMALL rows goes to all tasks and the other is dealt evenly."""
    a, b = estimated(left), estimated(right)
    if a * b < PRODUCT or max(a, b) >= UNKNOWN:
        return left, right
    for small in (left, right) if a < b else (right, left):
        if small.count() <= SMALL:
            parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return (F.broadcast(left), right.repartition(parts)) if small is left else (left.repartition(parts), F.broadcast(right))
    return left, right


def in_order(left: DataFrame, right: DataFrame, a: str, b: str, up: bool) -> DataFrame | None:
    """Of the product of two sides that aren't small, all pairs in which the left's number a is at most (``up``) or at least the right's b, and few
    others; None where a product is planned as always. The values of the side that goes to all tasks are cut into ranges. A row of the other is
    compared only with ranges that may hold values in order with its own. A task goes through one range after another, each with all of its rows: so few
    rows wait to be passed on, and equal columns of the result lie near each other, which files store in few bytes."""
    x, y = estimated(left), estimated(right)
    if x * y < PRODUCT or max(x, y) >= UNKNOWN:
        return None
    for small, large, v, w in ((left, right, a, b), (right, left, b, a)) if x < y else ((right, left, b, a), (left, right, a, b)):
        if (n := small.count()) <= SMALL:
            k = min(RANGES, max(1, n // RANGE))
            cuts = small.select(F.percentile_approx(quoted(v).cast("double"), [i / k for i in range(1, k)] or [0.5], 10_000)).first()[0] or []
            cuts = F.array(*map(F.lit, sorted({c for c in cuts if math.isfinite(c)}))).cast("array<double>")
            range_of = lambda c: F.size(F.filter(cuts, lambda x: x <= quoted(c).cast("double")))  # noqa: E731  # NULL is least: 0
            parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(TASKS, n * large.count() // PAIRS))
            first, last = (F.lit(0), range_of(w)) if (small is left) == up else (range_of(w), F.size(cuts))
            asked = large.repartition(parts).select("*", F.explode(F.sequence(first, last, F.lit(1))).alias("__asked")).sortWithinPartitions("__asked")
            # Spark drops a sort just below a join, but not below a generator
            asked = asked.withColumn("__range", F.explode(F.array("__asked"))).drop("__asked")
            return asked.join(F.broadcast(small.withColumn("__range", range_of(v))), "__range").drop("__range")
    return None


def natural(text: str) -> list[tuple[int, int, str]]:
    """A sort key by which 9 comes before 10."""
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"[0-9]+|[^0-9]+", text)]


def _shown(v: object) -> str:
    return "NULL" if v is None else bytes(v).hex() if isinstance(v, bytes | bytearray) else str(v)


class Relation:
    """Base of all nodes; the fluent operators are here, each node only compiles itself."""

    children: tuple[Relation, ...] = ()
    keys: frozenset[frozenset[str]] = frozenset()
    name: str | None = None

    # -- what a node defines

    @cached_property
    def types(self) -> Types:
        return {f.name: f.dataType for f in self.df().schema.fields}

    @property
    def scheme(self) -> tuple[str, ...]:
        return tuple(sorted(self.types))

    def build(self, env: Env) -> DataFrame:
        raise NotImplementedError

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        raise NotImplementedError

    # -- compiling and fetching

    def df(self, env: Env | None = None, memo: dict[int, DataFrame] | None = None) -> DataFrame:
        """The rows; columns in order of name. env replaces leaves; memo shares subtrees within one compilation."""
        memo = {} if memo is None else memo
        if id(self) not in memo:
            began = time.perf_counter()
            made = self.build(_Compiling(env or {}, memo))
            memo[id(self)] = cols(made, sorted(made.columns))
            if ACTIVITY is not None:
                ACTIVITY.append((self.name or self.label(), time.perf_counter() - began))
        return memo[id(self)]

    def rows(self) -> Iterator[dict[str, object]]:
        for r in self.df().toLocalIterator(prefetchPartitions=True):
            yield r.asDict()

    def bulk_rows(self, size: int = 1000) -> Iterator[list[dict[str, object]]]:
        it = self.rows()
        while batch := list(itertools.islice(it, size)):
            yield batch

    def collect_async(self, postprocess: Callable[[list[dict]], object] | None = None) -> Future:
        return _POOL.submit(lambda: (postprocess or (lambda x: x))([r.asDict() for r in self.df().collect()]))

    def fetch_async(self, call: Callable[[list[dict[str, object]]], None], size: int = 1000) -> Future:
        """call(rows) for batch after batch in another thread, as they come; an empty batch is the last."""

        def run() -> None:
            for batch in self.bulk_rows(size):
                call(batch)
            call([])

        return _POOL.submit(run)

    def contains(self, row: dict[str, object]) -> bool:
        if set(row) != set(self.scheme):
            return False
        return not self.select(row).is_empty()

    def is_empty(self) -> bool:
        return self.df().isEmpty()

    def text(self, n: int = 20) -> str:
        """At most n rows as a table of text, columns in order of name, rows in the order in which people count."""
        names = list(self.scheme)
        got = [[_shown(r[k]) for k in names] for r in self.df().limit(n + 1).collect()]
        lines = [names, *sorted(got[:n], key=lambda r: [natural(v) for v in r])]
        wide = [max(len(r[k]) for r in lines) for k in range(len(names))]
        out = ["  ".join(v.ljust(w) for v, w in zip(r, wide)).rstrip() for r in lines]
        return "\n".join([*out, *(["..."] if len(got) > n else [])])

    def show(self, n: int = 20) -> None:
        print(self.text(n))

    def one_row(self) -> dict[str, object] | None:
        """The only row, or None if there are none or several."""
        got = self.df().limit(2).collect()
        return got[0].asDict() if len(got) == 1 else None

    def one_value(self) -> object:
        row = self.one_row()
        if len(self.scheme) != 1:
            raise ValueError("one_value needs a single attribute")
        return None if row is None else row[self.scheme[0]]

    # -- set operators

    def union(self, other: Relation) -> Relation:
        return Union(self, other)

    def intersection(self, other: Relation) -> Relation:
        return Intersection(self, other)

    def difference(self, other: Relation) -> Relation:
        return Difference(self, other)

    __add__, __sub__, __and__ = union, difference, intersection

    # -- projection, renaming, constants

    def project(self, *names: str) -> Relation:
        return Project(self, names)

    def project_dropping(self, *names: str) -> Relation:
        return Project(self, [a for a in self.scheme if a not in names])

    def rename(self, names: dict[str, str]) -> Relation:
        return Rename(self, names)

    def rename_prime(self) -> Relation:
        return Rename(self, {a: a + "'" for a in self.scheme})

    def project_renamed(self, names: dict[str, str]) -> Relation:
        return self.project(*names).rename(names)

    def with_update(self, new: dict[str, object], where: object | None = None) -> Relation:
        """The rows with constants for some attributes; with ``where``, in the rows that match alone."""
        return Update(self, new, TRUE if where is None else _predicate(where))

    # -- selection

    def select(self, where: object) -> Relation:
        return Select(self, _predicate(where))

    def mutable_select(self, where: object) -> MutableSelect:
        return MutableSelect(self, _predicate(where))

    def split(self, where: object) -> tuple[Relation, Relation]:
        p = _predicate(where)
        return Select(self, p), Select(self, ~p)

    # -- joins

    def equijoin(self, other: Relation, matching: dict[str, str], narrow: int = 0) -> Relation:
        """narrow: if self has at most so many distinct values to match, they are looked up first and other is asked for these alone."""
        return Equijoin(self, other, matching, narrow)

    def join(self, other: Relation) -> Relation:
        """Natural join; with no attribute in common, the product."""
        common = sorted(set(self.scheme) & set(other.scheme))
        hidden = {c: f"__right {c}" for c in common}
        both = Equijoin(self, Rename(other, hidden) if hidden else other, hidden)
        return Project(both, [a for a in both.scheme if a not in hidden.values()], lossless=True) if hidden else both

    def thetajoin(self, other: Relation, where: object) -> Relation:
        return self.join(other).select(where)

    def left_outer_join(self, other: Relation) -> Relation:
        return LeftOuter(self, other)

    def divide(self, other: Relation) -> Relation:
        return Divide(self, other)

    # -- aggregates and conditions

    def min(self, attribute: str) -> Relation:
        c = quoted(attribute)
        return Aggregate(self, attribute, lambda: F.when(F.count_if(c.isNull()) > 0, F.lit(None)).otherwise(F.min(c)), f"min({attribute})")

    def max(self, attribute: str) -> Relation:
        return Aggregate(self, attribute, lambda: F.max(quoted(attribute)), f"max({attribute})")

    def count(self) -> Relation:
        return Aggregate(self, "count", lambda: F.count("*"), "count", on_empty=True)

    def aggregate(self, attribute: str, make: Callable[[], Column], on_empty: bool = False) -> Relation:
        """Any aggregate expression of columns as a relation of one attribute; no row for no rows unless on_empty."""
        return Aggregate(self, attribute, make, "custom", on_empty)

    def fold(self, attribute: str, initial: object, step: Callable[[object, object], object], merge: Callable[[object, object], object], kind: str, on_empty: bool = True, arrow: bool = False) -> Relation:
        """A Python fold over batches in every partition, merged over the partitions' states. step gets lists of rows as dicts, or with
        ``arrow`` record batches, which need no object a row."""
        return Fold(self, attribute, initial, step, merge, kind, on_empty, arrow)

    def otherwise(self, other: Relation) -> Relation:
        return Otherwise(self, other)

    def unique(self, attribute: str, matching: object, strict: bool = True) -> Relation:
        """All rows if they share one value of the attribute, and (strict) it is ``matching``; else none."""
        return Unique(self, attribute, matching, strict)

    def cache(self, up_to: int) -> Relation:
        return Cached(self, up_to)

    def named(self, name: str) -> Relation:
        self.name = name
        return self

    # -- looking at trees

    def label(self) -> str:
        return type(self).__name__

    def dump(self, depth: int = 0) -> str:
        own = "  " * depth + (f"{self.name}: " if self.name else "") + self.label()
        return "\n".join([own, *(c.dump(depth + 1) for c in self.children)])

    def dump_unique(self) -> str:
        """One numbered line a node, however often it is used; children by number."""
        number: dict[int, int] = {}
        lines: list[str] = []

        def visit(r: Relation) -> int:
            if id(r) not in number:
                below = [visit(c) for c in r.children]
                number[id(r)] = len(number) + 1
                lines.append(f"{number[id(r)]}: " + (f"{r.name}: " if r.name else "") + r.label() + (f" of {', '.join(map(str, below))}" if below else ""))
            return number[id(r)]

        visit(self)
        return "\n".join(lines)

    def plan_graphviz(self) -> str:
        """Spark's physical plan as a graph."""
        lines = [x for x in self.df()._jdf.queryExecution().executedPlan().toString().splitlines() if x.strip()]
        nodes, edges, open_at = [], [], []
        for n, line in enumerate(lines):
            text = line.lstrip(" :+-*")
            depth = len(line) - len(text)
            open_at = [(d, k) for d, k in open_at if d < depth]
            nodes.append(f'  p{n} [label="{text[:60].replace(chr(34), chr(39))}"];')
            if open_at:
                edges.append(f"  p{open_at[-1][1]} -> p{n};")
            open_at.append((depth, n))
        return "\n".join(["digraph plan {", *nodes, *edges, "}"])

    def graphviz(self) -> str:
        seen: dict[int, Relation] = {}

        def visit(r: Relation) -> None:
            if id(r) not in seen:
                seen[id(r)] = r
                for c in r.children:
                    visit(c)

        visit(self)
        number = {k: n for n, k in enumerate(seen)}
        nodes = [f'  n{number[k]} [label="{r.name or r.label()}"];' for k, r in seen.items()]
        edges = [f"  n{number[k]} -> n{number[id(c)]};" for k, r in seen.items() for c in r.children]
        return "\n".join(["digraph relation {", *nodes, *edges, "}"])

    def code(self) -> str:
        """The tree as a chain of calls; leaves by name."""
        if not self.children:
            return self.name or "leaf"
        first, *rest = [c.code() for c in self.children]
        call = lambda name, *args: f"{first}.{name}({', '.join(args)})"
        match self:
            case Select():
                return call("select", self.where.code())
            case Project():
                return call("project", *map(repr, self.names))
            case Rename():
                return call("rename", repr({a: b for a, b in self.names.items() if a != b}))
            case Update():
                return call("with_update", repr(self.new), *([] if self.where is TRUE else [self.where.code()]))
            case Equijoin():
                return call("equijoin", rest[0], repr(self.matching), *([f"narrow={self.narrow}"] if self.narrow else []))
            case Unique():
                return call("unique", repr(self.attribute), repr(self.matching), *([] if self.strict else ["strict=False"]))
            case Cached():
                return call("cache", str(self.up_to))
            case Aggregate():
                return call("count") if self.what == "count" else call(self.what.split("(")[0], repr(self.attribute))
            case Fold():
                return call("fold", repr(self.attribute), "...")
            case LeftOuter():
                return call("left_outer_join", *rest)
        return call(type(self).__name__.lower(), *rest)

    def leaves(self) -> list[Relation]:
        out: dict[int, Relation] = {}
        for c in self.children:
            out |= {id(x): x for x in c.leaves()}
        return list(out.values()) if self.children else [self]


class _Compiling:
    """What a node needs to build itself: replaced leaves, and children already compiled."""

    def __init__(self, env: Env, memo: dict[int, DataFrame]) -> None:
        self.env, self.memo = env, memo

    def __call__(self, r: Relation) -> DataFrame:
        return r.df(self.env, self.memo)


def _predicate(where: object) -> Predicate:
    return row_matches(where) if isinstance(where, dict) else as_predicate(where)


class Leaf(Relation):
    """Rows from a DataFrame. Unless a key is declared or ``clean`` says so, duplicates are removed."""

    def __init__(self, data: DataFrame, keys: Iterable[Iterable[str]] = (), clean: bool = False, name: str | None = None) -> None:
        self.keys = frozenset(frozenset(k) for k in keys)
        self.name = name
        self._rows = data if clean or self.keys else data.distinct()

    @cached_property
    def types(self) -> Types:
        return {f.name: f.dataType for f in self._rows.schema.fields}

    def build(self, c: _Compiling) -> DataFrame:
        return c.env.get(id(self), self._rows)

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return self


def literal(spark: SparkSession, attributes: list[str], *rows: list[object], schema: str | None = None) -> Relation:
    """A relation of literal rows. Types follow from the values, or from schema where a column has none but NULL."""
    return Leaf(spark.createDataFrame([tuple(r) for r in rows], schema or (attributes if rows else T.StructType([T.StructField(a, T.StringType()) for a in attributes]))))


class _Pairwise(Relation):
    def __init__(self, left: Relation, right: Relation) -> None:
        if set(left.scheme) != set(right.scheme):
            raise ValueError(f"schemes differ: {left.scheme} and {right.scheme}")
        self.children = (left, right)
        self.types = left.types

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return type(self)(*children)


class Union(_Pairwise):
    def build(self, c: _Compiling) -> DataFrame:
        return c(self.children[0]).unionByName(c(self.children[1])).distinct()


class Disjoint(Union):
    """Union of sets that share no row; ``keys`` are those of a set that holds both."""

    def __init__(self, left: Relation, right: Relation, keys: Iterable[frozenset[str]] = ()) -> None:
        super().__init__(left, right)
        self.keys = frozenset(keys)

    def build(self, c: _Compiling) -> DataFrame:
        return c(self.children[0]).unionByName(c(self.children[1]))

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Disjoint(*children, self.keys)


class Intersection(_Pairwise):
    def __init__(self, left: Relation, right: Relation) -> None:
        super().__init__(left, right)
        self.keys = left.keys | right.keys

    def build(self, c: _Compiling) -> DataFrame:
        return meet(c(self.children[0]), c(self.children[1]))


class Difference(_Pairwise):
    def __init__(self, left: Relation, right: Relation) -> None:
        super().__init__(left, right)
        self.keys = left.keys

    def build(self, c: _Compiling) -> DataFrame:
        return minus(c(self.children[0]), c(self.children[1]))


class Project(Relation):
    def __init__(self, of: Relation, names: Iterable[str], lossless: bool = False) -> None:
        self.names = sorted(set(names))
        if missing := set(self.names) - set(of.scheme):
            raise ValueError(f"no attributes {sorted(missing)} among {of.scheme}")
        self.children, self.lossless = (of,), lossless
        self.keys = frozenset(k for k in of.keys if k <= set(self.names))
        self.types = {n: of.types[n] for n in self.names}

    def build(self, c: _Compiling) -> DataFrame:
        of = c(self.children[0])
        if not self.names:  # no attributes: one empty row if there is any
            return of.limit(1).select()
        out = cols(of, self.names)
        return out if self.keys or self.lossless else out.distinct()

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Project(children[0], self.names, self.lossless)

    def label(self) -> str:
        return f"Project {', '.join(self.names)}"


class Rename(Relation):
    def __init__(self, of: Relation, names: dict[str, str]) -> None:
        self.names = {a: names.get(a, a) for a in of.scheme}
        if set(names) - set(of.scheme) or len(set(self.names.values())) < len(self.names):
            raise ValueError(f"cannot rename {names} in {of.scheme}")
        self.children = (of,)
        self.keys = frozenset(frozenset(self.names[a] for a in k) for k in of.keys)
        self.types = {self.names[a]: t for a, t in of.types.items()}

    def build(self, c: _Compiling) -> DataFrame:
        return c(self.children[0]).select(*(quoted(a).alias(b) for a, b in self.names.items()))

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Rename(children[0], self.names)


class Select(Relation):
    def __init__(self, of: Relation, where: Predicate) -> None:
        if missing := where.attributes() - set(of.scheme):
            raise ValueError(f"no attributes {sorted(missing)} among {of.scheme}")
        self.children, self.where, self.keys, self.types = (of,), where, of.keys, of.types

    def build(self, c: _Compiling) -> DataFrame:
        of, order = self.children[0], self._order()
        return (c(of) if order is None else of.build(c, order)).where(self.where.holds(of.types))

    def _order(self) -> tuple[str, str, bool] | None:
        """Of a product's pairs, an attribute of each side whose order (left at most right, or at least) the predicate demands."""
        of, asked = self.children[0], [self.where]
        if not isinstance(of, Equijoin) or of.matching:
            return None
        while asked:
            p = asked.pop()
            if isinstance(p, And):
                asked += p.parts()
            elif isinstance(p, Compare) and p.op in ("lt", "le", "gt", "ge") and isinstance(p.left, Attr) and isinstance(p.right, Attr):
                (m, n), up = (p.left.name, p.right.name), p.op in ("lt", "le")
                if m in of.children[1].types:
                    m, n, up = n, m, not up
                kinds = {V.kind(of.types[m]), V.kind(of.types[n])}
                if m in of.children[0].types and n in of.children[1].types and kinds in ({1}, {2}):
                    return m, n, up
        return None

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Select(children[0], self.where)


class MutableSelect(Select):
    """A selection whose predicate can be set. set() returns the rows that came and went, and tells the observers of views over it."""

    def __init__(self, of: Relation, where: Predicate) -> None:
        super().__init__(of, where)
        self._observers: list[tuple[Relation, Callable]] = []

    def observe(self, view: Relation, call: Callable) -> Callable[[], None]:
        """call(change of view) whenever set() changes a view that is made of this selection; returns what ends it."""
        self._observers.append((view, call))
        return lambda: self._observers.remove((view, call))

    def set(self, where: object) -> tuple[DataFrame, DataFrame]:
        from relspan.plans.delta import between, derivative

        old = self.df()
        self.where = _predicate(where)
        own = between(old, self.df())
        for view, call in list(self._observers):
            change = derivative(view, {self: own})
            if not change.is_empty():
                call(change)
        return own.added, own.removed

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Select(children[0], self.where)


class Equijoin(Relation):
    """Inner join that keeps both sides' attributes; other attributes in common are an error."""

    def __init__(self, left: Relation, right: Relation, matching: dict[str, str], narrow: int = 0) -> None:
        self.narrow, self._asked = narrow, None
        if clash := set(left.scheme) & set(right.scheme):
            raise ValueError(f"both sides have {sorted(clash)}")
        if missing := (set(matching) - set(left.scheme)) | (set(matching.values()) - set(right.scheme)):
            raise ValueError(f"no attributes {sorted(missing)} to match")
        self.children, self.matching = (left, right), dict(matching)
        self.types = left.types | right.types
        keys = {a | b for a in left.keys for b in right.keys}
        keys |= {a for a in left.keys if any(k <= set(matching.values()) for k in right.keys)}
        keys |= {b for b in right.keys if any(k <= set(matching) for k in left.keys)}
        back = {b: a for a, b in matching.items()}
        self.keys = frozenset(keys | {frozenset(back.get(x, x) for x in k) for k in keys})

    def build(self, c: _Compiling, order: tuple[str, str, bool] | None = None) -> DataFrame:
        """With ``order``, see ``in_order``, of a product's pairs those in order and maybe others."""
        left, right = c(self.children[0]), self._right(c)
        pairs = [(a, b) for a, b in self.matching.items() if V.kind(self.types[a]) == V.kind(self.types[b])]
        if len(pairs) < len(self.matching):  # values of unlike kinds are equal only as NULLs
            for a, b in self.matching.items():
                if (a, b) not in pairs:
                    left, right = left.where(quoted(a).isNull()), right.where(quoted(b).isNull())
        if not any(k <= set(m) for x, m in zip(self.children, (self.matching, self.matching.values())) for k in x.keys):
            if order and (made := in_order(left, right, *order)) is not None:
                return made
            left, right = dealt(left, right)
        return null_safe(left, right, pairs, "inner")

    def _right(self, c: _Compiling) -> DataFrame:
        """The right side, or what of it can match the few values of the left."""
        if not self.narrow or not self.matching:
            return c(self.children[1])
        found = cols(c(self.children[0]), self.matching).distinct().limit(self.narrow + 1).collect()
        if len(found) > self.narrow:
            return c(self.children[1])
        some = combined([row_matches({b: r[a] for a, b in self.matching.items()}) for r in found], Or)
        self._asked = self.children[1].select(FALSE if some is None else some)  # kept, as plans are shared by identity
        return c(self._asked)

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Equijoin(*children, self.matching, self.narrow)

    def label(self) -> str:
        return f"Equijoin {self.matching}"


class _Composite(Relation):
    """A node with a plan of its own that is defined by simpler ones, for changes and updates."""

    def expanded(self) -> Relation:
        raise NotImplementedError

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return type(self)(*children)


class LeftOuter(_Composite):
    def __init__(self, left: Relation, right: Relation) -> None:
        self.children = (left, right)
        self.types = right.types | left.types

    def expanded(self) -> Relation:
        left, right = self.children
        inner = left.join(right)
        rest = left.difference(inner.project(*left.scheme))
        only = [a for a in right.scheme if a not in left.scheme]
        return inner.union(NullExtended(rest, {a: right.types[a] for a in only})) if only else left

    def build(self, c: _Compiling) -> DataFrame:
        left, right = map(c, self.children)
        common = [x for x in left.columns if x in right.columns]
        if len(common) == len(right.columns):
            return left
        hidden = right.select(*(quoted(x).alias(f"__right {x}" if x in common else x) for x in right.columns))
        return cols(null_safe(left, hidden, [(x, f"__right {x}") for x in common], "left"), self.scheme)


class NullExtended(Relation):
    """The rows with further attributes that are all NULL."""

    def __init__(self, of: Relation, more: Types) -> None:
        self.children, self.more = (of,), more
        self.types, self.keys = of.types | more, of.keys

    def build(self, c: _Compiling) -> DataFrame:
        return c(self.children[0]).select("*", *(F.lit(None).cast(t).alias(a) for a, t in self.more.items()))

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return NullExtended(children[0], self.more)


class Divide(_Composite):
    """What is left of self's attributes, for which self has every row of the divisor. Counts instead of a product."""

    def __init__(self, left: Relation, right: Relation) -> None:
        if not set(right.scheme) < set(left.scheme):
            raise ValueError("the divisor's attributes must be some of the dividend's")
        self.children = (left, right)
        self.rest = [a for a in left.scheme if a not in right.scheme]
        self.types = {a: left.types[a] for a in self.rest}

    def expanded(self) -> Relation:
        left, right = self.children
        candidates = left.project(*self.rest)
        return candidates.difference(candidates.join(right).difference(left).project(*self.rest))

    def build(self, c: _Compiling) -> DataFrame:
        left, right = map(c, self.children)
        hit = null_safe(left.withColumn("__all", F.lit(1)), right.withColumn("__hit", F.lit(1)).select(*(quoted(x).alias(f"__right {x}") for x in right.columns), "__hit"), [(x, f"__right {x}") for x in right.columns], "left")
        got = hit.groupBy(*map(quoted, self.rest)).agg(F.count("__hit").alias("__n"))
        return cols(got.join(F.broadcast(right.agg(F.count("*").alias("__m"))), F.col("__n") == F.col("__m")), self.rest)  # one row


class Update(Relation):
    def __init__(self, of: Relation, new: dict[str, object], where: Predicate = TRUE) -> None:
        if missing := (set(new) | where.attributes()) - set(of.scheme):
            raise ValueError(f"no attributes {sorted(missing)} among {of.scheme}")
        self.children, self.new, self.where, self.types = (of,), dict(new), where, of.types
        self.keys = frozenset(k for k in of.keys if not k & set(new))

    def build(self, c: _Compiling) -> DataFrame:
        of = c(self.children[0])
        hit = self.where.holds(self.types)
        out = of.select(*(F.when(hit, F.lit(self.new[a]).cast(self.types[a])).otherwise(quoted(a)).alias(a) if a in self.new else quoted(a) for a in of.columns))
        return out if self.keys else out.distinct()

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Update(children[0], self.new, self.where)

    def label(self) -> str:
        return f"Update {self.new}"


class Aggregate(Relation):
    """One row of one attribute, with partial sums in every task."""

    def __init__(self, of: Relation, attribute: str, make: Callable[[], Column], what: str, on_empty: bool = False) -> None:
        self.children, self.attribute, self.make, self.what, self.on_empty = (of,), attribute, make, what, on_empty
        self.keys = frozenset([frozenset()])

    def build(self, c: _Compiling) -> DataFrame:
        out = c(self.children[0]).agg(self.make().alias(self.attribute), F.count("*").alias("__n"))
        return cols(out if self.on_empty else out.where("__n > 0"), [self.attribute])

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Aggregate(children[0], self.attribute, self.make, self.what, self.on_empty)

    def label(self) -> str:
        return self.what


class Fold(Relation):
    def __init__(self, of: Relation, attribute: str, initial: object, step: Callable, merge: Callable, kind: str, on_empty: bool, arrow: bool = False) -> None:
        self.children, self.args, self.attribute = (of,), (attribute, initial, step, merge, kind, on_empty, arrow), attribute
        self.keys = frozenset([frozenset()])

    def build(self, c: _Compiling) -> DataFrame:
        import pickle

        import pyarrow as pa

        attribute, initial, step, merge, kind, on_empty, arrow = self.args

        def partial(batches):
            state, n = initial, 0
            for b in batches:
                n += b.num_rows
                if b.num_rows:
                    state = step(state, b if arrow else b.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary()), pa.array([n])], ["state", "n"])

        def final(batches):
            states = [pickle.loads(s) for b in batches for s, n in zip(b.column("state").to_pylist(), b.column("n").to_pylist()) if n]
            if states or on_empty:
                yield pa.RecordBatch.from_arrays([pa.array([reduce(merge, states) if states else initial])], [attribute])

        rows = c(self.children[0])
        ship(rows.sparkSession)
        # a state a partition is shuffled to one task; the rows are folded where they lie
        return rows.mapInArrow(partial, "state binary, n long").repartition(1).mapInArrow(final, f"`{attribute}` {kind}")

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Fold(children[0], *self.args)


class Otherwise(_Pairwise):
    def build(self, c: _Compiling) -> DataFrame:
        left, right = map(c, self.children)
        return left.unionByName(right.join(left.limit(1).select(F.lit(1).alias("__any")), F.lit(True), "left_anti"))


class Unique(Relation):
    def __init__(self, of: Relation, attribute: str, matching: object, strict: bool = True) -> None:
        self.children, self.attribute, self.matching, self.strict, self.types, self.keys = (of,), attribute, matching, strict, of.types, of.keys

    def build(self, c: _Compiling) -> DataFrame:
        of, a = c(self.children[0]), quoted(self.attribute)
        one = of.agg(F.min(a).alias("__lo"), F.max(a).alias("__hi"), F.count_if(a.isNull()).alias("__nulls"), F.count("*").alias("__n"))
        same = (F.col("__nulls") == F.col("__n")) | ((F.col("__nulls") == 0) & (F.col("__lo") == F.col("__hi")))
        if self.strict:
            test = Attr("__lo") == self.matching
            same &= test.holds({"__lo": self.types[self.attribute]})
        return cols(of.join(F.broadcast(one.where(same)), F.lit(True), "left_semi"), of.columns)  # one row

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Unique(children[0], self.attribute, self.matching, self.strict)


class Cached(Relation):
    """Keeps the rows in memory if there are at most up_to of them, until a table below has changed."""

    def __init__(self, of: Relation, up_to: int) -> None:
        self.children, self.up_to, self.types, self.keys = (of,), up_to, of.types, of.keys
        self._kept: DataFrame | None = None
        self._of: list[object] = []

    def build(self, c: _Compiling) -> DataFrame:
        if c.env:
            return c(self.children[0])
        below = [getattr(x, "current", lambda x=x: x)() for x in self.leaves()]
        if self._kept is None or any(a is not b for a, b in zip(below, self._of)):
            self.forget()
            rows = c(self.children[0])
            if rows.limit(self.up_to + 1).count() > self.up_to:
                return rows
            self._kept, self._of = rows.persist(), below
        return self._kept

    def forget(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
            self._kept = None

    def rebuilt(self, children: tuple[Relation, ...]) -> Relation:
        return Cached(children[0], self.up_to)


@contextmanager
def watched() -> Iterator[list[tuple[str, float]]]:
    """Collect what is compiled within, and how long each node took with what is below it."""
    global ACTIVITY
    was, ACTIVITY = ACTIVITY, []
    try:
        yield ACTIVITY
    finally:
        ACTIVITY = was


def evaluate_together(relations: Iterable[Relation]) -> list[list[dict[str, object]]]:
    """The rows of several relations; subtrees that more than one of them has are computed once."""
    relations = list(relations)
    parents: dict[int, set[int]] = {}
    nodes: dict[int, Relation] = {}

    def visit(r: Relation, parent: int) -> None:
        fresh = id(r) not in nodes
        nodes[id(r)] = r
        parents.setdefault(id(r), set()).add(parent)
        for child in r.children if fresh else ():
            visit(child, id(r))

    for k, r in enumerate(relations):
        visit(r, -1 - k)
    memo: dict[int, DataFrame] = {}
    kept = []

    def depth(r: Relation) -> int:
        return 1 + max(map(depth, r.children), default=0)

    shared = [r for r in nodes.values() if len(parents[id(r)]) > 1 and r.children]
    for r in sorted(shared, key=depth):  # what stands below is kept first
        memo[id(r)] = r.df(memo=memo).persist()
        kept.append(memo[id(r)])
    try:
        return [[x.asDict() for x in r.df(memo=memo).collect()] for r in relations]
    finally:
        for df in kept:
            df.unpersist()


def union_all(relations: Iterable[Relation | None]) -> Relation | None:
    """Union of those that aren't None, which stands for empty."""
    some = [r for r in relations if r is not None]
    return reduce(Union, some) if some else None


def disjoint_or_none(relations: Iterable[Relation | None], keys: Iterable[frozenset[str]]) -> Relation | None:
    """Union of those that aren't None and share no row, all of them within a relation with these keys."""
    some = [r for r in relations if r is not None]
    return reduce(lambda a, b: Disjoint(a, b, keys), some) if some else None


def intersection_all(relations: Iterable[Relation]) -> Relation:
    """Of one relation itself, of more their intersection."""
    return reduce(Intersection, relations)


def minus_or_none(a: Relation | None, b: Relation | None) -> Relation | None:
    return a if a is None or b is None else Difference(a, b)


def meet_or_none(a: Relation | None, b: Relation | None) -> Relation | None:
    return None if a is None or b is None else Intersection(a, b)
