"""Predicates as small trees: they compile to columns, and can be renamed, simplified and shown to exclude each other."""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions import values as V

Types = dict[str, T.DataType]


_SIGNS = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def as_predicate(x: object) -> Predicate:
    return x if isinstance(x, Predicate) else Const(x)


class Predicate:
    """Base of the tree. ``==`` and the like build comparisons; & | ~ combine."""

    __hash__ = object.__hash__

    def __eq__(self, other: object) -> Compare:  # type: ignore[override]
        return Compare("eq", self, as_predicate(other))

    def __ne__(self, other: object) -> Compare:  # type: ignore[override]
        return Compare("ne", self, as_predicate(other))

    def __lt__(self, other: object) -> Compare:
        return Compare("lt", self, as_predicate(other))

    def __le__(self, other: object) -> Compare:
        return Compare("le", self, as_predicate(other))

    def __gt__(self, other: object) -> Compare:
        return Compare("gt", self, as_predicate(other))

    def __ge__(self, other: object) -> Compare:
        return Compare("ge", self, as_predicate(other))

    def __and__(self, other: object) -> And:
        return And(self, as_predicate(other))

    def __or__(self, other: object) -> Or:
        return Or(self, as_predicate(other))

    def __invert__(self) -> Not:
        return Not(self)

    def glob(self, pattern: str) -> Glob:
        return Glob(self, pattern)

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        """The column and its type."""
        raise NotImplementedError

    def holds(self, types: Types) -> Column:
        """Whether the value is truthy, as a non-null boolean."""
        return V.truthy(*self.value(types))

    def parts(self) -> tuple[Predicate, ...]:
        return ()

    def rebuilt(self, parts: tuple[Predicate, ...]) -> Predicate:
        return self

    def mapped(self, f: Callable[[Predicate], Predicate]) -> Predicate:
        """The tree with f applied to every node, leaves first."""
        return f(self.rebuilt(tuple(p.mapped(f) for p in self.parts())))

    def code(self) -> str:
        """As Python."""
        match self:
            case Attr():
                return f"Attr({self.name!r})"
            case Const():
                return repr(self.constant)
            case Compare():
                return f"({self.left.code() if not isinstance(self.left, Const) else f'Const({self.left.constant!r})'} {_SIGNS[self.op]} {self.right.code()})"
            case And() | Or():
                return f"({self.left.code()} {'&' if isinstance(self, And) else '|'} {self.right.code()})"
            case Not():
                return f"~{self.inner.code()}"
            case Glob():
                return f"{self.inner.code()}.glob({self.pattern!r})"
        return f"Custom({', '.join([getattr(self.make, '__name__', 'make'), *(p.code() for p in self.parts())])})"

    def attributes(self) -> set[str]:
        return set().union(*(p.attributes() for p in self.parts()), {self.name} if isinstance(self, Attr) else set())

    def renamed(self, names: dict[str, str]) -> Predicate:
        return self.mapped(lambda p: Attr(names.get(p.name, p.name)) if isinstance(p, Attr) else p)

    def substituted(self, constants: dict[str, object]) -> Predicate:
        return self.mapped(lambda p: Const(constants[p.name]) if isinstance(p, Attr) and p.name in constants else p)


@dataclass(eq=False)
class Attr(Predicate):
    name: str

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        if self.name not in types:
            raise ValueError(f"no attribute {self.name!r} among {sorted(types)}")
        return F.col("`" + self.name.replace("`", "``") + "`"), types[self.name]


@dataclass(eq=False)
class Const(Predicate):
    constant: object

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        c = self.constant
        kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), bytearray: T.BinaryType(), type(None): T.NullType()}
        return F.lit(c), kinds.get(type(c), T.TimestampType())


@dataclass(eq=False)
class Compare(Predicate):
    op: str
    left: Predicate
    right: Predicate

    def parts(self) -> tuple[Predicate, ...]:
        return self.left, self.right

    def rebuilt(self, parts: tuple[Predicate, ...]) -> Predicate:
        return Compare(self.op, *parts)

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        return self.holds(types), T.BooleanType()

    def holds(self, types: Types) -> Column:
        (a, ta), (b, tb) = self.left.value(types), self.right.value(types)
        match self.op:
            case "eq":
                return V.equal(a, b, ta, tb)
            case "ne":
                return ~V.equal(a, b, ta, tb)
            case "lt":
                return V.less(a, b, ta, tb)
            case "le":
                return ~V.less(b, a, tb, ta)
            case "gt":
                return V.less(b, a, tb, ta)
        return ~V.less(a, b, ta, tb)


class _Pair(Predicate):
    def __init__(self, left: Predicate, right: Predicate) -> None:
        self.left, self.right = left, right

    def parts(self) -> tuple[Predicate, ...]:
        return self.left, self.right

    def rebuilt(self, parts: tuple[Predicate, ...]) -> Predicate:
        return type(self)(*parts)

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        return self.holds(types), T.BooleanType()


class And(_Pair):
    def holds(self, types: Types) -> Column:
        return self.left.holds(types) & self.right.holds(types)


class Or(_Pair):
    def holds(self, types: Types) -> Column:
        return self.left.holds(types) | self.right.holds(types)


class Not(Predicate):
    def __init__(self, inner: Predicate) -> None:
        self.inner = inner

    def parts(self) -> tuple[Predicate, ...]:
        return (self.inner,)

    def rebuilt(self, parts: tuple[Predicate, ...]) -> Predicate:
        return Not(*parts)

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        return self.holds(types), T.BooleanType()

    def holds(self, types: Types) -> Column:
        return ~self.inner.holds(types)


class Glob(Predicate):
    def __init__(self, inner: Predicate, pattern: str) -> None:
        self.inner, self.pattern = inner, pattern

    def parts(self) -> tuple[Predicate, ...]:
        return (self.inner,)

    def rebuilt(self, parts: tuple[Predicate, ...]) -> Predicate:
        return Glob(parts[0], self.pattern)

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        return self.holds(types), T.BooleanType()

    def holds(self, types: Types) -> Column:
        a, t = self.inner.value(types)
        return V.glob(a, self.pattern, t)


class Custom(Predicate):
    """Any test of values: make gets the columns of the parts and returns a boolean column (built-in functions
    best; a pandas UDF works)."""

    def __init__(self, make: Callable[..., Column], *inner: Predicate) -> None:
        self.make, self.inner = make, inner

    def parts(self) -> tuple[Predicate, ...]:
        return self.inner

    def rebuilt(self, parts: tuple[Predicate, ...]) -> Predicate:
        return Custom(self.make, *parts)

    def value(self, types: Types) -> tuple[Column, T.DataType]:
        return self.holds(types), T.BooleanType()

    def holds(self, types: Types) -> Column:
        return F.coalesce(self.make(*(p.value(types)[0] for p in self.inner)), F.lit(False))


TRUE, FALSE = Const(True), Const(False)


def row_matches(row: dict[str, object]) -> Predicate:
    return combined([Attr(k) == v for k, v in row.items()], And) or TRUE


def combined(predicates: Iterable[Predicate], how: type[_Pair]) -> Predicate | None:
    """One balanced tree of all, so depth is logarithmic; None for none."""
    level = list(predicates)
    while len(level) > 1:
        level = [how(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def truth(p: Predicate) -> bool | None:
    """Of a constant; None for all else."""
    if not isinstance(p, Const):
        return None
    return not (type(p.constant) in (bool, int) and p.constant == 0)


def simplified(p: Predicate) -> Predicate:
    """Fold what constants decide; the rest stays."""

    def fold(q: Predicate) -> Predicate:
        if isinstance(q, Not) and truth(q.inner) is not None:
            return Const(not truth(q.inner))
        if isinstance(q, Compare) and isinstance(q.left, Const) and isinstance(q.right, Const):
            return Const(_compare(q.op, q.left.constant, q.right.constant))
        if isinstance(q, And | Or):
            ends = isinstance(q, Or)  # the truth that decides
            for own, other in ((q.left, q.right), (q.right, q.left)):
                if truth(own) is ends:
                    return Const(ends)
                if truth(own) is (not ends):
                    return other
        return q

    return p.mapped(fold)


def _compare(op: str, a: object, b: object) -> bool:
    rank = {type(None): 0, bool: 1, int: 1, float: 2, str: 3, bytes: 4}
    x, y = ((rank.get(type(v), 5), 0 if v is None else v) for v in (a, b))
    return {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}[op](x, y)


def weakened(p: Predicate, names: set[str]) -> Predicate:
    """What still holds of a row that held p after its attributes ``names`` were set to something else."""
    match p:
        case And():
            return And(weakened(p.left, names), weakened(p.right, names))
        case Or():
            return Or(weakened(p.left, names), weakened(p.right, names))
    return TRUE if p.attributes() & names else p


def exclusive(p: Predicate, q: Predicate) -> bool:
    """Whether no row can satisfy both, as far as equalities with constants show it. False if unknown."""

    def cases(x: Predicate) -> list[dict[str, object]]:
        """Ways to satisfy x, each with the values that it fixes; an empty list if none."""
        if isinstance(x, Const):
            return [{}] if truth(x) else []
        if isinstance(x, Compare) and x.op == "eq":
            for a, b in ((x.left, x.right), (x.right, x.left)):
                if isinstance(a, Attr) and isinstance(b, Const):
                    return [{a.name: (type(b.constant), b.constant)}]
        if isinstance(x, Or):
            return cases(x.left) + cases(x.right)
        if isinstance(x, And):
            return joined(cases(x.left), cases(x.right))
        return [{}]

    def joined(a: list[dict], b: list[dict]) -> list[dict]:
        return [m | n for m in a for n in b if all(m[k] == n[k] for k in m.keys() & n.keys())]

    if sum(1 for _ in _nodes(p)) + sum(1 for _ in _nodes(q)) > 200:
        return False
    return not reduce(joined, [cases(simplified(p)), cases(simplified(q))])


def _nodes(p: Predicate) -> Iterable[Predicate]:
    yield p
    for x in p.parts():
        yield from _nodes(x)
