"""Derivatives: what a transaction adds to and removes from any relation, from what it adds to and removes from the leaves.

A leaf's change must be minimal (added = new - old, removed = old - new); every rule then gives a minimal change. Rules
refer to a subtree's state before the change by compiling it over the leaves' old rows, so nothing is nested.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from relspan.plans import relation as R
from relspan.plans.relation import Relation, disjoint_or_none, meet_or_none, minus_or_none, union_all


@dataclass
class Change:
    """Rows added and removed; None is none at all."""

    added: DataFrame | None
    removed: DataFrame | None

    def reversed(self) -> Change:
        return Change(self.removed, self.added)

    def then(self, later: Change) -> Change:
        """This change and a later one together: what the later one takes back is in neither."""
        return Change(_sum(_less(self.added, later.removed), _less(later.added, self.removed)), _sum(_less(self.removed, later.added), _less(later.removed, self.added)))

    def is_empty(self) -> bool:
        return all(x is None or x.isEmpty() for x in (self.added, self.removed))


def _less(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    return a if a is None or b is None else R.minus(a, b)


def _sum(a: DataFrame | None, b: DataFrame | None) -> DataFrame | None:
    """Of disjoint sets."""
    return b if a is None else a if b is None else a.unionByName(b)


@dataclass
class LeafChange(Change):
    """A leaf's change with its rows before and after."""

    before: DataFrame
    after: DataFrame


def between(before: DataFrame, after: DataFrame) -> LeafChange:
    """The minimal change from one set of rows to another."""
    return LeafChange(R.minus(after, before), R.minus(before, after), before, after)


class Derivative:
    """The change of a relation, for changes of some of its leaves by id()."""

    def __init__(self, relation: Relation, changes: dict[int, LeafChange]) -> None:
        self.changes = changes
        self.olds: dict[int, Relation] = {}
        self.news: dict[int, Relation] = {}
        self.memo: dict[int, tuple[Relation | None, Relation | None]] = {}
        self.made: list[Relation] = []  # kept, as all else goes by id()
        self.relation = relation

    def change(self) -> Change:
        added, removed = self.of(self.relation)
        memo: dict[int, DataFrame] = {}
        return Change(None if added is None else added.df(memo=memo), None if removed is None else removed.df(memo=memo))

    def _state(self, r: Relation, kept: dict[int, Relation], which: str) -> Relation:
        if id(r) not in kept:
            if id(r) in self.changes:
                kept[id(r)] = R.Leaf(getattr(self.changes[id(r)], which), keys=r.keys, clean=True)
            elif not r.children:
                kept[id(r)] = r
            else:
                kept[id(r)] = r.rebuilt(tuple(self._state(c, kept, which) for c in r.children))
        return kept[id(r)]

    def old(self, r: Relation) -> Relation:
        return self._state(r, self.olds, "before")

    def new(self, r: Relation) -> Relation:
        return self._state(r, self.news, "after")

    def of(self, r: Relation) -> tuple[Relation | None, Relation | None]:
        if id(r) not in self.memo:
            self.memo[id(r)] = self._of(r)
        return self.memo[id(r)]

    def _touched(self, r: Relation) -> bool:
        return id(r) in self.changes or any(map(self._touched, r.children))

    def _of(self, r: Relation) -> tuple[Relation | None, Relation | None]:
        if id(r) in self.changes:
            c = self.changes[id(r)]
            return tuple(None if x is None else R.Leaf(x, keys=r.keys, clean=True) for x in (c.added, c.removed))
        if not self._touched(r):
            return None, None
        if isinstance(r, R.Cached):
            return self.of(r.children[0])
        if isinstance(r, R._Composite):
            self.made.append(r.expanded())
            return self.of(self.made[-1])
        if len(r.children) == 2:
            (a, b), ((a_add, a_rem), (b_add, b_rem)) = r.children, map(self.of, r.children)
            match r:
                case R.Union():
                    return union_all([minus_or_none(a_add, self.old(b)), minus_or_none(b_add, self.old(a))]), union_all([minus_or_none(a_rem, self.new(b)), minus_or_none(b_rem, self.new(a))])
                case R.Intersection():
                    return union_all([meet_or_none(a_add, self.new(b)), meet_or_none(b_add, self.new(a))]), union_all([meet_or_none(a_rem, self.old(b)), meet_or_none(b_rem, self.old(a))])
                case R.Difference():
                    return union_all([minus_or_none(a_add, self.new(b)), meet_or_none(b_rem, self.new(a))]), union_all([minus_or_none(a_rem, self.old(b)), meet_or_none(b_add, self.old(a))])
                case R.Equijoin():
                    # a side's rows that stay meet the other side's change, so no pair is made twice
                    join = lambda x, y: None if x is None or y is None else R.Equijoin(x, y, r.matching)
                    return disjoint_or_none([join(a_add, self.new(b)), join(minus_or_none(self.new(a), a_add), b_add)], r.keys), disjoint_or_none([join(a_rem, self.old(b)), join(minus_or_none(self.old(a), a_rem), b_rem)], r.keys)
        elif isinstance(r, R.Select | R.Rename | R.NullExtended):
            return tuple(None if x is None else r.rebuilt((x,)) for x in self.of(r.children[0]))
        elif isinstance(r, R.Project):
            names, of = set(r.names), r.children[0]
            key_of = lambda x: next((k for k in sorted(x.keys, key=sorted) if k <= names), None)
            if not r.lossless and isinstance(of, R.Equijoin) and of.matching and None not in (keys := [key_of(x) for x in of.children]):
                return self._pairs(r, of, *keys)
            add, rem = self.of(of)
            keyed = key_of(of) is not None
            lift = lambda x: None if x is None else R.Project(x, r.names, r.lossless or keyed)
            if r.lossless:
                return lift(add), lift(rem)
            if keyed:  # a row that was there with other values of what is dropped has the same key, so it was removed
                return minus_or_none(lift(add), lift(rem)), minus_or_none(lift(rem), lift(add))
            return minus_or_none(lift(add), self.old(r)), minus_or_none(lift(rem), self.new(r))
        elif isinstance(r, R.Update):
            add, rem = self.of(r.children[0])
            lift = lambda x: None if x is None else r.rebuilt((x,))
            return minus_or_none(lift(add), self.old(r)), minus_or_none(lift(rem), self.new(r))
        # aggregates and conditions: one row, or all or nothing
        return R.Difference(self.new(r), self.old(r)), R.Difference(self.old(r), self.new(r))

    def _pairs(self, r: R.Project, j: R.Equijoin, a_key: frozenset[str], b_key: frozenset[str]) -> tuple[Relation | None, Relation | None]:
        """The change of a projection of a join that keeps a key of each side. The sides are projected first, so pairs aren't compared with
        pairs: the same pair was there before only if both its rows have changed what they are matched by."""
        a, b = (R.Project(c, (set(r.names) | set(m)) & set(c.scheme)) for c, m in zip(j.children, (j.matching, j.matching.values())))
        self.made += [a, b]
        (a_add, a_rem), (b_add, b_rem) = self.of(a), self.of(b)
        pairs = lambda x, y: None if x is None or y is None else R.Project(R.Equijoin(x, y, j.matching), r.names, lossless=True)

        def again(x: Relation | None, y: Relation | None, key: frozenset[str]) -> Relation | None:
            """Rows of x whose key y has too."""
            if x is None or y is None:
                return None
            other = {k: f"__other {k}" for k in key}
            return R.Project(R.Equijoin(x, R.Rename(R.Project(y, key), other), other), x.scheme, lossless=True)

        def side(a_own: Relation | None, a_back: Relation | None, b_own: Relation | None, b_back: Relation | None, a_all: Relation, b_all: Relation) -> Relation | None:
            out = [pairs(minus_or_none(a_all, a_own), b_own)]
            x, y = again(a_own, a_back, a_key), again(b_own, b_back, b_key)
            if x is None or y is None:
                out.append(pairs(a_own, b_all))
            else:
                was = pairs(again(a_back, a_own, a_key), again(b_back, b_own, b_key))
                out += [pairs(R.Difference(a_own, x), b_all), pairs(x, R.Difference(b_all, y)), minus_or_none(pairs(x, y), was)]
            return disjoint_or_none(out, r.keys)

        return side(a_add, a_rem, b_add, b_rem, self.new(a), self.new(b)), side(a_rem, a_add, b_rem, b_add, self.old(a), self.old(b))


def derivative(relation: Relation, changes: dict[Relation, LeafChange]) -> Change:
    return Derivative(relation, {id(k): v for k, v in changes.items()}).change()


class Variables:
    """A relation's change for changes that are bound to leaves one after another."""

    def __init__(self, relation: Relation) -> None:
        self.relation = relation
        self.bound: dict[Relation, LeafChange] = {}

    def set_change(self, leaf: Relation, change: LeafChange) -> None:
        self.bound[leaf] = change

    def add_change(self, leaf: Relation, change: LeafChange) -> None:
        """After what is bound already; what the two take back from one another cancels out."""
        was = self.bound.get(leaf)
        both = change if was is None else was.then(change)
        self.bound[leaf] = LeafChange(both.added, both.removed, change.before if was is None else was.before, change.after)

    def clear(self) -> None:
        self.bound.clear()

    def change(self) -> Change:
        return derivative(self.relation, self.bound)
