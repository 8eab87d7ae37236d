"""update() on any relation, pushed down to the tables it is made of. What matches is settled before anything changes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from relspan.functions.predicates import TRUE, Predicate
from relspan.plans import relation as R
from relspan.plans.relation import Relation, cols
from relspan.sources.scratch import staged
from relspan.sources.tables import Table


def update(view: Relation, where: object, new: dict[str, object]) -> None:
    if unknown := set(new) - set(view.scheme):
        raise ValueError(f"the relation has no {sorted(unknown)}")
    tables = [t for t in view.leaves() if isinstance(t, Table)]
    if not tables:
        raise ValueError("nothing below this relation can be updated")
    plan: list[tuple[Table, Predicate, DataFrame | None, dict]] = []
    _push(view, R._predicate(where), None, new, plan)
    settled = [(t, p, None if rows is None else staged(rows.distinct(), "matching"), v) for t, p, rows, v in plan]
    with tables[0].db.transaction():
        for t, p, rows, values in settled:
            t.update_rows(p, rows, values)


def _push(r: Relation, where: Predicate, rows: DataFrame | None, new: dict[str, object], plan: list) -> None:
    """Add what has to change in the tables below r for its rows that hold ``where`` and match ``rows``."""
    if not new:
        return
    if isinstance(r, Table):
        plan.append((r, where, rows, new))
        return
    hit = lambda: _matching(r, where, rows)
    match r:
        case R.Select():
            _push(r.children[0], r.where & where, rows, new, plan)
        case R.Project() | R.Union() | R.Cached():
            for c in r.children:
                _push(c, where, rows, new, plan)
        case R.Intersection():
            for c in r.children:
                _push(c, TRUE, hit(), new, plan)
        case R.Difference():
            _push(r.children[0], TRUE, hit(), new, plan)
        case R.Equijoin():
            for c in r.children:
                some = {a: v for a, v in new.items() if a in c.scheme}
                _push(c, TRUE, cols(hit(), c.scheme), some, plan)
        case R.Rename():
            back = {b: a for a, b in r.names.items()}
            _push(r.children[0], where.renamed(back), None if rows is None else rows.select(*(R.quoted(c).alias(back[c]) for c in rows.columns)), {back[a]: v for a, v in new.items()}, plan)
        case R.NullExtended():
            own = {a: v for a, v in new.items() if a not in r.more}
            _push(r.children[0], TRUE, cols(hit(), r.children[0].scheme), own, plan)
        case R.Update():
            own = {a: v for a, v in new.items() if a not in r.new}
            keep = None if rows is None else rows.drop(*r.new)
            if isinstance(r.where, type(TRUE)):
                _push(r.children[0], where.substituted(r.new), keep, own, plan)
            else:
                _push(r.children[0], where, keep, own, plan)
        case R.Otherwise():
            _push(r.children[0] if not r.children[0].is_empty() else r.children[1], where, rows, new, plan)
        case R.Unique():
            if not r.is_empty():
                _push(r.children[0], where, rows, new, plan)
        case R._Composite():
            _push(r.expanded(), where, rows, new, plan)
    # aggregates and literals have nothing to update


def _matching(r: Relation, where: Predicate, rows: DataFrame | None) -> DataFrame:
    out = r.select(where).df()
    return out if rows is None else R.null_safe(out, rows, [(c, c) for c in rows.columns], "left_semi")
