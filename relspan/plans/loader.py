"""Relations from plans written as JSON: an input, then stages, each of which may be projected.

{"input": "orders", "stages": [{"select": {"o_orderstatus": "F"}}, {"join": "customer_orders", "project": ["o_orderkey"]}]}

Stages: select (equalities), join and union (a relation's name or a plan), count. A plan's name for an input stands for a
relation given to ``load``.
"""

from __future__ import annotations

import json

from relspan.plans.relation import Relation


def load(plan: str | dict, relations: dict[str, Relation]) -> Relation:
    """Build the relation that a plan describes."""
    plan = json.loads(plan) if isinstance(plan, str) else plan

    def named(x: str | dict) -> Relation:
        if isinstance(x, dict):
            return load(x, relations)
        if x not in relations:
            raise ValueError(f"no relation {x!r} among {sorted(relations)}")
        return relations[x]

    out = named(plan["input"])
    for stage in plan.get("stages", []):
        kinds = [k for k in stage if k != "project"]
        if len(kinds) > 1 or not stage or (kinds and kinds[0] not in ("select", "join", "union", "count")):
            raise ValueError(f"cannot read the stage {stage}")
        match kinds:
            case ["select"]:
                out = out.select(stage["select"])
            case ["join"]:
                out = out.join(named(stage["join"]))
            case ["union"]:
                out = out.union(named(stage["union"]))
            case ["count"]:
                out = out.count()
        if "project" in stage:
            out = out.project(*stage["project"])
    return out
