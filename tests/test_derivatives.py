"""Changes of views against brute force: new - old and old - new."""

import random
from itertools import product

import pytest

from relspan.functions.predicates import Attr
from relspan.plans import relation as R
from relspan.plans.delta import between, derivative
from relspan.plans.relation import Leaf, literal

A = Attr


def as_set(df):
    got = [] if df is None else [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def check(view, changes):
    memo = {id(k): v.before for k, v in changes.items()}, {id(k): v.after for k, v in changes.items()}
    old, new = as_set(view.df(memo[0])), as_set(view.df(memo[1]))
    change = derivative(view, changes)
    assert as_set(change.added) == new - old and as_set(change.removed) == old - new


def test_every_change_of_two_flags(spark):
    """Two views over one table, for every state of a row before and after."""
    states = list(enumerate(product([(a, b) for a in (0, 1) for b in (0, 1)], repeat=2)))
    frame = lambda side: spark.createDataFrame([(*s[side], n) for n, s in states], "a long, b long, n long")
    base = Leaf(frame(0))
    views = [base.select(A(c) == 1).project("n") for c in "ab"]
    changes = {base: between(frame(0), frame(1))}
    for view, holds in ((views[0] + views[1], lambda a, b: a or b), (views[0].intersection(views[1]), lambda a, b: a and b), (views[0] - views[1], lambda a, b: a and not b)):
        was, now = ({n for n, s in states if holds(*s[side])} for side in (0, 1))
        c = derivative(view, changes)
        assert {r[0] for r in as_set(c.added)} == now - was and {r[0] for r in as_set(c.removed)} == was - now


def test_join_sides_change_together(spark):
    a, b = literal(spark, ["id", "text"], [1, "old"], [2, "x"]), literal(spark, ["ident", "title"], [1, "OLD"], [2, "X"])
    new_a, new_b = literal(spark, ["id", "text"], [1, "new"], [2, "x"]), literal(spark, ["ident", "title"], [1, "NEW"], [2, "X"])
    c = derivative(a.equijoin(b, {"id": "ident"}), {a: between(a.df(), new_a.df()), b: between(b.df(), new_b.df())})
    assert as_set(c.added) == {(1, 1, "new", "NEW")} and as_set(c.removed) == {(1, 1, "old", "OLD")}


def random_tree(rng, leaves, depth):
    if depth == 0:
        return rng.choice(leaves)
    sub = lambda: random_tree(rng, leaves, depth - 1)
    x = sub()
    v = rng.randrange(3)
    match rng.randrange(12):
        case 0:
            return x + sub()
        case 1:
            return x - sub()
        case 2:
            return x.intersection(sub())
        case 3:
            return x.select(A("a") == v)
        case 4:
            return x.select((A("b") < v) | ~(A("a") >= A("b")))
        case 5:
            return x.project("a").join(sub().project("b"))
        case 6:
            return x.rename({"a": "b", "b": "a"})
        case 7:
            return x.with_update({"a": v}, A("b") == v if rng.random() < 0.5 else None)
        case 8:
            return x.join(sub())
        case 9:
            return x.otherwise(sub())
        case 10:
            return x.project("a").left_outer_join(sub())
        case _:
            return x.unique("a", v)


@pytest.mark.parametrize("seed", range(14))
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    frame = lambda: spark.createDataFrame(sorted({(rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1, 2])) for _ in range(rng.randrange(1, 7))}, key=str), "a long, b long")
    leaves = [Leaf(frame()) for _ in range(2)]
    changes = {x: between(x.df(), frame()) for x in leaves if rng.random() < 0.8}
    check(random_tree(rng, leaves, 3), changes)
    check(leaves[0].min("a"), changes)
    check(leaves[1].count(), changes)
    check(leaves[0].divide(leaves[1].project("b")), changes)


@pytest.mark.parametrize("seed", range(4))
def test_pairs_of_keyed_sides(spark, seed):
    """Projections of a join that keep both keys; rows change what they are matched by, and what is dropped, on one side or on both."""
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 0, 1])
    state = lambda: sorted((k, value(), value()) for k in range(8) if rng.random() < 0.8)
    a_frame, b_frame = (lambda names: lambda: spark.createDataFrame(state(), names))("id long, k long, x long"), (lambda names: lambda: spark.createDataFrame(state(), names))("jd long, m long, y long")
    a, b = Leaf(a_frame(), keys=[["id"]]), Leaf(b_frame(), keys=[["jd"]])
    changes = {a: between(a.df(), a_frame()), b: between(b.df(), b_frame())}
    joined = a.select(~(A("x") == 1)).equijoin(b, {"k": "m"})
    for view in (joined.project("id", "jd"), joined.project("id", "jd", "y"), joined.project("id", "k"), joined, a.project("id", "x"), a.project("x").join(b.project("jd"))):
        check(view, changes)
        check(view, {a: changes[a]})
        check(view, {b: changes[b]})


def test_pairs_are_made_once(spark):
    """The change of a projected join neither compares pairs with pairs nor removes repeated ones; its tasks don't follow the few values that are matched."""
    SF = "/root/testdata/sf0.01"
    c, s = (Leaf(spark.read.parquet(f"{SF}/{n}.parquet"), keys=[[k]]) for n, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    changes = {x: between(x.df().where(f"{w} <> 1"), x.df().where(f"{w} <> 2")) for x, w in ((c, "c_nationkey"), (s, "s_nationkey"))}
    change = derivative(c.equijoin(s, {"c_nationkey": "s_nationkey"}).project("c_custkey", "s_suppkey"), changes)
    for side in (change.added, change.removed):
        assert "Aggregate" not in side._jdf.queryExecution().optimizedPlan().toString()


def test_joins_without_keys_are_dealt(spark, monkeypatch):
    SF = "/root/testdata/sf0.01"
    c, s = (Leaf(spark.read.parquet(f"{SF}/{n}.parquet"), keys=[[k]]) for n, k in (("customer", "c_custkey"), ("supplier", "s_suppkey")))
    views = [c.equijoin(s, {"c_nationkey": "s_nationkey"}).project("c_custkey", "s_suppkey"), s.project("s_suppkey", "s_acctbal").thetajoin(s.project("s_suppkey", "s_acctbal").rename_prime(), A("s_acctbal") < A("s_acctbal'")).project("s_suppkey", "s_suppkey'")]
    plain = [as_set(v.df()) for v in views]
    monkeypatch.setattr(R, "PRODUCT", 1)
    for view, want in zip(views, plain):
        sizes = view.df().rdd.glom().map(len).collect()
        assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
        assert as_set(view.df()) == want
    monkeypatch.setattr(R, "SMALL", 0)
    assert as_set(views[0].df()) == plain[0]


def test_joins_by_order_compare_few_ranges(spark, monkeypatch):
    """All pairs in order, whatever the values; they come range by range, so that result files store them in few bytes."""
    nan, inf = float("nan"), float("inf")
    monkeypatch.setattr(R, "RANGE", 2)
    for kinds, values in (("double", [None, nan, inf, -inf, 0.0, -0.0, 2.5, 2.5, 2.5, 7.0, -3.0]), ("long", [None, 1 << 62, (1 << 62) + 1, 3, 3, 3, 0, -9])):
        t = Leaf(spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, v {kinds}"), keys=[["k"]])
        few = t.select(A("k") < 3)
        sides = [(t, t.rename_prime()), (few, t.rename_prime()), (t, few.rename_prime())]
        for n, p in enumerate((A("v") < A("v'"), A("v") <= A("v'"), A("v") > A("v'"), (A("v'") > A("v")) & (A("k") != 1), A("v'") <= A("v"), (A("v'") < A("v")) | (A("k") == 1))):
            view = sides[n % 3][0].thetajoin(sides[n % 3][1], p).project("k", "k'")
            monkeypatch.setattr(R, "PRODUCT", R.UNKNOWN)
            want = sorted(map(tuple, view.df().collect()))
            monkeypatch.setattr(R, "PRODUCT", 1)
            assert sorted(map(tuple, view.df().collect())) == want

    s = Leaf(spark.range(2000).selectExpr("id AS k", "id * 7919 % 2000 AS v"), keys=[["k"]])
    monkeypatch.setattr(R, "RANGE", 100)
    monkeypatch.setattr(R, "PAIRS", 1 << 19)
    view = s.thetajoin(s.rename_prime(), A("v") < A("v'")).project("k", "k'")
    parts = [p for p in view.df().rdd.glom().collect() if p]
    assert sum(map(len, parts)) == len({tuple(r) for p in parts for r in p}) == 1999 * 1000
    assert len(parts) == 7  # of 4,000,000 pairs, not only of shuffle partitions
    for p in parts:
        places = [(r["k'"] * 7919 % 2000 + 1) // 100 for r in p]
        assert sum(x != y for x, y in zip(places, places[1:])) < 0.02 * len(p)
