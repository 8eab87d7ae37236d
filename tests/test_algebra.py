"""Operators on small literal relations."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.predicates import TRUE, And, Attr, Const, Custom, Not, Or, combined, exclusive, simplified
from relspan.functions.values import boxed, glob_to_regex
from relspan.plans.relation import Fold, Leaf, literal

A = Attr


def rows(r):
    got = [tuple(x) for x in r.df().collect()]
    assert len(got) == len(set(got)), "duplicates"
    return set(got)


@pytest.fixture(scope="module")
def abc(spark):
    r = literal(spark, ["A", "B", "C"], ["a", "b", "c"], ["d", "a", "f"], ["c", "b", "d"])
    s = literal(spark, ["A", "B", "C"], ["b", "g", "a"], ["d", "a", "f"])
    return r, s


def test_set_operators(abc):
    r, s = abc
    assert rows(r + s) == {("a", "b", "c"), ("d", "a", "f"), ("c", "b", "d"), ("b", "g", "a")}
    assert rows(r.intersection(s)) == {("d", "a", "f")}
    assert rows(r - s) == {("a", "b", "c"), ("c", "b", "d")}
    assert rows(r - r) == set() and rows(r + r) == rows(r) == rows(r.intersection(r))
    with pytest.raises(ValueError):
        r.union(s.project("A"))


def test_project_and_rename(abc, spark):
    r, _ = abc
    assert rows(r.project("B")) == {("b",), ("a",)}
    assert rows(r.project_dropping("A", "C")) == rows(r.project("B"))
    assert r.rename_prime().scheme == ("A'", "B'", "C'")
    assert rows(r.project("A", "B").rename({"A": "B", "B": "A"})) == {("b", "a"), ("a", "d"), ("b", "c")}
    assert rows(r.project_renamed({"B": "X"})) == {("b",), ("a",)}
    assert len(r.project().df().collect()) == 1 and len(r.select(A("A") == "no").project().df().collect()) == 0
    assert rows(r.join(r.project())) == rows(r) and rows(r.join(r.select(Const(False)).project())) == set()
    for bad in (lambda: r.project("Z"), lambda: r.rename({"A": "B"}), lambda: r.select(A("Z") == 1), lambda: r.with_update({"Z": 1})):
        with pytest.raises(ValueError):
            bad()


def test_joins(spark):
    lines = literal(spark, ["line", "gauge"], [1, "narrow"], [1, "broad"], [2, "narrow"], [5, "metre"])
    drivers = literal(spark, ["driver", "gauge"], ["Ada", "metre"], ["Ada", "narrow"], ["Ben", "broad"], ["Cid", "narrow"])
    assert rows(lines.join(drivers).project("line", "driver")) == {("Ada", 1), ("Cid", 1), ("Ben", 1), ("Ada", 2), ("Cid", 2), ("Ada", 5)}
    t = literal(spark, ["run", "from", "to"], [1, 10, 20], [2, 30, 40], [3, 15, 25])
    assert rows(t.thetajoin(t.rename_prime(), A("to") < A("from'")).project("run", "run'")) == {(1, 2), (3, 2)}
    with pytest.raises(ValueError):
        t.equijoin(t, {"run": "run"})
    e = literal(spark, ["emp", "dept"], ["Al", "x"], ["Bob", "y"], ["Cy", None])
    d = literal(spark, ["dept", "boss"], ["x", 1], [None, 9])
    assert {(r.emp, r.dept, r.boss) for r in e.left_outer_join(d).df().collect()} == {("Al", "x", 1), ("Bob", "y", None), ("Cy", None, 9)}
    assert rows(e.left_outer_join(d)) == rows(e.left_outer_join(d).expanded())


def test_division(spark):
    knows = {"Ada": "abc", "Ben": "a", "Cid": "bc", "Dot": "abcd"}
    c = literal(spark, ["who", "what"], *[[p, q] for p, qs in knows.items() for q in qs])
    for asked in ("abc", "a", "d", "bd"):
        got = rows(c.divide(literal(spark, ["what"], *[[q] for q in asked])))
        assert got == {(p,) for p, qs in knows.items() if set(asked) <= set(qs)}
    none = c.project("what").select(A("what") == "z")
    assert rows(c.divide(none)) == {(p,) for p in knows} == rows(c.divide(none).expanded())


def test_aggregates_and_conditions(spark):
    r = literal(spark, ["id", "name", "count"], [1, "cat", 1], [2, "dog", 3], [3, "fish", 2], [4, "ant", 3])
    none = r.select(A("id") < 0)
    assert (rows(r.min("count")), rows(r.max("count")), rows(r.count())) == ({(1,)}, {(3,)}, {(4,)})
    assert (rows(none.min("count")), rows(none.max("count")), rows(none.count())) == (set(), set(), {(0,)})
    assert rows(r.project("count").count()) == {(3,)}
    nulls = literal(spark, ["v"], [1], [None])
    assert rows(nulls.min("v")) == {(None,)} and rows(nulls.max("v")) == {(1,)}
    assert rows(r.otherwise(none)) == rows(r) == rows(none.otherwise(r))
    assert {(x["id"], x["count"]) for x in r.select(A("count") == 3).unique("count", 3).df().collect()} == {(2, 3), (4, 3)}
    assert rows(r.unique("count", 3)) == set() and rows(r.select(A("id") == 1).unique("count", 7)) == set()
    assert len(rows(r.select(A("id") == 1).unique("count", 7, strict=False))) == 1
    total = Fold(r, "total", 0, lambda s, b: s + sum(x["count"] for x in b), lambda a, b: a + b, "long", True)
    assert rows(total) == {(9,)}


def test_updates_as_expressions(spark):
    r = literal(spark, ["a", "b"], [1, 1], [2, 1], [3, 2])
    assert rows(r.project("b").with_update({"b": 7})) == {(7,)}
    assert rows(r.with_update({"b": 9}, A("a") < 3)) == {(1, 9), (2, 9), (3, 2)}


def test_total_comparison(spark):
    r = literal(spark, ["k", "v"], ["null", None], ["one", 1], ["two", 2])
    keys = lambda p: {x[0] for x in rows(r.select(p).project("k"))}
    assert keys(A("v") == None) == {"null"}  # noqa: E711
    assert keys(A("v") != 1) == {"null", "two"}
    assert keys(A("v") < 2) == {"null", "one"} and keys(A("v") >= 1) == {"one", "two"} and keys(A("v") <= None) == {"null"}
    assert keys(A("v") < 1.0) == {"null", "one", "two"}  # an integer is before any real
    assert keys(A("v") == 1.0) == set() and keys(A("v") < "a") == {"null", "one", "two"}
    assert keys(A("v")) == {"null", "one", "two"} and keys(~(A("v") == 1) & ~(A("v") == 2)) == {"null"}
    assert keys(Custom(lambda c: c % 2 == 0, A("v"))) == {"two"}
    b = literal(spark, ["k"], ["x"]).df()
    order = b.select(F.explode(F.array(*(boxed(F.lit(v).cast(t.simpleString()), t) for v, t in ((b"z", T.BinaryType()), ("a", T.StringType()), (0.5, T.DoubleType()), (9, T.LongType()), (None, T.NullType()))))).alias("x")).orderBy("x").select("x.t").collect()
    assert [x.t for x in order] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("pattern,hits", [("pl*", {"planet", "plant"}), ("plan*t", {"planet", "plant"}), ("p?????", {"person", "planet"}), ("*r*", {"person"}), ("p[el]*", {"person", "planet", "plant"}), ("p[^l]*", {"person"}), ("PL*", set()), ("plant", {"plant"}), ("*", {"person", "planet", "plant"}), ("p.*", set()), ("[a", set())])
def test_glob(spark, pattern, hits):
    r = literal(spark, ["kind"], ["planet"], ["person"], ["plant"])
    assert {x[0] for x in rows(r.select(A("kind").glob(pattern)))} == hits


def test_predicate_trees(spark):
    p = combined([A("x") == k for k in range(64)], Or)
    depth = lambda q: 1 + max(map(depth, q.parts()), default=0)
    assert depth(p) == 8 and combined([], And) is None
    assert p.renamed({"x": "y"}).attributes() == {"y"}
    assert simplified((Const(1) == 1) & (A("x") == 2)).attributes() == {"x"}
    assert isinstance(simplified(Not(Const(0)) | A("x")), Const)
    assert exclusive(A("x") == 1, A("x") == 2) and not exclusive(A("x") == 1, A("y") == 2)
    assert exclusive((A("x") == 1) | (A("x") == 2), (A("x") == 3) & (A("y") == 1)) and not exclusive(A("x") > 1, A("x") == 0)
    assert not exclusive(TRUE, A("x") == 1) and exclusive(Const(False), TRUE)
    assert glob_to_regex("a.b") == r"(?s)^a\.b$"


def test_plans(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    r = Leaf(spark.read.parquet(f"{tmp_path}/t"), keys=[["id"]])
    plan = lambda x: x.df()._jdf.queryExecution().executedPlan().toString()
    one = plan(r.select(A("k") == 3).project("id", "k"))
    assert "EqualNullSafe(k,3)" in one and "ReadSchema: struct<id:bigint,k:bigint>" in one and "Aggregate" not in one
    assert "Aggregate" in plan(r.project("k"))
    assert "Or(IsNull(k),LessThan(k,3))" in plan(r.select(A("k") < 3))
    assert "Aggregate" not in plan(r.join(r.project("id", "k").rename({"k": "j"})))


def test_fetching(spark):
    r = literal(spark, ["a"], *[[k] for k in range(25)])
    assert [len(b) for b in r.bulk_rows(10)] == [10, 10, 5] and r.contains({"a": 3}) and not r.contains({"a": 99}) and not r.contains({"b": 3})
    assert sorted(r.collect_async(lambda x: [y["a"] for y in x]).result(60)) == list(range(25))
    assert r.select(A("a") == 3).one_value() == 3 and r.one_row() is None and not r.is_empty()
    assert rows(r.cache(5)) == rows(r.cache(100)) == rows(r)
    assert "Select" in r.select(A("a") == 1).project("a").dump() and "->" in r.union(r).graphviz()


def test_shared_plans_and_loader(spark):
    from relspan.plans.loader import load
    from relspan.plans.relation import evaluate_together

    calls = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pdf

    counted = Leaf(spark.range(5).coalesce(1).mapInPandas(seen, "id long"), keys=[["id"]])
    base = counted.select(A("id") < 4)
    got = evaluate_together([base.min("id"), base.max("id"), base.count()])
    assert got == [[{"id": 0}], [{"id": 3}], [{"count": 4}]] and calls.value == 5
    e = literal(spark, ["emp", "dept"], ["Al", "x"], ["Bob", "y"]).named("e")
    d = literal(spark, ["dept", "boss"], ["x", 1], ["y", 2]).named("d")
    plan = {"input": "e", "stages": [{"select": {"dept": "x"}}, {"join": "d", "project": ["emp", "boss"]}, {"union": {"input": "e", "stages": [{"join": "d", "project": ["emp", "boss"]}]}}]}
    assert rows(load(plan, {"e": e, "d": d})) == {(1, "Al"), (2, "Bob")}
    assert rows(load({"input": "e", "stages": [{"count": True}]}, {"e": e})) == {(2,)}
    with pytest.raises(ValueError):
        load({"input": "q"}, {})
    assert e.project("emp").rename({"emp": "n"}).code() == "e.project('emp').rename({'emp': 'n'})"
