"""Registered queries about state against their SQL, and what they need to read for it."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan import stateful
from relspan.functions.predicates import Attr, Custom, weakened
from relspan.operators import textindex as X
from relspan.plans.delta import Change, between
from relspan.plans.relation import Leaf, literal, natural
from relspan.sources import scratch, sqlite, tables
from relspan.sources.tables import Database

A = Attr
SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def test_queries_match_their_sql(spark):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sql, wrong = stateful.oracle_sql(), []
    assert set(sql) == set(stateful.queries())
    for name, query in stateful.queries().items():
        want = con.sql(sql[name])
        names = list(want.columns)
        df = query(spark, SF)
        got = Counter(tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect())
        if sorted(df.columns) != sorted(names) or got != Counter(tuple(map(plain, r)) for r in want.fetchall()):
            wrong.append(name)
    assert not wrong


def read_from(path, *filters, where=None):
    """Rows that a scan takes out of a SQLite table, as its tasks do."""
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("s", T.StringType())])
    reader = sqlite.SqliteReader(schema, {"path": path, "table": "t", **({"where": where} if where else {})})
    list(reader.pushFilters(list(filters)))
    return [r for p in reader.partitions() for r in reader.read(p)]


@pytest.fixture(scope="module")
def ten(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('sqlite')}/ten.db"
    sqlite.write(spark.createDataFrame([(k, k / 2, f"text {k}") for k in range(9)] + [(None, None, None)], "a long, r double, s string"), path, "t")
    return path


def test_sqlite_reads_what_is_asked_for(spark, ten):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNull, LessThanOrEqual, StringStartsWith

    assert len(read_from(ten)) == 10
    assert [r[0] for r in read_from(ten, EqualTo(("a",), 3))] == [3] and [r[0] for r in read_from(ten, EqualTo(("r",), 1.5))] == [3]
    assert sorted(r[0] for r in read_from(ten, LessThanOrEqual(("a",), 2))) == [0, 1, 2] and len(read_from(ten, GreaterThan(("a",), 2), EqualTo(("s",), "text 5"))) == 1
    assert len(read_from(ten, In(("a",), (1, 2, 77)))) == 2 and len(read_from(ten, IsNull(("a",)))) == 1 and len(read_from(ten, StringStartsWith(("s",), "text 8"))) == 1
    t = sqlite.SqliteTable(spark, ten, "t")
    for p, n in ((A("a") == 3, 1), ((A("a") < 2) | A("s").glob("*7"), 4), (~(A("a") >= 3), 4), (A("a") == None, 1), (A("s") < 5, 1), (A("a") <= None, 1), (A("r") > 3.5, 1), (A("a") == 1.0, 0), (Custom(lambda c: c > 7, A("a")) & (A("a") > 5), 1)):  # noqa: E711
        sql, exact = sqlite.to_sql(p, t.types)
        assert t.select(p).df().count() == n and (not exact or len(read_from(ten, where=sql)) == n)
    assert sqlite.to_sql(Custom(lambda c: c > 7, A("a")) & (A("a") > 5), t.types)[1] is False
    with pytest.raises(ValueError):
        t.delete(Custom(lambda c: c > 7, A("a")))


def test_joins_ask_a_source_for_few_rows(spark, ten, monkeypatch):
    """A join with one row reads one of ten; through a rename as well; with more rows than allowed it reads all."""
    asked = []
    read = sqlite.read
    monkeypatch.setattr(sqlite, "read", lambda s, path, table, schema=None, where=None: asked.append(where) or read(s, path, table, schema, where))
    t = sqlite.SqliteTable(spark, ten, "t", T.StructType([T.StructField("a", T.LongType()), T.StructField("r", T.DoubleType()), T.StructField("s", T.StringType())]))
    one = literal(spark, ["k"], [4])
    assert one.equijoin(t, {"k": "a"}, narrow=100).df().count() == 1 and len(read_from(ten, where=asked[-1])) == 1
    both = one.equijoin(t, {"k": "a"}, narrow=100).project("k").union(one.with_update({"k": 5}).equijoin(t, {"k": "a"}, narrow=100).project("k"))
    assert both.df().count() == 2 and sum(len(read_from(ten, where=w)) for w in asked[-2:]) == 2
    assert literal(spark, ["k"], *[[k] for k in range(5)]).equijoin(t, {"k": "a"}, narrow=3).df().count() == 5 and asked[-1] is None
    assert literal(spark, ["k"], [1]).select(A("k") == 2).equijoin(t, {"k": "a"}, narrow=3).df().count() == 0 and len(read_from(ten, where=asked[-1])) == 0


def test_narrow_joins_reach_parquet(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS k").write.parquet(f"{tmp_path}/t")
    r = Leaf(spark.read.parquet(f"{tmp_path}/t"), keys=[["id"]])
    plan = literal(spark, ["x"], [4], [5]).equijoin(r, {"x": "id"}, narrow=10).df()._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualNullSafe(id,4),EqualNullSafe(id,5))" in plan or "Or(EqualNullSafe(id,5),EqualNullSafe(id,4))" in plan


def test_commits_store_changes_alone(spark, monkeypatch):
    db = Database(spark)
    t = db.create("t", spark.range(1000).selectExpr("id", "id % 10 AS k"), ["id"])
    base, wrote, kept = t._version.base, [], tables.staged_counted

    def counted(df, label):
        df, n = kept(df, label)
        wrote.append(n)
        return df, n

    monkeypatch.setattr(tables, "staged_counted", counted)
    t.add({"id": 5000, "k": 1})
    t.update(A("id") == 7, {"k": 99})
    t.delete(A("id") == 8)
    assert t._version.base is base and max(wrote) <= 3 and len(wrote) > 3
    assert t.df().count() == 1000 and {(r.id, r.k) for r in t._version.added.collect()} == {(5000, 1), (7, 99)} and {r.id for r in t._version.removed.collect()} == {7, 8}
    t.add({"id": 8, "k": 8})  # as it was
    assert {r.id for r in t._version.removed.collect()} == {7}
    with db.transaction():
        for k in range(6):
            t.update(A("id") == 100 + k, {"k": 50})
        t.delete(A("k") == 50)
    assert t.df().count() == 995 and t.df().where("k = 50").count() == 0
    monkeypatch.setattr(tables, "COMPACT_ROWS", 5)
    monkeypatch.setattr(tables, "COMPACT_SHARE", 0.0)
    before = db.snapshot()
    t.delete(A("k") == 3)
    assert t._version.base is not base and t._version.removed is None and t.df().where("k = 3").count() == 0
    db.restore(before)
    assert t.df().count() == 995


def test_changes_compose(spark):
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "n long")
    values = lambda df: set() if df is None else {r.n for r in df.collect()}
    both = Change(frame(1, 2), frame(8)).then(Change(frame(8, 3), frame(2, 9)))
    assert values(both.added) == {1, 3} and values(both.removed) == {9}
    assert values(Change(None, frame(1)).then(Change(frame(1), None)).removed) == set()


def test_what_an_update_leaves_true():
    p = (A("a") == 1) & (A("b") == 2)
    assert weakened(p, {"b"}).attributes() == {"a"} and weakened(~p, {"b"}).attributes() == set() and weakened(p, {"c"}).attributes() == {"a", "b"}


def test_index_layers(spark, monkeypatch):
    """An index refreshed again and again equals a new one; only the change is written, until layers are many."""
    monkeypatch.setattr(X, "LAYERS", 3)
    monkeypatch.setattr(X, "CLUSTERED", 0)
    text = {1: "old words here", 2: "other old things", 3: "words again and old words"}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "id long, text string")
    index = X.TextIndex(Leaf(frame(text), keys=[["id"]]), "id", ["text"])
    heard = []
    index.search("old").observe(heard.append)
    for k in range(5):
        new = {k + 1: f"old number {k}", 10 + k: "words words"}
        gone = {i: text[i] for i in new if i in text}
        index.refresh(frame(new), frame(gone) if gone else None)
        text |= new
        fresh = X.TextIndex(Leaf(frame(text), keys=[["id"]]), "id", ["text"])
        for query in ("old", "words NEAR/2 old", '"old words"', "num*"):
            tree = X.parse(query)
            assert {tuple(r) for r in index.rank(tree).collect()} == {tuple(r) for r in fresh.rank(tree).collect()}
    assert len(index.layers) <= 4 and len(heard) == 5
    index.refresh(None, frame({1: text.pop(1)}))
    assert {r.id for r in index.matching(X.parse("old")).collect()} == {i for i, t in text.items() if "old" in t}


def test_postings_are_pruned_by_token(spark, monkeypatch):
    monkeypatch.setattr(X, "CLUSTERED", 0)
    index = X.TextIndex(Leaf(spark.createDataFrame([(k, f"word{k} common") for k in range(50)], "id long, text string"), keys=[["id"]]), "id", ["text"])
    plan = index.hits(X.Phrase(("common",)))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,common)" in plan
    files = index.postings.withColumn("f", F.input_file_name()).groupBy("f").agg(F.min("token").alias("lo"), F.max("token").alias("hi")).collect()
    edges = sorted((r.lo, r.hi) for r in files)
    assert all(a[1] <= b[0] for a, b in zip(edges, edges[1:]))


def test_near_by_bands(spark):
    words = ["a"] + ["x"] * 30 + ["b"] + ["y"] * 3 + ["a", "b", "c"] + ["z"] * 11 + ["a"]
    index = X.TextIndex(Leaf(spark.createDataFrame([(1, " ".join(words)), (2, "b c d a"), (3, "a")], "id long, text string"), keys=[["id"]]), "id", ["text"])
    near = lambda q: {r.id for r in index.matching(X.parse(q)).collect()}
    place = lambda w: [k for k, x in enumerate(words) if x == w]
    for n in (0, 1, 2, 3, 10, 12, 13, 40):
        want = any(0 <= abs(i - j) - 1 <= n for i in place("a") for j in place("c"))
        assert (1 in near(f"a NEAR/{n} c")) == want
    assert near('"b c" NEAR/1 a') == {1, 2} and near('"b c" NEAR/0 a') == {1}


def test_natural_order():
    assert sorted(["a10", "a9", "b", "a"], key=natural) == ["a", "a9", "a10", "b"]


def test_no_local_folder_off_local_masters(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_between_of_equal_tables(spark):
    df = spark.range(5).toDF("n")
    assert between(df, df).is_empty()


@pytest.mark.parametrize("n", [0, 3])
def test_rows_are_counted_as_they_are_written(spark, n):
    df = spark.range(10).where(F.col("id") < n).select("id", F.lit("x").alias("a`b.c"))
    for some in (df, df.join(df.withColumnRenamed("a`b.c", "d"), "id"), df.limit(n), df.distinct()):
        out, count = scratch.staged_counted(some, "counted")
        assert count == n == out.count() and out.columns == some.columns
