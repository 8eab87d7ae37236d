"""Tables, transactions, observers, view updates, recursion, streams, stores."""

import plistlib
import sqlite3
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relspan.functions.predicates import Attr
from relspan.operators import recursion, summary
from relspan.operators.viewupdate import update
from relspan.plans.relation import literal
from relspan.sources import property_lists, sqlite
from relspan.sources.tables import Database, unaffected
from relspan.streaming.changes import apply_batch, follow

A = Attr


def rows(x):
    got = [tuple(r) for r in (x if hasattr(x, "collect") else x.df()).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture
def db(spark):
    d = Database(spark)
    d.create("people", spark.createDataFrame([(1, "Al", 10), (2, "Bea", 20), (3, "Cy", 10)], "id long, name string, house long"))
    d.create("houses", spark.createDataFrame([(10, "North"), (20, "South")], "hid long, address string"), ["hid"])
    return d


def test_mutations(db):
    p = db["people"]
    p.add({"id": 4, "name": "Di", "house": None}, {"id": 1, "name": "Al", "house": 10})
    p.delete(A("house") == 20)
    p.update(A("house") == None, {"house": 30})  # noqa: E711
    assert rows(p) == {(10, 1, "Al"), (10, 3, "Cy"), (30, 4, "Di")}
    db["houses"].add({"hid": 10, "address": "West"})  # the key replaces
    assert rows(db["houses"]) == {("West", 10), ("South", 20)}
    with pytest.raises(ValueError):
        p.update(True, {"age": 1})
    with pytest.raises(ValueError):
        p.add({"id": 1})


def test_transactions(db):
    p, seen = db["people"], []
    db.observe(p, lambda c, tags: seen.append((rows(c.added), rows(c.removed), tags)))
    with pytest.raises(RuntimeError), db.transaction():
        p.delete(True)
        assert p.is_empty()
        raise RuntimeError
    assert len(rows(p)) == 3 and not seen
    with db.transaction({"me"}):
        p.update(A("id") == 1, {"name": "X"})
        p.update(A("id") == 1, {"name": "Al"})
        p.update(A("id") == 2, {"name": "Y"})
        other = []
        t = threading.Thread(target=lambda: other.extend(rows(p)))
        t.start()
        t.join()
        assert (20, 2, "Bea") in other and (20, 2, "Y") in rows(p)
    assert seen == [({(20, 2, "Y")}, {(20, 2, "Bea")}, {"me"})]
    tries = []

    def busy(d):
        tries.append(1)
        d["people"].delete(A("id") == 3)
        if len(tries) < 3:
            raise sqlite3.OperationalError("database is locked")

    db.run(busy, sqlite.is_busy)
    assert len(tries) == 3 and len(rows(p)) == 2


def test_observed_views_and_queue(db):
    p = db["people"]
    view = p.equijoin(db["houses"], {"house": "hid"}).project("name", "address")
    changes, contents, values = [], [], []
    end = db.observe(view, lambda c, tags: changes.append((rows(c.added), rows(c.removed))))
    db.observe_content(view, lambda df, tags: contents.append((rows(df), tags)))
    stop = summary.publish(db, p.select(A("id") == 1).project("name"), summary.one_string, values.append, ignore="self")
    db.update_later(p, A("id") == 1, {"name": "Abe"}, tag="ui")
    db.delete_later("people", A("id") == 3, tag="other")
    db.add_later("people", {"id": 9, "name": "No", "house": 99})
    assert db.state == "pending"
    db.flush()
    assert db.state == "idle"
    assert changes == [({("North", "Abe")}, {("North", "Al"), ("North", "Cy")})]
    assert contents == [({("North", "Abe"), ("South", "Bea")}, {"ui", "other", None})]
    db.update_later(p, A("id") == 1, {"name": "Own"}, tag="self")
    db.flush()
    end()
    stop()
    p.delete(A("id") == 1)
    assert values == ["Al", "Abe"] and len(changes) == 2
    assert unaffected(p.select(A("id") == 1).project("name"), p, A("id") == 2) and not unaffected(p.project("name"), p, A("id") == 2)


def test_view_updates(db, spark):
    p, h = db["people"], db["houses"]
    update(p.equijoin(h, {"house": "hid"}), A("name") == "Al", {"address": "East"})
    assert rows(h) == {("East", 10), ("South", 20)}
    update(p.project("house"), A("house") == 10, {"house": 11})
    assert {r[0] for r in rows(p)} == {11, 20}
    update(p.rename({"name": "n"}).select(A("id") > 1), A("n") == "Cy", {"n": "Cyd"})
    assert (11, 3, "Cyd") in rows(p) and (11, 1, "Al") in rows(p)
    update(p.count(), True, {"count": 3})
    d = Database(spark)
    a = d.create("a", spark.createDataFrame([("x", 1), ("y", 2)], "n string, v long"))
    b = d.create("b", spark.createDataFrame([("x", 1), ("z", 3)], "n string, v long"))
    update(a - b, True, {"v": 20})
    assert rows(a) == {("x", 1), ("y", 20)} and rows(b) == {("x", 1), ("z", 3)}
    update(a.intersection(b), A("n") == "x", {"v": 10})
    assert ("x", 10) in rows(a) and ("x", 10) in rows(b)
    update(a + b, A("n") == "x", {"v": 11})
    assert ("x", 11) in rows(a) and ("x", 11) in rows(b)
    update(a.select(A("v") == 999).otherwise(b), A("n") == "z", {"v": 30})
    assert ("z", 30) in rows(b)
    with pytest.raises(ValueError):
        update(literal(spark, ["q"], [1]), True, {"q": 2})


def test_snapshots_deltas_undo(db):
    p = db["people"]
    first = db.snapshot()
    p.delete(A("id") == 1)
    second = db.snapshot()
    d = db.delta(first, second)
    db.restore(first)
    assert len(rows(p)) == 3
    db.apply(d)
    assert len(rows(p)) == 2
    db.apply(db.reversed(d))
    assert len(rows(p)) == 3
    db.undoable("one", lambda x: x["people"].delete(A("id") == 2))
    db.undoable("two", lambda x: x["people"].update(A("id") == 1, {"name": "Z"}))
    assert (db.undo(), db.undo(), db.undo()) == ("two", "one", None) and rows(p) == {(10, 1, "Al"), (20, 2, "Bea"), (10, 3, "Cy")}
    assert (db.redo(), db.redo(), db.redo()) == ("one", "two", None) and rows(p) == {(10, 1, "Z"), (10, 3, "Cy")}


def test_save_and_open(db, spark, tmp_path):
    db.save(str(tmp_path))
    db["people"].delete(True)
    db.save(str(tmp_path))
    assert rows(Database.open(spark, str(tmp_path))["people"]) == set() and rows(Database.open(spark, str(tmp_path))["houses"]) == rows(db["houses"])
    assert rows(db.sql("SELECT count(*) FROM houses")) == {(2,)}
    with pytest.raises(ValueError):
        db.create("people", db["people"].df())
    with pytest.raises(ValueError):
        db.get_or_create("people", db["houses"].df())


def test_recursion(spark):
    d = Database(spark)
    nodes = [(1, None), (2, 1), (3, 1), (4, 2), (5, 4), (6, None), (7, 6), (8, 9), (9, 8)]
    t = d.create("nodes", spark.createDataFrame(nodes, "id long, parent long"))
    d.create("names", spark.createDataFrame([(2, "b"), (6, "f"), (5, "e")], "node long, name string"))
    d.create("current", spark.createDataFrame([(5,)], "id long"))
    got = recursion.recursive_select({n: x for n, x in d.tables.items()}, "nodes", A("id") == 8, [recursion.Edge("nodes", "id", "nodes", "parent"), recursion.Edge("nodes", "id", "names", "node")])
    assert {r[0] for r in rows(got["nodes"])} == {8, 9}
    paths = recursion.tree_paths(t.select(A("id") < 8), "id", "parent")
    assert {(r.id, r.depth) for r in paths.collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 0), (7, 1)}
    up = recursion.CascadingUpdate("current", {"id": 5}, t.select(A("parent") == 6).project("id"), {"id": "id"})
    gone = recursion.cascading_delete(d, "nodes", A("id") == 2, [recursion.Edge("nodes", "id", "nodes", "parent"), recursion.Edge("nodes", "id", "names", "node")], [up])
    assert {r[0] for r in rows(gone["nodes"])} == {2, 4, 5} and rows(d["names"]) == {("f", 6)} and rows(d["current"]) == {(7,)}
    recursion.tree_delete(t, A("id") == 1, "id", "parent")
    assert {r[0] for r in rows(t)} == {6, 7, 8, 9}


def test_summaries(spark):
    from relspan.plans.delta import Change

    add = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "carlos")], "id long, name string")
    rem = spark.createDataFrame([(3, "charles"), (4, "donald")], "id long, name string")
    assert {(r.id, r.name, r.change_type) for r in summary.change_summary(Change(add, rem), "id").collect()} == {(1, "alice", "added"), (2, "bob", "added"), (3, "carlos", "updated"), (4, "donald", "deleted")}
    s = summary.SortedRows([{"id": 3, "name": "charles"}, {"id": 4, "name": "donald"}], "id", "name")
    events = s.apply(Change(add, rem))
    assert [r["name"] for r in s.rows] == ["alice", "bob", "carlos"] and events[0] == ("delete", 1) and len(events) == 4
    kind = lambda *v: summary.common_value(literal(spark, ["a", "k"], *[[x, k] for k, x in enumerate(v)], schema="a long, k long"), "a").first()
    assert (kind().kind, kind(5, 5).kind, kind(5, 6).kind, kind(None).kind, kind(None, 1).kind) == ("none", "one", "multi", "one", "multi")
    assert summary.order_between(None, None) == 5 and 1 < summary.order_between(None, 2) < 2


def test_streams(spark, db, tmp_path):
    schema = "id long, name string, house long, _op string, _seq long"
    batch = spark.createDataFrame([(7, "G", 10, "add", 1), (1, "Al", 10, "remove", 1), (8, "H", 1, "add", 1), (8, "H", 1, "remove", 2)], schema)
    apply_batch(db, "people", batch)
    apply_batch(db, "people", batch)
    assert {r[1] for r in rows(db["people"])} == {2, 3, 7}
    spark.createDataFrame([(9, "I", 20, "add", 1)], schema).write.parquet(f"{tmp_path}/in")
    seen = []
    db.observe(db["people"].count(), lambda c, tags: seen.append((rows(c.added), tags)))
    q = follow(db, "people", spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), available_now=True)
    q.awaitTermination(60)
    assert seen == [({(4,)}, {"stream"})]


SCHEMA = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("real", T.DoubleType())])
STORED = [(b"\x00x", 1, "one", 0.5), (None, 2, None, None), (b"", 3, "é", -1.0)]


def test_property_lists(spark, tmp_path):
    df = spark.createDataFrame(STORED, SCHEMA)
    codec = (lambda b: b[::-1], lambda b: b[::-1])
    property_lists.write_file(df, f"{tmp_path}/t.plist", codec)
    back = property_lists.read_file(spark, f"{tmp_path}/t.plist", SCHEMA, codec)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert property_lists.read_file(spark, f"{tmp_path}/no.plist", SCHEMA, create=True).count() == 0
    with pytest.raises(ValueError):
        property_lists.read_file(spark, f"{tmp_path}/t.plist", T.StructType(SCHEMA.fields[:2]), codec)
    property_lists.write_directory(df, f"{tmp_path}/d", ["id"])
    property_lists.write_directory(spark.createDataFrame([(None, 2, "two", 2.0)], SCHEMA), f"{tmp_path}/d", ["id"])
    got = property_lists.read_directory(spark, f"{tmp_path}/d", SCHEMA)
    assert {(r.id, r.name) for r in got.collect()} == {(1, "one"), (2, "two"), (3, "é")}
    assert property_lists.look_up(spark, f"{tmp_path}/d", {"id": 2}, SCHEMA).first().name == "two" and property_lists.look_up(spark, f"{tmp_path}/d", {"id": 5}, SCHEMA).count() == 0
    property_lists.delete_rows(got.where("id = 1"), f"{tmp_path}/d", ["id"])
    change = property_lists.replaced(df.select("id"), property_lists.read_directory(spark, f"{tmp_path}/d", SCHEMA).select("id"))
    assert rows(change.removed) == {(1,)} and rows(change.added) == set()
    assert plistlib.loads(property_lists.encode_row({"a": None, "b": 3})) == {"a": [], "b": ["integer", 3]}


def test_sqlite(spark, tmp_path):
    path = f"{tmp_path}/x.db"
    df = spark.createDataFrame(STORED, SCHEMA)
    sqlite.write(df, path, "t")
    sqlite.write(df, path, "t")  # a set: nothing twice
    back = sqlite.read(spark, path, "t")
    assert sorted(map(str, back.select("data", "id", "name", "real").collect())) == sorted(map(str, df.collect()))
    assert back.where("name = 'one'").count() == 1 and back.where("name IS NULL").count() == 1 and back.where("id = 3").count() == 1
    assert sqlite.tables(path) == {"t": ["data", "id", "name", "real"]}
    assert sqlite.execute(path, "SELECT name FROM t WHERE id = ?", [2]) == [(None,)]
    sqlite.write(df.limit(0), path, "t", overwrite=True)
    assert sqlite.read(spark, path, "t", SCHEMA).count() == 0


def test_mutable_select(spark):
    view = literal(spark, ["a"], *[[k] for k in range(6)]).mutable_select(A("a") < 3)
    added, removed = view.set((A("a") > 1) & (A("a") < 5))
    assert rows(added) == {(3,), (4,)} and rows(removed) == {(0,), (1,)} and view.df().agg(F.count("*")).first()[0] == 3


def test_cache_follows_its_table(db):
    view = db["people"].select(A("house") == 10).cache(100)
    assert len(rows(view)) == 2
    db["people"].add({"id": 5, "name": "Eve", "house": 10})
    assert len(rows(view)) == 3 and view._kept is not None
