"""The library's registered queries, each over whole tables, and the SQL that holds their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.functions.predicates import And, Attr, Custom, Or, combined
from relspan.operators import recursion, summary, textindex
from relspan.operators.viewupdate import update
from relspan.plans import relation as R
from relspan.plans.delta import between, derivative
from relspan.plans.relation import Leaf, Relation
from relspan.sources import property_lists
from relspan.sources.scratch import new_folder
from relspan.sources.tables import Database

Query = Callable[[SparkSession, str], DataFrame]

#: Keys of the driver's tables: with them no duplicates need removing.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id", "labels": "doc_id", "events": "event_id", "pages": "page_id", "benchmark": "item_id"}


def load(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Leaf(df, keys=[[KEYS[name]]] if name in KEYS else (), name=name)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of a segment and their nations: select, join, project."""
    customer = load(spark, sf_dir, "customer").select(Attr("c_mktsegment") == "BUILDING")
    return customer.equijoin(load(spark, sf_dir, "nation"), {"c_nationkey": "n_nationkey"}).project("c_custkey", "n_name").df()


class _Tables:
    """T(spark, dir).orders and so on."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> Relation:
        return load(self.spark, self.sf_dir, name)


def _labelled(t: _Tables) -> Relation:
    """doc_id and its labels, NULL where there are none."""
    return t.documents.project("doc_id").left_outer_join(t.labels)


def _selected(t: _Tables) -> Relation:
    return t.nation.project("n_nationkey")


def _poor(t: _Tables) -> Relation:
    return t.supplier.select(Attr("s_acctbal") < 0.0).project("s_nationkey").rename({"s_nationkey": "n_nationkey"})


def _divide(t: _Tables) -> Relation:
    a = t.lineitem.select((Attr("l_returnflag") == "R") & (Attr("l_quantity") > 40.0)).project("l_suppkey", "l_linenumber")
    return a.divide(t.lineitem.project("l_linenumber"))


def _delta(make: Callable[[Relation, Relation], Relation], which: str) -> Query:
    """A view over customers and suppliers by nation, when segment BUILDING leaves and MACHINERY comes, and rich suppliers leave and those in debt come."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _Tables(spark, sf_dir)
        c, s = t.customer, t.supplier
        c_old, c_new = c.select(Attr("c_mktsegment") != "MACHINERY"), c.select(Attr("c_mktsegment") != "BUILDING")
        s_old, s_new = s.select(Attr("s_acctbal") >= 0.0), s.select(Attr("s_acctbal") < 500.0)
        left, right = Leaf(c_new.df(), keys=[["c_custkey"]]), Leaf(s_new.df(), keys=[["s_suppkey"]])
        changes = {left: between(c_old.df(), c_new.df()), right: between(s_old.df(), s_new.df())}
        change = derivative(make(left, right), changes)
        out = getattr(change, which)
        return out if out is not None else make(left, right).df().limit(0)

    return run


def _c_nations(c: Relation, above: float = 9000.0) -> Relation:
    return c.select(Attr("c_acctbal") > above).project("c_nationkey").rename({"c_nationkey": "k"})


def _s_nations(s: Relation) -> Relation:
    return s.select(Attr("s_acctbal") < 1000.0).project("s_nationkey").rename({"s_nationkey": "k"})


_VIEWS = {
    "select": lambda c, s: c.select(Attr("c_acctbal") > 0.0),
    "project": lambda c, s: _c_nations(c, 9800.0),
    "union": lambda c, s: _c_nations(c, 9800.0).union(_s_nations(s)),
    "intersection": lambda c, s: _c_nations(c, 9800.0).intersection(_s_nations(s)),
    "difference": lambda c, s: _c_nations(c, 9800.0).difference(_s_nations(s)),
    "join": lambda c, s: c.select(Attr("c_acctbal") > 9000.0).equijoin(s, {"c_nationkey": "s_nationkey"}).project("c_custkey", "s_suppkey"),
    "update": lambda c, s: c.select(Attr("c_acctbal") > 9800.0).project("c_nationkey", "c_mktsegment").with_update({"c_mktsegment": "ANY"}),
    "max": lambda c, s: c.max("c_acctbal"),
}
_VIEW_SQL = {
    "select": "SELECT * FROM {c} WHERE c_acctbal > 0",
    "project": "SELECT DISTINCT c_nationkey AS k FROM {c} WHERE c_acctbal > 9800",
    "union": "SELECT c_nationkey AS k FROM {c} WHERE c_acctbal > 9800 UNION SELECT s_nationkey FROM {s} WHERE s_acctbal < 1000",
    "intersection": "SELECT c_nationkey AS k FROM {c} WHERE c_acctbal > 9800 INTERSECT SELECT s_nationkey FROM {s} WHERE s_acctbal < 1000",
    "difference": "SELECT c_nationkey AS k FROM {c} WHERE c_acctbal > 9800 EXCEPT SELECT s_nationkey FROM {s} WHERE s_acctbal < 1000",
    "join": "SELECT c_custkey, s_suppkey FROM {c} JOIN {s} ON c_nationkey = s_nationkey WHERE c_acctbal > 9000",
    "update": "SELECT DISTINCT c_nationkey, 'ANY' AS c_mktsegment FROM {c} WHERE c_acctbal > 9800",
    "max": "SELECT max(c_acctbal) AS c_acctbal FROM {c} HAVING count(*) > 0",
}
_OLD = {"c": "(SELECT * FROM customer WHERE c_mktsegment <> 'MACHINERY')", "s": "(SELECT * FROM supplier WHERE s_acctbal >= 0)"}
_NEW = {"c": "(SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')", "s": "(SELECT * FROM supplier WHERE s_acctbal < 500)"}


def _delta_sql(view: str, which: str) -> str:
    a, b = (_NEW, _OLD) if which == "added" else (_OLD, _NEW)
    return f"SELECT * FROM ({_VIEW_SQL[view].format(**a)}) EXCEPT SELECT * FROM ({_VIEW_SQL[view].format(**b)})"


def _change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _Tables(spark, sf_dir)
    r = t.customer.project("c_custkey", "c_mktsegment", "c_acctbal").df()
    old = r.where("c_acctbal >= 0")
    new = r.where("c_mktsegment <> 'MACHINERY'").withColumn("c_mktsegment", F.when(F.col("c_acctbal") > 9000, "RICH").otherwise(F.col("c_mktsegment")))
    return summary.change_summary(between(old, new), "c_custkey")


def _db(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    db = Database(spark)
    for n in names:
        db.create(n, spark.read.parquet(f"{sf_dir}/{n}.parquet"), [KEYS[n]])
    return db


def _saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database that is changed, saved and opened again."""
    db = _db(spark, sf_dir, "nation")
    db["nation"].delete(Attr("n_regionkey") == 1)
    folder = new_folder(spark, "saved")
    db.save(folder)
    return Database.open(spark, folder)["nation"].df()


def _property_list_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, uri = load(spark, sf_dir, "region").df(), f"{new_folder(spark, 'plist')}/region.plist"
    property_lists.write_file(df, uri)
    return property_lists.read_file(spark, uri, df.schema)


def _property_list_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, uri = load(spark, sf_dir, "nation").df(), new_folder(spark, "plists")
    property_lists.write_directory(df, uri, ["n_nationkey"])
    property_lists.delete_rows(df.where("n_regionkey = 1"), uri, ["n_nationkey"])
    return property_lists.read_directory(spark, uri, df.schema)


def _sqlite_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SQLite file in the shared folder, which must be one that the executors mount."""
    from relspan.stateful import _sqlite

    return _sqlite(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").df().where("s_nationkey = 3")


def _update_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "nation", "region")
    view = db["nation"].equijoin(db["region"], {"n_regionkey": "r_regionkey"})
    update(view, Attr("r_name") == "ASIA", {"n_name": "SOMEWHERE"})
    return db["nation"].df()


def _update_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "customer")
    update(db["customer"].project("c_mktsegment"), Attr("c_mktsegment") == "BUILDING", {"c_mktsegment": "HOUSES"})
    return db["customer"].df()


def _update_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "customer")
    update(db["customer"].select(Attr("c_acctbal") < 0.0), Attr("c_mktsegment") == "BUILDING", {"c_acctbal": 0.0})
    return db["customer"].df()


def _table_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "nation")
    with db.transaction():
        db["nation"].add({"n_nationkey": 99, "n_name": "ATLANTIS", "n_regionkey": 1})
        db["nation"].delete(Attr("n_regionkey") == 2)
        db["nation"].update(Attr("n_regionkey") == 3, {"n_name": "EUROPEAN"})
    return db["nation"].df()


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "nation")
    before = db.snapshot()
    db["nation"].delete(Attr("n_regionkey") == 2)
    db.restore(before)
    return db["nation"].df()


def _delta_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "nation")
    before = db.snapshot()
    db["nation"].update(Attr("n_regionkey") == 2, {"n_name": "ASIAN"})
    d = db.delta(before, db.snapshot())
    db.apply(db.reversed(d))
    db.apply(d)
    return db["nation"].df()


def _undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _db(spark, sf_dir, "nation")
    db.undoable("first", lambda d: d["nation"].update(Attr("n_regionkey") == 1, {"n_name": "ONE"}))
    db.undoable("second", lambda d: d["nation"].delete(Attr("n_regionkey") == 0))
    db.undo()
    db.undo()
    db.redo()
    return db["nation"].df()


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a tree: the parent of key k is k div 3."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr("c_custkey div 3").alias("parent"))


def _recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = Leaf(_tree(spark, sf_dir), keys=[["c_custkey"]])
    got = recursion.recursive_select({"nodes": nodes}, "nodes", Attr("c_custkey") == 1, [recursion.Edge("nodes", "c_custkey", "nodes", "parent")])
    return got["nodes"].project("c_custkey").df()


def _tree_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    nodes = db.create("nodes", _tree(spark, sf_dir), ["c_custkey"])
    recursion.tree_delete(nodes, Attr("c_custkey") == 1, "c_custkey", "parent")
    return nodes.project("c_custkey").df()


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete a region, its nations and their suppliers; what remains of suppliers."""
    db = _db(spark, sf_dir, "region", "nation", "supplier")
    edges = [recursion.Edge("region", "r_regionkey", "nation", "n_regionkey"), recursion.Edge("nation", "n_nationkey", "supplier", "s_nationkey")]
    recursion.cascading_delete(db, "region", Attr("r_regionkey") == 1, edges)
    return db["supplier"].project("s_suppkey", "s_nationkey").df()


def _search(query: str, columns: tuple[str, ...] = ("doc_id",)) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = textindex.TextIndex(load(spark, sf_dir, "documents"), "doc_id", ["text"], dealt=False)
        if columns == ("doc_id",):
            return index.matching(textindex.parse(query)).withColumnRenamed("id", "doc_id")
        if columns == ("doc_id", "rank"):
            return index.rank(textindex.parse(query)).select(F.col("id").alias("doc_id"), F.round("rank", 9).alias("rank"))
        return index.search(query).df().select(*columns)

    return run


def _structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _search("that* OR with", ("doc_id", "text_snippet"))(spark, sf_dir)  # which has sent this package to the executors

    def run(batches):
        for pdf in batches:
            s = [textindex.StructuredSnippet.parse(x) for x in pdf.text_snippet]
            yield pdf.assign(plain=[x.text for x in s], n_matches=[len(x.matches) for x in s], at_start=[x.ellipsis_at_start for x in s], at_end=[x.ellipsis_at_end for x in s]).drop(columns="text_snippet")

    return raw.mapInPandas(run, "doc_id long, plain string, n_matches long, at_start boolean, at_end boolean")


def _contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = load(spark, sf_dir, "region").project("r_name")
    return spark.createDataFrame([(n, r.contains({"r_name": n})) for n in ("ASIA", "ATLANTIS")], "name string, there boolean")


def _mutable_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = load(spark, sf_dir, "nation").mutable_select(Attr("n_regionkey") <= 1)
    added, removed = view.set((Attr("n_regionkey") >= 1) & (Attr("n_regionkey") < 3))
    return added.withColumn("side", F.lit("added")).unionByName(removed.withColumn("side", F.lit("removed")))


def queries() -> dict[str, Query]:
    A = Attr  # noqa: N806
    simple: dict[str, Callable[[_Tables], Relation]] = {
        "select_eq": lambda t: t.nation.select(A("n_regionkey") == 1),
        "select_ne": lambda t: t.nation.select(A("n_regionkey") != 1),
        "select_range": lambda t: t.orders.select((A("o_totalprice") >= 100000.0) & (A("o_totalprice") < 200000.0)).project("o_orderkey", "o_totalprice"),
        "select_or_not": lambda t: t.customer.select((A("c_mktsegment") == "BUILDING") | ~(A("c_nationkey") == 3)).project("c_custkey"),
        "select_row": lambda t: t.nation.select({"n_regionkey": 1, "n_name": "CANADA"}).union(t.nation.select({"n_regionkey": 0, "n_nationkey": 0})),
        "select_glob": lambda t: t.part.select(A("p_type").glob("PROMO*")).project("p_partkey", "p_type"),
        "select_glob_class": lambda t: t.part.select(A("p_type").glob("*[AB]?*")).project("p_partkey", "p_type"),
        "select_custom": lambda t: t.supplier.select(Custom(lambda a: F.abs(a) % 100 < 10, A("s_acctbal"))).project("s_suppkey"),
        "select_any_of": lambda t: t.orders.select(combined([A("o_orderpriority") == p for p in ("1-URGENT", "2-HIGH", "5-LOW")], Or)).project("o_orderkey"),
        "select_all_of": lambda t: t.orders.select(combined([A("o_orderstatus") == "O", A("o_totalprice") > 50000.0, A("o_orderpriority") != "5-LOW"], And)).project("o_orderkey"),
        "select_lt_null": lambda t: _labelled(t).select(A("quality") < 1),
        "select_ge_null": lambda t: _labelled(t).select(A("quality") >= None).project("doc_id"),
        "select_truthy": lambda t: _labelled(t).select(A("toxic")).project("doc_id"),
        "split_match": lambda t: t.customer.split(A("c_acctbal") < 0.0)[0].project("c_custkey"),
        "split_rest": lambda t: t.customer.split(A("c_acctbal") < 0.0)[1].project("c_custkey"),
        "project": lambda t: t.orders.project("o_orderpriority", "o_orderstatus"),
        "project_dropping": lambda t: t.customer.project_dropping("c_custkey", "c_name", "c_acctbal"),
        "project_none": lambda t: t.region.join(t.nation.project()),
        "rename": lambda t: t.region.rename({"r_regionkey": "key", "r_name": "name"}),
        "rename_swap": lambda t: t.customer.project("c_custkey", "c_nationkey").rename({"c_custkey": "c_nationkey", "c_nationkey": "c_custkey"}),
        "rename_prime": lambda t: t.region.rename_prime(),
        "project_renamed": lambda t: t.customer.project_renamed({"c_mktsegment": "segment", "c_nationkey": "nation"}),
        "with_update": lambda t: t.customer.project("c_mktsegment", "c_nationkey").with_update({"c_nationkey": 0}),
        "with_update_query": lambda t: t.customer.project("c_custkey", "c_mktsegment", "c_acctbal").with_update({"c_mktsegment": "NEG"}, A("c_acctbal") < 0.0),
        "union": lambda t: t.customer.project("c_nationkey").rename({"c_nationkey": "k"}).union(t.supplier.project("s_nationkey").rename({"s_nationkey": "k"})),
        "intersection": lambda t: _c_nations(t.customer).intersection(_s_nations(t.supplier)),
        "difference": lambda t: _selected(t).difference(_poor(t)),
        "natural_join": lambda t: t.documents.project("doc_id", "lang").join(t.labels),
        "natural_join_null": lambda t: _labelled(t).join(_labelled(t).project("doc_id", "quality").with_update({"quality": None}, A("quality") == 0)),
        "cross_join": lambda t: t.region.join(t.nation.project("n_name")),
        "equijoin": lambda t: t.nation.equijoin(t.region, {"n_regionkey": "r_regionkey"}),
        "equijoin_three": lambda t: t.orders.select(A("o_totalprice") > 300000.0).equijoin(t.customer, {"o_custkey": "c_custkey"}).equijoin(t.nation, {"c_nationkey": "n_nationkey"}).project("o_orderkey", "c_name", "n_name"),
        "thetajoin": lambda t: t.supplier.project("s_suppkey", "s_acctbal").thetajoin(t.supplier.project("s_suppkey", "s_acctbal").rename_prime(), A("s_acctbal") < A("s_acctbal'")).project("s_suppkey", "s_suppkey'"),
        "left_outer_join": lambda t: t.documents.project("doc_id", "lang").left_outer_join(t.labels),
        "divide": _divide,
        "min": lambda t: t.orders.min("o_totalprice"),
        "max": lambda t: t.orders.max("o_totalprice"),
        "min_empty": lambda t: t.orders.select(A("o_totalprice") < 0.0).min("o_totalprice"),
        "min_with_null": lambda t: _labelled(t).min("quality"),
        "max_with_null": lambda t: _labelled(t).max("quality"),
        "count": lambda t: t.orders.project("o_custkey").count(),
        "count_empty": lambda t: t.orders.select(A("o_totalprice") < 0.0).count(),
        "aggregate_custom": lambda t: t.lineitem.aggregate("total", lambda: F.round(F.sum("l_quantity"), 2)),
        "aggregate_fold": lambda t: t.orders.project("o_orderkey", "o_orderstatus").fold("n", 0, lambda s, rows: s + sum(r["o_orderstatus"] == "F" for r in rows), lambda a, b: a + b, "long"),
        "otherwise_left": lambda t: t.nation.select(A("n_regionkey") == 1).otherwise(t.nation),
        "otherwise_right": lambda t: t.nation.select(A("n_regionkey") == 77).otherwise(t.nation),
        "unique_pass": lambda t: t.nation.select(A("n_regionkey") == 2).unique("n_regionkey", 2),
        "unique_fail": lambda t: t.nation.unique("n_regionkey", 2),
        "cached": lambda t: t.nation.select(A("n_regionkey") == 1).cache(1000).project("n_name"),
    }
    out: dict[str, Query] = {n: (lambda s, d, f=f: f(_Tables(s, d)).df()) for n, f in simple.items()}
    out |= {f"delta_{v}_{w}": _delta(make, w) for v, make in _VIEWS.items() for w in ("added", "removed")}
    out |= {
        "flagship": flagship, "contains": _contains, "mutable_select": _mutable_select, "change_summary": _change_summary,
        "update_through_join": _update_join, "update_through_project": _update_project, "update_through_select": _update_select,
        "table_mutations": _table_ops, "snapshot_restore": _snapshot, "delta_apply": _delta_apply, "undo_redo": _undo,
        "saved_database": _saved, "property_list_file": _property_list_file, "property_list_directory": _property_list_directory, "sqlite_select": _sqlite_select,
        "recursive_select": _recursive, "tree_delete": _tree_delete, "cascading_delete": _cascade,
        "tree_paths": lambda s, d: recursion.tree_paths(Leaf(_tree(s, d).withColumn("parent", F.when(F.col("c_custkey") > 2, F.col("parent"))), keys=[["c_custkey"]]), "c_custkey", "parent").select("c_custkey", "depth"),
        "common_value": lambda s, d: summary.common_value(load(s, d, "nation").select(Attr("n_regionkey") == 1), "n_regionkey"),
        "common_value_multi": lambda s, d: summary.common_value(load(s, d, "nation"), "n_regionkey"),
        "text_search_term": _search("the"), "text_search_prefix": _search("tion*"), "text_search_and": _search("the with"), "text_search_or": _search("idiot OR clown"), "text_search_not": _search("the NOT with"),
        "text_search_phrase": _search('"of the"'), "text_search_near": _search("idiot NEAR/20 the"), "text_rank": _search("idiot OR the", ("doc_id", "rank")),
        "snippet": _search("that* OR with", ("doc_id", "text_snippet")), "structured_snippet": _structured,
    }
    return out


_LABELLED = "(SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')"
_C = "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9000"
_S = "SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 1000"
_TREE = "WITH RECURSIVE t(k) AS (SELECT c_custkey FROM customer WHERE c_custkey = 1 UNION SELECT c.c_custkey FROM customer c JOIN t ON c.c_custkey // 3 = t.k)"


def oracle_sql() -> dict[str, str]:
    sql = {
        "flagship": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
        "select_eq": "SELECT * FROM nation WHERE n_regionkey IS NOT DISTINCT FROM 1",
        "select_ne": "SELECT * FROM nation WHERE n_regionkey IS DISTINCT FROM 1",
        "select_range": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000",
        "select_or_not": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR NOT (c_nationkey = 3)",
        "select_row": "SELECT * FROM nation WHERE n_regionkey = 1 AND n_name = 'CANADA' UNION SELECT * FROM nation WHERE n_regionkey = 0 AND n_nationkey = 0",
        "select_glob": "SELECT p_partkey, p_type FROM part WHERE p_type GLOB 'PROMO*'",
        "select_glob_class": "SELECT p_partkey, p_type FROM part WHERE p_type GLOB '*[AB]?*'",
        "select_custom": "SELECT s_suppkey FROM supplier WHERE abs(s_acctbal) % 100 < 10",
        "select_any_of": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')",
        "select_all_of": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000 AND o_orderpriority <> '5-LOW'",
        "select_lt_null": f"SELECT * FROM {_LABELLED} WHERE quality IS NULL OR quality < 1",
        "select_ge_null": f"SELECT doc_id FROM {_LABELLED}",
        "select_truthy": f"SELECT doc_id FROM {_LABELLED} WHERE toxic IS DISTINCT FROM 0",
        "split_match": "SELECT c_custkey FROM customer WHERE c_acctbal < 0",
        "split_rest": "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0",
        "project": "SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders",
        "project_dropping": "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer",
        "project_none": "SELECT * FROM region WHERE EXISTS (SELECT 1 FROM nation)",
        "rename": "SELECT r_regionkey AS key, r_name AS name FROM region",
        "rename_swap": "SELECT c_custkey AS c_nationkey, c_nationkey AS c_custkey FROM customer",
        "rename_prime": """SELECT r_regionkey AS "r_regionkey'", r_name AS "r_name'" FROM region""",
        "project_renamed": "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer",
        "with_update": "SELECT DISTINCT c_mktsegment, CAST(0 AS INTEGER) AS c_nationkey FROM customer",
        "with_update_query": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NEG' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer",
        "union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
        "intersection": f"{_C} INTERSECT {_S}",
        "difference": "SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0",
        "natural_join": "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)",
        "natural_join_null": f"SELECT a.* FROM {_LABELLED} a JOIN (SELECT DISTINCT doc_id, CASE WHEN quality = 0 THEN NULL ELSE quality END AS quality FROM {_LABELLED}) b ON a.doc_id = b.doc_id AND a.quality IS NOT DISTINCT FROM b.quality",
        "cross_join": "SELECT r_regionkey, r_name, n_name FROM region, (SELECT DISTINCT n_name FROM nation)",
        "equijoin": "SELECT * FROM nation JOIN region ON n_regionkey IS NOT DISTINCT FROM r_regionkey",
        "equijoin_three": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000",
        "thetajoin": """SELECT a.s_suppkey, b.s_suppkey AS "s_suppkey'" FROM supplier a, supplier b WHERE a.s_acctbal < b.s_acctbal""",
        "left_outer_join": "SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)",
        "divide": "WITH a AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40), d AS (SELECT DISTINCT l_linenumber FROM lineitem) SELECT l_suppkey FROM a GROUP BY l_suppkey HAVING count(*) = (SELECT count(*) FROM d)",
        "min": "SELECT min(o_totalprice) AS o_totalprice FROM orders HAVING count(*) > 0",
        "max": "SELECT max(o_totalprice) AS o_totalprice FROM orders HAVING count(*) > 0",
        "min_empty": "SELECT min(o_totalprice) AS o_totalprice FROM orders WHERE o_totalprice < 0 HAVING count(*) > 0",
        "min_with_null": f"SELECT CASE WHEN count(*) > count(quality) THEN NULL ELSE min(quality) END AS quality FROM {_LABELLED} HAVING count(*) > 0",
        "max_with_null": f"SELECT max(quality) AS quality FROM {_LABELLED} HAVING count(*) > 0",
        "count": "SELECT count(DISTINCT o_custkey) AS count FROM orders",
        "count_empty": "SELECT count(*) AS count FROM orders WHERE o_totalprice < 0",
        "aggregate_custom": "SELECT round(sum(l_quantity), 2) AS total FROM (SELECT DISTINCT * FROM lineitem)",
        "aggregate_fold": "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'",
        "otherwise_left": "SELECT * FROM nation WHERE n_regionkey = 1",
        "otherwise_right": "SELECT * FROM nation",
        "unique_pass": "SELECT * FROM nation WHERE n_regionkey = 2",
        "unique_fail": "SELECT * FROM nation WHERE (SELECT count(DISTINCT n_regionkey) FROM nation) = 1",
        "cached": "SELECT DISTINCT n_name FROM nation WHERE n_regionkey = 1",
        "contains": "SELECT 'ASIA' AS name, 'ASIA' IN (SELECT r_name FROM region) AS there UNION ALL SELECT 'ATLANTIS', 'ATLANTIS' IN (SELECT r_name FROM region)",
        "mutable_select": "SELECT *, 'added' AS side FROM nation WHERE n_regionkey = 2 UNION ALL SELECT *, 'removed' FROM nation WHERE n_regionkey < 1",
        "change_summary": "WITH o AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_acctbal >= 0), n AS (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY'), a AS (SELECT * FROM n EXCEPT SELECT * FROM o), r AS (SELECT * FROM o EXCEPT SELECT * FROM n) SELECT coalesce(a.c_custkey, r.c_custkey) AS c_custkey, coalesce(a.c_mktsegment, r.c_mktsegment) AS c_mktsegment, coalesce(a.c_acctbal, r.c_acctbal) AS c_acctbal, CASE WHEN a.c_custkey IS NULL THEN 'deleted' WHEN r.c_custkey IS NULL THEN 'added' ELSE 'updated' END AS change_type FROM a FULL JOIN r ON a.c_custkey = r.c_custkey",
        "update_through_join": "SELECT n_nationkey, CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA') THEN 'SOMEWHERE' ELSE n_name END AS n_name, n_regionkey FROM nation",
        "update_through_project": "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSES' ELSE c_mktsegment END AS c_mktsegment FROM customer",
        "update_through_select": "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
        "table_mutations": "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN 'EUROPEAN' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 99, 'ATLANTIS', 1",
        "snapshot_restore": "SELECT * FROM nation",
        "saved_database": "SELECT * FROM nation WHERE n_regionkey <> 1",
        "property_list_file": "SELECT * FROM region",
        "property_list_directory": "SELECT * FROM nation WHERE n_regionkey <> 1",
        "sqlite_select": "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_nationkey = 3",
        "delta_apply": "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'ASIAN' ELSE n_name END AS n_name, n_regionkey FROM nation",
        "undo_redo": "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'ONE' ELSE n_name END AS n_name, n_regionkey FROM nation",
        "recursive_select": f"{_TREE} SELECT k AS c_custkey FROM t",
        "tree_delete": f"{_TREE} SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT k FROM t)",
        "tree_paths": "WITH RECURSIVE n AS (SELECT c_custkey, CASE WHEN c_custkey > 2 THEN c_custkey // 3 END AS p FROM customer), t(c_custkey, depth) AS (SELECT c_custkey, 0 FROM n WHERE p IS NULL UNION ALL SELECT n.c_custkey, depth + 1 FROM n JOIN t ON n.p = t.c_custkey) SELECT c_custkey, CAST(depth AS INTEGER) AS depth FROM t",
        "cascading_delete": "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
        "common_value": "SELECT 'one' AS kind, CAST(1 AS INTEGER) AS value",
        "common_value_multi": "SELECT CASE WHEN count(*) = 0 THEN 'none' WHEN count(DISTINCT n_regionkey) = 1 THEN 'one' ELSE 'multi' END AS kind, CASE WHEN count(DISTINCT n_regionkey) = 1 THEN min(n_regionkey) END AS value FROM nation",
        "text_search_term": f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'the')",
        "text_search_prefix": f"SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda x: starts_with(x, 'tion'))) > 0",
        "text_search_and": f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'the') AND list_contains({_WORDS}, 'with')",
        "text_search_or": f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'idiot') OR list_contains({_WORDS}, 'clown')",
        "text_search_not": f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'the') AND NOT list_contains({_WORDS}, 'with')",
        "text_search_phrase": f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' of the ')",
        "text_search_near": f"WITH w AS (SELECT doc_id, unnest({_WORDS}) AS t, generate_subscripts({_WORDS}, 1) AS p FROM documents) SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.t = 'idiot' AND b.t = 'the' AND abs(a.p - b.p) - 1 BETWEEN 0 AND 20",
        "text_rank": f"WITH c AS (SELECT doc_id, len(list_filter({_WORDS}, lambda x: x = 'idiot')) AS a, len(list_filter({_WORDS}, lambda x: x = 'the')) AS b FROM documents) SELECT doc_id, round(CASE WHEN (SELECT sum(a) FROM c) > 0 THEN a / (SELECT sum(a) FROM c) ELSE 0 END + b / (SELECT sum(b) FROM c), 9) AS rank FROM c WHERE a > 0 OR b > 0",
    }
    return sql | {f"delta_{v}_{w}": _delta_sql(v, w) for v in _VIEWS for w in ("added", "removed")}
