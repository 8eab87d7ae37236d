"""Full-text search."""

import pytest

from relspan.operators import textindex as X
from relspan.plans.relation import Leaf, literal


@pytest.fixture(scope="module")
def index(spark):
    r = literal(
        spark, ["id", "text", "title"], [1, "The princess and the pea", "A tale"], [2, "Two princesses dance; a prince watches", "princess"], [3, "Über die Brücke", "Straße"], [4, "nothing here", None],
        [5, " ".join(["filler"] * 40 + ["needle", "in", "hay"] + ["filler"] * 40), "long"],
    )
    return X.TextIndex(r, "id", ["text", "title"])


@pytest.mark.parametrize("query,ids", [("princess", {1, 2}), ("princess*", {1, 2}), ("prince", {2}), ("PRINCESS pea", {1}), ('"the pea"', {1}), ('"pea the"', set()), ("pea OR prince", {1, 2}), ("princess NOT pea", {2}), ("über", {3}), ("uber", set()), ("(pea OR dance) tale", {1}), ("princess NEAR/2 pea", {1}), ("princess NEAR/1 pea", set()), ('"in ha*"', {5}), ("", set()), ("...", set())])
def test_queries(index, query, ids):
    assert {r.id for r in index.matching(X.parse(query)).collect()} == ids


def test_rank_and_snippets(index):
    got = {r.id: r for r in index.search("princess*").df().collect()}
    assert got[1]["rank"] == pytest.approx(0.5) and got[2]["rank"] == pytest.approx(1.5)
    assert got[1].text_snippet == "The \x02princess\x03 and the pea"
    s = X.StructuredSnippet.parse(index.search("needle").df().first().text_snippet)
    assert s.ellipsis_at_start and s.ellipsis_at_end and s.text[slice(*s.matches[0])] == "needle" and len(s.text.split()) == X.WINDOW
    with pytest.raises(ValueError):
        X.parse("a OR")
    with pytest.raises(ValueError):
        X.parse("(a")


def test_refresh(spark):
    r = literal(spark, ["id", "text"], [1, "old words"], [2, "other"])
    index = X.TextIndex(r, "id", ["text"])
    live = index.search("words")
    assert {x.id for x in live.df().collect()} == {1}
    index.refresh(spark.createDataFrame([(1, "new"), (3, "words again")], "id long, text string"), spark.createDataFrame([(1, "old words")], "id long, text string"))
    assert {x.id for x in live.df().collect()} == {3}
    live.query = "new"
    assert live.relation().project("id").one_value() == 1


def test_blocks_hold_every_posting(monkeypatch):
    """A row a token and block, not a posting; long lists are cut, groups end at batches; nulls and rows without words do no harm."""
    import random

    import pyarrow as pa

    rng = random.Random(1)
    rows = [(rng.choice([None, k, k + 0]), rng.choice("xy"), [rng.choice("aaaab") + rng.choice(["", "é"]) for _ in range(rng.randrange(30))] if k % 7 else None) for k in range(60)]
    want = sorted(((i, f, p, t) for i, f, w in rows for p, t in enumerate(w or ())), key=repr)
    for block, grouped in ((4096, 10**6), (5, 10**6), (5, 100)):
        monkeypatch.setattr(X, "BLOCK", block)
        monkeypatch.setattr(X, "GROUPED", grouped)
        batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[at : at + 9]], t) for k, t in enumerate((pa.int64(), pa.string(), pa.list_(pa.string())))], ["id", "field", "w"]) for at in range(0, 60, 9)]
        got = [r for b in X.blocks(batches) for r in b.to_pylist()]
        assert all(0 < len(r["ids"]) == len(r["places"]) <= block for r in got)
        assert sorted(((i, r["field"], p, r["token"]) for r in got for i, p in zip(r["ids"], r["places"])), key=repr) == want
        assert block < 4096 or len(got) == len({(f, t) for _, f, _, t in want})
    assert list(X.blocks([])) == []


def test_few_found_rows_need_no_shuffle_of_texts(spark, index):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "123456789")
    found = index.search("princess").df()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == X.BATCH_BYTES  # a worker holds few texts at a time


def test_ranges_are_even_by_bytes(spark, monkeypatch):
    """Long blocks of frequent tokens lie together: files that hold like numbers of blocks differ by far. Every block stays, also of null ids, and tokens stay in order."""
    from pyspark.sql import functions as F

    flat = spark.range(0, 6000, 1, 3).select(
        F.when(F.col("id") % 2 == 0, F.format_string("a%04d", "id")).otherwise(F.when(F.col("id") % 3 == 0, "the").otherwise(F.format_string("z%04d", "id"))).alias("token"), F.lit("text").alias("field"),
        F.when(F.col("id") % 3 == 0, F.sequence(F.when(F.col("id") % 9 > 0, F.col("id")), F.col("id") + 300)).alias("ids"),
    )
    flat = flat.withColumn("ids", F.coalesce("ids", F.array(F.lit(None).cast("long")))).withColumn("places", F.transform("ids", lambda x: F.lit(1)))
    monkeypatch.setattr(X, "CLUSTERED", 0)
    monkeypatch.setattr(X, "FILE", 2000)
    rows = lambda df: sorted(((r.token, r.id) for r in df.collect()), key=repr)
    made = []
    monkeypatch.setattr(X, "staged", lambda df, label, stage=X.staged: made.append(stage(df, label)) or made[-1])
    got = X.TextIndex._stored(flat)
    stored = made[-1].withColumn("file", F.input_file_name())
    assert "first" not in stored.columns and rows(got) == rows(flat.select("token", F.explode("ids").alias("id")))
    files = stored.groupBy("file").agg(F.sum(F.size("ids") * 12 + 96).alias("b"), F.min("token").alias("lo"), F.max("token").alias("hi")).sort("lo", "hi").collect()
    assert len(files) > 8 and max(f.b for f in files) < 2.5 * sum(f.b for f in files) / len(files)
    assert all(x.hi <= y.lo for x, y in zip(files, files[1:]))


def test_near_is_dealt_by_key(index):
    """What the few files of a frequent token give is dealt to tasks before the join; results are in test_queries."""
    plan = index.matching(X.parse("princess NEAR/2 pea"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 2


def test_tokens_by_bytes():
    """What array operations find in UTF-8 is what TOKEN finds, at any slice, also in bytes that are no UTF-8."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    near = [chr(c) for c in range(256)] + list("aAzZ09 ,") * 20
    far = near + list("ÀÉßÿ×÷µªº²¼—“”…€ ⁥⁯⁰ⁱ₫İΣςЖ漢😀́‍�") * 3
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(rng.choice([near, far])) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(9))]
        assert X.tokens_of(pa.array(["zé", *texts], pa.string()).slice(1)).to_pylist() == [X._tokens(t or "") for t in texts]
    raw = [b"ab\xc3", b"\xa9cd", b"", b"\xa9", b"x\xe2\x80", b"\x93y", b"ok \xc3\x89", b"\xc3", b"", b"\xa9z", b"\xff", b"a\xe2\x82\xacb", b"\x80\xc3"]
    at = np.cumsum([0, *map(len, raw)]).astype(np.int32)
    torn = pa.StringArray.from_buffers(len(raw), pa.py_buffer(at), pa.py_buffer(b"".join(raw)))
    assert X.tokens_of(torn).to_pylist() == [X._tokens(r.decode("utf-8", "replace")) for r in raw]


def test_index_of_few_searches_is_not_shuffled(spark, monkeypatch):
    """The same answers as an index dealt by token, with nothing dealt, after changes too; the registered searches ask such an index."""
    from relspan import registry, stateful

    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    content = Leaf(frame([(k, f"Word{k % 7} common\x02 É{k % 3} " + "x " * k) for k in range(40)] + [(40, None), (41, "common")]), keys=[["id"]])
    dealt = X.TextIndex(content, "id", ["text"])
    monkeypatch.setattr(X, "CLUSTERED", 0)
    clustered = X.TextIndex(content, "id", ["text"])

    def stored(found):
        raise AssertionError("dealt by token")

    monkeypatch.setattr(X.TextIndex, "_stored", staticmethod(stored))
    made = []
    monkeypatch.setattr(X, "staged", lambda df, label, stage=X.staged, **o: made.append(df) or stage(df, label, **o))
    plain = X.TextIndex(content, "id", ["text"], dealt=False)
    assert len(made) == 1 and "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(token,common)" in plain.hits(X.Phrase(("common",)))._jdf.queryExecution().executedPlan().toString()
    for query in ("common", "word1 NEAR/2 é1", '"common é2"', "word* NOT x", "x OR é0"):
        got = [sorted(map(tuple, i.rank(X.parse(query)).collect())) for i in (plain, dealt, clustered)]
        assert got[0] == got[1] == got[2] and got[0]
    plain.refresh(frame([(1, "new common"), (50, "new")]), frame([(1, None), (2, None)]))
    assert {r.id for r in plain.matching(X.parse("new")).collect()} == {1, 50}
    assert {r.id for r in plain.matching(X.parse("common")).collect()} == {*range(40), 41} - {2}
    for name, some in (("text_search_term", registry), ("text_rank", registry), ("text_search_not", registry), ("snippet", registry), ("text_refreshed", stateful), ("snippet_window", stateful)):
        some.queries()[name](spark, "/root/testdata/sf0.001")


def test_snippet_of_many_hits():
    """The window with the most hits is found by their order: 40,000 hits took the square of that before. Short texts agree with a plain count."""
    import random
    import time

    began = time.time()
    s = X.StructuredSnippet.parse(X.snippet("that " * 40_000 + "x that", [(("that",), False)]))
    assert len(s.matches) == X.WINDOW and not s.ellipsis_at_start and s.ellipsis_at_end and time.time() - began < 20
    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice(["a", "b", "ab", "c", "É"]) for _ in range(rng.randrange(50))]
        for want, prefix in ((("a",), False), (("a",), True), (("a", "b"), False), (("b", "a"), True), (("é", "c", "a"), False)):
            n = len(want)
            hits = [k for k in range(len(words) - n + 1) if (low := [w.lower() for w in words[k : k + n]])[:-1] == list(want[:-1]) and (low[-1].startswith(want[-1]) if prefix else low[-1] == want[-1])]
            begins = [max(0, min(s, len(words) - X.WINDOW)) for s in sorted({0, *(max(0, k - X.WINDOW // 3) for k in hits)})]
            at = max(begins, key=lambda s: sum(s <= k < s + X.WINDOW for k in hits))
            got = X.StructuredSnippet.parse(X.snippet(" ".join(words), [(want, prefix)]))
            assert got.text == " ".join(words[at : at + X.WINDOW]) and got.ellipsis_at_start == (at > 0) and got.ellipsis_at_end == (at + X.WINDOW < len(words))
            if n == 1:
                assert len(got.matches) == sum(at <= k < at + X.WINDOW for k in hits)


@pytest.mark.parametrize("kind", ["string", "int", "decimal(20,2)", "date", "double"])
def test_stored_lists_of_any_id(spark, kind):
    """Lists are stored as differences, with no dictionary, whatever their type; null is an id, too."""
    import pyarrow.parquet as pq

    value = "date_add(DATE'2020-01-01', CAST(id AS int))" if kind == "date" else f"CAST(id * 7919 % 300 AS {kind})"
    rows = spark.range(300).selectExpr(f"CASE WHEN id < 200 THEN {value} END AS id", "concat('common ', repeat('x ', CAST(id % 5 AS int))) AS text")
    index = X.TextIndex(Leaf(rows), "id", ["text"], dealt=False)
    meta = pq.ParquetFile(index.postings.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    assert not any("DICTIONARY" in e for k in range(meta.num_columns) if "list" in (c := meta.column(k)).path_in_schema for e in c.encodings)
    want = [(r.id, len(r.text.split()) - 1) for r in rows.distinct().collect()]
    ids = lambda token: sorted((r.id for r in index.hits(X.Phrase((token,))).collect()), key=repr)
    assert ids("common") == sorted((i for i, _ in want), key=repr) and ids("x") == sorted((i for i, n in want for _ in range(n)), key=repr)
