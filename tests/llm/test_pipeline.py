"""Every stage on its own input, against brute force, and the run as a whole."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from relspan.llm import mixing, token_records
from relspan.llm import quality as quality_operator
from tests.llm.test_operators import DOCS, brute_components, brute_fingerprint, brute_hits, brute_targets

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit(7) for c in ("score", "rep", "fp", "pass")})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    quality, dedup, clean, mix, records = (f for _, f in corpus_pipeline.STAGES)
    kept = quality(spark, docs, SF)
    assert kept.columns == docs.columns and kept.where("score = 7").count() == kept.count()
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert sum(q == (i in ids) for i, q in labels.items()) >= 0.9 * len(labels)

    rows = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    comp = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    one = dedup(spark, kept, SF)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(comp))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hits = {h[0]: h[-1] for h in brute_hits([(r.doc_id, r.text) for r in one.collect()], items)}
    free = clean(spark, one, SF)
    assert free.columns == docs.columns and {r.doc_id for r in free.collect()} == {i for i, h in hits.items() if not h}

    mixed = mix(spark, free, SF)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("doc_id", F.regexp_count("text", F.lit(mixing.TOKEN)).alias("n")).collect():
        words[r.doc_id] += r.n
    assert words == +Counter({r.doc_id: r.taken for r in mixing.mix(free).collect()})

    out = records(spark, mixed, SF).collect()
    assert len(out) == mixed.count() and min(r.start for r in out) == 0
    ends = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_of_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, SF).count() == 0
    assert token_records.token_records(none, corpus_pipeline.tokenizer_json()).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_on_odd_rows(spark):
    """Nulls in every column, rows that repeat, ids that repeat with other texts, ties, empty and very long texts, clashing columns."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    prose = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND n_chars > 400").orderBy("doc_id").limit(12).collect()]
    leak = max((t for _, t in items), key=len)
    rows = [(k, t, f"s{k % 3}") for k, t in enumerate(prose)]
    rows += [(0, prose[0], "s0"), (1, prose[2], "s1"), (20, prose[3], None), (21, None, "s1"), (22, "", None), (23, " \t\n", "s2"), (None, prose[4], "s0"), (None, None, None), (24, prose[5] + " " + leak, "s2"), (2, prose[6] + " " + leak, "s2"), (25, " ".join(prose * 60), "s0"), (26, "one", "s0")]
    frame = lambda some: spark.createDataFrame([(i, t, None if i == 3 else "en", s, None if t is None else len(t)) for i, t, s in some], DOCS).withColumns({c: F.lit("x") for c in ("__least", "rep", "k", "size", "label", "__slot", "__SLOT2", "__rep", "__score", "__text", "__n", "__component")})
    plain = lambda df: Counter((r.doc_id, r.text, r.source) for r in df.collect())
    judge, dedup, clean, mix, records = (f for _, f in corpus_pipeline.STAGES)
    docs = frame(rows)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    alone = {t: [r.s for r in quality_operator.score_quality(frame([(1, t, "s")]), labels, name="s").collect()][0] for t in (None, "", prose[0], rows[-2][1])}
    kept = plain(judge(spark, docs, SF))
    assert not kept - Counter(rows)
    for i, t, s in rows:
        assert (i, t, s) not in kept or kept[i, t, s] == Counter(rows)[i, t, s]
        if t in alone:
            assert ((i, t, s) in kept) == (alone[t] >= quality_operator.REJECT_BELOW)
    assert alone[None] == alone[""]

    comp = brute_components(list(range(len(rows))), [brute_fingerprint(t) for _, t, _ in rows])
    groups = {}
    for row, c in zip(rows, comp):
        if row[0] is not None:
            groups.setdefault(c, []).append(row)
    want = Counter(min(g, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2] is not None, r[2] or "")) for g in groups.values()) + Counter(r for r in rows if r[0] is None)
    assert plain(dedup(spark, docs, SF)) == want

    hit = {t: h[-1] for _, t, _ in rows for h in brute_hits([(1, t)], items)}
    assert hit[rows[-4][1]] and plain(clean(spark, docs, SF)) == Counter(r for r in rows if not hit[r[1]])

    mixed = mix(spark, docs, SF)
    assert mixed.columns == docs.columns
    size, target = brute_targets(rows)
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
        assert any(i == r.doc_id and s == r.source and (t or "").startswith(r.text) for i, t, s in rows)
    assert {s: n for s, n in words.items() if n} == {s: int(t + 0.5) for s, t in target.items() if size[s]}

    out = records(spark, docs, SF).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r.doc_id for r in sorted(out, key=lambda r: r.start)] == [i for i, _, _ in order] and Counter(r.doc_id for r in out) == Counter(i for i, _, _ in rows)
