"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import gzip
import hashlib
import json
import math
import pathlib
import pickle
import random
import re
import shutil
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relspan.llm import decontaminate, extract, fitting, lengths, mixing, quality, simhash, spotsigs, token_records, toxicity, warc
from relspan.llm.common import BATCH_BYTES, id_ranges, python_ready
from relspan.llm.components import connected_components
from relspan.llm.encoding import Encoder
from relspan.llm.queries import oracle_sql, queries, tokenizer_json
from relspan.sources.scratch import new_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows, clash=()):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)
    return df.withColumns({c: F.lit("clash") for c in clash}) if clash else df


PROSE = "It was the best of times and it was the worst of times for the people of the old town by the sea who had to go on with the work of the day".split()


def some_docs():
    text = lambda k, n: " ".join(PROSE[(k * 7 + j * (k % 5 + 1)) % len(PROSE)] + (str(j % 3) if k % 2 else "") for j in range(n))
    rows = [(k, text(k, 5 + k * 3 % 60), f"s{k % 4}" if k % 9 else None) for k in range(40)]
    rows += [(40, None, "s1"), (41, "", "s0"), (42, " \t\n ", None), (43, "one", "s2"), (44, text(3, 4000), "s3"), (None, "no id at all here", "s1"), (7, rows[7][1], rows[7][2]), (8, "another text for the id", rows[8][2])]
    return rows


# 1


def brute_hits(rows, items, width=10):
    find = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (s or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = defaultdict(set)
    for i, t in items:
        w = find(t)
        for s in range(len(w) - min(width, len(w)) + 1 if w else 0):
            windows[tuple(w[s : s + width])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, ids = find(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if found := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    ids |= found
        named = sorted({str(x) for x in ids if x is not None})
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination(spark):
    long = " ".join(f"w{k}" for k in range(37))
    items = [(1, long), (2, "Only THREE words"), (3, None), (4, ""), (5, "the the the the the the the the the the the"), (10, long), (6, "never seen in any of the documents of this test at all")]
    rows = [
        (1, "x " + long.upper() + "! y", "a"), (2, "so only three, words here; only three words", "a"), (3, " ".join(f"w{k}" for k in range(9)), "a"), (4, "the " * 300, "b"), (5, None, "b"), (6, "", "b"), (None, long, "b"),
        (7, " ".join(f"w{k}" for k in range(5, 15)) + " and " + " ".join(f"w{k}" for k in range(20, 37)), None), (7, "clean", None), (7, "clean", None), (8, "é" * 9 + " Éa only three words", "c"),
    ]
    clash = ("pos", "term", "rep", "item", "n", "w", "term_id")
    got = decontaminate.digest(decontaminate.decontaminate(docs_of(spark, rows, clash), spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)))).collect()
    assert Counter(map(tuple, got)) == brute_hits(rows, items)


@pytest.mark.parametrize("rows,items", [([], [(1, "a b")]), ([(1, "a b", "s")], []), ([], [])])
def test_decontamination_of_nothing(spark, rows, items):
    got = decontaminate.digest(decontaminate.decontaminate(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert Counter(map(tuple, got)) == brute_hits(rows, items)


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, "alpha beta so gamma delta epsilon zeta uh eta theta iota kappa", "s"), (2, "kappa iota nothing near", "s"), (3, item, "s")]
    terms, vocabulary = decontaminate.test_terms(spark.createDataFrame([(1, item)], "item_id long, text string"))
    index = decontaminate.build_index(docs_of(spark, rows), vocabulary)
    assert {r.doc_id for r in decontaminate.proximity_matches(index, terms, slop=3).collect()} == {1, 3}


def brute_near(text, item, slop, share):
    w, t = (text or "").split(), item.split()
    bands = defaultdict(set)
    for pos, x in enumerate(w):
        for q, y in enumerate(t):
            if x == y:
                bands[(pos - q) // (2 * slop)].add(q)
                bands[(pos - q + slop) // (2 * slop) + 0.5].add(q)
    return any(len(b) >= share * len(t) for b in bands.values())


def test_proximity_loses_no_match(spark):
    draw = random.Random(3)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(300)]
    make = lambda n: [draw.choice(rare if draw.random() < 0.3 else common) for _ in range(n)]
    items = [make(n) for n in (1, 2, 4, 5, 9, 10, 10, 10, 14, 15, 23, 35)] + [["nowhere", *make(9)], ["alpha", "beta", *common[:8]], ["nowhere", "never", "not", *make(7)]]
    rows = [(0, " ".join(items[-3][1:]), "s"), (1, " ".join(["x", "y", *common[:8]]), "s"), (2, "alpha beta", "s"), (3, None, "s"), (4, "", "s"), (None, " ".join(items[7]), "s"), (0, "no such words", "s")]
    for k, w in enumerate(items * 4):
        drop = set(draw.sample(range(len(w)), min(len(w), int(len(w) * 0.2) + draw.choice([0, 0, 1]))))
        rows.append((10 + k, " ".join(["z"] * draw.randrange(9) + ["other" if q in drop else x for q, x in enumerate(w)] + make(5)), "s"))
    table = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    want = Counter((i, t, str(k)) for i, t, _ in rows for k, w in enumerate(items) if brute_near(t, " ".join(w), 3, 0.8))
    assert (0, rows[0][1], "12") in want and (1, rows[1][1], "13") in want and len(want) > 40
    found = decontaminate.decontaminate(docs_of(spark, rows), table, slop=3).select("doc_id", "rep", "near_ids", "item_ids", "n_hit")
    texts = {r.rep: r.text for r in docs_of(spark, rows).select(F.xxhash64("text").alias("rep"), "text").collect()}
    found = found.collect()
    assert len(found) == len(rows) and Counter((r.doc_id, texts[r.rep], k) for r in found for k in r.near_ids) == want
    terms, vocabulary = decontaminate.test_terms(table)
    index = decontaminate.build_index(docs_of(spark, rows), vocabulary)
    near = decontaminate.proximity_matches(index, terms, slop=3).select("doc_id", "rep", "item").distinct().join(terms.select("item", "item_id").distinct(), "item")
    assert Counter((r.doc_id, texts[r.rep], str(r.item_id)) for r in near.collect()) == want


# 2 and 4


def labelled(n=400):
    rng = np.random.default_rng(3)
    words = [a + b + c for a in ("ba", "do", "ri", "ma", "ne") for b in ("lo", "ti", "se") for c in ("n", "ra", "s", "")]
    rows, labels = [], []
    for k in range(n):
        w = [words[j] for j in rng.integers(0, len(words), 60)]
        bad = k % 4 == 0
        rude = k % 3 == 0
        if rude:
            w[int(rng.integers(0, 60))] = "scoundrel"
        text = " ".join(w)
        if bad:
            text = " ".join(w[:20]) + "\n" + " ".join(x.upper() + "!!" for x in w[20:30] * 4)
        rows.append((k, text, "s"))
        labels.append((k, int(not bad), int("scoundrel" in text.lower())))
    return rows, labels


@pytest.mark.parametrize("module,column,at", [(toxicity, "toxic", 0.3), (quality, "quality", 0.7)])
def test_classifiers(spark, module, column, at):
    rows, labels = labelled()
    extra = [(1000, None, None), (1001, "", "s"), (1002, "x" * 50_000 + " " + "y " * 20_000, "s"), (None, "no id", "s"), (5, rows[5][1], "s")]
    table = spark.createDataFrame([*labels, (2000, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    got = module.digest(docs_of(spark, rows + extra, ("score", "label", "at", "x")), table).toPandas()
    assert len(got) == len(rows) + len(extra) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= at)).all()
    assert all(h == (not math.isnan(i) and zlib.crc32(str(int(i)).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    truth = {k: (q if column == "quality" else t) for k, q, t in labels}
    held = got[got.held_out & (got.doc_id < 400)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    again = module.digest(docs_of(spark, rows), table).toPandas()
    assert np.allclose(again.sort_values("doc_id").score, got[got.doc_id < 400].drop_duplicates("doc_id").sort_values("doc_id").score, atol=1e-6)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_without_labels(spark, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in module.digest(docs_of(spark, [(1, "a", "s"), (2, None, "s")]), none).collect()} == {0.5 if module is toxicity else 1.0}
    assert module.digest(docs_of(spark, []), none).count() == 0


def bag_of(x, word=(), of=()):
    return quality._packed(np.asarray(x), np.array(word, np.int64), np.array(of, np.int64))


def test_attention_learns():
    """One bad passage among good ones decides, whether its measures or its words tell it."""
    rng = np.random.default_rng(1)
    for told_by in ("measures", "words"):
        rows = []
        for k in range(300):
            n = int(rng.integers(1, 9))
            x, of = rng.normal(0, told_by == "measures", (n, quality.N_FEATURES)), np.repeat(np.arange(n), 5 * (told_by == "words"))
            word = rng.integers(100, 130, len(of))
            if k % 2:
                bad = int(rng.integers(0, n))
                if told_by == "measures":
                    x[bad, 3] = 6.0
                else:
                    word[5 * bad] = 7
            rows.append((k % 2, bag_of(x, word, of)))
        m = quality.attention_mil(rows[:200], passes=30)
        got = quality.score_bags(m, [x for _, x in rows[200:]]) >= 0.5
        assert sum(g == y for g, (y, _) in zip(got, rows[200:])) >= 95


def brute_bag_score(m, x, word, of):
    h = []
    for k, row in enumerate(x):
        mine = [w for w, o in zip(word, of) if o == k]
        own = [sum(m["words"][w][j] for w in mine) / math.sqrt(max(len(mine), 1)) for j in range(quality.HIDDEN)]
        z = [min(max((v - a) / s, -6), 6) for v, a, s in zip(row, m["mean"], m["std"])]
        h.append([math.tanh(sum(z[i] * m["we"][i][j] for i in range(len(z))) + own[j] + m["be"][j]) for j in range(quality.HIDDEN)])
    dot = lambda a, w, j: sum(a[i] * w[i][j] for i in range(len(a)))
    e = [sum(math.tanh(dot(r, m["v"], j)) / (1 + math.exp(-dot(r, m["u"], j))) * m["a"][j] for j in range(quality.GATE)) for r in h]
    a = [math.exp(v) for v in e]
    bag = [sum(w * r[j] for w, r in zip(a, h)) / sum(a) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(b * w for b, w in zip(bag, m["w"])) + float(m["b"]))))


def some_weights(rng):
    m = quality.fresh_weights(rng.normal(0, 1, quality.N_FEATURES), rng.uniform(0.5, 2, quality.N_FEATURES))
    return m | {k: rng.normal(0, 0.5, m[k].shape) for k in ("words", "be", "w", "b")}


def test_forward_and_gradient_of_the_bags():
    rng = np.random.default_rng(4)
    m, bags = some_weights(rng), []
    for n in (1, 4, 9):
        of = np.sort(rng.integers(0, n, 6 * n))
        bags.append((rng.normal(0, 2, (n, quality.N_FEATURES)), rng.integers(0, 1 << quality.BITS, len(of)), of))
    p, y = quality._joined(bags), np.array([1.0, 0.0, 1.0])
    assert np.allclose(quality._forward(m, p, 3)["p"], [brute_bag_score(m, *b) for b in bags])
    loss = lambda: -np.mean([math.log(q if t else 1 - q) for q, t in zip(quality._forward(m, p, 3)["p"], y)])
    g = quality._gradient(m, p, y)
    for k in g:
        for at in [tuple(rng.integers(0, s) for s in m[k].shape) for _ in range(3)] + ([(p.word[0], 2)] if k == "words" else []):
            kept, step = m[k][at].copy(), 1e-5
            m[k][at] = kept + step
            more = loss()
            m[k][at] = kept - step
            slope = (more - loss()) / (2 * step)
            m[k][at] = kept
            assert g[k][at] == pytest.approx(slope, abs=1e-7), k


def test_a_score_depends_on_its_text_alone():
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["Alpha", "beta", "gamma!!", "delta", "x"], int(n))) for n in rng.integers(0, 300, 20)] + ["", None, "one", "z" * 5000]
    m = some_weights(rng)
    m["w"] = m["w"] * 50  # far apart
    alone = [quality._score(m, [t])[0] for t in texts]
    assert np.allclose(quality._score(m, texts), alone) and np.allclose(quality.score_bags(m, quality._featurize(texts)), alone, atol=1e-4)


def test_ftrl_by_brute_force():
    rng = np.random.default_rng(6)
    rows = [(int(k % 3 == 0), np.unique(rng.integers(0, 30, 8) + 100 * (k % 3 == 0)).astype(np.int32).tobytes()) for k in range(40)]
    size, z, n = 1 << toxicity.BITS, defaultdict(float), defaultdict(float)

    def weight(i):
        if i == size:
            return -z[i] / ((1.0 + math.sqrt(n[i])) / 0.7)
        return 0.0 if abs(z[i]) <= 0.9 else -(z[i] - math.copysign(0.9, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.7 + 0.5)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            y, own = rows[k][0], [*np.frombuffer(rows[k][1], np.int32).tolist(), size]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7
                z[i] += g - s * w[i]
                n[i] += g * g
    kept, weights, bias = toxicity.ftrl(rows, alpha=0.7, beta=1.0, l1=0.9, l2=0.5, passes=3)
    want = {i: weight(i) for i in z if i != size and weight(i)}
    assert set(kept.tolist()) == set(want) and len(want) < 120
    assert np.allclose(weights, [want[i] for i in kept.tolist()], atol=1e-6) and bias == pytest.approx(weight(size))
    dense = lambda x: 1 / (1 + math.exp(-bias - sum(want.get(i, 0.0) for i in np.frombuffer(x, np.int32).tolist())))
    assert np.allclose(toxicity.score_bags((kept, weights, bias), [x for _, x in rows]), [dense(x) for _, x in rows], atol=1e-5)


def test_fitting_sample_is_bounded(spark):
    often, null = [k for k in range(200, 300) if zlib.crc32(str(k).encode()) % 4 != 2][:2]
    rows = [(often, f"text {k % 50:03d}", "s") for k in range(5000)] + [(k, f"other {k}", "s") for k in range(100, 140)] + [(null, None, "s")]
    labels = spark.createDataFrame([(often, 1), (often, 1), (null, 1), (None, 1), (9999, 1), *((k, k % 2) for k in range(100, 140))], "doc_id long, toxic int")
    got = fitting.fitting_sample(docs_of(spark, rows), labels, "toxic", 100).collect()
    assert Counter(r.text for r in got if r.text is None or r.text.startswith("text")) == {"text 000": 1, None: 1}
    free = [k for k in range(100, 140) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert len(got) == len(free) + 2
    assert all(n <= 6 for n in Counter(r.label for r in fitting.fitting_sample(docs_of(spark, rows), labels, "toxic", 6).collect()).values())
    sample = fitting.fitting_sample(docs_of(spark, rows), labels, "toxic", 100)
    held = pickle.loads(fitting.fit_in_one_task(sample, lambda texts: [b"x" * 10 for _ in texts], lambda got: [x for _, x in got], most_bytes=55))
    assert held == [b"x" * 10] * 5


# 3


def brute_targets(rows):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    return size, target


def test_mixing(spark):
    rows = some_docs() + [(100 + k, " ".join(["w"] * 300), "hot") for k in range(100)]
    got = mixing.mix(docs_of(spark, rows, ("size", "ord", "start", "b", "k", "w"))).collect()
    size, target = brute_targets(rows)
    by = defaultdict(int)
    source = defaultdict(set)
    for i, _, s in rows:
        source[i].add(s)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in rows)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = next(s for s in source[r.doc_id] if size[s] == r.source_size)
        assert r.target == pytest.approx(target[s])
        by[s] += r.taken
    for s in size:
        assert abs(by[s] - target[s]) <= 2
    again = mixing.mix(docs_of(spark, rows).repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("blocks", [300, 7])
def test_targets_are_met_with_large_blocks(spark, monkeypatch, blocks):
    monkeypatch.setattr(mixing, "BLOCKS", blocks)
    rows = some_docs() + [(100 + k, " ".join(f"w{j}" for j in range(30)), "hot") for k in range(300)] + [(500, "a few words", "tiny"), (501, "v " * 61, "more"), (502, "u " * 83, None)]
    docs = docs_of(spark, rows)
    size, target = brute_targets(rows)
    assert -(-sum(size.values()) // blocks) > 40
    want = {s: int(t + 0.5) for s, t in target.items() if size[s]}
    assert min(want.values()) > 0
    by, mixed = defaultdict(int), Counter()
    taken, *_ = mixing.schedule(docs)
    for r in taken.collect():
        assert 0 <= r.lo < r.hi <= r.size
        by[r.source] += r.hi - r.lo
    assert by == want
    got = Counter((r.doc_id, r.taken) for r in mixing.mix(docs).collect())
    for r in mixing.apply_mix(docs).collect():
        mixed[r.source] += len(r.text.split())
    assert mixed == want
    monkeypatch.undo()
    assert got == Counter((r.doc_id, r.taken) for r in mixing.mix(docs).collect())  # as with blocks of one word


def brute_schedule(size, target, block):
    """(k, source, rank) of every slot, point by point."""
    order = [s for s in sorted(size, key=lambda s: (s is None, s or "")) if size[s]]
    quota = {}
    for s in order:
        words = math.floor(target[s] + 0.5)
        quota[s] = words // size[s] * -(-size[s] // block) + -(-(words % size[s]) // block)
    total, at, got, out = sum(quota.values()), 0, Counter(), []
    ends = []
    for s in order:
        ends.append((at / total, (at + quota[s]) / total, s))
        at += quota[s]
    points = int(total * 1.01) + mixing.CHUNK
    for k in range(points):
        u = k * mixing.GOLDEN - math.floor(k * mixing.GOLDEN)
        s = next(s for lo, hi, s in ends if lo <= u < hi)
        if got[s] < quota[s]:
            out.append((k, s, got[s]))
        got[s] += 1
    return out + [(points + r, s, r) for s in order for r in range(got[s], quota[s])], quota


def test_schedule_is_even(spark):
    """Slot by slot as by brute force, and every beginning of it has nearly the target shares."""
    rows = [(k, "w " * 50, f"s{k % 3}") for k in range(60)] + [(k, "v " * 7, "tiny") for k in range(60, 63)] + [(k, "u " * 400, None) for k in range(63, 70)]
    size, target = brute_targets(rows)
    for block in (3, 10):
        taken, *_ = mixing.schedule(docs_of(spark, rows), block=block)
        want, quota = brute_schedule(size, target, block)
        got = {(r.k, r.source, r["rank"]) for r in taken.select("k", "source", "rank").distinct().collect()}
        assert got == set(want)
        seen, total = Counter(), sum(quota.values())
        for n, (_, s, _) in enumerate(sorted(want), 1):
            seen[s] += 1
            if n % 5 == 0:
                assert all(abs(seen[x] - n * quota[x] / total) < 5 for x in quota)
    first = {(r.doc_id, r.taken > 0): r.first_slot for r in mixing.mix(docs_of(spark, rows)).collect()}
    assert min(x for x in first.values() if x is not None) == 0 and all((x is None) == (not t) for (_, t), x in first.items())


def test_mixed_corpus_stands_in_slot_order(spark):
    rows = [(k, f"w{k} " * 30, f"s{k % 3}") for k in range(90)] + [(k, f"v{k} " * 30, None) for k in range(90, 300)]
    docs = docs_of(spark, rows)
    taken, *_ = mixing.schedule(docs)
    first = defaultdict(lambda: 1 << 60)
    for r in taken.collect():
        first[r.doc_id, r["pass"]] = min(first[r.doc_id, r["pass"]], r.k)
    path = new_folder(spark, "mixed")
    mixing.apply_mix(docs, parts=5).write.parquet(path)
    files = sorted(pathlib.Path(path.removeprefix("file://")).glob("part-*"))
    got = [r.doc_id for f in files for r in spark.read.parquet(str(f)).coalesce(1).collect()]
    assert len(files) == 5 and got == [i for (i, _), _ in sorted(first.items(), key=lambda x: x[1])]
    _, target = brute_targets(rows)
    source, seen, total = {i: s for i, _, s in rows}, Counter(), sum(target.values())
    for n, i in enumerate(got, 1):
        seen[source[i]] += 30
        assert all(abs(seen[s] - 30 * n * target[s] / total) < 150 for s in target)  # a few documents, at every place


def test_applied_mix(spark):
    rows = some_docs()
    docs = docs_of(spark, rows, ("pass", "n"))
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert any((t or "").startswith(r.text) or t == r.text for i, t, _ in rows if i == r.doc_id)
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    assert words == +taken


# 5


def test_archive(spark):
    page = lambda k: f"<html>{'x' * 200}{k}</html>"
    rows = [(k, f"http://a/{k}", page(k % 3)) for k in range(30)] + [(30, None, None), (31, "u", ""), (32, "u", "short"), (33, "u", "short"), (34, "u\r\nv", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb" + "é" * 60), (None, "u", page(0)), (2, "http://a/2", page(2)), (None, "v", page("only null")), (None, "w", page("only null"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("payload", "header", "first")})
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        again = i is not None and h in first and first[h] != i
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert Counter(map(tuple, warc.archive_round_trip(pages).collect())) == want
    folder, to = new_folder(spark, "t"), new_folder(spark, "x")
    warc.write_archive(pages, folder)
    stored = warc.read_payloads(spark, folder).collect()
    assert sorted(r.payload_digest for r in stored) == sorted({hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows})  # each once
    for r in warc.records(spark, folder).collect():
        fields, block, payload = next(warc.parse_records(__import__("io").BytesIO(bytes(r.record))))
        assert (len(payload) == 0) == (r.record_type == "revisit" or r.payload_digest == hashlib.sha256(b"").hexdigest())
        assert fields["warc-payload-digest"] == "sha256:" + r.payload_digest
    assert warc.export_records(spark, folder, to).agg(F.sum("records")).first()[0] == len(rows)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_round_trip_reads_page_records(spark, monkeypatch):
    pages = spark.createDataFrame([(k, None if k == 4 else f"http://a/{k}", f"<p>{'x' * 150}{k % 3}</p>") for k in range(12)] + [(12, "u", ""), (13, "u", "")], "page_id long, url string, html string")
    made = []
    monkeypatch.setattr(warc, "new_folder", lambda s, label: made.append(new_folder(s, label)) or made[-1])
    got = warc.archive_round_trip(pages).collect()
    assert len(made) == 2 and len(got) == 14
    kept = {}
    for f in sorted(pathlib.Path(made[1].removeprefix("file://")).glob("*.warc.gz")):
        for fields, block, payload in warc.parse_records(gzip.open(f)):
            kept[int(fields["page-id"])] = (block, payload)
    own = {r.page_id: r for r in got}
    for r in pages.collect():
        body, g = r.html.encode(), own[r.page_id]
        again = g.record_type == "revisit"
        assert kept[r.page_id] == (warc.header(r.page_id, r.url, g.record_type, hashlib.sha256(body).hexdigest(), len(body), g.refers_to), b"" if again else body)
        assert again == (3 <= r.page_id < 12) and g.payload_bytes == len(body)
    folder = made[0]
    heads = spark.read.parquet(f"{folder}/headers").collect()
    wrong = new_folder(spark, "w")
    spark.createDataFrame([(h.page_id, h.payload_digest, bytes(h.header).replace(b"Content-Length: 1", b"Content-Length: 2")) for h in heads], "page_id long, payload_digest string, header binary").write.parquet(f"{wrong}/headers")
    for sub in ("payloads", "parts", "index"):
        shutil.copytree(f"{folder}/{sub}".removeprefix("file://"), f"{wrong}/{sub}".removeprefix("file://"))
    with pytest.raises(Exception, match="does not end where its length says"):
        warc.read_records(spark, f"{wrong}/out", warc.export_records(spark, wrong, f"{wrong}/out"), "long").collect()


# 6 and 10


def test_lengths_and_records(spark):
    rows = some_docs() + [(200, "It's 5 o'clock <|endoftext|> “quoted” é x y ½ don't''s", "s"), (201, "Straße ÀÉ naïve ½²3 1234", "s")]
    docs = docs_of(spark, rows, ("range_id", "ids", "part", "length")).repartition(5)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        x = ids(t)
        want.append((i, start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = token_records.token_records(docs, tokenizer_json()).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    hist = lengths.digest(docs, tokenizer_json())
    n = np.array([w[2] - 1 for w in want])
    for r in hist.collect():
        assert (r.n_docs, r.docs_longer, r.truncated_total) == ((n == r.length).sum(), (n > r.length).sum(), np.minimum(n, r.length).sum())
    assert lengths.truncated_total(hist, 17) == np.minimum(n, 17).sum()
    assert lengths.quantile(hist, 0.5) == np.sort(n)[math.ceil(0.5 * len(n)) - 1]
    assert token_records.token_records(docs.limit(0), tokenizer_json()).count() == 0
    assert lengths.digest(docs.limit(0), tokenizer_json()).count() == 0


def test_record_files(spark):
    docs = docs_of(spark, [(k, f"word{k} and more", "s") for k in range(20)]).coalesce(1)
    folder = new_folder(spark, "t")
    files = token_records.write_records(docs, tokenizer_json(), 2, folder)
    back = token_records.read_at(folder, files[0][0], [5, 0, 19])
    assert [i for i, _ in back] == [5, 0, 19] and all(x[-1] == 2 for _, x in back)
    whole = token_records.frame(b"payload")
    for k in range(len(whole)):
        damaged = whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :]
        with pytest.raises(ValueError):
            token_records.read_frame(__import__("io").BytesIO(damaged))


@pytest.mark.parametrize("slots", [8, 1 << 12])
def test_encoder_equals_the_library(monkeypatch, slots):
    """Within a small table, which displaces and drops words, and for every Latin-1 character."""
    monkeypatch.setattr("relspan.llm.encoding.SLOTS", slots)
    monkeypatch.setattr("relspan.llm.encoding.POOL", 8 * slots)
    monkeypatch.setattr("relspan.llm.encoding.SLICE", 2000)
    enc, plain = Encoder(tokenizer_json()), Tokenizer.from_str(tokenizer_json())
    draw = random.Random(slots)
    letters = [chr(c) for c in range(256)] + list("'" * 5 + "ssttrevmlldd  ÀÉ½²×÷ß") * 6
    texts = [f"word{k} Thing{k * 7}, it's {k}!" for k in range(500)] + ["".join(draw.choice(letters[97:] if k % 2 else letters) for _ in range(draw.randrange(60))) for k in range(2000)]
    texts += ["x" * 17 + " it's " + "é" * 17 + "'ll" + "'" * 2 + "ve", "’", "中文 and Latin", "a <|endoftext|> b", "K ẞ İ", "", None, "'", "' 's's don't l'lle", "don't" + "'" * 2 + "s", "a" * 5000]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want and list(enc.count(texts)) == list(map(len, want))
    assert len(enc.pool) <= 8 * slots + 20_000 and len(enc.keys) == slots


def test_encoder_of_another_tokenizer():
    """What splits text by another pattern goes through the library whole."""
    made = json.loads(tokenizer_json())
    made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"
    enc, plain = Encoder(json.dumps(made)), Tokenizer.from_str(json.dumps(made))
    assert not enc.by_word and Encoder(tokenizer_json()).by_word
    assert [x.tolist() for x in enc.encode(["Route66 it's 12ab"])] == [plain.encode("Route66 it's 12ab", add_special_tokens=False).ids]


def test_batches_are_bounded_by_bytes(spark):
    python_ready(spark)
    df = spark.range(40).coalesce(1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["rows"])

    rows = [r.rows for r in df.mapInArrow(sizes, "rows long").collect()]
    assert sum(rows) == 40 and max(rows) <= (BATCH_BYTES >> 20) + 1


# 7


def test_extraction(spark):
    keep = ["The title", "A first paragraph of the article with enough words to be one.", "One.", "A link stands here in the middle of a longer sentence of the text.", "tail & end <x> é"]
    body = f"<h1>{keep[0]}</h1><p>{keep[1]}</p><p>{keep[2]}</p><p>A <a href=x>link stands</a> here in the\n middle   of a longer sentence of the text.</p><div class='ad'>Buy this fine thing now, it is cheap and good.</div><p>tail &amp; end &lt;x&gt; &#233;</p>"
    around = "<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div id='cookie-banner'>We use cookies on this site, please say that you agree to it.</div>{}<div class='comments'><p>A reader has written this long comment about the article here.</p></div><aside>More things to read</aside><form><p>Sign up with your address to get our letter each week.</p></form><footer>&copy; all rights</footer><script>var a='<p>no</p>'</script>"
    rows = [(1, "u", "<html><head><title>no</title><style>p{}</style></head><body>" + around.format(f"<article>{body}</article>")), (2, "u", around.format(f"<div class=content>{body}</div>")), (3, None, None), (4, "u", ""), (5, "u", "<p>cut off <b>text &am"), (None, "u", "<script>only()</script>"), (1, "u", "<main><p>twice the id</p></main>")]
    got = extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(0)})).collect()
    want = [(1, "\n".join(keep)), (2, "\n".join(keep)), (3, ""), (4, ""), (5, "cut off text &am"), (None, ""), (1, "twice the id")]
    assert Counter((r.page_id, r.text) for r in got) == Counter(want) and all(r.n_chars == len(r.text) for r in got)


def test_extraction_of_self_closed_svg_and_page_forms():
    tree = extract.train(extract.labelled_rows())
    text = lambda page: extract.main_text(page, tree)
    assert text('<main><p>one</p><svg class="i"/><p>two three four</p></main>') == "one\ntwo three four"
    assert text("<main><p>one</p><svg/><p>two</p><SVG a='x>y' /><p>three</p><svg class=i><g/><text>no</text></svg><p>four</p></main>") == "one\ntwo\nthree\nfour"
    long = [" ".join(f"word{k}{j}" for j in range(40)) for k in range(3)]
    nav = "<nav><a href=1>Home</a> <a href=2>News</a></nav>"
    cells = "".join(f"<tr><td>{x}</td></tr>" for x in long)
    for body in (f"<table>{cells}</table>", f"<div role=main><table>{cells}</table></div>", f"<div class=content>{''.join(f'<div>{x}</div>' for x in long)}</div>", f"<fieldset><table>{cells}</table></fieldset>"):
        assert text(f"<body><form id=aspnetForm action=x>{nav}{body}<div class=footer>all rights are reserved by the owners of the site</div></form></body>") == "\n".join(long)
    paragraph = f"<div><p>{long[0]}</p></div>"
    sign = "<form><p>Sign up with your address to get our letter each week.</p></form>"
    assert text(paragraph + sign) == long[0] and text(f"<form>{paragraph}<fieldset><p>Sign up with your address to get our letter each week.</p></fieldset></form>") == long[0]
    assert text(f"<main><p>a short text</p></main>{sign}") == "a short text"
    assert text(f"<p>a short text here</p><form class=newsletter>{paragraph}</form>") == "a short text here"


def test_tree_fits_its_table():
    rows = extract.labelled_rows()
    tree = extract.train(rows)
    assert (extract.classify(tree, rows) == rows[:, -1]).all()
    named, text = rows[:, extract.NAMES[0]] > 0, rows[:, -1] == 1
    assert (named & text).sum() >= 10 and (~named & ~text).sum() >= 40  # names alone don't settle it


PAGE = [  # held out: blocks of a page in order and whether they are main text
    ("<div class=top><a href=/>Daily paper</a></div><table><tr><td><a href=1>World</a><td><a href=2>Sport</a><td><a href=3>Arts</a></table>", None),
    ("<div class='post-share-story'><h1>{}</h1>", 7), ("<p>{}</p>", 60), ("<p>{}</p>", 1), ("<div class='comment-free'><p>{}</p></div>", 45), ("<blockquote>{}</blockquote>", 12), ("<ul><li>{}<li>", 3), ("{}</ul>", 2), ("<p>{}</p></div>", 70),
    ("<div class='related-posts'><p><a href=4>One more thing</a></p><p>It was said that the other one is better to read.</p></div>", None), ("<div class='article-comments'><p>A reader has much to say about all this and says it here in one long line of words that goes on for a while.</p></div>", None),
    ("<p><a href=5>About us</a></p><p><a href=6>Contact</a></p><p>(c) the paper</p>", None),
]


def test_held_out_page():
    tree = extract.train(extract.labelled_rows())
    number, page, want = 0, "", []
    for html, n in PAGE:
        if n is not None:
            want.append(" ".join(f"w{number + k}" for k in range(n)))
            number += n
            html = html.format(want[-1])
        page += html
    assert extract.main_text(page, tree) == "\n".join(want)
    assert extract.main_text(f"<body><main>{page}</main>", tree).startswith(want[0])


def test_drops_by_counts(spark):
    """Most of what is dropped is dropped by counts and link densities, whatever it is named."""
    tree = extract.train(extract.labelled_rows())
    dropped = counted = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        x = extract.features(extract.blocks(r.html))
        out = ~extract.classify(tree, x)
        dropped += out.sum()
        counted += (out & extract.by_counts(tree, x)).sum()
        nameless = x * [1, 1, 1, 1, 1, 1, 0, 1]
        assert (out & (x[:, 1] > 0.9)).sum() == (~extract.classify(tree, nameless) & (x[:, 1] > 0.9)).sum()  # menus need no names
    assert counted > 0.7 * dropped


def test_markup_that_is_not_closed():
    tree = extract.train(extract.labelled_rows())
    text = lambda page: extract.main_text(page, tree)
    long = " ".join(f"word{k}" for k in range(40))
    assert text(f"<html><head><title>t</title><meta a=b><body><p>{long}") == long  # no end of head
    assert text('<p>see <a href="x>link</a> and more of it</p>') == "see link and more of it"  # a quote that isn't closed
    assert text('<p title="a > b <c>">one <b data-x=\'<i>\'>two</b></p>') == "one two"
    assert text(f"<p>{long}</p><p>a<svg><g><p>{long} two</p>") == f"{long}\na\n{long} two"  # a paragraph ends an svg
    assert text(f"<p>{long}</p><![CDATA[no]]><p>{long} <!-- no > no --> two") == f"{long}\n{long} two"
    assert text(f"<p hidden>no</p><div style='display: none'><p>{long}</p></div><main><p>yes") == "yes"
    (block,) = extract.blocks("<p><a href=/news/>Home page</a></p>")
    assert (block.words, block.linked) == (2, 2)
    assert [b.linked for b in extract.blocks("<p><a name=x/>no link</p><p><a href=1>one <a href=2>two</a> three</p>")] == [0, 2]


@pytest.mark.parametrize("page", ["<div>{}x y</div>", "<form><fieldset>{}x", "<i>{}<p>t</b>", "<a href='x>{}", "<![CDATA[{}", '<p title="{}', "<li><ul>{}", "<!--{}", "<svg>{}<x/>", "</p>{}</b>"])
def test_time_is_linear_in_nesting(page):
    start, end = page.split("{}")
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        extract.blocks(start * n + end * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5 and took[1] < 10


def test_extraction_of_no_pages(spark):
    assert extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    big = "<p>" + "word " * 400_000 + "</p>"
    got = extract.extract_text(spark.createDataFrame([(1, None, big), (1, None, big), (2, "u", "<main>\x00<p>a\x00b</p>")], "page_id long, url string, html string")).collect()
    assert [len(r.text) for r in got] == [5 * 400_000 - 1] * 2 + [len("\x00\na\x00b")]


# 8


def test_spotsigs(spark):
    rows = [r for r in some_docs() if r[0] != 8 or "another" not in (r[1] or "")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in spotsigs.next_to_each(docs_of(spark, rows, ("range_id", "ahead", "text2")).repartition(6)).collect())
    want = Counter()
    for k, (i, t, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = spotsigs.signature_sets([t, e, nxt])
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), spotsigs.as_text(a), round(spotsigs.likeness(a, b), 9), round(spotsigs.likeness(a, c), 9))] += 1
    assert got == want
    assert spotsigs.next_to_each(docs_of(spark, [])).count() == 0
    one = spotsigs.next_to_each(docs_of(spark, [(1, "the only text", "s")])).first()
    assert one.near_next == 1.0


def test_spotsigs_chains():
    text = "The quick brown fox is of some note, and THE lazy dog sleeps."
    anchors = set(spotsigs.ANCHORS)
    w = re.findall(r"[a-z]+", text.lower())
    chains = {tuple([x for x in w[k + 1 :] if x not in anchors][: spotsigs.CHAIN]) for k in range(len(w)) if w[k] in anchors}
    assert len(spotsigs.signature_sets([text])[0]) == len({c for c in chains if len(c) == spotsigs.CHAIN})


def test_spotsigs_classes(spark):
    base = [f"the {chr(97 + k % 26)}{k}x of y{k} and z{k} in q{k}" for k in range(40)]
    rows = [(1, " ".join(base), "s"), (2, " ".join(base), "s"), (3, " ".join(base[:38]), "s"), (4, " ".join(reversed([f"the m{k} of n{k}" for k in range(30)])), "s"), (5, None, "s"), (6, " ".join(base[:20]), "s")]
    got = {r.doc_id: r.class_id for r in spotsigs.near_duplicates(docs_of(spark, rows)).collect()}
    sets = dict(zip((1, 2, 3, 4, 5, 6), spotsigs.signature_sets([t for _, t, _ in rows])))
    assert spotsigs.likeness(sets[1], sets[3]) >= 0.8 > spotsigs.likeness(sets[1], sets[6])
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}


@pytest.mark.parametrize("tile", [7, 4096])
def test_spotsigs_classes_brute(spark, monkeypatch, tile):
    """Families of near copies, chains of edits and families that share much without being alike."""
    monkeypatch.setattr(spotsigs, "TILE", tile)
    monkeypatch.setattr(spotsigs, "CENTRES", 1)
    rng = random.Random(5)
    rows, word = [], lambda: "".join(rng.choice("bcdfgklmnprtvz") + rng.choice("aeiou") for _ in range(3))
    for family in range(4):
        base = [f"the {word()} of {word()}" for _ in range(rng.randint(20, 40))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"the {word()} of {word()}"
            rows.append((len(rows), " ".join(copy), "s"))
            if rng.random() < 0.4:
                base = copy
        half = base[: len(base) // 2] + [f"the {word()} of {word()}" for _ in range(len(base) // 2)]
        rows += [(len(rows) + k, " ".join(half[k:]), "s") for k in range(5)]
    rng.shuffle(rows)
    sets = spotsigs.signature_sets([t for _, t, _ in rows])
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if spotsigs.likeness(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    want = {i: least[find(k)] for k, (i, _, _) in enumerate(rows)}
    assert 4 < len(set(want.values())) < len(rows) // 2
    assert {r.doc_id: r.class_id for r in spotsigs.near_duplicates(docs_of(spark, rows)).collect()} == want


def brute_classes(ids, sets):
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            if spotsigs.likeness(sets[i], sets[j]) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for k, i in enumerate(ids):
        some = [x for x in (i, least.get(find(k))) if x is not None]
        least[find(k)] = min(some) if some else None
    return Counter((i, least[find(k)]) for k, i in enumerate(ids))


def test_spotsigs_classes_of_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = Counter(map(tuple, queries()["spotsigs_classes"](spark, SF).collect()))
    assert got == brute_classes([r.doc_id for r in docs], spotsigs.signature_sets([r.text for r in docs]))
    rows = some_docs() + [(900, None, "s"), (None, None, "s"), (None, "a lone text of its own for the one that has no id", "s")]
    got = Counter(map(tuple, spotsigs.near_duplicates(docs_of(spark, rows, ("rep", "n", "sig", "label", "sketch"))).collect()))
    assert got == brute_classes([r[0] for r in rows], spotsigs.signature_sets([t for _, t, _ in rows]))
    assert spotsigs.near_duplicates(docs_of(spark, [])).count() == 0


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 32, int(rng.integers(0, 400))).astype(np.uint32))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 32, int(rng.integers(0, 40))).astype(np.uint32)]))
        apart = sum((x ^ y).bit_count() for x, y in zip(spotsigs.sketch(a), spotsigs.sketch(b)))
        assert apart <= len(np.setxor1d(a, b)) and len(spotsigs.sketch(a)) * 8 == spotsigs.SKETCH


# 9


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(x for x in (least.get(find(k)), i) if x is not None) if i is not None or least.get(find(k)) is not None else None
    return [least[find(k)] for k in range(len(ids))]


def test_simhash(spark):
    rows = some_docs() + [(300 + k, " ".join(PROSE * 20) + f" x{k}", "s") for k in range(30)]
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components([r[0] for r in rows], fps)
    got = simhash.digest(docs_of(spark, rows, ("fp", "anchor", "own"))).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))
    assert simhash.digest(docs_of(spark, [])).count() == 0
    kept = simhash.keep_one(docs_of(spark, rows))
    labels = brute_components(list(range(len(rows))), fps)  # a component by its first row
    want = {(c, k) for k, c in zip(labels, comp) if c is not None}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(c for c, _ in want)


def test_keep_one_tells_rows_of_an_id_apart(spark):
    x, y, z = " ".join(PROSE * 3), "something else altogether stands in this other text of the id", "and here a third one about ships and their masters"
    rows = [(3, x, "s"), (5, x, "s"), (5, y, "s"), (6, z, "b"), (6, z, "a"), (None, x, "s"), (9, y, "s"), (7, None, "s"), (7, "", "s"), (8, f"{y} {y[::-1]}", "s"), (8, f"{z} {y}", "s"), (11, f"{z} {y}", "s")]
    want = Counter([(3, x, "s"), (5, y, "s"), (6, z, "a"), (None, x, "s"), (7, None, "s"), (8, f"{y} {y[::-1]}", "s"), (8, f"{z} {y}", "s")])
    for k in (1, 5):
        for order in (rows, rows[::-1]):
            got = simhash.keep_one(docs_of(spark, order).repartition(k)).collect()
            assert Counter((r.doc_id, r.text, r.source) for r in got) == want


@pytest.mark.parametrize("scheme,code", [(simhash.THREE, 15), (simhash.TWO, 31)])
def test_anchors_cover(scheme, code):
    """Every value lies within one bit of its anchor, which is a codeword, and two near values meet at the anchor of either."""
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2**63, 200, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 200, dtype=np.uint64)
    y = x.copy()
    for k in range(len(y)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            y[k] ^= np.uint64(1 << int(b))
    met = np.zeros(len(x), bool)
    for p, ((first, bits), (r, a, own), (s, b, _)) in enumerate(zip(scheme.parts, simhash.anchors(x, scheme), simhash.anchors(y, scheme))):
        home = dict(zip(r[own].tolist(), a[own].tolist()))
        assert len(home) == len(x) == own.sum()
        for k, anchor in home.items():
            value = int(x[k]) >> first & (1 << bits) - 1
            place = anchor // len(scheme.parts)
            assert anchor % len(scheme.parts) == p and (value ^ place).bit_count() <= 1
            check = 0
            for bit in range(code):
                check ^= (bit + 1) * (place >> bit & 1)
            assert check == 0
        met |= np.isin(r[own] * (1 << 40) + a[own], s * (1 << 40) + b)[np.argsort(r[own])]
    assert met.all()


@pytest.mark.parametrize("scheme", [simhash.THREE, simhash.TWO])
def test_schemes_agree(spark, monkeypatch, scheme):
    monkeypatch.setattr(simhash, "small_side", lambda df: df)  # as if too many to broadcast
    rows = some_docs() + [(300 + k, " ".join(PROSE * 20) + f" x{k}", "s") for k in range(30)]
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    comp = brute_components([r[0] for r in rows], fps)
    got = simhash.near_duplicates(docs_of(spark, rows), scheme).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == Counter((r[0], f, c) for r, f, c in zip(rows, fps, comp))


@pytest.mark.parametrize("tile", [8, 4096])
def test_no_link_is_lost(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = set(base.tolist()) | {0}
    for b in base.tolist():
        for _ in range(4):
            x = b
            for k in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                x ^= 1 << int(k)
            fps.add(x)
    for k in range(300):  # a dense group about zero
        fps.add(sum(1 << int(b) for b in rng.choice(12, int(rng.integers(1, 4)), replace=False)))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    comps = {r.node: r.component for r in connected_components(edges).collect()}
    want = brute_components(signed, fps)
    assert [comps.get(x, x) for x in signed] == want
    assert edges.count() < 60 * len(fps)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(200, 201), (300, 300)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {k: 0 for k in range(101)} | {200: 200, 201: 200}


def test_ranges_follow_the_key(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k")).union(spark.createDataFrame([(None,)], "k long"))
    out, parts = id_ranges(df, "k", 8)
    got = sorted(out.collect(), key=lambda r: (r.k is not None, r.k or 0))
    assert [r.range_id for r in got] == sorted(r.range_id for r in got) and parts == 8
    assert max(Counter(r.range_id for r in got).values()) < 200
    out, parts = id_ranges(df, "k", 40, coarse=5)
    got = sorted(out.collect(), key=lambda r: (r.k is not None, r.k or 0))
    assert [r.range_id for r in got] == sorted(r.range_id for r in got) and parts > 30 and max(Counter(r.range_id for r in got).values()) < 100
    with pytest.raises(TypeError):
        id_ranges(df.selectExpr("CAST(k AS STRING) AS k"), "k", 8)


# registered queries


def test_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        want = con.sql(sql)
        names = list(want.columns)
        got = Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in queries()[name](spark, SF).select(*names).collect())
        assert got == Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want.fetchall()), name


def test_spotsigs_posts_only_shared_signatures(spark, monkeypatch):
    """Buckets hold numbers instead of digests, and no signature of a single set."""
    kept = {}

    def recorded(df, label, stage=spotsigs.staged):
        kept[label] = stage(df, label)
        return kept[label]

    monkeypatch.setattr(spotsigs, "staged", recorded)
    words = lambda k: " ".join(f"the w{k}x{i} v{k}x{i}" for i in range(20))
    docs = [(k, words(k)) for k in range(8)] + [(20, words(3) + " the last one"), (21, words(5)), (30, None), (31, "")]
    got = {tuple(r) for r in spotsigs.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(k, k) for k in range(8)} | {(20, 3), (21, 5), (30, 30), (31, 30)}
    posted = kept["posted"]
    assert dict(posted.dtypes)["rep"] == "bigint"
    assert posted.groupBy("sig").agg({"rep": "count"}).count() > 0 and posted.select("rep").distinct().count() == 2
