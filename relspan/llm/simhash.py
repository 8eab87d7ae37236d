"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most THRESHOLD = 4 of 64 bits differ in at most one bit of one of three parts (21, 21 and 22
bits). For each part the anchors are a covering code: Hamming(15,11) on its first 15 bits, which covers them with
radius 1, times all values of the rest. A fingerprint belongs to its nearest anchor and is replicated
to every anchor within the covering radius plus the part's threshold; those that meet at an anchor are compared there
on all 64 bits. What an anchor finds is reduced to a forest at once, so large groups give no pairs.

Anchors of three parts meet more and more fingerprints as these grow. Beyond WIDE different ones two parts of 32 bits with Hamming(31,26) are
used, of which one differs in at most two bits: more copies of each, far fewer comparisons. Both find every link.

Defined cases: null, empty and all-blank texts have fingerprint zero and link like any other; fewer than four words make
one shingle; equal texts always share a component; a null doc_id has a fingerprint but never names a component
unless its component has no other; rows that share a doc_id belong each to the component of its own text; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspan.llm.common import packed, python_ready, small_side, unpacked
from relspan.llm.components import connected_components
from relspan.sources.scratch import discard, staged

THRESHOLD, SHINGLE, SEED = 4, 4, 42


class Scheme(NamedTuple):
    """Parts of the fingerprint, (first bit, bits); bits in which the nearest part differs at most; bits of the Hamming code."""

    parts: tuple[tuple[int, int], ...]
    differ: int
    code_bits: int


THREE = Scheme(((0, 21), (21, 21), (42, 22)), 1, 15)
TWO = Scheme(((0, 32), (32, 32)), 2, 31)
#: Different fingerprints up to which three parts cost less: about 42 copies of each against 300, and at most 2**12 owners an anchor.
WIDE = 1 << 29
#: Owners of one anchor that are compared in one task; more are dealt to tiles.
TILE = 4096
#: Keys over which a component's rows are dealt where names of components are too many to broadcast.
SALT = 16
#: Pairs that numpy compares at once.
CELLS = 4_000_000


def fingerprint(text: bytes | None) -> int:
    """64-bit SimHash of the text's 4-word shingles, as unsigned."""
    w = (text or b"").lower().split()  # bytes: A-Z only, and white space is \\x20 \\x09-\\x0D
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in zip(*(w[k:] for k in range(SHINGLE)))] if len(w) >= SHINGLE else [xxhash.xxh64_intdigest(b" ".join(w), SEED)]
    ones = np.zeros(64, np.int64)
    for cut in range(0, len(h), 4096):
        ones += np.unpackbits(np.array(h[cut : cut + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, rep: bool = False) -> DataFrame:
    """(doc_id, fp[, rep]), stored; fp is the fingerprint's 64 bits as a signed long, rep the SHA-256 of the text."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x) for x in b.column("text").to_pylist()], np.uint64).view(np.int64)
            names = ["doc_id", "fp", "rep"][: 2 + rep]
            yield pa.RecordBatch.from_arrays([pa.array(fp) if c == "fp" else b.column(c) for c in names], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = [F.sha2(F.coalesce("text", F.lit("")), 256).alias("rep")] if rep else []
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *own)
    return staged(rows.mapInArrow(run, f"doc_id {kind}, fp long" + ", rep string" * rep), "fingerprints")


@lru_cache
def _syndromes(code_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For the lower 16 bits and for the others of a value: the XOR of the places (from 1) of its ones within the code."""
    x = np.arange(1 << 16)
    return tuple(np.bitwise_xor.reduce([np.where(x >> k & 1, k + 1 + base, 0) for k in range(16) if k + base < code_bits]) if base < code_bits else np.zeros(1 << 16, np.int64) for base in (0, 16))


def _nearest(value: np.ndarray, code_bits: int) -> np.ndarray:
    """The nearest anchor: the bit at the syndrome's place leads to the codeword; 0 is a codeword."""
    low, high = _syndromes(code_bits)
    s = low[value & 0xFFFF] ^ high[(value >> 16) & 0xFFFF]
    return np.where(s > 0, value ^ (np.int64(1) << np.maximum(s - 1, 0)), value)


def anchors(fp: np.ndarray, scheme: Scheme = THREE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor, own) for unsigned fingerprints, part by part: each row's nearest anchor (own) and all others in reach."""
    for p, (first, bits) in enumerate(scheme.parts):
        v = ((fp >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        home = _nearest(v, scheme.code_bits)
        flips = [sum(1 << k for k in some) for n in range(scheme.differ + 1) for some in combinations(range(bits), n)]
        reach = np.sort(_nearest(v[:, None] ^ np.array(flips, np.int64)[None, :], scheme.code_bits), 1)
        fresh = np.ones(reach.shape, bool)
        fresh[:, 1:] = reach[:, 1:] != reach[:, :-1]
        r, c = np.nonzero(fresh)
        yield r, reach[r, c] * len(scheme.parts) + p, reach[r, c] == home[r]


def _replicate(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column("fp").to_numpy(zero_copy_only=False)
            for cut in range(0, len(every), 1024):
                fp = every[cut : cut + 1024]
                for r, a, own in anchors(fp.view(np.uint64), scheme):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(fp[r]), pa.array(own)], ["anchor", "fp", "own"])

    return run


def _forest(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what lies within THRESHOLD of an owner, for rows sorted by key; at most one edge a row."""
    bounds = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(bounds, len(key)))
    big = sizes > 64
    found_a, found_b = [], []
    # small groups together: every owner against every row of its group
    group = np.repeat(np.arange(len(bounds)), sizes)
    owner = np.flatnonzero(own & ~big[group])
    n = sizes[group[owner]]
    step = max(1, CELLS // 64)
    for cut in range(0, len(owner), step):
        o, m = owner[cut : cut + step], n[cut : cut + step]
        left = np.repeat(o, m)
        right = np.arange(len(left)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(bounds[group[o]], m)
        near = (fp[left] != fp[right]) & (np.bitwise_count(fp[left] ^ fp[right]) <= THRESHOLD)
        found_a.append(fp[left[near]])
        found_b.append(fp[right[near]])
    for g in np.flatnonzero(big):
        x = fp[bounds[g] : bounds[g] + sizes[g]]
        mine = np.flatnonzero(own[bounds[g] : bounds[g] + sizes[g]])
        parent = np.arange(len(x))
        for cut in range(0, len(mine), max(1, CELLS // len(x))):
            o = mine[cut : cut + max(1, CELLS // len(x))]
            i, j = np.nonzero(np.bitwise_count(x[o][:, None] ^ x[None, :]) <= THRESHOLD)
            i = o[i]
            while True:  # join by the least root until nothing changes
                a, b = parent[i], parent[j]
                if (a == b).all():
                    break
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
        linked = parent != np.arange(len(x))
        found_a.append(x[parent[linked]])
        found_b.append(x[linked])
    return np.concatenate(found_a or [fp[:0]]), np.concatenate(found_b or [fp[:0]])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (anchor, tile); a group is held until its last row has come."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = _forest(*(np.concatenate(x) for x in zip(*parts)))
        a, b = a.view(np.int64), b.view(np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for batch in batches:
        k, fp, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "own"))
        if not len(k):
            continue
        fp = fp.view(np.uint64)
        last = np.searchsorted(k, k[-1])
        if last:
            yield out([*held, (k[:last], fp[:last], own[:last])])
            held = []
        elif held and held[0][0][0] != k[0]:
            yield out(held)
            held = []
        held.append((k[last:], fp[last:], own[last:]))
    if held:
        yield out(held)


def links(fps: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints; their components are those of all links of at most THRESHOLD bits.

    The scheme follows from the number of distinct fingerprints unless it is given.
    """
    spark = fps.sparkSession
    python_ready(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    each = staged(fps.select("fp").distinct(), "distinct")
    scheme = scheme or (THREE if each.count() <= WIDE else TWO)
    spread = staged(each.repartition(parts).mapInArrow(_replicate(scheme), "anchor long, fp long, own boolean"), "anchors")
    heavy = spread.groupBy("anchor").agg(F.sum(F.col("own").cast("long")).alias("owners")).where(F.col("owners") > TILE)
    heavy = staged(heavy.select("anchor", F.ceil(F.col("owners") / TILE).cast("int").alias("tiles")), "heavy")
    if heavy.isEmpty():
        tiled = spread.withColumn("key", F.col("anchor"))
    else:  # an owner goes to one tile of its anchor, and to all others as one to be compared with
        n = F.coalesce("tiles", F.lit(1))
        tiled = spread.join(heavy, "anchor", "left").withColumn("tile", F.explode(F.sequence(F.lit(0), n - 1)))
        tiled = tiled.withColumn("own", F.col("own") & (F.col("tile") == F.pmod(F.xxhash64("fp"), n))).withColumn("key", F.xxhash64("anchor", "tile"))
    dealt = tiled.select("key", "fp", "own").repartition(parts, "key").sortWithinPartitions("key")
    found = staged(dealt.mapInArrow(_compare, "a long, b long").distinct(), "links")
    discard(spark, each, spread, heavy)
    return found


def named_components(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """(doc_id, fp, component, component_id), one row a row of docs. component: a fingerprint that names it; component_id is the
    least doc_id reachable by links.

    A component may hold most rows, so none is dealt by its component: the names of components with several fingerprints, a row each, are
    broadcast if a count shows that they are few, and otherwise joined over SALT keys each.
    """
    found = fingerprints(docs)
    least = staged(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    comps = connected_components(links(found, scheme))
    linked = staged(least.join(comps, least.fp == comps.node).select("fp", "first", "component"), "linked")
    ids = staged(linked.groupBy("component").agg(F.min("first").alias("component_id")), "names")
    few = small_side(ids)
    if few is ids:  # too many to broadcast
        few = ids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        with_id = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int")).join(few, ["component", "salt"])
    else:
        with_id = linked.join(few, "component")
    with_id = with_id.select(F.col("fp").alias("node"), "component", "component_id")
    named = least.join(with_id, least.fp == with_id.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), F.when(F.col("node").isNull(), F.col("first")).otherwise(F.col("component_id")).alias("component_id"))
    return found.join(staged(named, "named"), "fp").select("doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """(doc_id, fp, component_id), one row a row of docs."""
    return named_components(docs, scheme).drop("component")


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each component: that with the least doc_id; of rows that share it and the component, the one
    with the least text, then the least other columns.

    Rows that share a doc_id but belong to different components, by their texts, stand each for its own. A row with no id can't
    stand for others and stays.
    """
    columns, kept = docs.columns, ["doc_id", "text"]
    docs = packed(docs, kept)
    found = named_components(docs).where("doc_id = component_id").select("doc_id", "fp", "component").distinct()
    twice = staged(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "twice")
    if twice.isEmpty():
        lone = docs.join(found, "doc_id", "left_semi")
    else:  # rows of one id are told apart by the hash of their text
        found = staged(found, "stand-in")
        rows = docs.join(twice, "doc_id", "left_semi")
        own = fingerprints(rows, rep=True).join(found, ["doc_id", "fp"]).select("doc_id", F.col("rep").alias("__rep"), F.col("component").alias("__component")).distinct()
        rows = rows.withColumn("__rep", F.sha2(F.coalesce("text", F.lit("")), 256)).join(own, ["doc_id", "__rep"])
        rows = rows.groupBy("doc_id", "__component").agg(F.min(F.struct("text", "__rest")).alias("__least")).select("doc_id", "__least.*")
        lone = docs.join(found, "doc_id", "left_semi").join(twice, "doc_id", "left_anti").unionByName(rows)
    return unpacked(lone.unionByName(docs.where("doc_id IS NULL")), columns, kept)
