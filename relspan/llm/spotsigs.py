"""SpotSigs: chains of content words that follow common-word anchors, as a document's set of signatures.

An anchor is a common word of ANCHORS; from it the next CHAIN content words (words that aren't anchors) form a signature.
The fingerprint is the sorted set of signature hashes. Sets are compared by Jaccard; sets whose lengths alone rule the
threshold out never meet, because they are partitioned by length, and within a length band only sets that share one
of their rarest signatures do.

Defined cases: null and empty texts have the empty set, whose likeness to another empty set is 1 and to all else 0; a text
with fewer content words than a chain takes is one signature, all its words; a text with no anchor takes every word as one;
rows that repeat a doc_id are documents of their own, ordered by text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm.bytewords import LETTERS_DIGITS, mix, slices, words_of
from relspan.llm.common import id_ranges, python_ready, scan_partitions, small_side
from relspan.llm.components import connected_components
from relspan.sources.scratch import staged

#: Common words of English, German, French and Spanish.
ANCHORS = """
the of and a to in is it for was on that with as are be this by at from or an
der die das und in zu den von mit ist des ein eine auf für nicht als auch es an
le la les de des et un une du en que qui est pour dans sur pas par au avec
el los las de del y que en un una es se por con no para su al lo como
""".split()
CHAIN = 2
HEX = 8  # hex digits of a signature
#: Centres that each bucket of near_duplicates tries before its members make pairs.
CENTRES = 2
#: Bits of a set's sketch; members of a bucket that are compared in one task; pairs that numpy compares at once.
SKETCH, TILE, CELLS = 512, 4096, 1_000_000


def _anchor_hashes() -> np.ndarray:
    return np.unique(words_of([" ".join(ANCHORS)], LETTERS_DIGITS).hash)


def signature_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct signatures (uint32) of every whole text."""
    anchors, out = _anchor_hashes(), []
    for part in slices(texts):
        w = words_of([x.lower() for x in part], LETTERS_DIGITS)
        n = len(part)
        common = np.isin(w.hash, anchors)
        bare = np.bincount(w.doc, common, n) == 0  # texts with no anchor
        content = np.flatnonzero(~common)
        docs_of = w.doc[content]
        spot = np.flatnonzero(common | bare[w.doc])
        at = np.searchsorted(content, spot, "left")
        ok = at + CHAIN <= len(content)
        spot, at = spot[ok], at[ok]
        ok = docs_of[at + CHAIN - 1] == w.doc[spot] if len(at) else np.empty(0, bool)
        spot, at = spot[ok], at[ok]
        h = np.zeros(len(at), np.uint64)
        for k in range(CHAIN):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w.hash[content[at + k]])
        d = w.doc[spot]
        few = (np.bincount(d, minlength=n) == 0) & (np.bincount(w.doc, minlength=n) > 0)
        if few.any():
            first = np.searchsorted(w.doc, np.arange(n))
            alone = [(k, mix(np.array([np.bitwise_xor.reduce(mix(w.hash[first[k] : np.searchsorted(w.doc, k, "right")] + np.arange(np.searchsorted(w.doc, k, "right") - first[k], dtype=np.uint64)))]))[0]) for k in np.flatnonzero(few)]
            d, h = np.append(d, [k for k, _ in alone]), np.append(h, np.array([x for _, x in alone], np.uint64))
        u = np.unique((d.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
        cuts = np.searchsorted((u >> np.uint64(32)).astype(np.int64), np.arange(1, n))
        out += [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32) for x in np.split(u, cuts)]
    return out


def as_text(signatures: np.ndarray) -> str:
    """The fingerprint: HEX digits a signature, in order."""
    return signatures.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two signature sets; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the first as many code points of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def next_to_each(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and both likenesses.

    Ranges of doc_id go to tasks in one shuffle; each range is also dealt the first document of the next one, so no
    task needs another's rows. The firsts are found from the ids alone, one for each range, and never collected.
    """
    python_ready(docs.sparkSession)
    ranged, parts = id_ranges(docs.select("doc_id", "text"), "doc_id", scan_partitions(docs))
    heads = ranged.groupBy("range_id").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    by_range = Window.orderBy("range_id")  # over a row a range
    goes = F.coalesce(F.lag("range_id").over(by_range), F.max("range_id").over(by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = staged(heads.select(goes.alias("to"), F.when(F.col("nulls") == 0, F.col("least")).alias("head")), "heads")  # null is the lowest id; the first one's goes round to the last
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = ranged.withColumn("ahead", F.lit(False))
    # the head is the least id of its range, so an equal id is in that range
    first = docs.select("doc_id", "text").join(small_side(heads), F.col("doc_id").eqNullSafe(F.col("head"))).select("doc_id", "text", F.col("to").alias("range_id"), F.lit(True).alias("ahead"))
    own = own.unionByName(first)
    dealt = own.repartitionById(parts, "range_id").sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        over = False

        def ready(rows: list[tuple]) -> pa.RecordBatch:
            texts = [x for _, x in rows]
            changed = [edited(x, y) for x, y in zip(texts, texts[1:])]
            sets = signature_sets(texts)
            new = signature_sets(changed)
            cols = [
                pa.array([i for i, _ in rows[:-1]], b_type), pa.array([len(x) for x in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in changed]),
                pa.array([as_text(x) for x in sets[:-1]]), pa.array([as_text(x) for x in new]),
                pa.array([likeness(x, y) for x, y in zip(sets, new)]), pa.array([likeness(x, y) for x, y in zip(sets, sets[1:])]),
            ]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        b_type = pa.int64()
        for b in batches:
            b_type = b.schema.field("doc_id").type
            for i, x, a in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ahead"))):
                if over:
                    break  # only the least of the rows ahead is next
                over = a
                held.append((i, x or ""))
            if len(held) > 1:
                yield ready(held)
                held = held[-1:]

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "ahead").mapInArrow(run, schema)


def _open(spots: DataFrame, label: DataFrame) -> DataFrame:
    """Members (sig, band, rep, n, label) of the buckets whose members aren't all of one class yet."""
    m = spots.join(label, "rep")
    mixed = m.groupBy("sig", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig", "band")
    return staged(m.join(mixed, ["sig", "band"]), "open")


def sketch(signatures: np.ndarray) -> bytes:
    """SKETCH bits: whether an odd number of signatures falls on each. Two sets differ in at least as many signatures as their sketches in bits."""
    return np.packbits(np.bincount(signatures % SKETCH, minlength=SKETCH).astype(np.uint8) & 1).tobytes()


def _unlike_pairs(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by key: pairs (rep, other) of a key's rows of unlike labels that lengths and sketches don't rule out, for each row
    that is its tile's own. Blocks of a key are compared by numpy, so memory is bounded by a block and the rows of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(parts).combine_chunks()
            key, n, label, own = (t.column(c).to_numpy() for c in ("key", "n", "label", "own"))
            rep = t.column("rep").combine_chunks()
            bits = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(len(key), -1)
            bounds = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                mine = np.flatnonzero(own[lo:hi]) + lo
                for cut in range(0, len(mine), max(1, CELLS // (hi - lo))):
                    o = mine[cut : cut + max(1, CELLS // (hi - lo))]
                    i, j = np.nonzero((label[o][:, None] != label[lo:hi][None, :]) & (np.minimum(n[o][:, None], n[lo:hi][None, :]) >= threshold * np.maximum(n[o][:, None], n[lo:hi][None, :])))
                    i, j = o[i], j + lo
                    for at in range(0, len(i), CELLS):
                        a, b = i[at : at + CELLS], j[at : at + CELLS]
                        apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
                        common = (n[a] + n[b] - apart) // 2  # at most
                        near = common >= threshold * (n[a] + n[b] - common) - 1e-9
                        if near.any():
                            yield pa.RecordBatch.from_arrays([rep.take(pa.array(a[near])), rep.take(pa.array(b[near]))], ["rep", "other"])

        for b in batches:
            if not b.num_rows:
                continue
            k = b.column("key").to_numpy()
            last = int(np.searchsorted(k, k[-1]))
            if last or (held and held[0].column("key")[0].as_py() != k[0]):
                yield from pairs([*held, b.slice(0, last)] if last else held)
                held = []
            held.append(b.slice(last))
        if held:
            yield from pairs(held)

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id): classes of documents linked by a Jaccard of ``threshold`` or more; class_id is the least doc_id in reach.

    Equal sets are one representative. Representatives post their rarest signatures, as many as the threshold asks for, under
    (length band, signature); only those that meet in such a bucket are compared, pruned by length and then exactly. First every
    bucket compares its members with one centre, CENTRES times with another one; this joins groups of near copies. Afterwards
    only members of different classes make pairs, and only where lengths and sketches of their sets leave the threshold possible: groups of near
    copies give none within themselves, unlike sets that share a common signature none at all, and no link is lost. A bucket of more than TILE
    members is compared in tiles.

    Defined cases: null and empty texts are one class, as their sets are equal; rows that repeat are of one class; a null doc_id names a class
    only if it has no other; an empty table has no rows.
    """
    spark = docs.sparkSession
    python_ready(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = signature_sets(b.column("text").to_pylist())
            s = [x.astype(np.int64).tolist() for x in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.list_(pa.int64())), pa.array(list(map(sketch, own)), pa.binary())], ["doc_id", "sigs", "sketch"])

    own = staged(docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, sigs array<bigint>, sketch binary").withColumn("same", F.unhex(F.sha2(F.array_join("sigs", ","), 256))), "sets")
    # numbered once they are stored, as numbers are what most of the shuffles below carry
    reps = own.groupBy("same").agg(F.first("sigs").alias("sigs"), F.first("sketch").alias("sketch")).withColumn("n", F.size("sigs")).where("n > 0")
    reps = staged(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    flat = reps.select("rep", "n", F.explode("sigs").alias("sig"))
    rare = Window.partitionBy("rep").orderBy("df", "sig")
    counts = staged(flat.groupBy("sig").agg(F.count("*").alias("df")), "counts")  # stored, so that Spark can split the rows of a common signature
    ranked = flat.join(counts, "sig").withColumn("r", F.row_number().over(rare))
    prefix = ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).where("df > 1")  # nothing meets in a bucket of one
    band = F.floor(F.log(F.col("n").cast("double")) / -np.log(threshold)).cast("int")
    spots = staged(prefix.select("rep", "n", "sig", F.explode(F.array(band, band + 1)).alias("band")), "posted")
    fits = F.least("n", "m") >= F.greatest("n", "m") * threshold

    def verified(pairs: DataFrame) -> DataFrame:
        cand = pairs.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()
        sig = reps.select("rep", "sigs", "n")
        both = cand.join(sig.toDF("a", "sa", "na"), "a").join(sig.toDF("b", "sb", "nb"), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return staged(both.where(common >= threshold * (F.col("na") + F.col("nb") - common)).select("a", "b"), "links")

    label, links = reps.select("rep", F.col("rep").alias("label")), None
    for turn in range(CENTRES):
        members = spots = _open(spots.select("rep", "n", "sig", "band"), label)  # a bucket of one class stays so
        centre = members.groupBy("sig", "band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("at"), F.col("rep").alias("other"), F.col("n").alias("m"), F.col("label").alias("its"))).alias("c"))
        centre = staged(centre.select("sig", "band", "c.*"), "centres")
        found = verified(members.join(centre, ["sig", "band"]).where("label <> its").where(fits))
        links = found if links is None else links.unionByName(found)
        label = staged(reps.select("rep").join(connected_components(links).toDF("rep", "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labels")
    members = _open(spots.select("rep", "n", "sig", "band"), label)
    heavy = staged(members.groupBy("sig", "band").count().where(F.col("count") > TILE).select("sig", "band", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "heavy")
    rows = members.join(reps.select("rep", "sketch"), "rep").withColumn("label", F.xxhash64("label"))
    if heavy.isEmpty():
        rows = rows.withColumns({"own": F.lit(True), "key": F.xxhash64("sig", "band")})
    else:  # a member is its own in one tile of its bucket, and to be compared with in all others
        tiles = F.coalesce("tiles", F.lit(1))
        rows = rows.join(heavy, ["sig", "band"], "left").withColumn("tile", F.explode(F.sequence(F.lit(0), tiles - 1)))
        rows = rows.withColumns({"own": F.col("tile") == F.pmod(F.xxhash64("rep"), tiles), "key": F.xxhash64("sig", "band", "tile")})
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.select("key", "rep", "n", "label", "own", "sketch").repartition(parts, "key").sortWithinPartitions("key")
    found = verified(dealt.mapInArrow(_unlike_pairs(threshold), "rep long, other long"))
    comps = connected_components(links.unionByName(found)).toDF("rep", "comp")
    comps = reps.select("same", "rep").join(comps, "rep", "left").select("same", F.coalesce("comp", "rep").alias("comp"))
    named = own.select("doc_id", "same").join(comps, "same", "left").withColumn("comp", F.coalesce("comp", F.lit(-1)))  # without signatures: one class
    least = staged(named.groupBy("comp").agg(F.min("doc_id").alias("class_id")), "classes")
    return named.join(small_side(least), "comp").select("doc_id", "class_id")
