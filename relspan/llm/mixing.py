"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents, in the order of a hash of doc_id, form one stream of words, cut into blocks of
equal size. Slot k of the schedule takes the golden-ratio point frac(k * 0.618...) through the cumulative targets to a
source; the slot's rank within its source picks the block, starting again at block 0 when the blocks run out. The last
slot of a source ends at the very word that reaches the target, so the block's size decides the order alone.
That order is what the points are for: a document's place in the mix is its first slot, and ``apply_mix`` deals the mixed corpus to
partitions in the order of slots, so every stretch of it has nearly the target shares. DataFrame functions only; prefix sums go by hash buckets, so a source that holds most rows is never in one task.

Defined cases: a null text has size 0, is taken 0 times and has no slot; a null source is a source of its own, last in order;
rows that repeat a doc_id are documents of their own; with no words at all every target is 0; other
columns are ignored. A source's taken words are its target, rounded to whole words, at any size of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relspan.llm.common import null_safe_join, packed, scan_partitions, unpacked
from relspan.sources.scratch import staged

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: A block has 1 / BLOCKS of all words (one word at least), so the schedule's length doesn't follow the input's.
BLOCKS = 1 << 20
GOLDEN = 0.6180339887498949
#: Rows that a bucket of a prefix sum has on average, slots in a chunk of ranks, cells of the unit interval.
BUCKET_ROWS, CHUNK, CELLS = 4000, 4096, 4096


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, ord), stored, one row a row of docs. ord: md5 of the id, the order of the stream."""
    size = F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return staged(docs.select("doc_id", "source", size.alias("size"), F.md5(ident.cast("binary")).alias("ord")), "sizes")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): one row a source.

    What stays below its limit gets level * weight; the level follows from sums in the order in which
    limits are met. The windows run over one row a source.
    """
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    own = own.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("total", F.sum("source_size").over(everything)).withColumn("w_total", F.sum("w").over(everything))
    capped, spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0))
    own = own.withColumn("level", (F.col("total") * F.lit(share) - capped) / (F.col("w_total") - spent))
    own = own.withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    own = own.withColumn("target", F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap"))))
    return staged(own.select("source", "source_size", "target", "total"), "targets")


def _running(df: DataFrame, keys: list[str], bucket: Column, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows before, by keys, in two levels: buckets that follow the order, then rows."""
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*keys, "__bucket").agg(F.sum(value).alias("__sum"))
    past = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "__bucket", F.coalesce(F.sum("__sum").over(past), F.lit(0)).alias("__base"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn(name, F.coalesce(F.sum(value).over(within), F.lit(0)))
    return null_safe_join(df, sums, [*keys, "__bucket"], "inner").withColumn(name, F.col(name) + F.col("__base")).drop("__bucket", "__base")


def placed(sized: DataFrame) -> DataFrame:
    """(doc_id, source, size, start), stored, of documents with words. start: the place in the source's stream, which no
    other document of the source has."""
    digits = 0
    rows = sized.count()
    while rows > BUCKET_ROWS * 16**digits and digits < 8:
        digits += 1
    return staged(_running(sized.where("size > 0"), ["source"], F.substring("ord", 1, digits), ["ord", "size"], "size", "start").drop("ord"), "placed")


def fragments(docs: DataFrame, block: int) -> DataFrame:
    """placed() documents cut at the blocks of their source: words lo to hi of the document lie in block b."""
    last = F.col("start") + F.col("size") - 1
    out = docs.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    lo = F.greatest(F.col("b") * block - F.col("start"), F.lit(0))
    return out.withColumn("lo", lo).withColumn("hi", F.least((F.col("b") + 1) * block - F.col("start"), F.col("size")))


def slots(spark: SparkSession, targets: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(k, source, rank, pass, b, upto): the schedule, and its number of slots. Ranks of a source are 0 up to its quota of blocks.

    upto: the words of the source's stream that the slot's pass takes. A last block, or a last slot, may hold fewer words than others.
    """
    quota = targets.where("source_size > 0").withColumn("words", F.floor(F.col("target") + 0.5)).withColumn("blocks", F.ceil(F.col("source_size") / block))
    passes = F.floor(F.col("words") / F.col("source_size"))
    quota = quota.withColumn("quota", passes * F.col("blocks") + F.ceil((F.col("words") - passes * F.col("source_size")) / block))
    quota = quota.where("quota > 0").select("source", "source_size", "words", "blocks", "quota")
    every = Window.orderBy(F.asc_nulls_last("source"))
    total = F.sum("quota").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("quota").over(every.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    quota = staged(quota.withColumn("to", upto / total).withColumn("from", (upto - F.col("quota")) / total), "quotas")
    n_slots = int(quota.agg(F.sum("quota")).first()[0] or 0)
    n = int(n_slots * 1.01) + CHUNK
    cell = F.sequence(F.floor(F.col("from") * CELLS), F.least(F.floor(F.col("to") * CELLS), F.lit(CELLS - 1)))
    cells = quota.withColumn("cell", F.explode(cell))
    turn = F.col("k") * F.lit(GOLDEN)
    points = spark.range(n).withColumnRenamed("id", "k").withColumn("u", turn - F.floor(turn)).withColumn("cell", F.floor(F.col("u") * CELLS))
    hit = points.join(cells, "cell").where("u >= from AND u < to").select("k", "source", "source_size", "words", "quota", "blocks", F.lit(1).alias("one"))
    ranked = _running(hit, ["source"], F.floor(F.col("k") / CHUNK), ["k"], "one", "rank").where("rank < quota")
    # a small source may be met too seldom: what its quota lacks comes at the end
    got = hit.groupBy("source").agg(F.count("*").alias("got"))
    short = null_safe_join(quota, got, ["source"], "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    late = short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("quota") - 1))).withColumn("k", n + F.col("rank"))
    turns = F.floor(F.col("rank") / F.col("blocks"))
    cols = ["k", "source", "rank", turns.alias("pass"), (F.col("rank") % F.col("blocks")).alias("b"), (F.col("words") - turns * F.col("source_size")).alias("upto")]
    return ranked.select(*cols).unionByName(late.select(*cols)), n_slots


def schedule(docs: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """(schedule, placed, sizes, targets, number of slots). The schedule has a row for each piece of a document that a slot takes:
    k, source, rank, pass, b, doc_id, size, start, lo, hi."""
    sized = sizes(docs)
    targets = source_targets(sized)
    words = (targets.agg(F.max("total")).first()[0] if block is None else 0) or 0
    block = block or max(1, -(-int(words) // BLOCKS))
    own = placed(sized)
    dealt, n_slots = slots(docs.sparkSession, targets, block)
    taken = null_safe_join(fragments(own, block), dealt, ["source", "b"], "inner")
    taken = taken.withColumn("hi", F.least("hi", F.col("upto") - F.col("start"))).where("hi > lo").drop("upto")
    return taken, own, sized, targets, n_slots


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot; one row a row of docs. first_slot: the document's place in the mix, null if it has none."""
    taken, own, sized, targets, _ = schedule(docs)
    row = ["doc_id", "source", "size", "start"]
    some = taken.groupBy(*row).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("k").alias("first_slot"))
    none = sized.where("size = 0").drop("ord").withColumns({"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")})
    out = null_safe_join(own, some, row, "left").drop("start").unionByName(none)
    out = out.withColumn("taken", F.coalesce("taken", F.lit(0)))
    return null_safe_join(out, targets.drop("total"), ["source"], "inner").select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def apply_mix(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each pass of the schedule over a document, in the order of first slots.

    Partition after partition (``parts``, as many as follow from the scan of docs) holds the next stretch of slots, sorted. A source's
    schedule ends within a document, or none: there the text ends after the words taken and n_chars follows.
    """
    taken, own, _, _, n_slots = schedule(docs)
    row = ["doc_id", "source", "size"]
    whole = taken.groupBy(*row, "start", "pass").agg(F.sum(F.col("hi") - F.col("lo")).alias("__n"), F.min("k").alias("__slot"))
    kept = ["doc_id", "source", "text", *(["n_chars"] if "n_chars" in docs.columns else [])]
    whole, same = whole.withColumnRenamed("size", "__size"), packed(docs, kept).withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long"))
    keys = ["doc_id", "source", "__size"]
    if not own.groupBy(*row).count().where("count > 1").isEmpty():
        # rows alike in id, source and size are told apart by their order
        nth = own.withColumn("__nth", F.row_number().over(Window.partitionBy(*row).orderBy("start"))).withColumnRenamed("size", "__size")
        whole = null_safe_join(whole, nth, [*keys, "start"], "inner")
        same = same.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"))))
        keys.append("__nth")
    out = null_safe_join(same, whole.drop("start", "pass"), keys, "inner")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + TOKEN), F.lit(0)), 1, F.col("__n").cast("int")), "")
    entire = F.col("__n") == F.col("__size")
    out = out.withColumn("text", F.when(entire, F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(entire, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    parts = parts or scan_partitions(docs)
    stretch = F.least(F.floor(F.col("__slot") * parts / max(n_slots, 1)), F.lit(parts - 1)).cast("int")
    return unpacked(out.repartitionById(parts, stretch).sortWithinPartitions("__slot", "doc_id"), docs.columns, kept)
