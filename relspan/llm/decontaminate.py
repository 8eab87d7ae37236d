"""Benchmark decontamination with a distributed positional inverted index.

Postings (term, document, position) of the training texts are stored once, sharded by document. A window
of test words is sought from its two rarest terms: their lists, each shifted by the term's offset,
are intersected on (document, item, shift); what survives is intersected with the lists of all other
terms of the item, which leaves exact phrases. DataFrame functions only.

Defined cases: a null text has no words; an item with no words matches nothing; an item with a null id counts
for hits but can't be listed; rows that repeat a doc_id keep one result row each, by their own text; other
columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm.common import lower_ascii, null_safe_join, small_side
from relspan.sources.scratch import staged

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END = "\x00"  # no word can hold it: a posting of it carries a document's length
DOC = ["doc_id", "rep"]  # rep: hash of the text, for rows that share a doc_id


def words(text: Column) -> Column:
    """Words of a text after A-Z are lower-cased: runs of digits, a-z and all beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def test_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, n, q, term_id) for every word of every item, and (term, term_id).

    ``item`` names a row, so rows that share an item_id stay apart.
    """
    rows = staged(items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    flat = rows.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("q", "term"))
    vocabulary = staged(flat.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id() + 1), "terms")
    return staged(flat.join(vocabulary, "term").drop("term"), "test-terms"), vocabulary


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Stored postings (doc_id, rep, pos, term_id) of every whole text, for the terms a search can ask for.

    term_id 0 marks one row a document, whose pos is its number of words. No shuffle: each task writes
    the postings of the documents it reads.
    """
    end = vocabulary.sparkSession.createDataFrame([(END, 0)], "term string, term_id long")
    tokens = docs.select("doc_id", F.xxhash64("text").alias("rep"), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    return staged(tokens.join(small_side(vocabulary.unionByName(end)), "term").select(*DOC, "pos", "term_id"), "postings")


def _rarest(terms: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """(item, w, q, term_id): the two rarest terms of each window of an item that may occur at all."""
    counts = index.groupBy("term_id").agg(F.count("*").alias("df"))
    lists = terms.join(counts, "term_id", "left").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("df", F.lit(0)).alias("df"), "term_id"))).alias("ts"))
    w = F.least(F.col("n"), F.lit(window))
    each = lists.select("item", w.alias("w"), "ts", F.explode(F.sequence(F.lit(1), F.col("n") - w + 1)).alias("s"))
    each = each.select("item", "w", F.slice("ts", F.col("s"), F.col("w")).alias("ts"))
    each = each.select("item", "w", F.array_sort(F.transform("ts", lambda t: F.struct(t["df"].alias("df"), t["q"].alias("q"), t["term_id"].alias("term_id")))).alias("ts"))
    each = each.where(F.col("ts")[0]["df"] > 0)
    return each.select("item", "w", F.explode(F.slice("ts", 1, 2)).alias("t")).select("item", "w", "t.q", "t.term_id").distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = 10) -> DataFrame:
    """Maximal runs (doc_id, rep, item, lo, n) of document words equal to consecutive item words.

    lo: the first word's place in the document. Runs are at least ``window`` long, or the whole item if
    it is shorter.
    """
    anchors = _rarest(terms, index, window)
    hits = index.join(small_side(staged(anchors, "anchors")), "term_id").select(*DOC, "item", "w", (F.col("pos") - F.col("q")).alias("shift"), "q")
    near = hits.groupBy(*DOC, "item", "shift", "w").agg(F.min("q").alias("a"), F.max("q").alias("b")).where((F.col("a") < F.col("b")) | (F.col("w") == 1))
    near = staged(near.drop("a", "b"), "candidates")
    among = null_safe_join(index.where("term_id > 0"), small_side(near.select(*DOC).distinct()), DOC, "left_semi")
    wanted = near.join(small_side(terms.drop("item_id", "n")), "item").withColumn("pos", F.col("shift") + F.col("q"))
    found = null_safe_join(wanted, among.distinct(), [*DOC, "pos", "term_id"], "left_semi")
    line = [*DOC, "item", "shift"]
    runs = found.withColumn("run", F.col("q") - F.row_number().over(Window.partitionBy(*line).orderBy("q")))
    return runs.groupBy(*line, "w", "run").agg(F.min("pos").alias("lo"), F.count("*").cast("int").alias("n")).where("n >= w").select(*DOC, "item", "lo", "n")


def _enough(terms: DataFrame, index: DataFrame, share: float) -> DataFrame:
    """(item, q, term_id): so many of the rarest words of each item that ``share`` of its words can't be met without one of them.

    Words that occur nowhere are missed by every document, so they count among the rarest and are then left out.
    """
    counts = index.groupBy("term_id").agg(F.count("*").alias("df"))
    lists = terms.join(counts, "term_id", "left").groupBy("item", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "q", "term_id"))).alias("ts"))
    missed = (F.col("n") - F.ceil(share * F.col("n"))).cast("int")
    return lists.select("item", F.explode(F.slice("ts", 1, missed + 1)).alias("t")).where("t.df > 0").select("item", "t.q", "t.term_id")


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, rep, item, around, n_terms): items of which ``share`` of the words stand in order, give or take ``slop`` words.

    Lists are intersected on bands of shifts 2 * slop wide, each posting in the two bands that hold it, so no
    pair of postings is compared. Each match holds one of the anchors that choose the candidates. A document's word counts
    for every equal word of the item in its band.
    """
    anchors = small_side(staged(_enough(terms, index, share), "anchors"))
    bands = lambda df: df.select(*[c for c in df.columns if c not in ("pos", "shift")], F.explode(F.array(F.floor(F.col("shift") / (2 * slop)), F.floor((F.col("shift") + slop) / (2 * slop)) + F.lit(0.5))).alias("around"))
    first = bands(index.join(anchors, "term_id").select(*DOC, "item", (F.col("pos") - F.col("q")).alias("shift"))).distinct()
    first = staged(first, "proximity-candidates")
    among = null_safe_join(index.where("term_id > 0"), small_side(first.select(*DOC).distinct()), DOC, "left_semi")
    every = bands(among.join(small_side(terms.drop("item_id")), "term_id").withColumn("shift", F.col("pos") - F.col("q")))
    counts = null_safe_join(every, first, [*DOC, "item", "around"], "left_semi").groupBy(*DOC, "item", "n", "around").agg(F.count_distinct("q").alias("n_terms"))
    return counts.where(F.col("n_terms") >= share * F.col("n")).drop("n")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """One row a row of docs: doc_id, rep, n_words, n_hit, n_items, item_ids (sorted strings), contaminated.

    All of these are of exact phrases. With a slop, near_ids has the items of proximity_matches too (sorted strings).
    """
    terms, vocabulary = test_terms(items)
    index = build_index(docs, vocabulary)
    names = terms.select("item", F.col("item_id").cast("string").alias("item_id")).distinct()
    runs = phrase_matches(index, terms, window).join(small_side(names), "item")
    hit = runs.select(*DOC, "item_id", F.explode(F.sequence("lo", F.col("lo") + F.col("n") - 1)).alias("pos"))
    hit = hit.groupBy(*DOC).agg(F.count_distinct("pos").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    lengths = index.where("term_id = 0").select(*DOC, F.col("pos").cast("long").alias("n_words"))
    out = null_safe_join(lengths, hit, DOC, "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "item_ids": F.coalesce("item_ids", none)})
    out = out.withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": F.col("n_hit") > 0})
    if slop is None:
        return out
    near = proximity_matches(index, terms, slop).join(small_side(names), "item").groupBy(*DOC).agg(F.array_sort(F.collect_set("item_id")).alias("near_ids"))
    return null_safe_join(out, near, DOC, "left").withColumn("near_ids", F.coalesce("near_ids", none))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
