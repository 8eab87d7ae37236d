"""Exact token-length histogram: totals, quantiles and truncated totals for every context limit.

Documents are aggregated by encoded length before any sum; suffix sums over the lengths then answer every limit. The sums
go by blocks of lengths, so no task holds all of them.

Defined cases: a null text has length 0; an empty table gives an empty histogram; rows that repeat count as often as they
stand; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspan.llm.common import python_ready
from relspan.llm.encoding import encoder
from relspan.sources.scratch import staged

BLOCK = 64


def encoded_lengths(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """docs' doc_id with ``length``, the number of ids of the whole text."""
    python_ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(enc.count(b.column("text").to_pylist())), pa.int64())], ["doc_id", "length"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row a length that occurs: n_docs and n_tokens of exactly that length; docs_longer and tokens_longer of greater
    ones; truncated_total, the tokens that a context limit of this length keeps; cut_total, those it loses;
    share_within, the documents' share that fits whole."""
    hist = staged(lengths.groupBy("length").agg(F.count("*").alias("n_docs")), "histogram")
    hist = hist.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    after = lambda part, by: part.orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    base = after(Window.partitionBy(F.lit(0)), "block")  # as many rows as the longest document has blocks
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(base), F.lit(0)).alias("db"), F.coalesce(F.sum("t").over(base), F.lit(0)).alias("tb"))
    within = after(Window.partitionBy("block"), "length")
    out = hist.join(blocks, "block")
    out = out.withColumns({"docs_longer": F.col("db") + F.coalesce(F.sum("n_docs").over(within), F.lit(0)), "tokens_longer": F.col("tb") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))})
    sums = hist.agg(F.sum("n_docs").alias("all_docs"), F.sum("n_tokens").alias("all_tokens"))
    out = out.join(F.broadcast(sums), F.lit(True))  # one row
    cut = F.col("tokens_longer") - F.col("length") * F.col("docs_longer")
    out = out.withColumns({"cut_total": cut, "truncated_total": F.col("all_tokens") - cut, "share_within": (F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")})
    return out.select("length", "n_docs", "n_tokens", "docs_longer", "tokens_longer", "truncated_total", "cut_total", "share_within")


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens that remain if every document is cut at any limit, whether it occurs as a length or not."""
    row = histogram.agg(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs"))).first()
    return int(row[0] or 0)


def quantile(histogram: DataFrame, q: float) -> int | None:
    """The least length within which a share q of the documents lies."""
    row = histogram.where(F.col("share_within") >= q).agg(F.min("length")).first()
    return None if row[0] is None else int(row[0])


def digest(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    return length_histogram(encoded_lengths(docs, tokenizer_json))
