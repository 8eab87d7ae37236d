"""A training corpus from raw documents, in stages that each take and return the columns of documents.

Every stage judges each row of its input; rows that repeat are judged alike, columns that documents doesn't have pass through, an empty table
gives an empty one, and texts are whole at any length. What a stage does with nulls and ties its docstring says. The last stage
returns the token records that it has written and read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspan.llm import decontaminate, mixing, quality, simhash, token_records
from relspan.llm.common import null_safe_join, packed, table, unpacked, unused
from relspan.llm.queries import END_ID, tokenizer_json
from relspan.sources.scratch import NO_CRC, new_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: rows whose score is at least REJECT_BELOW.

    A null text scores as an empty one does; a null doc_id is no matter; rows of equal texts stay or go together. With no labels at all every row stays.
    """
    score = unused(docs.columns, "__score")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), name=score)
    return scored.where(F.col(score) >= quality.REJECT_BELOW).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the least doc_id, then the least text, then the least other columns.

    Null, empty and blank texts are one group. Rows that share a doc_id but not a group stand each for its own. A row without a doc_id stays.
    """
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs, by the text of each row: of two rows with one doc_id only that goes which holds a window.

    Null and empty texts hold none and stay, as all rows do if there are no items.
    """
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id", F.col("rep").alias("__rep")).distinct()
    own = ["doc_id", "text"]
    return unpacked(null_safe_join(packed(docs, own).withColumn("__rep", F.xxhash64("text")), found, ["doc_id", "__rep"], "left_anti"), docs.columns, own)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as the schedule takes them, in the order of the schedule; a text is cut where its source's target is reached.

    A null source is a source of its own, last in order. A text without words is never taken. Of rows alike in doc_id, source and size the hash of the
    text decides the order.
    """
    return mixing.apply_mix(docs)


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records written to files and read back: doc_id, start, n_tokens, ids_crc32, one row a row of docs, in ascending order of doc_id, then text.

    A null doc_id comes first; a null text has the end id alone.
    """
    return token_records.token_records(docs, tokenizer_json(), END_ID)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", records_stage),
]

#: A trained classifier and a tokenizer can't be put in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_folder(spark, f"stage-{k}")
        out.write.options(**NO_CRC).parquet(path)
        docs = spark.read.parquet(path)
    return docs
