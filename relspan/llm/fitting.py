"""Samples of labelled rows to fit on, and models sent to the tasks that score."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from relspan.llm.common import held_out, python_ready, small_side, unused

#: A classifier is fitted on at most so many labelled rows of label 1 and so many of label 0.
FIT_ROWS = 3000
#: ... whose features take at most so many bytes; in the order of the hash, a row that doesn't fit is passed over.
FIT_BYTES = 96 << 20


def fitting_sample(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(text, label, at): at most ``most`` labelled rows of either label, none held out, chosen by a hash of doc_id.

    Only ids and labels are ranked; the texts of the chosen follow in one join. Null labels and labels
    of unknown documents don't count; label rows that repeat are one, and so are rows of docs that share a doc_id: the one with the least text.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).where(~held_out(F.col("doc_id")) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("at", F.xxhash64("doc_id"))
    some = [rows.where(F.col("label") == v).orderBy("at", "doc_id").limit(most) for v in (0, 1)]
    some = some[0].unionByName(some[1])
    found = docs.select("doc_id", "text").join(small_side(some, 2 * most), "doc_id")
    return found.groupBy("doc_id", "label", "at").agg(F.min("text").alias("text")).select("text", "label", "at")


def fit_in_one_task(sample: DataFrame, featurize: Callable[[list[str]], list[bytes]], fit: Callable[[list[tuple[int, bytes]]], object], most_bytes: int = FIT_BYTES) -> bytes:
    """Featurize the bounded sample where it lies, then fit in a single task; returns the pickled model.

    Rows are fitted in the order of ``at``, so reruns agree; Spark sorts them, so the task holds no more than FIT_BYTES. An empty sample gives fit([]).
    """
    python_ready(sample.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = featurize(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("label").cast(pa.int32()), pa.array(x, pa.binary())], ["at", "label", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for y, x in zip(*(b.column(c).to_pylist() for c in ("label", "x"))):
                if held + len(x) <= most_bytes:
                    held += len(x)
                    rows.append((y, x))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], ["model"])

    made = sample.mapInArrow(features, "at long, label int, x binary").repartition(1).sortWithinPartitions("at", "label", "x").mapInArrow(fitted, "model binary")
    return next((r.model for r in made.collect()), None) or pickle.dumps(fit([]))


def score_with(docs: DataFrame, model: bytes, score: Callable[[object, list[str]], list[float]], name: str = "score") -> DataFrame:
    """docs with the column ``name``, made batch by batch from whole texts; a column that docs has under this name goes."""
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = docs.drop(name)
    read = unused([*docs.columns, name], "__text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for b in batches:
            s = score(own, b.column(read).to_pylist())
            keep = [n for n in b.schema.names if n != read]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(s, pa.float64())], [*keep, name])

    return docs.withColumn(read, F.col("text")).mapInArrow(scored, schema)
