"""Change batches from Structured Streaming into a database: each micro-batch is one transaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from relspan.plans.relation import cols
from relspan.sources.scratch import new_folder
from relspan.sources.tables import Database


def apply_batch(db: Database, table: str, batch: DataFrame, tag: object = "stream") -> None:
    """Rows with ``_op`` add or remove. A row that a batch both adds and removes ends as its greatest ``_seq`` says, if there is
    one, else it is added."""
    t = db[table]
    names = t.schema.names
    seq = F.col("_seq") if "_seq" in batch.columns else (F.col("_op") == "add").cast("int")
    last = batch.groupBy(*map(lambda n: F.col(f"`{n}`"), names)).agg(F.max_by("_op", seq).alias("_op"))
    with db.transaction({tag}):
        t.remove_all(cols(last.where("_op = 'remove'"), names))
        t.add_all(cols(last.where("_op = 'add'"), names))


def follow(db: Database, table: str, stream: DataFrame, available_now: bool = False) -> StreamingQuery:
    """Apply a stream of changes to a table. Offsets are kept in the shared folder, so a restarted query goes on; adding and removing
    are idempotent, so a batch that runs twice does no harm."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_batch(db, table, batch)).option("checkpointLocation", new_folder(db.spark, f"follow-{table}"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
