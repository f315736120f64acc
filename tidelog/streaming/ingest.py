"""Structured Streaming into a table: every micro-batch is applied as a change batch.

The table skips a batch id that it has applied, so a batch repeated after a failure
changes nothing, and the order of batches doesn't matter: the newest number wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.changes import BucketedTable
from tidelog.storage.workspace import new_folder


def ingest(changes: DataFrame, table: BucketedTable, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start applying a stream of (store_id, key, seq_no, tombstone, value) to the table.
    ``checkpoint`` must be kept with the table: it holds the position in the source."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, f"stream-{batch_id}")

    return (
        changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_events_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of the event log, built by a stream over the events file."""
    path = new_folder(spark, "stream")
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(
        f"{sf_dir}/events.parquet*"
    )
    changes = events.select(
        F.lit(0).cast("bigint").alias("store_id"),
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("key"),
        (F.col("event_id") + 1).cast("bigint").alias("seq_no"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.coalesce("props", F.lit("")).alias("value"),
    )
    table = BucketedTable(spark, f"{path}/table")
    ingest(changes, table, f"{path}/checkpoint").awaitTermination()
    return table.state().select("key", "seq_no", "value")
