"""Mutation logs derived from the test tables.

Each log has ``seq_no, key, value, tombstone``; numbers are dense from 1 and unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources.tables import table


def events_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user; errors are deletes."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).cast("bigint").alias("seq_no"),
        F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
    )


def events_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user and one of seven shards; errors are deletes."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).cast("bigint").alias("seq_no"),
        F.concat(F.lit("u:"), F.col("user_id").cast("string"), F.lit(":"), (F.col("event_id") % 7).cast("string")).alias("key"),
        F.col("props").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
    )


def orders_cust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer; finished ones are deletes."""
    return table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") + 1).cast("bigint").alias("seq_no"),
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("key"),
        F.col("o_orderpriority").alias("value"),
        (F.col("o_orderstatus") == "F").alias("tombstone"),
    )
