"""The write-ahead log: record sizes, segments, validation and recovery.

A log row is ``seq_no, key, value, tombstone``; a stored record adds ``segment_id`` and its
place in the segment. Rows with null key or number have no record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import WAL_HEADER, WAL_RECORD_OVERHEAD
from tidelog.operators.runs import greedy_packing, running_sum


def record_bytes() -> Column:
    """Bytes of a record; a delete has no value."""
    value = F.when(F.col("tombstone"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0)))
    return (F.lit(WAL_RECORD_OVERHEAD) + F.octet_length("key") + value).cast("bigint")


def offsets(log: DataFrame) -> DataFrame:
    """(seq_no, bytes, end_offset): records one after another in a single segment."""
    sized = log.where("seq_no is not null and key is not null").select("seq_no", record_bytes().alias("bytes"))
    return running_sum(sized, ["seq_no"], "bytes").select("seq_no", "bytes", (F.col("total") + WAL_HEADER).alias("end_offset"))


def segments(log: DataFrame, roll_size: int, store: str | None = None) -> DataFrame:
    """(store, seq_no, segment_id): the rolling rule, cut in parallel (see
    ``runs.greedy_packing``); only numbers and sizes are moved."""
    sized = log.where("seq_no is not null and key is not null").select(
        (F.col(store) if store else F.lit(0)).cast("bigint").alias("store"), "seq_no", record_bytes().alias("bytes")
    )
    return greedy_packing(sized, roll_size - WAL_HEADER).withColumnRenamed("bin", "segment_id")


def record_is_valid(max_key: int, max_value: int) -> Column:
    """Checks of a stored record with ``length, key_len, value_len, type, crc, body_crc``:
    lengths present and consistent, type known, a delete without value, sizes in bounds,
    checksum equal."""
    k, v = F.col("key_len"), F.col("value_len")
    return F.coalesce(
        (F.col("length") == 17 + k + v)
        & (k > 0) & (v >= 0) & (k <= max_key) & (v <= max_value)
        & F.col("type").isin(1, 2)
        & ((F.col("type") == 1) | (v == 0))
        & (F.col("crc") == F.col("body_crc")),
        F.lit(False),
    )


def valid_prefix(records: DataFrame, bad: Column, segment: str = "segment_id", at: str = "at") -> DataFrame:
    """The records before the first bad one of each segment. The place of the first bad
    record is one row per segment, so segments aren't sorted or gathered."""
    first_bad = records.where(bad).groupBy(segment).agg(F.min(at).alias("_bad"))
    return records.join(first_bad, segment, "left").where(F.col("_bad").isNull() | (F.col(at) < F.col("_bad"))).drop("_bad")


def recovery_report(records: DataFrame, bad: Column) -> DataFrame:
    """(segments, records, truncated, last_seqno, gap): read-only; nothing is cut off. ``gap``
    tells whether numbers are missing between the first and the last that was kept."""
    first_bad = records.where(bad).groupBy("segment_id").agg(F.min("at").alias("_bad"))
    joined = records.join(first_bad, "segment_id", "left")
    kept = F.col("_bad").isNull() | (F.col("at") < F.col("_bad"))
    return joined.agg(
        F.count_distinct("segment_id").alias("segments"),
        F.count_if(kept).alias("records"),
        F.count_distinct(F.when(F.col("_bad").isNotNull(), F.col("segment_id"))).alias("truncated"),
        F.max(F.when(kept, F.col("seq_no"))).alias("last_seqno"),
        F.coalesce(F.max(F.when(kept, F.col("seq_no"))) - F.min(F.when(kept, F.col("seq_no"))) + 1 > F.count_distinct(F.when(kept, F.col("seq_no"))), F.lit(False)).alias("gap"),
    )


def replay(records: DataFrame, bad: Column) -> DataFrame:
    """The log that recovery applies: valid prefixes, a number written twice taken once."""
    return valid_prefix(records, bad).groupBy("seq_no").agg(
        F.max(F.struct("key", "value", "tombstone")).alias("m")
    ).select("seq_no", "m.key", "m.value", "m.tombstone")


def retention(segments_: DataFrame, flushed_segment: int) -> DataFrame:
    """(segment_id): segments that may be deleted once ``flushed_segment`` is flushed."""
    return segments_.where(F.col("segment_id") < flushed_segment).select("segment_id").distinct()


def cache_hits(accesses: DataFrame, blocks: int) -> DataFrame:
    """(at, block, hit) for an LRU cache of ``blocks`` blocks over accesses ordered by
    ``at``. By stack distance: an access hits if fewer than ``blocks`` other blocks came
    since the block's last access. The simulation is a fold over the order; its state is
    the cache itself, of bounded size, and independent traces run in parallel by the
    column ``trace``, if there is one."""
    has = "trace" in accesses.columns
    rows = accesses.select((F.col("trace") if has else F.lit(0)).cast("bigint").alias("trace"), "at", "block")
    ordered = rows.where("at is not null and block is not null").repartition("trace").sortWithinPartitions("trace", "at")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, {}
        for pdf in batches:
            out = []
            for t, b in zip(pdf["trace"], pdf["block"]):
                if t != current:
                    current, held = t, {}
                hit = held.pop(b, None) is not None
                held[b] = True
                if len(held) > blocks:
                    held.pop(next(iter(held)))
                out.append(hit)
            yield pd.DataFrame({"at": pdf["at"], "block": pdf["block"], "hit": out})

    return ordered.mapInPandas(fold, "at bigint, block bigint, hit boolean")
