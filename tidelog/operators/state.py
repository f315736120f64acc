"""Newest-wins state of a mutation log: lookups, history, snapshots, validation.

A log has the columns ``seq_no, key, value, tombstone``. Sequence numbers are unique; if
not, a delete wins over a put of the same number, then the greater value. Rows whose key
or number is null are ignored by all operators; an empty value is a value, an empty key
is reported as invalid by ``validate`` and else an ordinary key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.joins import lookup_join


def usable(log: DataFrame) -> DataFrame:
    return log.select("seq_no", "key", "value", "tombstone").where("seq_no is not null and key is not null")


def newest(log: DataFrame, by: tuple[str, ...] = ("key",)) -> DataFrame:
    """The newest mutation of each key (or of each other grouping), deletes included.
    One aggregation that combines on the map side: a hot key sends a row per map task."""
    return (
        log.where("seq_no is not null and key is not null")
        .groupBy(*by)
        .agg(F.max(F.struct("seq_no", "tombstone", "value")).alias("m"))
        .select(*by, "m.seq_no", "m.value", "m.tombstone")
    )


def latest_state(log: DataFrame) -> DataFrame:
    """(key, seq_no, value) of the visible keys."""
    return newest(log).where(~F.col("tombstone")).select("key", "seq_no", "value")


def state_as_of(log: DataFrame, seq_no: int) -> DataFrame:
    """The state after the mutation ``seq_no``; the limit is pushed to the scan."""
    return latest_state(log.where(F.col("seq_no") <= seq_no))


def point_get(log: DataFrame, key: str) -> DataFrame:
    """The visible value of one key; no row if there is none. The key is pushed to the
    scan, and no shuffle by key is needed: one row comes from each task."""
    found = usable(log).where(F.col("key") == key).agg(F.max(F.struct("seq_no", "tombstone", "value", "key")).alias("m"))
    return found.where("m is not null and not m.tombstone").select("m.key", "m.seq_no", "m.value")


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, status, value) for each distinct probe key; status is ok, not_found or
    invalid_argument. The log is first reduced to keys that are asked for, if the probes
    are few enough to be broadcast."""
    asked = probes.select("key").distinct()
    hits = lookup_join(usable(log), asked.where("key is not null"), ["key"], "left_semi", name="probes")
    state = latest_state(hits).select(F.col("key").alias("found"), "seq_no", "value")
    bad = F.col("key").isNull() | (F.col("key") == "")
    status = F.when(bad, "invalid_argument").when(F.col("found").isNull(), "not_found").otherwise("ok")
    return asked.join(state, F.col("key") == F.col("found"), "left").select("key", status.alias("status"), "value")


def tombstoned_keys(log: DataFrame) -> DataFrame:
    return newest(log).where("tombstone").select("key", "seq_no")


def key_history(log: DataFrame) -> DataFrame:
    """Versions, deletes, first and last number of each key."""
    return (
        usable(log).groupBy("key")
        .agg(
            F.count("*").alias("versions"),
            F.count_if("tombstone").alias("deletes"),
            F.min("seq_no").alias("first_seq"),
            F.max("seq_no").alias("last_seq"),
        )
    )


def validation(max_key: int, max_value: int) -> Column:
    """Status of a mutation under limits on key and value bytes."""
    k, v = F.octet_length("key"), F.octet_length("value")
    return (
        F.when(F.col("key").isNull(), "null_key")
        .when(k == 0, "empty_key")
        .when(k > max_key, "key_too_long")
        .when(F.col("tombstone"), "ok")
        .when(F.col("value").isNull(), "null_value")
        .when(v > max_value, "value_too_long")
        .otherwise("ok")
    )


def validate(log: DataFrame, max_key: int, max_value: int) -> DataFrame:
    """Counts of mutations by status."""
    return log.groupBy(validation(max_key, max_value).alias("status")).agg(F.count("*").alias("n"))


def expire_tombstones(log: DataFrame, horizon: int) -> DataFrame:
    """Newest mutation per key without deletes of number ``horizon`` or before: what a
    merge of all runs may drop (an extension; merges keep deletes by default)."""
    return newest(log).where(~F.col("tombstone") | (F.col("seq_no") > horizon)).select("key", "seq_no", "value", "tombstone")


def range_scan(log: DataFrame, low: str, high: str) -> DataFrame:
    """Visible keys from ``low`` on and below ``high``; pushed to the scan."""
    return latest_state(log.where((F.col("key") >= low) & (F.col("key") < high)))


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    """Visible keys that start with ``prefix``; pushed to the scan."""
    return latest_state(log.where(F.col("key").startswith(prefix)))
