"""Applying a stream of inserts, updates and deletes (bucketed copy-on-write).

The table lies in a folder as hash buckets of its key, one sorted file each. A batch of
changes is reduced to the newest change of each key, routed to the buckets by the same
hash, and sort-merged with the touched buckets only; the merged buckets are written as
replacement files and a new manifest, published atomically, names them. Buckets without
a change keep their files. The stored side of the merge is read bucket by bucket in its
order: it is neither exchanged nor sorted (see ``storage.buckets``). Buckets that grow
beyond ``max_bucket_bytes`` are split in two before the next batch; files that none of the
newest ``retain`` versions names are deleted.

Change rows are deliveries: one mutation, named by (scope, sequence number), can
arrive several times, out of order and with fields missing. A delivery is whole
if it has a key and is a delete, or has a key, a value and says that it is no
delete. Other deliveries are put together by mutation until they are whole; what
stays incomplete is kept as pending fragments for later batches. A bitmap of the mutations
that were applied tells which fragments came after, or beside, a whole delivery of theirs:
they are dropped, so what is pending doesn't grow with the history.

Defined results: rows without scope or sequence number can't be ordered and are
ignored; an empty key or value is a value; keys compare as exact bytes; of equal
sequence numbers of one key a delete wins, then the greater value; an empty batch
changes no rows; a batch id applied before is skipped (ids that end in ``-<number>`` are
kept as ranges of numbers); columns of the change table other than those named are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.seen import SeenNumbers
from tidelog.storage.buckets import Buckets
from tidelog.storage.manifest import ManifestStore
from tidelog.storage.workspace import delete

COLUMNS = ("store_id", "key", "seq_no", "tombstone", "value")
SCHEMA = "store_id bigint, key string, seq_no bigint, tombstone boolean, value string"


def whole() -> Column:
    """True for a delivery that is a complete mutation by itself."""
    put = F.col("value").isNotNull() & ~F.col("tombstone")
    return F.coalesce(F.col("key").isNotNull() & (F.col("tombstone") | put), F.lit(False))


def assemble(fragments: DataFrame) -> DataFrame:
    """One row per mutation out of its incomplete deliveries."""
    return fragments.groupBy("store_id", "seq_no").agg(
        F.max("key").alias("key"), F.max("tombstone").alias("tombstone"), F.max("value").alias("value")
    ).select(*COLUMNS)


def newest_per_key(mutations: DataFrame) -> DataFrame:
    """The newest mutation of each key; combined on the map side before the shuffle,
    so a key with a third of all rows sends one row per map task."""
    return (
        mutations.groupBy("store_id", "key")
        .agg(F.max(F.struct("seq_no", "tombstone", "value")).alias("m"))
        .select("store_id", "key", "m.seq_no", "m.tombstone", "m.value")
    )


def _numbered(batch_id: str) -> tuple[str, int | None]:
    found = re.fullmatch(r"(.*)-(\d+)", batch_id)
    return (found[1] + "-", int(found[2])) if found else (batch_id, None)


def was_applied(batches: dict, batch_id: str) -> bool:
    name, n = _numbered(batch_id)
    return name in batches and (n is None or any(a <= n <= b for a, b in batches[name]))


def with_batch(batches: dict, batch_id: str) -> dict:
    """The applied batches, with neighbouring numbers of one name as one range."""
    name, n = _numbered(batch_id)
    spans = sorted([*batches.get(name, []), *([] if n is None else [[n, n]])])
    joined: list[list[int]] = []
    for a, b in spans:
        if joined and a <= joined[-1][1] + 1:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    return {**batches, name: joined}


@dataclass
class ApplyReport:
    version: int
    touched: list[int]
    skipped: bool = False


class BucketedTable:
    """A keyed table under copy-on-write; one writer at a time, any readers."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, max_bucket_bytes: int = 1 << 30, retain: int = 10):
        self.spark, self.path = spark, path.rstrip("/")
        self.max_bucket_bytes, self.retain = max_bucket_bytes, max(1, retain)
        self.store = ManifestStore(spark, path)
        held = self.store.read()
        #: As many buckets as shuffle partitions at first: then grouping a batch by key
        #: also deals it to the buckets.
        self.buckets = held["buckets"] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _table(self, count: int | None = None) -> Buckets:
        return Buckets(self.spark, self.path, SCHEMA, ["store_id", "key"], count or self.buckets)

    def _pending(self, held: dict | None) -> DataFrame:
        if not held or not held["pending"]:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{held['pending']}")

    def apply(self, changes: DataFrame, batch_id: str) -> ApplyReport:
        """Merge one batch. Failing at any point before the manifest is published
        leaves the table as it was; the same batch can then be applied again."""
        old = self.store.read() or {"version": 0, "buckets": self.buckets, "files": {}, "seen": {}, "seen_buckets": self.buckets, "pending": None, "batches": {}}
        if was_applied(old["batches"], batch_id):
            return ApplyReport(old["version"], [], True)
        version, files = old["version"] + 1, old["files"]
        table, seen = self._table(old["buckets"]), SeenNumbers(self.spark, self.path, old["seen_buckets"])
        if any(size > self.max_bucket_bytes for _, size in files.values()):
            table, files = table.split(files, f"data/{version:010d}-split")
        rows = changes.select(*COLUMNS).where("store_id is not null and seq_no is not null")
        work = f"{self.path}/work/{version:010d}"
        assemble(rows.where(~whole()).unionByName(self._pending(old))).write.mode("overwrite").parquet(work)
        assembled = self.spark.read.schema(SCHEMA).parquet(work)
        mutations = rows.where(whole()).unionByName(assembled.where(whole()))
        newer = lambda a, b: F.greatest(a, b)  # noqa: E731  # by number, delete, value; a null is less
        new_files = table.merged(files, newest_per_key(mutations), version, newer)
        new_seen = seen.added(old["seen"], mutations.select("store_id", "seq_no"), version)
        pending = f"pending/{version:010d}"
        seen.missing(new_seen, assembled.where(~whole()), pending)
        self.store.commit(
            version,
            {
                "buckets": table.count, "files": new_files, "seen": new_seen, "seen_buckets": seen.buckets.count,
                "pending": pending, "batches": with_batch(old["batches"], batch_id),
            },
        )
        self.buckets = table.count
        delete(self.spark, work)
        # buckets that were split and then rewritten at once
        for b, f in files.items():
            if f != new_files.get(b) and f != old["files"].get(b):
                delete(self.spark, f"{self.path}/{f[0]}")
        self.vacuum()
        return ApplyReport(version, sorted(int(b) for b, f in new_files.items() if f != files.get(b)))

    def vacuum(self, retain: int | None = None) -> None:
        """Delete the versions before the newest ``retain`` and the files that only they name."""
        self.store.expire(retain or self.retain, lambda m: {m["pending"], *(f[0] for f in [*m["files"].values(), *m["seen"].values()])} - {None})

    def rows(self, version: int | None = None) -> DataFrame:
        """The newest mutation of each key, deletes included, as of a version."""
        held = self.store.read(version)
        return self._table().read(held["files"] if held else {})

    def state(self, version: int | None = None) -> DataFrame:
        """The visible rows: newest mutation of each key that isn't a delete."""
        return self.rows(version).where(~F.col("tombstone"))

    def pending(self) -> DataFrame:
        """Mutations that no delivery so far has made complete."""
        return self._pending(self.store.read())
