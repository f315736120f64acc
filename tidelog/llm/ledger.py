"""Has this key been seen before? (exact bucketed key ledger)

Every key ever met is kept on disk, hash-partitioned into sorted buckets, never in memory.
A batch is ranked within each key by arrival and reduced to one row per key; these rows are
routed to the buckets by the same hash and sort-merge left-joined with the buckets they
fall in, and only with these; the ledger's side is read in its order, neither exchanged
nor sorted (see ``storage.buckets``). Keys without a match are new and are appended, one file
for each touched bucket, under a new manifest. A row is "met before" unless it is the first
row of a new key. No filter is asked, so the rate of wrong answers is zero, with memory
bounded by the sort buffers of a task.

Appended files are layers; a key lies in one of them only. After ``layers`` of them they
are merged into the base buckets they touch, so neither files nor joins grow with the number
of batches. Buckets beyond ``max_bucket_bytes`` are then split.

A key with a third of all rows sends one row per map task to the join; which row was
first comes back by its id, not by its key, so no task gathers the rows of one key.

Defined results: null keys and scopes are never met; an empty key is a key; keys are
equal byte for byte; ids repeated in a batch count once; rows arrive by ascending id; a
batch id applied before gives its answers again and changes nothing; empty batches and
histories are allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.changes import was_applied, with_batch
from tidelog.storage.buckets import Buckets
from tidelog.storage.manifest import ManifestStore
from tidelog.storage.workspace import delete

#: ``first_id``: the row that brought the key; null for keys of a history.
SCHEMA = "store_id bigint, key string, first_id bigint"
KEY = ["store_id", "key"]


class KeyLedger:
    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, layers: int = 4, max_bucket_bytes: int = 1 << 30):
        self.spark, self.path, self.layers, self.max_bucket_bytes = spark, path.rstrip("/"), layers, max_bucket_bytes
        self.store = ManifestStore(spark, path)
        held = self.store.read()
        #: As many as shuffle partitions at first: then ranking a batch deals it to them.
        self.buckets = held["buckets"] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _held(self) -> dict:
        return self.store.read() or {"version": 0, "buckets": self.buckets, "files": {}, "layers": [], "batches": {}}

    def _table(self, held: dict) -> Buckets:
        return Buckets(self.spark, self.path, SCHEMA, KEY, held["buckets"])

    def keys(self) -> DataFrame:
        """All keys of the ledger."""
        held = self._held()
        table, out = self._table(held), None
        for files in [held["files"], *held["layers"]]:
            rows = table.read(files).select(*KEY)
            out = rows if out is None else out.unionByName(rows)
        return out

    def _commit(self, held: dict, layer: dict, batch_id: str) -> None:
        """Publish a layer; merge the layers when there are enough."""
        version, table = held["version"] + 1, self._table(held)
        files, layers = held["files"], [*held["layers"], *([layer] if layer else [])]
        if not files and len(layers) == 1:
            files, layers = layers[0], []
        if len(layers) > self.layers:
            batch = table.read(layers[0])
            for more in layers[1:]:
                batch = batch.unionByName(table.read(more))
            files, layers = table.merged(files, batch, version, F.coalesce, "base"), []
            if any(size > self.max_bucket_bytes for _, size in files.values()):
                table, files = table.split(files, f"base/{version:010d}-split")
        self.buckets = table.count
        self.store.commit(version, {"buckets": table.count, "files": files, "layers": layers, "batches": with_batch(held["batches"], batch_id)})
        self.store.expire(1, lambda m: {f[0] for fs in [m["files"], *m["layers"]] for f in fs.values()})

    def _first(self, held: dict, asked: DataFrame, folder: str) -> dict[str, list]:
        """The asked rows, one per key, of which the key isn't in the ledger, or is there
        because of this very row; written as buckets."""
        table, routed = self._table(held), f"asked/{held['version'] + 1:010d}"
        mine = table.write(table.dealt(asked), routed)
        parts = [{b: f for b, f in files.items() if b in mine} for files in [held["files"], *held["layers"]]]
        parts = [p for p in parts if p]
        if not parts:
            return mine
        with table.opened(mine, *parts) as (rows, *stored):
            known = F.lit(None).cast("struct<first:bigint>")
            for i, s in enumerate(stored):
                rows = rows.join(s.select(*KEY, F.struct(F.col("first_id").alias("first")).alias(f"held_{i}")).hint("merge"), KEY, "left")
                known = F.coalesce(known, F.col(f"held_{i}"))
            made = table.write(rows.where(known.isNull() | F.coalesce(known["first"] == F.col("first_id"), F.lit(False))), folder)
        delete(self.spark, f"{self.path}/{routed}")
        return made

    def load(self, history: DataFrame, batch_id: str = "history") -> None:
        """Add the keys of a history, whatever its order."""
        held = self._held()
        if was_applied(held["batches"], batch_id):
            return
        keys = history.select(*KEY).where("store_id is not null and key is not null").distinct()
        self._commit(held, self._first(held, keys.withColumn("first_id", F.lit(None).cast("bigint")), f"data/{held['version'] + 1:010d}"), batch_id)

    def check(self, batch: DataFrame, id_col: str, batch_id: str) -> DataFrame:
        """(id): the rows of the batch whose key was met before; the batch's new keys
        are then part of the ledger."""
        held = self._held()
        rows = batch.select(F.col(id_col).alias("id"), *KEY).where("id is not null and store_id is not null and key is not null")
        ranked = rows.groupBy(*KEY).agg(F.min("id").alias("first_id"))
        applied = was_applied(held["batches"], batch_id)
        new = self._first(held, ranked, f"{'again' if applied else 'data'}/{held['version'] + 1:010d}")
        # the answer outlives the layer, which a later batch may merge
        first = f"{self.path}/first/{batch_id}"
        self._table(held).read(new).select("first_id").write.mode("overwrite").parquet(first)
        if applied:
            delete(self.spark, f"{self.path}/again")
        else:
            self._commit(held, new, batch_id)
        done = self.spark.read.schema("first_id bigint").parquet(first)
        return (
            rows.select("id").distinct()
            .join(done.select(F.col("first_id").alias("id")), "id", "left_anti")
            .withColumnRenamed("id", id_col)
        )
