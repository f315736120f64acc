"""Processing only new or changed records (high watermark, atomic commit).

The source is a log of commits: every append writes a folder of its own and is published
under the next commit number, so the numbers only grow and what lies under a number never
changes. A run reads the committed watermark, fixes the newest commit as its upper limit at
the start, and reads exactly the commits ``low < number <= high``: its work follows what is
new, not the history. Output and the new watermark, which is that limit, are published in
one manifest. A run that dies before leaves only an unnamed folder; the next run starts
from the same watermark, so nothing is skipped or repeated.

A mutation, (scope, sequence number), can be delivered again in later commits. A bitmap of
the mutations decided so far (``operators.seen``) is committed together with the watermark;
deliveries of these are dropped, so each mutation is put out once.

Coverage that another system recorded before the first run enters as marks: in a scope with
a mark, mutations whose earliest known arrival in the commits read is not later than the
mark are covered and never put out. Without any known arrival they aren't decided: the next
delivery that tells one decides.

Defined results: rows without scope or sequence number are ignored; in a scope without a mark
every mutation is new, whatever its arrival; an arrival at the mark itself is covered; a
run without new commits puts nothing out and publishes nothing; a commit id appended before
is skipped; status texts compare trimmed and without case; of status rows with one log time
the greater text counts; attempts without start time never set a mark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.changes import was_applied, with_batch
from tidelog.operators.joins import lookup_join
from tidelog.operators.seen import SeenNumbers
from tidelog.storage.manifest import ManifestStore
from tidelog.storage.workspace import delete

#: Versions whose files are kept.
RETAIN = 10


def last_success(attempts: DataFrame) -> DataFrame:
    """(store_id, watermark): start of the last attempt whose latest status row says
    that it succeeded."""
    status = F.lower(F.trim(F.regexp_replace("status", r"(?U)\s+", " ")))
    latest = (
        attempts.where("attempt_id is not null")
        .groupBy("attempt_id")
        .agg(
            F.max(F.struct(F.col("logged_at"), status.alias("status"))).alias("last"),
            F.max("started_at").alias("started_at"),
            F.max("store_id").alias("store_id"),
        )
    )
    return (
        latest.where("last.status = 'succeeded' and started_at is not null and store_id is not null")
        .groupBy("store_id")
        .agg(F.max("started_at").alias("watermark"))
    )


SOURCE = "store_id bigint, seq_no bigint, arrived_at timestamp_ntz"


class CommitLog:
    """Deliveries under commit numbers that only grow; one writer, any readers."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SOURCE):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.store = ManifestStore(spark, path)

    def latest(self) -> int:
        return (self.store.read() or {"version": 0})["version"]

    def append(self, rows: DataFrame, commit_id: str) -> int:
        """Publish rows under the next number; returns the newest number."""
        held = self.store.read() or {"version": 0, "ids": {}}
        if was_applied(held["ids"], commit_id):
            return held["version"]
        number = held["version"] + 1
        columns = [c.split()[0] for c in self.schema.split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/commits/{number:010d}")
        return self.store.commit(number, {"ids": with_batch(held["ids"], commit_id)})["version"]

    def read(self, low: int, high: int) -> DataFrame:
        """The rows of the commits after ``low`` up to ``high``; no other file is opened."""
        folders = [f"{self.path}/commits/{n:010d}" for n in range(low + 1, high + 1)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)


class IncrementalReader:
    """Runs over a commit log; see the module text."""

    def __init__(self, spark: SparkSession, path: str, log: CommitLog, buckets: int | None = None):
        self.spark, self.path, self.log = spark, path.rstrip("/"), log
        self.store = ManifestStore(spark, path)
        held = self.store.read()
        self.buckets = held["buckets"] if held else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _held(self) -> dict:
        return self.store.read() or {"version": 0, "low": 0, "marks": None, "output": None, "seen": {}, "buckets": self.buckets}

    def seed(self, marks: DataFrame) -> None:
        """Take over marks, (store_id, watermark), that another system recorded."""
        held = self._held()
        folder = f"marks/{held['version'] + 1:010d}"
        marks.write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self.store.commit(held["version"] + 1, {**held, "marks": folder})

    def _marks(self, held: dict) -> DataFrame:
        if held["marks"]:
            return self.spark.read.parquet(f"{self.path}/{held['marks']}")
        return self.spark.createDataFrame([], "store_id bigint, watermark timestamp_ntz")

    def run(self, commit: bool = True) -> DataFrame:
        """Put out what is new up to the limit fixed now: (store_id, seq_no, position).
        ``commit=False`` stops before publishing, as a failing run would (for tests)."""
        held = self._held()
        low, high, version = held["low"], self.log.latest(), held["version"] + 1
        if high == low:
            return self._output(None)
        met = (
            self.log.read(low, high).where("store_id is not null and seq_no is not null")
            .groupBy("store_id", "seq_no").agg(F.min("arrived_at").alias("position"))
        )
        marked = lookup_join(met, self._marks(held), ["store_id"], "left", spread="seq_no", name="marks")
        decided = marked.select(
            "store_id", "seq_no", "position",
            F.expr("watermark is null or coalesce(position > watermark, false)").alias("fresh"),
            F.expr("watermark is null or position is not null").alias("known"),
        )
        work, folder = f"{self.path}/work/{version:010d}", f"output/{version:010d}"
        if held["seen"]:
            decided.write.mode("overwrite").parquet(work)
            decided = self.spark.read.schema(decided.schema).parquet(work)
        seen = SeenNumbers(self.spark, self.path, held["buckets"])
        first = seen.missing(held["seen"], decided, folder)
        files = seen.added(held["seen"], first.where("known"), version)
        if commit:
            self.store.commit(version, {**held, "low": high, "output": folder, "seen": files})
            self.store.expire(RETAIN, lambda m: {f[0] for f in m["seen"].values()})
        delete(self.spark, work)
        return self._output(folder)

    def _output(self, folder: str | None) -> DataFrame:
        schema = "store_id bigint, seq_no bigint, position timestamp_ntz, fresh boolean, known boolean"
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], schema)
        return rows.where("fresh").select("store_id", "seq_no", "position")
