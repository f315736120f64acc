"""Sorted hash buckets: a keyed table as one file per bucket, read without moving it.

A bucket is the rows whose key hashes to its number, in key order, in one Parquet file of
the bucketed layout that Spark knows. A version of the table is a map from bucket to the
folder that has its newest file, and the file's size; a change writes new files for the
touched buckets only. ``opened`` gives the named buckets to Spark as a bucketed and sorted
table, so a join on the key is a merge join in which the stored side is neither exchanged
nor sorted again.

Defined results: an empty table has no files; a bucket without rows has no folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.storage.workspace import delete, hadoop

#: Settings under which the planner uses the layout. The order of a bucket's file is
#: trusted, as every bucket has one file.
_LAYOUT = {
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the time of a block."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def name() -> str:
    return f"tidelog_{uuid.uuid4().hex}"


#: Bucket -> (folder under the table's path, bytes).
Files = Mapping[str, Sequence]


class Buckets:
    """The layout of one table: its folder, columns, key and number of buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], count: int):
        self.spark, self.path, self.schema, self.keys, self.count = spark, path.rstrip("/"), schema, list(keys), count
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def number(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.count))

    def dealt(self, rows: DataFrame) -> DataFrame:
        """``rows`` with each bucket in one task. Where they were just grouped by the key
        into as many partitions, nothing is moved."""
        return rows.repartition(self.count, *self.keys)

    def write(self, rows: DataFrame, folder: str) -> dict[str, list]:
        """Write rows of which each bucket lies in one task; returns the new files."""
        table, path = name(), f"{self.path}/{folder}"
        delete(self.spark, path)
        (
            rows.select(*self.columns).withColumn("bucket", self.number())
            .write.partitionBy("bucket").bucketBy(self.count, *self.keys).sortBy(*self.keys)
            .option("path", path).mode("overwrite").saveAsTable(table)
        )
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        fs, p = hadoop(self.spark, path)
        files: dict[str, list] = {}
        listed = fs.listFiles(p, True) if fs.exists(p) else None
        while listed is not None and listed.hasNext():
            status = listed.next()
            at = status.getPath().getParent().getName()
            if at.startswith("bucket=") and status.getPath().getName().endswith(".parquet"):
                files[at[7:]] = [f"{folder}/{at}", status.getLen()]
        return files

    def read(self, files: Files) -> DataFrame:
        """The rows of the named buckets, for use without the layout."""
        if not files:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f[0]}" for f in files.values()])

    def merged(self, files: Files, batch: DataFrame, version: int, combine: Callable[[Column, Column], Column], label: str = "data") -> dict[str, list]:
        """The files after a batch of one row per key is merged in. The batch is routed to
        its buckets by a write; these are merge-joined with the buckets of the same number
        and written anew. ``combine`` makes the values, given as structs (null for none)
        of the stored and of the new row. Buckets without a row of the batch stay."""
        routed = self.write(self.dealt(batch), f"{label}/{version:010d}")
        stored = {b: files[b] for b in routed if b in files}
        if not stored:
            return {**files, **routed}
        values = [c for c in self.columns if c not in self.keys]
        with self.opened(stored, routed) as (old, new):
            joined = old.select(*self.keys, F.struct(*values).alias("old")).hint("merge").join(
                new.select(*self.keys, F.struct(*values).alias("new")), self.keys, "full_outer"
            )
            made = joined.select(*self.keys, combine(F.col("old"), F.col("new")).alias("made")).select(*self.keys, "made.*")
            written = self.write(made, f"{label}/{version:010d}-merged")
        delete(self.spark, f"{self.path}/{label}/{version:010d}")
        return {**files, **written}

    @contextmanager
    def opened(self, *versions: Files) -> Iterator[list[DataFrame]]:
        """The named buckets of one or more versions as bucketed, sorted tables, for plans
        that run inside the block."""
        tables = []
        by = ", ".join(f"`{k}`" for k in self.keys)
        try:
            with settings(self.spark, _LAYOUT):
                for files in versions:
                    tables.append(name())
                    self.spark.sql(
                        f"CREATE TABLE {tables[-1]} ({self.schema}, bucket int) USING parquet PARTITIONED BY (bucket) "
                        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.count} BUCKETS LOCATION '{self.path}/none'"
                    )
                    parts = [f"PARTITION (bucket={int(b)}) LOCATION '{self.path}/{f[0]}'" for b, f in files.items()]
                    if parts:
                        self.spark.sql(f"ALTER TABLE {tables[-1]} ADD {' '.join(parts)}")
                yield [self.spark.table(t).select(*self.columns) for t in tables]
        finally:
            for t in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def split(self, files: Files, folder: str) -> tuple[Buckets, dict[str, list]]:
        """The same rows in twice as many buckets: each bucket's rows go to two of them,
        in the task that reads it, so nothing is exchanged."""
        twice = Buckets(self.spark, self.path, self.schema, self.keys, self.count * 2)
        with self.opened(files) as (rows,):
            return twice, twice.write(rows, folder)
