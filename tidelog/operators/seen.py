"""Which sequence numbers of each scope were met: a bitmap of them, in buckets on disk.

A page covers ``PAGE`` numbers of one scope with one bit each, so the numbers of a long
history take about a bit each, and no filter is asked: the answer is exact. A batch is
reduced to pages on the map side, so a scope with a third of all rows is no larger in a
task than its pages, and only the buckets that its pages fall in are read or written.

Defined results: null scopes and numbers are never met and never added; numbers may be
negative; adding a number again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.storage.buckets import Buckets, Files

WORDS = 64
PAGE = 64 * WORDS


def _page() -> Column:
    return F.floor(F.col("seq_no") / PAGE).cast("bigint")


def pages(ids: DataFrame) -> DataFrame:
    """(store_id, page, bits): the pages of (store_id, seq_no) rows."""
    word = F.floor(F.pmod(F.col("seq_no"), F.lit(PAGE)) / 64).cast("int")
    bit = F.expr("shiftleft(1L, cast(pmod(seq_no, 64) as int))")
    words = (
        ids.where("store_id is not null and seq_no is not null")
        .groupBy("store_id", _page().alias("page"), word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    )
    # at most WORDS entries a page
    held = words.groupBy("store_id", "page").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0).cast("bigint")))
    return held.select("store_id", "page", every.alias("bits"))


class SeenNumbers:
    def __init__(self, spark: SparkSession, path: str, count: int):
        self.buckets = Buckets(spark, path, "store_id bigint, page bigint, bits array<bigint>", ["store_id", "page"], count)

    def added(self, files: Files, ids: DataFrame, version: int) -> dict[str, list]:
        """The files after the (store_id, seq_no) rows are added."""
        both = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))
        bits = lambda old, new: F.struct(
            F.when(old.isNull(), new["bits"]).when(new.isNull(), old["bits"]).otherwise(both(old["bits"], new["bits"])).alias("bits")
        )
        return self.buckets.merged(files, pages(ids), version, bits, "seen")

    def missing(self, files: Files, ids: DataFrame, folder: str) -> DataFrame:
        """The rows of ``ids`` (one per number, with any other columns) that weren't met;
        written to the folder of that name, from which they are read back."""
        b, path = self.buckets, f"{self.buckets.path}/{folder}"
        placed = ids.withColumn("page", _page())
        numbers = placed.select("store_id", "page").distinct().select(b.number().alias("b")).distinct() if files else None
        touched = {str(r.b) for r in numbers.collect()} if files else set()
        with b.opened({k: f for k, f in files.items() if k in touched}) as (stored,):
            word = F.try_element_at(F.col("bits"), (F.floor(F.pmod(F.col("seq_no"), F.lit(PAGE)) / 64) + 1).cast("int"))
            met = F.coalesce(F.expr("shiftleft(1L, cast(pmod(seq_no, 64) as int))").bitwiseAND(word) != 0, F.lit(False))
            left = b.dealt(placed).join(stored.hint("merge"), ["store_id", "page"], "left") if touched else placed.withColumn("bits", F.lit(None).cast("array<bigint>"))
            left.where(~met).drop("page", "bits").write.mode("overwrite").parquet(path)
        return b.spark.read.schema(ids.schema).parquet(path)
