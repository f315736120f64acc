"""Joins against a side that is usually, but not provably, small."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.storage.workspace import folder_bytes, new_folder

#: Largest written size, in bytes, of a side that is broadcast. It is written plainly, without
#: compression or dictionaries, so the size is about that of the rows in memory.
BROADCAST_BYTES = 8 << 20
#: Words of 64 bits in the filter of ``sift``, two numbers each: at most BROADCAST_BYTES as well.
WORDS = 1 << 19


def measured(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written to a work folder, and the bytes that it takes there."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path), folder_bytes(spark, path)


def sift(big: DataFrame, small: DataFrame, on: list[str]) -> DataFrame:
    """``big`` without most rows whose key isn't in ``small``, by one bit a key in a filter of
    fixed size: a join by a shuffle then moves few rows in vain. All others stay."""
    if any(dict(big.dtypes)[c] != dict(small.dtypes)[c] for c in on):
        return big  # hashes follow the type
    keys = f"xxhash64({', '.join(f'`{c}`' for c in on)})"
    slot, bit = F.expr(f"pmod(shiftrightunsigned({keys}, 6), {WORDS})"), F.expr(f"shiftleft(1L, cast({keys} & 63 as int))")
    words = small.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_word"))
    return big.withColumn("_slot", slot).join(F.broadcast(words), "_slot").where(F.col("_word").bitwiseAND(bit) != 0).drop("_slot", "_word")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    spread: str | None = None,
    limit: int = BROADCAST_BYTES,
    name: str = "lookup",
    sifted: bool = False,
) -> DataFrame:
    """Join ``big`` with ``small``, which has one row per key.

    ``small`` is written and measured: up to ``limit`` bytes it is broadcast. A
    larger one is joined by a shuffle in which the rows of one key of ``big`` are
    spread over salts taken from the column ``spread``, so that a key with a third
    of all rows doesn't end in one task; ``small`` is repeated once per salt. With ``sifted``,
    for an inner or semi join that keeps few rows, others are dropped before the shuffle.
    """
    small, size = measured(small, name)
    if size <= limit:
        return big.join(F.broadcast(small), on, how)
    if sifted and how in ("inner", "left_semi"):
        big = sift(big, small, on)
    if not spread:
        return big.join(small, on, how)
    salts = max(2, math.ceil(math.sqrt(int(big.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))))
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts)))
        .join(salted, [*on, "_salt"], how)
        .drop("_salt")
    )


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt out to all cores if its files give it far fewer partitions: one large
    row group would else keep a costly step on one core. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
