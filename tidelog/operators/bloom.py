"""Bloom filters of runs, as a relation of set bits and as a probe against it.

A filter over ``n`` keys has ``m = 8 * ceil(bits_per_key * n / 8)`` bits. Two polynomial
hashes of the key's bytes, to the bases 257 and 263 modulo ``m``, give the positions
``(h1 + i * max(1, h2)) mod m`` for ``i`` from 1 to the number of hashes. Everything stays
in built-in expressions. Keys are null-free; an empty key hashes to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.joins import lookup_join
from tidelog.storage.workspace import materialise

# Bases of the two polynomial hashes, and the shift of a signed byte.
BASE_1, BASE_2 = 257, 263
SHIFT = 128


def key_bytes(key: Column | str) -> Column:
    """The bytes of a key, each as the number that the hashes add: the signed byte plus
    128, which is the unsigned byte plus 128 modulo 256."""
    digits = F.hex(F.encode(F.col(key) if isinstance(key, str) else key, "UTF-8"))
    at = F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1)
    one = lambda i: (F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint") + SHIFT) % 256
    return F.when(F.length(digits) > 0, F.transform(at, one)).otherwise(F.array().cast("array<bigint>"))


def polynomial(terms: Column, base: int, m: Column) -> Column:
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda h, b: (h * base + b) % m)


def hashes(rows: DataFrame, key: str = "key", m: str = "m") -> DataFrame:
    """Adds ``h1`` and ``h2`` of the key modulo the column ``m``."""
    with_bytes = rows.withColumn("_bytes", key_bytes(key))
    return (
        with_bytes.withColumn("h1", polynomial(F.col("_bytes"), BASE_1, F.col(m)))
        .withColumn("h2", polynomial(F.col("_bytes"), BASE_2, F.col(m)))
        .drop("_bytes")
    )


def positions(hash_count: int) -> Column:
    step = F.greatest(F.lit(1).cast("bigint"), F.col("h2"))
    return F.transform(F.sequence(F.lit(1), F.lit(hash_count)), lambda i: (F.col("h1") + i * step) % F.col("m"))


def sizes(entries: DataFrame, bits_per_key: int) -> DataFrame:
    """(run_id, m): bits of each run's filter; one row per run."""
    return entries.groupBy("run_id").agg((F.ceil(F.count("*") * bits_per_key / 8) * 8).cast("bigint").alias("m"))


def packed_filters(entries: DataFrame, bits_per_key: int, hash_count: int) -> DataFrame:
    """(run_id, m, word, bits): the filters as 64-bit words; a filter of any size is spread
    over rows, so none has to fit one task. Bits of a word are combined on the map side."""
    held = materialise(entries.select("run_id", "key"), "filtered")
    placed = hashes(lookup_join(held, sizes(held, bits_per_key), ["run_id"], "inner", spread="key", name="sizes"))
    spots = placed.select("run_id", "m", F.explode(positions(hash_count)).alias("bit"))
    return spots.groupBy("run_id", "m", F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    )


def fill(entries: DataFrame, bits_per_key: int, hash_count: int) -> DataFrame:
    """(run_id, m, bits_set)."""
    filters = packed_filters(entries, bits_per_key, hash_count)
    return filters.groupBy("run_id", "m").agg(F.sum(F.bit_count("bits").cast("bigint")).alias("bits_set"))


def probe(filters: DataFrame, asked: DataFrame, hash_count: int) -> DataFrame:
    """(run_id, key, maybe) for the asked (run_id, key) rows: maybe if all bits are set.

    Each asked row looks up only the words that its positions fall in: an equi-join on
    (run, word), then all of its bits must have been found."""
    filters = materialise(filters, "filters")
    per_run = filters.select("run_id", "m").distinct()
    placed = hashes(lookup_join(asked.select("run_id", "key"), per_run, ["run_id"], "inner", spread="key", name="sizes"))
    spots = placed.select("run_id", "key", F.explode(positions(hash_count)).alias("bit"))
    wanted = spots.groupBy("run_id", "key", F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("mask")
    )
    hit = wanted.join(filters.select("run_id", "word", "bits"), ["run_id", "word"], "left")
    full = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    return hit.groupBy("run_id", "key").agg(F.min(full).alias("maybe"))


def effect(entries: DataFrame, asked: DataFrame, bits_per_key: int, hash_count: int) -> DataFrame:
    """(run_id, checked, negatives, false_positives, false_negatives)."""
    entries = materialise(entries.select("run_id", "key"), "entries")
    answers = probe(packed_filters(entries, bits_per_key, hash_count), asked, hash_count)
    truth = entries.select("run_id", "key", F.lit(True).alias("there"))
    both = answers.join(truth, ["run_id", "key"], "left")
    there = F.col("there").isNotNull()
    return both.groupBy("run_id").agg(
        F.count("*").alias("checked"),
        F.count_if(~F.col("maybe")).alias("negatives"),
        F.count_if(F.col("maybe") & ~there).alias("false_positives"),
        F.count_if(~F.col("maybe") & there).alias("false_negatives"),
    )
