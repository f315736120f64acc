"""Runs: cutting a log, flushing, metadata, zone maps, merging, manifests.

A run holds the newest mutation of each key among a stretch of the log, deletes
included. Rows with null key or number are ignored; an empty log has no runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import ENTRY_OVERHEAD, RUN_ENTRY_OVERHEAD, IOFailure
from tidelog.operators.joins import lookup_join
from tidelog.operators.state import latest_state, newest
from tidelog.storage.workspace import materialise


def fixed_run_id(size: int) -> Column:
    """Runs of ``size`` mutations by their number."""
    return F.floor((F.col("seq_no") - 1) / size).cast("bigint")


def flush(log: DataFrame, run_id: Column) -> DataFrame:
    """(run_id, key, seq_no, value, tombstone): one entry per key of each run."""
    return newest(log.withColumn("run_id", run_id), ("run_id", "key"))


def data_bytes() -> Column:
    """Encoded size of an entry in a run."""
    return F.lit(RUN_ENTRY_OVERHEAD) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def run_metadata(entries: DataFrame) -> DataFrame:
    """Count, key and number ranges and encoded bytes of each run."""
    return entries.groupBy("run_id").agg(
        F.count("*").alias("entry_count"),
        F.min("key").alias("min_key"), F.max("key").alias("max_key"),
        F.min("seq_no").alias("min_seq_no"), F.max("seq_no").alias("max_seq_no"),
        F.sum(data_bytes().cast("bigint")).alias("data_bytes"),
    )


def cut_positions(sizes: Iterator[tuple], limit: int) -> Iterator[int]:
    """The exact cutting rule as a fold over (key, bytes) in order: yields the run of each
    mutation. A table is sealed before a mutation that would take it to ``limit`` or more;
    one that reaches ``limit`` exactly still joins it. Space of an overwritten key is
    given back only after the mutation was taken."""
    run, held, total = 0, {}, 0
    for key, size in sizes:
        if total + size >= limit:
            if total + size == limit:
                yield run
                run, held, total = run + 1, {}, 0
                continue
            if total == 0:
                raise IOFailure(f"an entry of {size} bytes exceeds a table of {limit}")
            run, held, total = run + 1, {}, 0
            if size == limit:
                yield run
                run += 1
                continue
            if size > limit:
                raise IOFailure(f"an entry of {size} bytes exceeds a table of {limit}")
        total += size - held.get(key, 0)
        held[key] = size
        yield run


def cut_exact(log: DataFrame, limit: int, store: str | None = None, overwrites: bool = True) -> DataFrame:
    """(store, seq_no, run_id) by bytes. With overwritten keys the rule is a sequential fold:
    each store is one ordered pass over (number, key, size); stores run in parallel, values
    aren't moved. Without (``overwrites=False``: the caller knows that keys don't repeat in a
    store) the runs are a greedy packing, which is cut in parallel within a store too."""
    sized = log.where("seq_no is not null and key is not null").select(
        (F.col(store) if store else F.lit(0)).cast("bigint").alias("store"), "seq_no", "key",
        (F.lit(ENTRY_OVERHEAD) + F.octet_length("key") + F.when(F.col("tombstone"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0)))).alias("size"),
    )
    if not overwrites:
        return greedy_packing(sized.select("store", "seq_no", F.col("size").cast("bigint").alias("bytes")), limit).withColumnRenamed("bin", "run_id")
    ordered = sized.repartition("store").sortWithinPartitions("store", "seq_no")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A task has whole stores in order; the state of the fold outlives the batches."""
        current, feed, runs = None, [], None

        def source() -> Iterator[tuple]:
            while True:
                yield feed.pop()

        for pdf in batches:
            out = []
            for s, k, n in zip(pdf["store"], pdf["key"], pdf["size"]):
                if s != current:
                    current, runs = s, cut_positions(source(), limit)
                feed.append((k, n))
                out.append(next(runs))
            yield pd.DataFrame({"store": pdf["store"], "seq_no": pdf["seq_no"], "run_id": out})

    return ordered.mapInPandas(fold, "store bigint, seq_no bigint, run_id bigint")


#: A part of a packing holds about as many bins, so what its first bin hands on soon agrees.
BINS_PER_PART = 16


def greedy_packing(sized: DataFrame, capacity: int) -> DataFrame:
    """(store, seq_no, bin): records of (store, seq_no, bytes) in the order of their numbers,
    each put into the open bin of its store if it still fits ``capacity``, else into a new one.

    Where a bin ends follows from where it starts and the running sum of bytes, so the
    records are range-partitioned into parts. Each part tells, for the records that may start
    its first new bin, which bin is open at its end and how many began; most of them agree
    after a few bins, so it is a short step function. These functions are composed from part
    to part, and each part then numbers its bins by itself. Only stores that span parts take
    this way: at most two a part. A record that exceeds the capacity raises IOFailure."""
    spark = sized.sparkSession
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (BINS_PER_PART * capacity)))
    placed = materialise(sized.repartitionByRange(parts, "store", "seq_no").withColumn("_part", F.spark_partition_id()), "parts")
    sums = placed.groupBy("store", "_part").agg(F.sum("bytes").alias("bytes"))
    split = sums.groupBy("store").agg(F.count("*").alias("n")).where("n > 1").select("store")
    # at most two stores of a part go over its ends
    spans = sums.join(split, "store", "left_semi").collect()
    before: dict[tuple[int, int], int] = {}
    run: dict[int, int] = {}
    for r in sorted(spans, key=lambda r: r["_part"]):
        before[r["_part"], r.store] = run.get(r.store, 0)
        run[r.store] = run.get(r.store, 0) + r.bytes

    def pieces(table: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, store, rows in order, ends) of a part, offsets counted within the store."""
        store, seq, size = (table.column(c).to_numpy() for c in ("store", "seq_no", "bytes"))
        if len(size) and size.max() > capacity:
            raise IOFailure(f"a record of {size.max()} bytes exceeds {capacity}")
        part = table.column("_part")[0].as_py()
        order = np.lexsort((seq, store))
        for rows in np.split(order, np.flatnonzero(np.diff(store[order])) + 1):
            s = int(store[rows[0]])
            yield part, s, rows, size[rows].cumsum() + before.get((part, s), 0), size[rows]

    def summary(table: pa.Table) -> pa.Table:
        out = []
        for part, s, _, ends, size in pieces(table):
            if (part, s) not in before:
                continue
            starts = ends - size
            after = np.searchsorted(ends, starts + capacity, "right").tolist()
            n = len(ends)
            last, count = list(range(n)), [1] * n
            for i in range(n - 1, -1, -1):
                if after[i] < n:
                    last[i], count[i] = last[after[i]], count[after[i]] + 1
            first = int(np.searchsorted(ends, starts[0] + capacity, "right"))  # later records can't be the first to start
            for i in range(min(first + 1, n)):
                if out and out[-1][:2] == (part, s) and out[-1][3:] == (int(starts[last[i]]), count[i]):
                    out[-1] = (part, s, int(ends[i]), *out[-1][3:])
                else:
                    out.append((part, s, int(ends[i]), int(starts[last[i]]), count[i]))
        columns = list(zip(*out)) or [()] * 5
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("part", "store", "upto", "last", "bins"), columns)})

    steps: dict[tuple[int, int], list] = {}
    if before:
        for r in placed.groupBy("_part").applyInArrow(summary, "part bigint, store bigint, upto bigint, last bigint, bins bigint").collect():
            steps.setdefault((r.part, r.store), []).append((r.upto, r["last"], r.bins))
    entering: dict[tuple[int, int], tuple[int, int]] = {}
    state: dict[int, tuple[int, int]] = {}
    for part, s in sorted(before):
        opened, bins = entering[part, s] = state.get(s, (-capacity - 1, 0))  # no bin yet: the first record starts one
        for upto, last, n in sorted(steps.get((part, s), [])):
            if upto > opened + capacity:
                opened, bins = last, bins + n
                break
        state[s] = (opened, bins)

    def number(table: pa.Table) -> pa.Table:
        bins = np.zeros(len(table), np.int64)
        for part, s, rows, ends, size in pieces(table):
            opened, n = entering.get((part, s), (-capacity - 1, 0))
            at = 0
            while at < len(ends):
                end = int(np.searchsorted(ends, opened + capacity, "right"))
                bins[rows[at:end]] = n - 1
                if end < len(ends):
                    opened, n = int(ends[end] - size[end]), n + 1
                at = end
        return pa.table({"store": table.column("store"), "seq_no": table.column("seq_no"), "bin": pa.array(bins)})

    return placed.groupBy("_part").applyInArrow(number, "store bigint, seq_no bigint, bin bigint")


def zone_map_candidates(metadata: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, candidates): runs whose key range has the probe. Metadata is one row per run;
    it is broadcast only if its written size allows. Beyond, keys are counted by two
    sorted passes: runs that start at or before the key less those that end before it."""
    asked = probes.select("key").where("key is not null").distinct()
    marks = (
        metadata.select(F.col("min_key").alias("key"), F.lit(0).alias("at"), F.lit(1).alias("n"))
        .unionByName(metadata.select(F.col("max_key").alias("key"), F.lit(2).alias("at"), F.lit(-1).alias("n")))
        .groupBy("key", "at").agg(F.sum("n").alias("n"))
    )
    events = marks.unionByName(asked.select("key", F.lit(1).alias("at"), F.lit(0).cast("bigint").alias("n")))
    return running_sum(events, ["key", "at"], "n").where("at = 1").select("key", F.col("total").alias("candidates"))


def running_sum(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """``total``: the sum of ``value`` over all rows up to this one in a global order.
    Rows are range-partitioned; each partition sums by itself and adds the totals of the
    partitions before it (one number per partition), so no task holds all rows."""
    parts = materialise(
        rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges"
    )
    before = parts.groupBy("_part").agg(F.sum(value).alias("_sum")).withColumn(
        "_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_part", "_before")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.withColumn("_inside", F.sum(value).over(inside))
    # one row per partition: bounded by the number of shuffle partitions
    return summed.join(F.broadcast(before), "_part").withColumn("total", (F.col("_inside") + F.col("_before")).cast("bigint")).drop("_part", "_inside", "_before")


def read_amplification(entries: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, candidates, containing): runs a lookup must consider, and runs that have it."""
    candidates = zone_map_candidates(run_metadata(entries), probes)
    has = entries.groupBy("key").agg(F.count_distinct("run_id").alias("containing"))
    return candidates.join(has, "key", "left").select("key", "candidates", F.coalesce("containing", F.lit(0).cast("bigint")).alias("containing"))


def merge_runs(entries: DataFrame) -> DataFrame:
    """Merge: the newest entry of each key over all given runs, deletes kept."""
    return newest(entries).select("key", "seq_no", "value", "tombstone")


def newest_runs(metadata: DataFrame, n: int) -> DataFrame:
    """The runs that the level-0 trigger merges: the ``n`` newest."""
    return metadata.orderBy(F.desc("run_id")).limit(n).select("run_id")


def merge_invariance(log: DataFrame, entries: DataFrame) -> DataFrame:
    """How many visible rows of the log the merged runs lack, and the reverse."""
    direct = latest_state(log).select("key", F.struct("seq_no", "value").alias("a"))
    merged = merge_runs(entries).where(~F.col("tombstone")).select("key", F.struct("seq_no", "value").alias("b"))
    both = direct.join(merged, "key", "full_outer")
    differ = ~F.col("a").eqNullSafe(F.col("b"))
    return both.agg(
        F.count_if(differ & F.col("a").isNotNull()).alias("only_log"), F.count_if(differ & F.col("b").isNotNull()).alias("only_runs")
    )


def _by_store(runs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Runs with a column ``store_id`` are stores of their own; without, one store."""
    return runs, ["store_id"] if "store_id" in runs.columns else []


def size_tier_pick(runs: DataFrame, fan_in: int = 4, ratio: int = 2) -> DataFrame:
    """(store_id, run_id): the runs that the size-tiered picker takes in each store. Of the
    runs by size, then newest first, the first ``fan_in`` neighbours whose largest is at most
    ``ratio`` times the smallest (rounded up); if there are none, the first ``fan_in`` by
    level, then newest first. Runs are metadata: one row each; a store's are one partition."""
    runs, by = _by_store(runs)
    by_size = Window.partitionBy(*by).orderBy("size", F.desc("run_id"))
    fallback = Window.partitionBy(*by).orderBy("level", F.desc("run_id"))
    whole = Window.partitionBy(*by)
    ranked = (
        runs.withColumn("at", F.row_number().over(by_size)).withColumn("top", F.lead("size", fan_in - 1).over(by_size))
        .withColumn("by_level", F.row_number().over(fallback))
    )
    fits = F.col("top").isNotNull() & (F.ceil(F.col("top") / F.greatest(F.col("size"), F.lit(1))) <= ratio)
    placed = ranked.withColumn("start", F.min(F.when(fits, F.col("at"))).over(whole)).withColumn("total", F.count("*").over(whole))
    picked = F.when(F.col("start").isNotNull(), F.col("at").between(F.col("start"), F.col("start") + fan_in - 1)).otherwise(
        (F.col("by_level") <= fan_in) & (F.col("total") >= fan_in)
    )
    return placed.where(picked).select(*by, "run_id")


def level0_trigger(runs: DataFrame, trigger: int = 8) -> DataFrame:
    """(store_id, run_id): the runs to merge after a flush of each store: the first
    ``trigger`` by level, newest first, if all of them are of level 0; else none."""
    runs, by = _by_store(runs)
    ranked = runs.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("level", F.desc("run_id")))).where(F.col("at") <= trigger)
    full = Window.partitionBy(*by)
    return (
        ranked.withColumn("n", F.count("*").over(full)).withColumn("top", F.max("level").over(full))
        .where((F.col("n") == trigger) & (F.col("top") == 0)).select(*by, "run_id")
    )


def manifest_history(metadata: DataFrame, trigger: int) -> DataFrame:
    """(store_id, epoch, live_runs, max_level) of stores that add their runs in order and,
    whenever ``trigger`` runs of level 0 are there, replace them by one of level 1. Each cycle
    is ``trigger`` additions and one replacement, so epochs follow from the run's place."""
    metadata, by = _by_store(metadata)
    runs = metadata.select(*by, F.dense_rank().over(Window.partitionBy(*by).orderBy("run_id")).cast("bigint").alias("i")).distinct()
    cycle, inside = F.floor((F.col("i") - 1) / trigger), (F.col("i") - 1) % trigger + 1
    top = F.when(cycle > 0, 1).otherwise(0)
    added = runs.select(*by, (cycle * (trigger + 1) + inside).alias("epoch"), (cycle + inside).alias("live_runs"), top.cast("bigint").alias("max_level"))
    merged = runs.where(inside == trigger).select(
        *by, ((cycle + 1) * (trigger + 1)).alias("epoch"), (cycle + 1).alias("live_runs"), F.lit(1).cast("bigint").alias("max_level")
    )
    return added.unionByName(merged).select(*by, *[F.col(c).cast("bigint").alias(c) for c in ("epoch", "live_runs", "max_level")])


def obsolete_runs(all_runs: DataFrame, retained: DataFrame) -> DataFrame:
    """(run_id): runs, or files, that no retained epoch of the manifest names."""
    return all_runs.select("run_id").distinct().join(retained.select("run_id").distinct(), "run_id", "left_anti")


def compaction_throttle(runs: DataFrame, mb_per_s: int) -> DataFrame:
    """(run_id, required_ms): least time in which the bytes may be written."""
    return runs.select("run_id", F.floor(F.col("bytes") * 1000 / F.lit(mb_per_s * 1048576)).cast("bigint").alias("required_ms"))


def floor_seek(blocks: DataFrame, probes: DataFrame) -> DataFrame:
    """(run_id, key, block_no): for each probe, a (run_id, key) row, the last block of the run
    whose first key is at most the key; -1 before the first. Probes and block starts of a run
    are merged in key order once."""
    asked = probes.select("run_id", "key").where("run_id is not null and key is not null").distinct()
    events = blocks.select("run_id", F.col("first_key").alias("key"), F.lit(0).alias("at"), "block_no").unionByName(
        asked.select("run_id", "key", F.lit(1).alias("at"), F.lit(None).cast("bigint").alias("block_no"))
    )
    w = Window.partitionBy("run_id").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("found", F.last("block_no", ignorenulls=True).over(w)).where("at = 1")
        .select("run_id", "key", F.coalesce("found", F.lit(-1).cast("bigint")).alias("block_no"))
    )


def sparse_index(entries: DataFrame, per_block: int) -> DataFrame:
    """(run_id, block_no, first_key) of blocks of ``per_block`` entries in key order."""
    at = F.row_number().over(Window.partitionBy("run_id").orderBy("key")) - 1
    blocks = entries.select("run_id", "key", F.floor(at / per_block).cast("bigint").alias("block_no"))
    return blocks.groupBy("run_id", "block_no").agg(F.min("key").alias("first_key"))


def index_is_sorted(index: DataFrame) -> DataFrame:
    """(run_id, valid): whether the first keys of each run rise strictly."""
    before = F.lag("first_key").over(Window.partitionBy("run_id").orderBy("block_no"))
    checked = index.withColumn("ok", before.isNull() | (before < F.col("first_key")))
    return checked.groupBy("run_id").agg(F.min("ok").alias("valid"))


def pack_blocks(entries: Iterator[tuple[int, int]], block_size: int, refresh_n: int) -> Iterator[int]:
    """The exact packing rule as a fold over (key bytes, value bytes) in key order: yields
    the block of each entry. An entry goes into the open block if what remains holds it,
    the restart points so far, its own restart point if one is due, and the trailer."""
    block, remaining, count, restarts = -1, 0, 0, 0
    for k, v in entries:
        need = ENTRY_OVERHEAD + k + v
        extra = 8 + k if count % refresh_n == 0 else 0
        if remaining < need + restarts + extra + 12:
            block, remaining, count, restarts, extra = block + 1, block_size, 0, 0, 8 + k
            if remaining < need + extra + 12:
                raise IOFailure(f"an entry of {k + v} bytes doesn't fit a block of {block_size}")
        restarts += extra
        remaining -= RUN_ENTRY_OVERHEAD + k + v
        count += 1
        yield block


def block_layout(entries: DataFrame, block_size: int, refresh_n: int) -> DataFrame:
    """(run_id, blocks, data_bytes): runs packed by the exact rule, runs in parallel; only
    sizes are moved, in key order."""
    sized = entries.select(
        "run_id", "key", F.octet_length("key").alias("k"),
        F.when(F.col("tombstone"), 0).otherwise(F.coalesce(F.octet_length("value"), F.lit(0))).alias("v"),
    ).repartition("run_id").sortWithinPartitions("run_id", "key").drop("key")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, feed, packed, blocks, total = None, [], None, 0, 0

        def source() -> Iterator[tuple[int, int]]:
            while True:
                yield feed.pop()

        for pdf in batches:
            done = []
            for r, k, v in zip(pdf["run_id"], pdf["k"], pdf["v"]):
                if r != current:
                    if current is not None:
                        done.append((current, blocks, total))
                    current, packed, total = r, pack_blocks(source(), block_size, refresh_n), 0
                feed.append((k, v))
                blocks = next(packed) + 1
                total += RUN_ENTRY_OVERHEAD + k + v
            if done:
                yield pd.DataFrame(done, columns=["run_id", "blocks", "data_bytes"])
        if current is not None:
            yield pd.DataFrame([(current, blocks, total)], columns=["run_id", "blocks", "data_bytes"])

    return sized.mapInPandas(fold, "run_id bigint, blocks bigint, data_bytes bigint")
