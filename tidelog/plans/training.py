"""Queries of the general training-data operators (problems 1, 2 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.changes import BucketedTable
from tidelog.operators.compaction import BLOCK, Compactor, live_small, resolve_runs
from tidelog.operators.incremental import CommitLog, IncrementalReader, last_success
from tidelog.operators.joins import lookup_join
from tidelog.sources.tables import table
from tidelog.storage.workspace import new_folder


#: Batches in which the feed is applied, cut by delivery number.
BATCHES = 2


def _applied(spark: SparkSession, sf_dir: str) -> BucketedTable:
    """The table after the whole feed was applied batch by batch."""
    log = table(spark, sf_dir, "mutation_log")
    low, high = log.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    target = BucketedTable(spark, new_folder(spark, "changes"))
    step = ((high or 0) - (low or 0)) // BATCHES + 1
    for i in range(BATCHES):
        start = (low or 0) + i * step
        target.apply(log.where(F.col("delivery_id").between(start, start + step - 1)), f"batch-{i}")
    return target


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, sf_dir).state().select("store_id", "key", "seq_no")


def p1_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible value of every key."""
    return _applied(spark, sf_dir).state().select("store_id", "key", "seq_no", "value")


def p1_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table built by one batch."""
    target = BucketedTable(spark, new_folder(spark, "changes"))
    target.apply(table(spark, sf_dir, "mutation_log"), "all")
    return target.state().select("store_id", "key", "seq_no", "value")


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[Compactor, DataFrame, DataFrame]:
    runs, entries = resolve_runs(table(spark, sf_dir, "table_handles")), table(spark, sf_dir, "run_entries")
    return Compactor(spark, new_folder(spark, "compaction")).compact(runs, entries), runs, entries


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that the committed compaction took as inputs."""
    return _compacted(spark, sf_dir)[0].inputs()


def p2_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs as they are: every entry of every output, with all its fields."""
    return _compacted(spark, sf_dir)[0].rewritten()


def p2_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct entries on disk after the compaction."""
    compactor, runs, entries = _compacted(spark, sf_dir)
    return compactor.entries(runs, entries).groupBy("store_id", "key", "seq_no").agg(F.max("value").alias("value"))


def p2_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per store with small runs: their number, bytes and entries, bytes and entries of the
    outputs, and whether these fill their blocks (none but one is below a block, and there
    are no more than blocks are full, and one)."""
    compactor, runs, entries = _compacted(spark, sf_dir)
    small = runs.where(live_small(runs)).select("run_id", "store_id", "bytes")
    before = small.groupBy("store_id").agg(F.count("*").alias("runs_before"), F.sum("bytes").alias("bytes_before"))
    alone = compactor.current().where("run_id = out_run_id").select("run_id").join(small, "run_id").select("store_id", F.col("run_id").alias("out_run_id"), "bytes")
    after = compactor.outputs().select("store_id", "out_run_id", "bytes").unionByName(alone).groupBy("store_id").agg(
        F.sum("bytes").alias("bytes_after"), F.count_if(F.col("bytes") < BLOCK).alias("below"), F.count("*").alias("runs_after")
    )
    taken = compactor.current().select("out_run_id").distinct()
    kinds = lambda rows: rows.select("store_id", "key", "seq_no").distinct().groupBy("store_id").agg(F.count("*").alias("n"))
    held = kinds(lookup_join(entries.select("run_id", "store_id", "key", "seq_no"), small.select("run_id"), ["run_id"], "left_semi", name="small"))
    kept = kinds(lookup_join(compactor.entries(runs, entries), taken, ["out_run_id"], "left_semi", name="taken"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return (
        before.join(after, "store_id", "left")
        .join(held.withColumnRenamed("n", "entries_before"), "store_id", "left").join(kept.withColumnRenamed("n", "entries_after"), "store_id", "left")
        .select("store_id", "runs_before", "bytes_before", "bytes_after", zero("entries_before").alias("entries_before"), zero("entries_after").alias("entries_after"),
                ((F.col("below") <= 1) & (F.col("runs_after") <= F.floor(F.col("bytes_before") / BLOCK) + 1)).alias("filled"))
    )


def _runs_of_two(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """What two runs put out: the deliveries of the earlier half of the time are committed
    before the first, the others, and those without a time, before the second."""
    log = CommitLog(spark, new_folder(spark, "commits"))
    reader = IncrementalReader(spark, new_folder(spark, "incremental"), log)
    reader.seed(last_success(table(spark, sf_dir, "flush_attempts")))
    rows = table(spark, sf_dir, "mutation_log").select("store_id", "seq_no", "arrived_at")
    low, high = rows.agg(F.min("arrived_at"), F.max("arrived_at")).first()
    early = F.lit(False) if low is None else F.coalesce(F.col("arrived_at") <= F.lit(str(low + (high - low) // 2)).cast("timestamp_ntz"), F.lit(False))
    out = []
    for i, part in enumerate((early, ~early)):
        log.append(rows.where(part), f"part-{i}")
        out.append(reader.run().select("store_id", "seq_no"))
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = _runs_of_two(spark, sf_dir)
    return first.unionByName(second)


def p5_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the second run alone puts out."""
    return _runs_of_two(spark, sf_dir)[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_state, p1_at_once, p2_found, p2_rewritten, p2_entries, p2_outputs, p5_found, p5_second_run)}

_MUTATIONS = """m as (select store_id, seq_no, max(key) as key, bool_or(tombstone) as tombstone, max(value) as value
  from mutation_log where store_id is not null and seq_no is not null group by store_id, seq_no),
n as (select *, row_number() over (partition by store_id, key order by seq_no desc) as r from m where key is not null)"""

_RUNS = r"""a as (select *, regexp_matches(lower(trim(file_name)), '\.sst$') as pub from table_handles),
r as (select run_id, max(case when pub and file_size > 0 then file_size end) as bytes, bool_or(removed_at is not null) as gone,
  max(case when pub then store_id end) as store_id
  from a group by run_id having bool_or(pub))"""

_UNCOVERED = """l as (select attempt_id, max(store_id) as store_id, max(started_at) as started_at,
  arg_max(coalesce(lower(trim(status)), ''), logged_at) as status from flush_attempts group by attempt_id),
w as (select store_id, max(started_at) as mark from l where status = 'succeeded' group by store_id),
m as (select store_id, seq_no, min(arrived_at) as at from mutation_log group by store_id, seq_no),
u as (select m.store_id, m.seq_no, m.at from m left join w on m.store_id = w.store_id where w.mark is null or m.at > w.mark)"""

ORACLE = {
    "p1_found": f"with {_MUTATIONS} select store_id, key, seq_no from n where r = 1 and not tombstone",
    "p1_state": f"with {_MUTATIONS} select store_id, key, seq_no, value from n where r = 1 and not tombstone",
    "p1_at_once": f"with {_MUTATIONS} select store_id, key, seq_no, value from n where r = 1 and not tombstone",
    "p2_found": f"with {_RUNS} select run_id from r where not gone and bytes < 4096",
    "p2_entries": f"""with {_RUNS} select e.store_id, e.key, e.seq_no, max(e.value) as value
      from run_entries e join r on e.run_id = r.run_id and not r.gone group by e.store_id, e.key, e.seq_no""",
    "p2_outputs": f"""with {_RUNS}, s as (select * from r where not gone and bytes < 4096),
      b as (select store_id, count(*) as runs_before, cast(sum(bytes) as bigint) as bytes_before from s group by store_id),
      d as (select store_id, count(*) as n from (select distinct e.store_id, e.key, e.seq_no from run_entries e join s on e.run_id = s.run_id) group by store_id)
      select b.store_id, runs_before, bytes_before, bytes_before as bytes_after, coalesce(n, 0) as entries_before, coalesce(n, 0) as entries_after,
      true as filled from b left join d on b.store_id = d.store_id""",
    "p5_found": f"with {_UNCOVERED} select store_id, seq_no from u",
    "p5_second_run": f"""with {_UNCOVERED}, c as (select make_timestamp((epoch_us(min(arrived_at)) + epoch_us(max(arrived_at))) // 2) as cut from mutation_log)
      select store_id, seq_no from u, c where u.at is null or u.at > cut""",
}
