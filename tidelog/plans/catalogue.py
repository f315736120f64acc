"""Queries of the mutation-log engine, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.checksum import crc32c_column
from tidelog.model import Config, bloom_parameters
from tidelog.operators import bloom, runs, state, wal
from tidelog.sources import native
from tidelog.sources.logs import events_shard, events_user, orders_cust
from tidelog.sources.tables import table
from tidelog.storage.workspace import new_folder

RUN = 500  # mutations of a fixed run
BITS, HASHES = bloom_parameters(0.01)
PER_BLOCK = 16  # entries of a block in the sparse index
SEGMENT = 1000  # records of a log segment in the recovery queries
MEMTABLE = 4096  # bytes of a memtable in the exact cut
ROLL = 8192  # bytes of a segment in the exact roll

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_SHARD = """l as (select event_id + 1 as seq_no, concat('u:', user_id, ':', event_id % 7) as key, props as value,
  event_type = 'error' as tombstone from events)"""
_USER = """l as (select event_id + 1 as seq_no, concat('u:', user_id) as key, props as value,
  event_type = 'error' as tombstone from events)"""
_CUST = """l as (select o_orderkey + 1 as seq_no, concat('c:', o_custkey) as key, o_orderpriority as value,
  o_orderstatus = 'F' as tombstone from orders)"""
_NEWEST = "n as (select *, row_number() over (partition by key order by seq_no desc) as r from l)"
_FLUSHED = f"""q as (select cast(floor((seq_no - 1) / {RUN}) as bigint) as run_id, * from l),
e as (select * from (select *, row_number() over (partition by run_id, key order by seq_no desc) as r from q) where r = 1)"""
_ENTRY = "17 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)"
_META = f"""d as (select run_id, count(*) as entry_count, min(key) as min_key, max(key) as max_key, min(seq_no) as min_seq_no,
  max(seq_no) as max_seq_no, cast(sum({_ENTRY}) as bigint) as data_bytes from e group by run_id)"""


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flush(events_shard(spark, sf_dir), runs.fixed_run_id(RUN))


@query(f"with {_SHARD}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone")
def q01_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(events_shard(spark, sf_dir))


@query(f"with {_USER}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone")
def q01_latest_state_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(events_user(spark, sf_dir))


@query(f"with {_CUST}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone")
def q01_latest_state_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(orders_cust(spark, sf_dir))


@query(f"with {_USER}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone and key = 'u:1'")
def q02_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.point_get(events_user(spark, sf_dir), "u:1")


_PROBES = """p as (select distinct concat('u:', user_id + 1, ':', event_id % 9) as key from events union select '' union select 'none')"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "events").select(
        F.concat(F.lit("u:"), (F.col("user_id") + 1).cast("string"), F.lit(":"), (F.col("event_id") % 9).cast("string")).alias("key")
    )
    return keys.distinct().union(spark.createDataFrame([("",), ("none",)], "key string"))


@query(f"""with {_SHARD}, {_NEWEST}, {_PROBES} select p.key,
  case when p.key = '' then 'invalid_argument' when n.key is null then 'not_found' else 'ok' end as status, n.value
  from p left join (select * from n where r = 1 and not tombstone) n on p.key = n.key""")
def q03_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.multi_get(events_shard(spark, sf_dir), _probes(spark, sf_dir))


@query(f"with {_SHARD}, {_NEWEST} select key, seq_no from n where r = 1 and tombstone")
def q04_tombstoned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.tombstoned_keys(events_shard(spark, sf_dir))


@query(f"""with {_SHARD} select key, count(*) as versions, count(*) filter (where tombstone) as deletes,
  min(seq_no) as first_seq, max(seq_no) as last_seq from l group by key""")
def q05_key_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.key_history(events_shard(spark, sf_dir))


@query(f"""with {_SHARD}, n as (select *, row_number() over (partition by key order by seq_no desc) as r from l where seq_no <= 700)
  select key, seq_no, value from n where r = 1 and not tombstone""")
def q06_state_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_as_of(events_shard(spark, sf_dir), 700)


@query(f"""with {_SHARD}, n as (select *, row_number() over (partition by key order by seq_no desc) as r from l
  where seq_no <= (select max(seq_no) // 2 from l)) select key, seq_no, value from n where r = 1 and not tombstone""")
def q06_state_at_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state at the middle of the numbers, which moves with the table."""
    log = events_shard(spark, sf_dir)
    return state.state_as_of(log, (log.agg(F.max("seq_no")).first()[0] or 0) // 2)


@query(f"""with {_SHARD}, s as (select case when octet_length(encode(key)) = 0 then 'empty_key'
  when octet_length(encode(key)) > 6 then 'key_too_long' when tombstone then 'ok' when value is null then 'null_value'
  when octet_length(encode(value)) > 12 then 'value_too_long' else 'ok' end as status from l)
  select status, count(*) as n from s group by status""")
def q07_validate_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.validate(events_shard(spark, sf_dir), 6, 12)


@query(f"""with {_SHARD}, d as (select case seq_no % 11 when 0 then null when 1 then '' else key end as key,
    case seq_no % 11 when 2 then null when 3 then concat(value, value, value) else value end as value, tombstone from l),
  s as (select case when key is null then 'null_key' when octet_length(encode(key)) = 0 then 'empty_key'
  when octet_length(encode(key)) > 6 then 'key_too_long' when tombstone then 'ok' when value is null then 'null_value'
  when octet_length(encode(value)) > 12 then 'value_too_long' else 'ok' end as status from d)
  select status, count(*) as n from s group by status""")
def q07_validate_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with every kind of bad mutation among them."""
    kind = F.col("seq_no") % 11
    log = events_shard(spark, sf_dir).withColumn("key", F.when(kind == 1, "").when(kind != 0, F.col("key"))).withColumn(
        "value", F.when(kind == 3, F.concat("value", "value", "value")).when(kind != 2, F.col("value"))
    )
    return state.validate(log, 6, 12)


@query(f"""with {_SHARD}, {_FLUSHED}, {_META}, top as (select max(run_id) as last from q),
  a as (select key, octet_length(encode(key)) as k, coalesce(octet_length(encode(value)), 0) as v from e, top where run_id = last)
  select (select max(seq_no) from l) as last_seqno, (select count(*) from a) as active_entries,
  (select cast(sum(41 + k + v) as bigint) from a) as active_bytes,
  (select count(*) from d, top where run_id < last) as live_runs,
  (select cast(coalesce(sum(data_bytes), 0) as bigint) from d, top where run_id < last) as live_bytes""")
def q08_store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a store whose last, open run is the active table."""
    entries = flushed(spark, sf_dir)
    size = (F.lit(41) + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).cast("bigint")
    per_run = entries.groupBy("run_id").agg(
        F.count("*").alias("n"), F.sum(size).alias("held"), F.sum(runs.data_bytes().cast("bigint")).alias("bytes"), F.max("seq_no").alias("seq")
    )
    last = F.max(F.struct("run_id", "n", "held"))
    return per_run.agg(
        F.max("seq").alias("last_seqno"), last.alias("t"), F.count("*").alias("c"), F.sum("bytes").alias("b"),
        F.max(F.struct("run_id", "bytes")).alias("tb"),
    ).select(
        "last_seqno", F.col("t.n").alias("active_entries"), F.col("t.held").alias("active_bytes"),
        (F.col("c") - 1).alias("live_runs"), (F.col("b") - F.col("tb.bytes")).alias("live_bytes"),
    )


@query(f"with {_SHARD}, {_FLUSHED} select run_id, key, seq_no, value, tombstone from e")
def q09_flush_runs_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flushed(spark, sf_dir)


@query(f"with {_SHARD}, {_FLUSHED}, {_META} select * from d")
def q10_list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_metadata(flushed(spark, sf_dir))


def _own_keys(log: DataFrame) -> DataFrame:
    """The log with a key of its own for every mutation, so nothing is overwritten."""
    return log.withColumn("key", F.concat("key", F.lit("#"), F.col("seq_no").cast("string")))


@query(f"""with recursive {_SHARD}, z as (select seq_no, 41 + octet_length(encode(concat(key, '#', seq_no)))
    + case when tombstone then 0 else coalesce(octet_length(encode(value)), 0) end as n from l),
  c(seq_no, run_id, total, sealed) as (
    select seq_no, cast(0 as bigint), n, n = {MEMTABLE} from z where seq_no = 1
    union all
    select z.seq_no,
      case when c.sealed or c.total + z.n > {MEMTABLE} then c.run_id + 1 else c.run_id end,
      case when c.sealed or c.total + z.n > {MEMTABLE} then z.n else c.total + z.n end,
      case when c.sealed or c.total + z.n > {MEMTABLE} then z.n = {MEMTABLE} else c.total + z.n = {MEMTABLE} end
    from c join z on z.seq_no = c.seq_no + 1)
  select seq_no, run_id from c""")
def q11_run_cut_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cut_exact(_own_keys(events_shard(spark, sf_dir)), MEMTABLE, overwrites=False).select("seq_no", "run_id")


@query(f"""with recursive {_SHARD}, z as (select (seq_no - 1) % 7 as store, seq_no, key, 41 + octet_length(encode(key))
    + case when tombstone then 0 else coalesce(octet_length(encode(value)), 0) end as n from l),
  w as (select *, row_number() over (partition by store order by seq_no) as i from z),
  x as (select *, lag(i) over (partition by store, key order by seq_no) as before, lag(n) over (partition by store, key order by seq_no) as held from w),
  c(store, i, seq_no, run_id, start, total, sealed) as (
    select store, i, seq_no, cast(0 as bigint), i, n, n = {MEMTABLE} from x where i = 1
    union all
    select x.store, x.i, x.seq_no,
      case when c.sealed or c.total + x.n > {MEMTABLE} then c.run_id + 1 else c.run_id end,
      case when c.sealed or c.total + x.n > {MEMTABLE} then x.i else c.start end,
      case when c.sealed or c.total + x.n > {MEMTABLE} then x.n else c.total + x.n - case when x.before >= c.start then x.held else 0 end end,
      case when c.sealed or c.total + x.n > {MEMTABLE} then x.n = {MEMTABLE} else c.total + x.n = {MEMTABLE} end
    from c join x on x.store = c.store and x.i = c.i + 1)
  select store, seq_no, run_id from c""")
def q11_run_cut_overwrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact cut with overwritten keys, one store per shard of the key."""
    log = events_shard(spark, sf_dir).withColumn("shard", F.substring_index("key", ":", -1).cast("bigint"))
    return runs.cut_exact(log, MEMTABLE, "shard")


@query(f"""with {_SHARD}, {_FLUSHED}, {_META}, p as (select distinct key from l)
  select p.key, count(*) as candidates from p join d on p.key between d.min_key and d.max_key group by p.key""")
def q12_zone_map_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.zone_map_candidates(runs.run_metadata(flushed(spark, sf_dir)), events_shard(spark, sf_dir))


@query(f"""with {_SHARD}, {_FLUSHED}, {_META}, p as (select distinct key from l),
  c as (select p.key, count(*) as candidates from p join d on p.key between d.min_key and d.max_key group by p.key)
  select c.key, c.candidates, (select count(*) from e where e.key = c.key) as containing from c""")
def q13_read_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.read_amplification(flushed(spark, sf_dir), events_shard(spark, sf_dir))


@query(f"""with {_SHARD}, {_FLUSHED}, top as (select distinct run_id from e order by run_id desc limit 8),
  m as (select *, row_number() over (partition by key order by seq_no desc) as w from e where run_id in (select run_id from top))
  select key, seq_no, value, tombstone from m where w = 1""")
def q14_merge_newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = flushed(spark, sf_dir)
    # eight rows
    top = runs.newest_runs(entries.select("run_id").distinct(), 8)
    return runs.merge_runs(entries.join(F.broadcast(top), "run_id", "left_semi"))


@query("select cast(0 as bigint) as only_log, cast(0 as bigint) as only_runs")
def q15_merge_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.merge_invariance(events_shard(spark, sf_dir), flushed(spark, sf_dir))


@query(f"""with {_SHARD}, {_NEWEST}, {_FLUSHED}, kept as (select * from e where run_id % 3 <> 1),
  m as (select *, row_number() over (partition by key order by seq_no desc) as w from kept),
  a as (select key, seq_no, value from n where r = 1 and not tombstone), b as (select key, seq_no, value from m where w = 1 and not tombstone)
  select (select count(*) from (select * from a except select * from b)) as only_log, (select count(*) from (select * from b except select * from a)) as only_runs""")
def q15_merge_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same comparison where a third of the runs is lost."""
    return runs.merge_invariance(events_shard(spark, sf_dir), flushed(spark, sf_dir).where("run_id % 3 <> 1"))


_SIZED = f"""with {_SHARD}, {_FLUSHED}, {_META}, s as (select run_id, data_bytes as size, cast(0 as bigint) as level from d)"""


@query(f"""{_SIZED}, o as (select *, row_number() over (order by size, run_id desc) as pos,
    lead(size, 3) over (order by size, run_id desc) as top from s),
  f as (select min(pos) as start from o where top is not null and ceil(top / size) <= 2)
  select run_id from o, f where pos between start and start + 3""")
def q16_size_tier_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = runs.run_metadata(flushed(spark, sf_dir))
    return runs.size_tier_pick(metadata.select("run_id", F.col("data_bytes").alias("size"), F.lit(0).alias("level")))


@query(f"""{_SIZED}, o as (select *, row_number() over (order by level, run_id desc) as pos from s)
  select run_id from o where pos <= 8 and (select count(*) from o) >= 8""")
def q16_level0_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = runs.run_metadata(flushed(spark, sf_dir))
    return runs.level0_trigger(metadata.select("run_id", F.lit(0).alias("level")), 8)


_HANDLES = r"""a as (select *, regexp_matches(lower(trim(file_name)), '\.sst$') as pub from table_handles),
r as (select run_id, max(case when pub and file_size > 0 then file_size end) as size, bool_or(removed_at is not null) as gone,
  max(case when pub then store_id end) as store_id, max(case when pub and level >= 0 then level end) as level from a group by run_id having bool_or(pub)),
s as (select store_id, run_id, size, coalesce(level, 0) as level from r where not gone and size is not null and store_id is not null)"""


def _stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live runs of all stores of the listings."""
    from tidelog.operators.compaction import resolve_runs

    held = resolve_runs(table(spark, sf_dir, "table_handles")).where("not removed and bytes is not null and store_id is not null")
    return held.select("store_id", "run_id", F.col("bytes").alias("size"), F.coalesce("level", F.lit(0)).alias("level"))


@query(f"""with {_HANDLES}, o as (select *, row_number() over (partition by store_id order by size, run_id desc) as pos,
    lead(size, 3) over (partition by store_id order by size, run_id desc) as top,
    row_number() over (partition by store_id order by level, run_id desc) as lv, count(*) over (partition by store_id) as n from s),
  f as (select *, min(case when top is not null and ceil(top / size) <= 2 then pos end) over (partition by store_id) as start from o)
  select store_id, run_id from f where case when start is not null then pos between start and start + 3 else lv <= 4 and n >= 4 end""")
def q16_size_tier_pick_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picker in every store, with its fallback by level."""
    return runs.size_tier_pick(_stores(spark, sf_dir))


@query(f"""with {_HANDLES}, o as (select *, row_number() over (partition by store_id order by level, run_id desc) as pos from s),
  g as (select store_id from o where pos <= 3 group by store_id having count(*) = 3 and max(level) = 0)
  select o.store_id, o.run_id from o join g on o.store_id = g.store_id where pos <= 3""")
def q16_level0_trigger_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.level0_trigger(_stores(spark, sf_dir), 3)


@query(f"""with recursive {_HANDLES}, t as (select store_id, count(distinct run_id) as runs from s group by store_id),
  m(store_id, epoch, added, fresh, merged) as (
    select store_id, cast(1 as bigint), cast(1 as bigint), cast(1 as bigint), cast(0 as bigint) from t
    union all
    select m.store_id, epoch + 1, case when fresh = 3 then added else added + 1 end,
      case when fresh = 3 then 0 else fresh + 1 end, case when fresh = 3 then merged + 1 else merged end
    from m join t on m.store_id = t.store_id where fresh = 3 or added < runs)
  select store_id, epoch, fresh + merged as live_runs, cast(case when merged > 0 then 1 else 0 end as bigint) as max_level from m""")
def q17_manifest_history_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.manifest_history(_stores(spark, sf_dir).select("store_id", "run_id"), 3)


@query(f"""with recursive {_SHARD}, t as (select count(distinct floor((seq_no - 1) / {RUN})) as runs from l),
  m(epoch, added, fresh, merged) as (
    select cast(1 as bigint), cast(1 as bigint), cast(1 as bigint), cast(0 as bigint)
    union all
    select epoch + 1, case when fresh = 8 then added else added + 1 end,
      case when fresh = 8 then 0 else fresh + 1 end, case when fresh = 8 then merged + 1 else merged end
    from m, t where fresh = 8 or added < runs)
  select epoch, fresh + merged as live_runs, cast(case when merged > 0 then 1 else 0 end as bigint) as max_level from m""")
def q17_manifest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events_shard(spark, sf_dir).select(runs.fixed_run_id(RUN).alias("run_id")).distinct()
    return runs.manifest_history(ids, 8)


@query(f"""with {_SHARD}, {_FLUSHED}, x as (select distinct run_id from e)
  select run_id from x where run_id not in (select run_id from x order by run_id desc limit 8)""")
def q18_obsolete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = events_shard(spark, sf_dir).select(runs.fixed_run_id(RUN).alias("run_id")).distinct()
    return runs.obsolete_runs(ids, runs.newest_runs(ids, 8))


@query(r"""select distinct h.run_id from table_handles h
  where not exists (select 1 from table_handles p where p.run_id = h.run_id and regexp_matches(lower(trim(p.file_name)), '\.sst$'))""")
def q18_orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of which only temporary files are listed."""
    from tidelog.operators.compaction import published

    handles = table(spark, sf_dir, "table_handles").where("run_id is not null")
    return handles.groupBy("run_id").agg(F.max(published()).alias("p")).where("not p").select("run_id")


@query("""with f as (select unnest([0.1, 0.01, 0.001]) as false_positive)
  select cast(false_positive as double) as false_positive, cast(ceil(-ln(false_positive) / power(ln(2), 2)) as bigint) as bits_per_key,
  cast(round(ceil(-ln(false_positive) / power(ln(2), 2)) * ln(2)) as bigint) as hash_count from f""")
def q19_bloom_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([(0.1,), (0.01,), (0.001,)], "false_positive double")
    bits = F.ceil(-F.log("false_positive") / F.pow(F.log(F.lit(2.0)), F.lit(2)))
    return rates.select("false_positive", bits.cast("bigint").alias("bits_per_key"), F.round(bits * F.log(F.lit(2.0))).cast("bigint").alias("hash_count"))


def _poly(base: int, m: str) -> str:
    byte = "(cast(concat('0x', substr(hex(encode(key)), cast(2 * i + 1 as int), 2)) as bigint) + 128) % 256"
    return (
        f"list_reduce(list_concat([cast(0 as bigint)], list_transform(range(octet_length(encode(key))), lambda i: {byte})), "
        f"lambda h, b: (h * {base} + b) % {m})"
    )


@query(f"with {_SHARD}, k as (select distinct key from l) select key, {_poly(257, '3920')} as h1, {_poly(263, '3920')} as h2 from k")
def q20_bloom_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events_shard(spark, sf_dir).select("key").distinct()
    return bloom.hashes(keys.withColumn("m", F.lit(3920).cast("bigint"))).select("key", "h1", "h2")


_BITS = f"""s as (select run_id, cast(ceil(count(*) * {BITS} / 8) * 8 as bigint) as m from e group by run_id),
h as (select e.run_id, key, m, {_poly(257, 'm')} as h1, {_poly(263, 'm')} as h2 from e join s on e.run_id = s.run_id),
b as (select distinct run_id, (h1 + i * greatest(1, h2)) % m as bit from h, range(1, {HASHES + 1}) t(i))"""


@query(f"""with {_SHARD}, {_FLUSHED}, {_BITS} select s.run_id, s.m, count(*) as bits_set from s join b on s.run_id = b.run_id group by s.run_id, s.m""")
def q21_bloom_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.fill(flushed(spark, sf_dir), BITS, HASHES)


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key against the run after its newest mutation's: what a lookup asks first."""
    newest = state.newest(events_shard(spark, sf_dir)).select("key", runs.fixed_run_id(RUN).alias("own"))
    return newest.select(F.explode(F.array(F.col("own"), F.greatest(F.col("own") - 1, F.lit(0)))).alias("run_id"), "key").distinct()


_NEAR = f"""w as (select key, cast(floor((max(seq_no) - 1) / {RUN}) as bigint) as own from l group by key),
k as (select own as run_id, key from w union select greatest(own - 1, 0), key from w),
a as (select s.run_id, k.key, m, {_poly(257, 'm')} as h1, {_poly(263, 'm')} as h2 from k join s on k.run_id = s.run_id),
g as (select a.run_id, a.key, bool_and(b.bit is not null) as maybe from a cross join range(1, {HASHES + 1}) t(i)
  left join b on b.run_id = a.run_id and b.bit = (h1 + i * greatest(1, h2)) % m group by a.run_id, a.key)"""


@query(f"with {_SHARD}, {_FLUSHED}, {_BITS}, {_NEAR} select run_id, key, maybe from g")
def q22_bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = bloom.packed_filters(flushed(spark, sf_dir), BITS, HASHES)
    return bloom.probe(filters, _asked(spark, sf_dir), HASHES)


@query(f"""with {_SHARD}, {_FLUSHED}, {_BITS}, {_NEAR}
  select g.run_id, count(*) as checked, count(*) filter (where not maybe) as negatives,
  count(*) filter (where maybe and e.key is null) as false_positives, count(*) filter (where not maybe and e.key is not null) as false_negatives
  from g left join e on g.run_id = e.run_id and g.key = e.key group by g.run_id""")
def q23_bloom_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom.effect(flushed(spark, sf_dir), _asked(spark, sf_dir), BITS, HASHES)


_INDEX = f"""x as (select *, cast(floor((row_number() over (partition by run_id order by key) - 1) / {PER_BLOCK}) as bigint) as block_no from e),
i as (select run_id, block_no, min(key) as first_key from x group by run_id, block_no)"""


@query(f"with {_SHARD}, {_FLUSHED}, {_INDEX} select run_id, block_no, first_key from i")
def q24_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.sparse_index(flushed(spark, sf_dir), PER_BLOCK)


@query(f"with {_SHARD}, {_FLUSHED}, {_INDEX} select run_id, true as valid from i group by run_id")
def q24_index_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.index_is_sorted(runs.sparse_index(flushed(spark, sf_dir), PER_BLOCK))


@query(f"""with {_SHARD}, {_FLUSHED}, {_INDEX}, d as (select run_id, block_no, case when run_id % 2 = 1 and block_no = 3 then 'u:' else first_key end as first_key from i),
  o as (select *, lag(first_key) over (partition by run_id order by block_no) as before from d)
  select run_id, bool_and(before is null or before < first_key) as valid from o group by run_id""")
def q24_damaged_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other run has one block start out of order."""
    index = runs.sparse_index(flushed(spark, sf_dir), PER_BLOCK)
    damaged = (F.col("run_id") % 2 == 1) & (F.col("block_no") == 3)
    return runs.index_is_sorted(index.withColumn("first_key", F.when(damaged, "u:").otherwise(F.col("first_key"))))


@query(f"""with {_SHARD}, {_FLUSHED}, {_INDEX}, w as (select key, cast(floor((max(seq_no) - 1) / {RUN}) as bigint) as own from l group by key),
  p as (select own as run_id, key from w union select greatest(own - 1, 0), key from w)
  select p.run_id, p.key, coalesce(max(i.block_no), -1) as block_no from p
  left join i on i.run_id = p.run_id and i.first_key <= p.key group by p.run_id, p.key""")
def q25_floor_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block of each key in the run of its newest mutation and in the one before."""
    index = runs.sparse_index(flushed(spark, sf_dir), PER_BLOCK)
    return runs.floor_seek(index, _asked(spark, sf_dir))


@query("""with t as (select event_type, event_id as pos, user_id % 40 as block from events),
  p as (select *, lag(pos) over (partition by event_type, block order by pos) as before, lead(pos) over (partition by event_type, block order by pos) as later from t),
  d as (select a.pos, count(b.pos) as others from p a left join p b on b.event_type = a.event_type and b.pos > a.before and b.pos < a.pos and (b.later is null or b.later >= a.pos)
    where a.before is not null group by a.pos)
  select p.pos as "at", cast(p.block as bigint) as block, p.before is not null and d.others < 16 as hit from p left join d on p.pos = d.pos""")
def q26_block_cache_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of an LRU cache of 16 blocks, one trace per event type."""
    events = table(spark, sf_dir, "events")
    return wal.cache_hits(
        events.select(F.abs(F.hash("event_type")).alias("trace"), F.col("event_id").alias("at"), (F.col("user_id") % 40).cast("bigint").alias("block")), 16
    )


_BYTES = "25 + octet_length(encode(key)) + case when tombstone then 0 else coalesce(octet_length(encode(value)), 0) end"


@query(f"""with {_SHARD}, z as (select seq_no, cast({_BYTES} as bigint) as bytes from l)
  select seq_no, bytes, cast(8 + sum(bytes) over (order by seq_no) as bigint) as end_offset from z""")
def q27_wal_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.offsets(events_shard(spark, sf_dir))


@query(f"""with recursive {_SHARD}, z as (select seq_no, cast({_BYTES} as bigint) as n from l),
  c(seq_no, segment_id, used) as (
    select seq_no, cast(0 as bigint), 8 + n from z where seq_no = 1
    union all
    select z.seq_no, case when c.used + z.n > {ROLL} then c.segment_id + 1 else c.segment_id end,
      case when c.used + z.n > {ROLL} then 8 + z.n else c.used + z.n end from c join z on z.seq_no = c.seq_no + 1)
  select seq_no, segment_id from c""")
def q28_wal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.segments(events_shard(spark, sf_dir), ROLL).select("seq_no", "segment_id")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in segments of 1000 records, as stored records. Damaged are the length of
    record 700 in the segments 2 and 9, and one byte of the body of record 500 in segment 4;
    checksums are those of the bytes as written and as they are now."""
    log = events_shard(spark, sf_dir)
    value = F.when(F.col("tombstone"), F.lit("")).otherwise(F.coalesce("value", F.lit("")))
    segment, at = F.floor((F.col("seq_no") - 1) / SEGMENT).cast("bigint"), (F.col("seq_no") - 1) % SEGMENT
    wrong_length = segment.isin(2, 9) & (at == 700)
    wrong_body = (segment == 4) & (at == 500)
    number = lambda n, width: F.unhex(F.lpad(F.hex(n), width, "0"))
    kind, key = F.when(F.col("tombstone"), 2).otherwise(1), F.encode("key", "UTF-8")
    body = F.concat(
        number(kind, 2), number(F.col("seq_no"), 16), number(F.octet_length("key"), 8), number(F.octet_length(value), 8), key, F.encode(value, "UTF-8")
    )
    now = F.when(wrong_body, F.concat(F.expr("substring(body, 1, octet_length(body) - 1)"), F.unhex(F.lit("00")))).otherwise(F.col("body"))
    return log.withColumn("body", body).select(
        "seq_no", "key", "value", "tombstone", segment.alias("segment_id"), at.alias("at"),
        F.octet_length("key").alias("key_len"), F.octet_length(value).alias("value_len"),
        (17 + F.octet_length("key") + F.octet_length(value) + F.when(wrong_length, 3).otherwise(0)).alias("length"),
        kind.alias("type"), crc32c_column(F.col("body")).alias("crc"), crc32c_column(now).alias("body_crc"),
    )


def _bad() -> F.Column:
    config = Config()
    return ~wal.record_is_valid(config.max_key_bytes, config.max_value_bytes)


_KEPT = f"""s as (select *, cast(floor((seq_no - 1) / {SEGMENT}) as bigint) as segment_id, (seq_no - 1) % {SEGMENT} as pos from l),
k as (select * from s where not (segment_id in (2, 9) and pos >= 700) and not (segment_id = 4 and pos >= 500))"""


@query(f"with {_SHARD}, {_KEPT} select segment_id, count(*) as records, max(seq_no) as last_seq from k group by segment_id")
def q29_wal_recover_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = wal.valid_prefix(_stored(spark, sf_dir), _bad())
    return kept.groupBy("segment_id").agg(F.count("*").alias("records"), F.max("seq_no").alias("last_seq"))


@query(f"""with {_SHARD}, {_KEPT}, {_NEWEST.replace("from l", "from k")} select key, seq_no, value from n where r = 1 and not tombstone""")
def q29_wal_replay_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest_state(wal.replay(_stored(spark, sf_dir), _bad()))


@query(f"""with {_SHARD}, {_KEPT} select (select count(distinct segment_id) from s) as segments, (select count(*) from k) as records,
  (select count(*) from s where (segment_id in (2, 9) and pos = 700) or (segment_id = 4 and pos = 500)) as truncated, (select max(seq_no) from k) as last_seqno,
  (select max(seq_no) - min(seq_no) + 1 > count(*) from k) as gap""")
def q30_wal_recovery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.recovery_report(_stored(spark, sf_dir), _bad())


@query("select distinct segment_id from mutation_log where segment_id < 3")
def q31_wal_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wal.retention(table(spark, sf_dir, "mutation_log"), 3)


@query(f"""with {_SHARD}, {_FLUSHED}, {_META} select run_id, cast(floor(data_bytes * 1000 / (2 * 1048576)) as bigint) as required_ms from d""")
def q32_compaction_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.compaction_throttle(runs.run_metadata(flushed(spark, sf_dir)).withColumnRenamed("data_bytes", "bytes"), 2)


@query(f"""with recursive {_SHARD}, {_FLUSHED}, z as (select run_id, row_number() over (partition by run_id order by key) as i, octet_length(encode(key)) as k,
    case when tombstone then 0 else coalesce(octet_length(encode(value)), 0) end as v from e),
  c(run_id, i, block, remaining, n, restarts, bytes) as (
    select run_id, i, cast(0 as bigint), 512 - 17 - k - v, 1, 8 + k, cast(17 + k + v as bigint) from z where i = 1
    union all
    select z.run_id, z.i, c.block + f.fresh, case when f.fresh = 1 then 512 else c.remaining end - 17 - z.k - z.v,
      case when f.fresh = 1 then 1 else c.n + 1 end,
      case when f.fresh = 1 then 8 + z.k else c.restarts + case when c.n % 10 = 0 then 8 + z.k else 0 end end, c.bytes + 17 + z.k + z.v
    from c join z on z.run_id = c.run_id and z.i = c.i + 1
    cross join lateral (select cast(c.remaining < 41 + z.k + z.v + c.restarts + case when c.n % 10 = 0 then 8 + z.k else 0 end + 12 as int) as fresh) f)
  select run_id, max(block) + 1 as blocks, max(bytes) as data_bytes from c group by run_id""")
def q33_block_layout_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.block_layout(flushed(spark, sf_dir), 512, 10)


@query(f"with {_SHARD} select seq_no, key, case when not tombstone then coalesce(value, '') end as value, tombstone from l")
def q34_binary_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as binary segments and read again, every record checked."""
    log = events_shard(spark, sf_dir).select("seq_no", F.encode("key", "UTF-8").alias("key"), F.encode("value", "UTF-8").alias("value"), "tombstone")
    path = new_folder(spark, "wal")
    native.save(native.wal_segments(log, ROLL), path)
    read = native.read_wal(spark, path)
    return read.select("seq_no", F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "tombstone")


@query(f"with {_SHARD}, {_FLUSHED} select run_id, key, seq_no, case when not tombstone then coalesce(value, '') end as value, tombstone from e")
def q35_binary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flushed runs written as binary run files and read again: headers, index, restart
    points, filters and the checksum of every block are checked."""
    entries = flushed(spark, sf_dir)
    text = lambda c: F.encode(c, "UTF-8").alias(c)
    path = new_folder(spark, "sst")
    native.save(native.run_files(entries.select("run_id", text("key"), "seq_no", text("value"), "tombstone"), block_size=512), path)
    read = native.read_runs(spark, path)
    return read.select("run_id", F.decode("key", "UTF-8").alias("key"), "seq_no", F.decode("value", "UTF-8").alias("value"), "tombstone")


@query(f"with {_SHARD}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone and key >= 'u:10' and key < 'u:12'")
def x1_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.range_scan(events_shard(spark, sf_dir), "u:10", "u:12")


@query(f"with {_SHARD}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone and starts_with(key, 'u:1')")
def x2_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.prefix_scan(events_shard(spark, sf_dir), "u:1")


@query(f"with {_SHARD}, {_NEWEST} select key, seq_no, value, tombstone from n where r = 1 and not (tombstone and seq_no <= 5000)")
def x3_expire_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.expire_tombstones(events_shard(spark, sf_dir), 5000)


@query(f"with {_USER}, {_NEWEST} select key, seq_no, value from n where r = 1 and not tombstone")
def x4_streaming_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidelog.streaming.ingest import stream_events_state

    return stream_events_state(spark, sf_dir)
