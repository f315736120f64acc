"""Far too many small files: size-tiered incremental compaction with a journal.

``resolve_runs`` makes one row per run out of its listings. ``Compactor.compact`` carries
out one generation: it takes the small runs that no generation considered before, and with
them what earlier ones left below a block in the same scopes; plans their merging level by
level; writes each final output as one file with the entries of its inputs; and publishes
journal and files in one manifest. Other runs and earlier outputs are neither read nor
written. A second generation without new small runs does nothing.

Levels: runs of one scope that are similar in size are merged ``fan_in`` at a time, from the
smallest size tier up; what is left below a block is packed by bytes, largest first, into
as many groups as it fills blocks, until a scope has at most one run below a block. Every
merge is a transaction of the journal, one row per input. Its id follows from its inputs,
so planning again gives the same rows; a planned round that is published is taken up, not
planned again, by a restart. A small run without a partner has a row without a transaction.

Outputs are as many as the data has blocks, so no list of them comes to the driver: the tasks
write and read the files, and a table of a generation, written with them, names them.

The merging of one scope is a fold over sizes, run by one task per scope over metadata
only. A scope of more than ``SHARD`` runs is cut into shards by a hash of the run id; what
the shards leave meets in further rounds, so no task holds more.

Defined results: a listing is published if its file name, without folder, blanks and
case, ends in ``.sst``; other listings count for nothing but ``removed_at``. Sizes and
counts that are null, zero or negative say nothing. A run without a usable size is not
small and is never merged; nor is one without a scope. Entries of one scope with equal key and
sequence number are copies: in the outputs of a generation they become one entry that has
each field if any copy has it (of different ones the greatest); a stand-in for a type or
writer only remains where no copy names one. Null run ids are ignored; empty tables give empty plans;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.joins import lookup_join
from tidelog.storage.manifest import ManifestStore
from tidelog.storage.workspace import delete, hadoop, materialise

#: Bytes of a block; a run below it is small.
BLOCK = 4096
#: About as many runs of one scope are merged in one task.
SHARD = 10_000
RUN = "store_id bigint, run_id bigint, bytes bigint, entries bigint, level bigint, original boolean"
JOURNAL = "store_id bigint, tier int, txn_id bigint, input_id bigint, output_id bigint, final_id bigint, bytes bigint, entries bigint, level bigint, original boolean, made boolean"
#: What an entry holds besides its place: copies are combined field by field.
FIELDS = {"entry_id": "bigint", "tombstone": "boolean", "value": "string", "value_type": "string", "writer": "string"}
ENTRIES = f"store_id bigint, key string, seq_no bigint, {', '.join(f'{c} {t}' for c, t in FIELDS.items())}, out_run_id bigint"
#: The files of a generation.
FILES = "out_run_id bigint, name string, rows bigint"
#: Stand-ins for "not known", compared trimmed and without case.
STAND_INS = ("", "-", "--", "?", "n/a", "na", "none", "null", "nil", "unknown", "unk", "not known", "undefined")


def known(name: str) -> Column:
    """True where a label is present: not null, blank or a stand-in."""
    text = F.lower(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")))
    return F.coalesce(~text.isin(*STAND_INS), F.lit(False))


def published(name: str = "file_name") -> Column:
    """Whether a listing's file name is that of a published run."""
    base = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?U)\s+", "")), r"^.*[/\\]", "")
    return F.coalesce(base.rlike(r"^[^.]+\.sst$"), F.lit(False))


def resolve_runs(listings: DataFrame) -> DataFrame:
    """One row per published run: (run_id, store_id, bytes, entries, level, removed)."""
    pub = published()
    usable = lambda c: F.max(F.when(pub & (F.col(c) > 0), F.col(c)))
    return (
        listings.where("run_id is not null")
        .groupBy("run_id")
        .agg(
            F.max(F.when(pub, F.col("store_id"))).alias("store_id"),
            usable("file_size").alias("bytes"),
            usable("entry_count").alias("entries"),
            F.max(F.when(pub & (F.col("level") >= 0), F.col("level"))).alias("level"),
            F.max(F.col("removed_at").isNotNull()).alias("removed"),
            F.max(pub).alias("published"),
        )
        .where("published")
        .drop("published")
    )


def live_small(runs: DataFrame, block: int = BLOCK) -> Column:
    return ~F.col("removed") & F.coalesce(F.col("bytes") < block, F.lit(False))


@dataclass
class Run:
    id: int
    bytes: int
    entries: int
    level: int
    original: bool
    made: bool = False


def output_id(inputs: list[int]) -> int:
    """Negative, so that it never meets the id of a run on disk; follows from the inputs."""
    digest = hashlib.blake2b(",".join(map(str, sorted(inputs))).encode(), digest_size=8).digest()
    return -(int.from_bytes(digest, "big") >> 2) - 1


def packed(runs: list[Run], block: int) -> list[list[Run]]:
    """Runs by bytes, largest first, each into the emptiest of as many groups as they fill
    blocks."""
    groups = [(0, i, []) for i in range(max(1, sum(r.bytes for r in runs) // block))]
    for r in sorted(runs, key=lambda r: (-r.bytes, r.id)):
        size, i, held = heapq.heappop(groups)
        heapq.heappush(groups, (size + r.bytes, i, [*held, r]))
    return [g for _, _, g in sorted(groups, key=lambda g: g[1]) if g]


def merge_levels(runs: list[Run], block: int, fan_in: int, smallest: int) -> list[tuple]:
    """The journal of one scope: (tier, txn, input, output, final output, ...) rows."""
    waiting, merges = list(runs), []

    def merge(tier: int, group: list[Run]) -> None:
        out = Run(output_id([r.id for r in group]), sum(r.bytes for r in group), sum(r.entries for r in group), 1 + max(r.level for r in group), False, True)
        merges.append((tier, group, out))
        taken = {r.id for r in group}
        waiting[:] = [r for r in waiting if r.id not in taken] + ([out] if out.bytes < block else [])

    tier, limit = 0, smallest
    while limit < block:
        due = sorted((r for r in waiting if r.bytes <= limit), key=lambda r: (r.bytes, r.id))
        for i in range(0, len(due) - fan_in + 1, fan_in):
            merge(tier, due[i : i + fan_in])
        tier, limit = tier + 1, limit * fan_in
    while len(waiting) > 1:
        for group in packed(waiting, block):
            if len(group) > 1:
                merge(tier, group)
        tier += 1
    final: dict[int, int] = {}
    for _, group, out in reversed(merges):
        for r in group:
            final[r.id] = final.get(out.id, out.id)
    rows = [
        (t, out.id, r.id, out.id, final[r.id], r.bytes, r.entries, r.level, r.original, r.made) for t, group, out in merges for r in group
    ]
    return rows + [(tier, None, r.id, r.id, r.id, r.bytes, r.entries, r.level, r.original, r.made) for r in waiting]


def _arrow(schema: str) -> pa.Schema:
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])


def write_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One Parquet file for each ``out_run_id`` of the batches, which are sorted by it; returns
    FILES rows. At most a batch is held. Another attempt of the task writes other names."""
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    schema, attempt = _arrow(ENTRIES).remove(len(ENTRIES.split(", ")) - 1), uuid.uuid4().hex
    now, writer, rows = None, None, 0
    try:
        for batch in batches:
            made, ids = [], batch.column(batch.num_columns - 1)
            part = pa.Table.from_arrays(batch.columns[:-1], names=schema.names).cast(schema)
            ends, start = pc.run_end_encode(ids), 0
            for end, out in zip(ends.run_ends.to_pylist(), ends.values.to_pylist()):
                if out != now:
                    if writer:
                        writer.close()
                        made.append((now, f"out_run_id={now}/{attempt}.parquet", rows))
                    now, rows = out, 0
                    system.create_dir(f"{base}/out_run_id={now}", recursive=True)
                    writer = pq.ParquetWriter(f"{base}/out_run_id={now}/{attempt}.parquet", schema, filesystem=system, store_schema=False)
                writer.write_table(part.slice(start, end - start))
                rows, start = rows + end - start, end
            yield _files_batch(made)
        if writer:
            writer.close()
            writer = None
            yield _files_batch([(now, f"out_run_id={now}/{attempt}.parquet", rows)])
    finally:
        if writer:
            writer.close()


def _files_batch(made: list[tuple]) -> pa.RecordBatch:
    schema = _arrow(FILES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made)) or [()] * 3, schema.types)], schema=schema)


def read_files(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries in the files that FILES rows name, with their ``out_run_id``."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(folder)
    schema = _arrow(ENTRIES)
    for batch in batches:
        for out, name, rows in zip(*(c.to_pylist() for c in batch.columns)):
            with system.open_input_file(f"{base}/{name}") as source, pq.ParquetFile(source) as file:
                if file.metadata.num_rows != rows:
                    raise ValueError(f"{name} has {file.metadata.num_rows} rows instead of {rows}")
                for part in file.iter_batches():
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([out] * len(part), pa.int64())], schema=schema)


class Compactor:
    """Generations of merging small runs; see the module text. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, fan_in: int = 4, smallest: int = 256):
        self.spark, self.path = spark, path.rstrip("/")
        self.block, self.fan_in, self.smallest = block, fan_in, smallest
        self.store = ManifestStore(spark, path)

    def _held(self) -> dict:
        return self.store.read() or {"version": 0, "done": [], "open": None}

    def _commit(self, held: dict, **change) -> dict:
        done = self.store.commit(held["version"] + 1, {**held, **change})
        self.store.expire(2, lambda m: set())
        return done

    def _load(self, folder: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    # -- planning

    def _candidates(self, runs: DataFrame, held: dict) -> DataFrame:
        small = runs.where(live_small(runs, self.block)).select(
            "store_id", "run_id", "bytes", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("level", F.lit(0)).alias("level"),
            F.lit(True).alias("original"),
        )
        if not held["done"]:
            return small
        current = self.current()
        fresh = small.join(current, "run_id", "left_anti")
        scopes = fresh.select("store_id").distinct()
        alone = small.join(current.where("run_id = out_run_id"), "run_id", "left_semi")
        left = self.outputs().where(F.col("bytes") < self.block).select(
            "store_id", F.col("out_run_id").alias("run_id"), "bytes", "entries", "level", F.lit(False).alias("original")
        )
        return fresh.unionByName(alone.unionByName(left).join(scopes, "store_id", "left_semi"))

    def plan(self, runs: DataFrame) -> DataFrame:
        """Plan a generation, or go on with one that is planned in part; returns its
        journal, empty if there is nothing new."""
        held = self._held()
        if held["open"] is None:
            generation = len(held["done"]) + 1
            folder = f"candidates/{generation:06d}"
            self._candidates(runs, held).write.mode("overwrite").parquet(f"{self.path}/{folder}")
            if self._load(folder, RUN).isEmpty():
                return self.spark.createDataFrame([], JOURNAL)
            held = self._commit(held, open={"generation": generation, "rounds": 0, "over": False})
        while not held["open"]["over"]:
            generation, n = held["open"]["generation"], held["open"]["rounds"] + 1
            waiting = self._load(f"candidates/{generation:06d}", RUN) if n == 1 else self._left(generation, n - 1)
            top = waiting.groupBy("store_id").count().agg(F.max("count")).first()[0] or 0
            self._plan_round(waiting, top, f"journal/{generation:06d}/{n:04d}")
            held = self._commit(held, open={"generation": generation, "rounds": n, "over": top <= SHARD})
        return self._journal(held["open"]["generation"], held["open"]["rounds"])

    def _left(self, generation: int, n: int) -> DataFrame:
        rows = self._load(f"journal/{generation:06d}/{n:04d}", JOURNAL).where("txn_id is null and store_id is not null")
        return rows.select("store_id", F.col("input_id").alias("run_id"), "bytes", "entries", "level", "original")

    def _plan_round(self, waiting: DataFrame, top: int, folder: str) -> None:
        if top > SHARD:
            sizes = waiting.groupBy("store_id").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"))
            cut = lookup_join(waiting, sizes, ["store_id"], "left", spread="run_id", name="shards").withColumn(
                "shard", F.coalesce(F.pmod(F.hash("run_id"), F.col("shards")), F.lit(0))
            )
        else:
            cut = waiting.withColumn("shard", F.lit(0))
        block, fan_in, smallest = self.block, self.fan_in, self.smallest

        def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in JOURNAL.split(", ")]
            types = [{"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in JOURNAL.split(", ")]
            for batch in batches:
                out = []
                for store, held in zip(*(c.to_pylist() for c in batch.columns)):
                    runs = [Run(*x.values(), x["id"] < 0 and not x["original"]) for x in held]
                    if store is None:
                        rows = [(0, None, r.id, r.id, r.id, r.bytes, r.entries, r.level, r.original, r.made) for r in runs]
                    else:
                        rows = merge_levels(runs, block, fan_in, smallest)
                    out += [(store, *r) for r in rows]
                columns = list(zip(*out)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        # metadata of at most about SHARD runs a row
        run = F.struct(F.col("run_id").alias("id"), "bytes", "entries", "level", "original")
        held = cut.groupBy("store_id", "shard").agg(F.collect_list(run).alias("held")).select("store_id", "held")
        held.mapInArrow(levels, JOURNAL).write.mode("overwrite").parquet(f"{self.path}/{folder}")

    # -- the journal

    def _journal(self, generation: int, rounds: int) -> DataFrame:
        return self.spark.read.schema(JOURNAL).parquet(*[f"{self.path}/journal/{generation:06d}/{n:04d}" for n in range(1, rounds + 1)])

    def journal(self) -> DataFrame:
        """All rows of the published generations."""
        out = self.spark.createDataFrame([], JOURNAL)
        for g in self._held()["done"]:
            out = out.unionByName(self._journal(g["generation"], g["rounds"]))
        return out

    def _moves(self, generation: int, rounds: int) -> DataFrame:
        """(run_id, out_run_id, original) of a generation's inputs."""
        first = self._load(f"journal/{generation:06d}/{1:04d}", JOURNAL)
        taken = self._load(f"candidates/{generation:06d}", RUN).select("run_id")
        at = first.join(taken, first["input_id"] == taken["run_id"], "left_semi").select(
            F.col("input_id").alias("run_id"), F.col("final_id").alias("out_run_id"), "original"
        )
        for n in range(2, rounds + 1):
            step = self._load(f"journal/{generation:06d}/{n:04d}", JOURNAL).select(F.col("input_id").alias("out_run_id"), F.col("final_id").alias("next"))
            at = at.join(step, "out_run_id", "left").select("run_id", F.coalesce("next", "out_run_id").alias("out_run_id"), "original")
        return at

    def current(self) -> DataFrame:
        """(run_id, out_run_id): for each small run considered so far the run that has its
        entries now; itself if it had no partner."""
        done = self._held()["done"]
        if not done:
            return self.spark.createDataFrame([], "run_id bigint, out_run_id bigint")
        return self._load(f"current/{done[-1]['generation']:06d}", "run_id bigint, out_run_id bigint")

    def inputs(self) -> DataFrame:
        """The runs on disk that the published generations took: all small live runs."""
        return self.journal().where("original").select(F.col("input_id").alias("run_id")).distinct()

    def outputs(self) -> DataFrame:
        """(store_id, out_run_id, bytes, entries, level) of the outputs in force, with the
        sums that the journal has."""
        live = self.current().where("run_id <> out_run_id").select("out_run_id").distinct()
        made = (
            self.journal().where("txn_id is not null").groupBy("store_id", F.col("output_id").alias("out_run_id"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("entries").alias("entries"), (F.max("level") + 1).alias("level"))
        )
        return made.join(live, "out_run_id", "left_semi").select("store_id", "out_run_id", "bytes", "entries", "level")

    # -- carrying out

    def compact(self, runs: DataFrame, entries: DataFrame) -> Compactor:
        """One generation: plan it, write its outputs, publish."""
        if not self.plan(runs).isEmpty():
            held = self._held()
            generation, rounds = held["open"]["generation"], held["open"]["rounds"]
            moves = materialise(self._moves(generation, rounds), "moves")
            self._rewrite(moves.where("run_id <> out_run_id"), entries, generation)
            step = moves.select(F.col("run_id").alias("out_run_id"), F.col("out_run_id").alias("next"))
            before = self.current()
            now = before.join(step, "out_run_id", "left").select("run_id", F.coalesce("next", "out_run_id").alias("out_run_id"))
            new = moves.where("original").join(before, "run_id", "left_anti").select("run_id", "out_run_id")
            now.unionByName(new).write.mode("overwrite").parquet(f"{self.path}/current/{generation:06d}")
            self._commit(held, open=None, done=[*held["done"], {"generation": generation, "rounds": rounds}])
        return self

    def _rewrite(self, moves: DataFrame, entries: DataFrame, generation: int) -> None:
        """One sorted file per output, with the entries of its inputs and no others; an entry
        that inputs of several outputs have goes to the first of these. An output is of about
        a block, so it is never too much for a task; copies are combined before they are
        brought together."""
        columns = ["store_id", "key", "seq_no", *FIELDS]
        absent = [F.lit(None).cast(t).alias(c) for c, t in FIELDS.items() if c not in entries.columns]
        source = entries.select("run_id", *[c for c in columns if c in entries.columns], *absent)
        targets = moves.select("run_id", "out_run_id")
        placed = lookup_join(source, targets, ["run_id"], "inner", spread="seq_no", name="targets", sifted=True)
        if self._held()["done"]:
            taken = targets.where("run_id < 0").select(F.col("run_id").alias("out_run_id"))
            earlier = self._files(taken).withColumnRenamed("out_run_id", "run_id").select("run_id", *columns)
            placed = placed.unionByName(lookup_join(earlier, targets, ["run_id"], "inner", spread="seq_no", name="targets"))
        # a known label sorts after a stand-in
        label = lambda c: F.concat(F.when(known(c), "1").otherwise("0"), F.col(c))
        best = lambda c: F.max(label(c)).substr(F.lit(2), F.lit(1 << 30)) if c in ("value_type", "writer") else F.max(c)
        delete(self.spark, f"{self.path}/data/{generation:06d}")  # of a run that failed
        (
            placed.groupBy("store_id", "key", "seq_no").agg(F.min("out_run_id").alias("out_run_id"), *[best(c).alias(c) for c in FIELDS])
            .repartition("out_run_id").sortWithinPartitions("out_run_id", "store_id", "key", F.desc("seq_no")).select(*columns, "out_run_id")
            .mapInArrow(partial(write_files, self._data(generation)), FILES).write.mode("overwrite").parquet(f"{self.path}/files/{generation:06d}")
        )

    def _data(self, generation: int) -> str:
        """The URI of the folder of a generation's outputs."""
        fs, path = hadoop(self.spark, f"{self.path}/data/{generation:06d}")
        return fs.makeQualified(path).toUri().toString()

    def _files(self, only: DataFrame | None = None) -> DataFrame:
        """The entries in the files of all outputs, or of those in ``only``."""
        out = self.spark.createDataFrame([], ENTRIES)
        # a number, as parts by the size of names would be few
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        for g in self._held()["done"]:
            named = self._load(f"files/{g['generation']:06d}", FILES)
            if only is not None:
                named = lookup_join(named, only, ["out_run_id"], "left_semi", name="only").select(named.columns)
            out = out.unionByName(named.repartition(parts, "out_run_id").mapInArrow(partial(read_files, self._data(g["generation"])), ENTRIES))
        return out

    def rewritten(self) -> DataFrame:
        """The entries of the outputs in force: out_run_id, store_id, key, seq_no and fields."""
        if len(self._held()["done"]) < 2:
            return self._files()
        return self._files(self.current().where("run_id <> out_run_id").select("out_run_id").distinct())

    def entries(self, runs: DataFrame, entries: DataFrame) -> DataFrame:
        """(out_run_id, store_id, key, seq_no, value) of all live runs after compaction:
        outputs in force, and the entries on disk of the runs that weren't merged."""
        merged = self.current().where("run_id <> out_run_id").select("run_id")
        kept = runs.where("not removed").select("run_id").join(merged, "run_id", "left_anti")
        rest = lookup_join(entries.select("run_id", "store_id", "key", "seq_no", "value"), kept, ["run_id"], "left_semi", name="kept")
        return self.rewritten().select("out_run_id", "store_id", "key", "seq_no", "value").unionByName(rest.withColumnRenamed("run_id", "out_run_id"))
