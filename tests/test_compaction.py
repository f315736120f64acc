import random
import uuid

import pytest

from tidelog.operators import compaction as C
from tidelog.storage.manifest import CommitConflict, ManifestStore

LISTING = "listing_id bigint, store_id bigint, run_id bigint, file_name string, file_size bigint, entry_count bigint, level bigint, removed_at timestamp, bytes int, tier int"
ENTRY = "entry_id bigint, run_id bigint, store_id bigint, key string, value string, seq_no bigint, tombstone boolean, level int"


def listings(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, *r[:6], datetime(2033, 1, 1) if r[6] else None, 1, 1) for i, r in enumerate(rows)], LISTING)


def test_resolving_runs(spark):
    rows = [
        (1, 1, "000001.sst", None, 5, 0, False), (1, 1, "data/000001.SST ", 100, None, None, False), (1, 1, "000001.sst.tmp", 9, 9, 9, False),
        (1, 2, "000002.tmp", 50, 1, 0, False),
        (1, 3, "sst\\000003.sst", 0, 3, 1, False), (1, 3, "./000003.sst", -1, 3, 1, True),
        (None, None, "000009.sst", 1, 1, 1, False), (2, 4, None, 1, 1, 1, False),
    ]
    got = {r.run_id: (r.bytes, r.entries, r.level, r.removed) for r in C.resolve_runs(listings(spark, rows)).collect()}
    assert got == {1: (100, 5, 0, False), 3: (None, 3, 1, True)}


def fixture(spark, n=70, seed=3):
    rng = random.Random(seed)
    runs, entries = [], []
    for run in range(1, n + 1):
        store = 1 if run % 3 else rng.choice([2, 3])
        runs.append((store, run, f"{run:06d}.sst", rng.choice([100, 300, 900, 2000, 4095, 4096, 9000, None]), 3, 0, rng.random() < 0.1))
        for _ in range(3):
            entries.append((run, store, rng.choice("abc"), rng.choice(["x", None, ""]), rng.randint(1, 9), False))
    entries += entries[:10]
    e = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(entries)], ENTRY)
    return runs, entries, C.resolve_runs(listings(spark, runs)), e


def outs(c):
    return {r.run_id: r.out_run_id for r in c.current().collect()}


def held_after(c):
    return {(r.out_run_id, r.store_id, r.key, r.seq_no): r.value for r in c.rewritten().collect()}


def check_entries(c, entries, final, live, once=True):
    """Every entry of the merged runs is in an output of one of its runs, with a value if
    any copy has one, and there is nothing else; ``once``: in one output only."""
    got, want, outs_of = held_after(c), {}, {}
    for run, store, key, value, seq, _ in entries:
        if run in live and final.get(run, run) != run:
            k = (store, key, seq)
            want[k] = max([v for v in (want.get(k), value) if v is not None], default=None)
            outs_of.setdefault(k, set()).add(final[run])
    assert {k[1:] for k in got} == set(want)
    for k, outs_ in outs_of.items():
        held = [v for g, v in got.items() if g[1:] == k]
        assert {g[0] for g in got if g[1:] == k} <= outs_ and (len(held) == 1 or not once)
        assert max([v for v in held if v is not None], default=None) == want[k]


@pytest.mark.parametrize("shard", [10_000, 5])
def test_a_generation(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(C, "SHARD", shard)
    runs, entries, resolved, e = fixture(spark)
    c = C.Compactor(spark, f"file://{tmp_path}/c").compact(resolved, e)
    small = {r[1]: r for r in runs if r[3] and r[3] < 4096 and not r[6]}
    assert {r.run_id for r in c.inputs().collect()} == set(small)
    final = outs(c)
    assert set(final) == set(small)
    size, store_of = {}, {}
    for run, out in final.items():
        size[out] = size.get(out, 0) + small[run][3]
        store_of.setdefault(out, set()).add(small[run][0])
    assert all(len(s) == 1 for s in store_of.values())
    # no scope keeps two runs below a block, and every output is one file
    below = [next(iter(store_of[o])) for o, n in size.items() if n < 4096]
    assert len(below) == len(set(below))
    check_entries(c, entries, final, set(small))
    assert {r.out_run_id: r.bytes for r in c.outputs().collect()} == {o: n for o, n in size.items() if o < 0}
    files = list((tmp_path / "c/data/000001").glob("out_run_id=*"))
    assert {int(f.name[11:]) for f in files} == {k[0] for k in held_after(c)} and all(len(list(f.glob("*.parquet"))) == 1 for f in files)
    # nothing new, nothing done
    version = c.store.read()["version"]
    again = C.Compactor(spark, f"file://{tmp_path}/c").compact(resolved, e)
    assert again.store.read()["version"] == version and outs(again) == final
    live = {r[1] for r in runs if not r[6]}
    kept = {(r.store_id, r.key, r.seq_no) for r in c.entries(resolved, e).collect()}
    assert kept == {(store, key, seq) for run, store, key, _, seq, _ in entries if run in live}


def test_a_second_generation_takes_only_new_runs(spark, tmp_path):
    runs, entries, resolved, e = fixture(spark, 40)
    path = f"file://{tmp_path}/c"
    C.Compactor(spark, path).compact(resolved, e)
    c = C.Compactor(spark, path)
    before = outs(c)
    more = [(1, 200 + i, f"{200 + i:06d}.sst", 700, 3, 0, False) for i in range(3)] + [(9, 300, "000300.sst", 50, 3, 0, False)]
    added = [(r[1], r[0], "new", "v", 1000 + r[1], False) for r in more]
    every = spark.createDataFrame([(i, *r, 0) for i, r in enumerate(entries + added)], ENTRY)
    journal = c.plan(C.resolve_runs(listings(spark, runs + more)))
    taken = {r.input_id for r in journal.where("original").collect()}
    alone = {r for r, o in before.items() if r == o}
    assert {r[1] for r in more} <= taken <= {r[1] for r in more} | alone
    c.compact(C.resolve_runs(listings(spark, runs + more)), every)
    after = outs(c)
    changed = {r for r in before if after[r] != before[r]}
    store_of = {r[1]: r[0] for r in runs + more}
    assert {store_of[r] for r in changed} <= {1} and after[300] == 300
    small = {r[1] for r in runs + more if r[3] and r[3] < 4096 and not r[6]}
    assert set(after) == small
    check_entries(c, entries + added, after, small, once=False)
    assert [g["generation"] for g in c.store.read()["done"]] == [1, 2]


def test_a_plan_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "SHARD", 5)
    _, _, resolved, e = fixture(spark)
    whole = C.Compactor(spark, f"file://{tmp_path}/a").compact(resolved, e)
    broken = C.Compactor(spark, f"file://{tmp_path}/b")
    real, calls = broken._plan_round, []

    def fail(waiting, top, folder):
        calls.append(folder[-4:])
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(waiting, top, folder)

    monkeypatch.setattr(broken, "_plan_round", fail)
    with pytest.raises(RuntimeError):
        broken.compact(resolved, e)
    assert broken.inputs().count() == 0 and broken.rewritten().count() == 0
    broken.compact(resolved, e)
    assert calls[:3] == ["0001", "0002", "0002"] and outs(broken) == outs(whole) and held_after(broken) == held_after(whole)


def test_empty(spark, tmp_path):
    resolved = C.resolve_runs(listings(spark, []))
    c = C.Compactor(spark, f"file://{tmp_path}/c").compact(resolved, spark.createDataFrame([], ENTRY))
    assert c.inputs().count() == 0 and c.rewritten().count() == 0 and c.journal().count() == 0
    lost = C.resolve_runs(listings(spark, [(None, 1, "1.sst", 5, 1, 0, False), (None, 2, "2.sst", 5, 1, 0, False)]))
    assert outs(c.compact(lost, spark.createDataFrame([], ENTRY))) == {1: 1, 2: 2}


def test_two_writers_of_one_version(spark, tmp_path):
    store = ManifestStore(spark, f"file://{tmp_path}/m")
    assert store.read() is None
    store.commit(1, {"a": 1})
    with pytest.raises(CommitConflict):
        store.commit(1, {"a": 2})
    assert store.read() == {"a": 1, "version": 1} and store.versions() == [1]


def test_rewriting_keeps_every_field(spark, tmp_path):
    resolved = C.resolve_runs(listings(spark, [(1, r, f"{r:06d}.sst", 100, 2, 0, False) for r in (1, 2)] + [(1, 3, "000003.sst", 9000, 2, 0, False)]))
    rows = [
        (1, 1, "a", None, 5, False, "hex", "unknown"), (2, 1, "a", "x", 5, False, "unknown", None), (2, 1, "b", None, 6, True, None, "w1"),
        (3, 1, "a", "x", 5, False, " ", "w2"), (3, 1, "a", "x", 5, False, " ", "w2"),
    ]
    e = spark.createDataFrame(rows, "run_id bigint, store_id bigint, key string, value string, seq_no bigint, tombstone boolean, value_type string, writer string")
    c = C.Compactor(spark, f"file://{tmp_path}/c").compact(resolved, e)
    out = set(outs(c).values())
    got = sorted((r.key, r.seq_no, r.tombstone, r.value, r.value_type, r.writer) for r in c.rewritten().collect())
    assert len(out) == 1
    assert got == [("a", 5, False, "x", "hex", "unknown"), ("b", 6, True, None, None, "w1")]


def test_levels():
    runs = lambda sizes: [C.Run(i, n, 1, 0, True) for i, n in enumerate(sizes, 1)]
    for sizes in ([16] * 300, [200] * 3 + [800] * 3 + [1100] * 3, [4000, 4000, 200], [4000, 4050], [3000] * 7, [1], list(range(1, 4000, 37))):
        rows = C.merge_levels(runs(sizes), 4096, 4, 256)
        assert rows == C.merge_levels(runs(sizes)[::-1], 4096, 4, 256)
        size = {}
        for r in rows:
            if not r[9]:
                size[r[4]] = size.get(r[4], 0) + r[5]
        assert sum(size.values()) == sum(sizes) and sum(n < 4096 for n in size.values()) <= 1
        assert len(size) <= sum(sizes) // 4096 + 1


def sent_by_stages(spark, act):
    """Bytes of the largest results of stages that ran in ``act``."""
    context, tracker = spark.sparkContext._jsc.sc(), spark.sparkContext.statusTracker()
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    act()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    context.listenerBus().waitUntilEmpty(30_000)
    ran = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return max(context.statusStore().lastStageAttempt(s).resultSize() for s in ran)


def test_the_driver_holds_no_list_of_outputs(spark, tmp_path):
    def compacted(n):
        runs = C.resolve_runs(listings(spark, [(i % 5, i, f"{i:06d}.sst", 4000, 1, 0, False) for i in range(2 * n)]))
        entries = spark.createDataFrame([(i, i, i % 5, f"k{i}", "v", i, False, 0) for i in range(2 * n)], ENTRY)
        c = C.Compactor(spark, f"file://{tmp_path}/{n}")
        sent = sent_by_stages(spark, lambda: c.compact(runs, entries))
        assert len(list((tmp_path / f"{n}/data/000001").glob("out_run_id=*/*.parquet"))) == c.rewritten().select("out_run_id").distinct().count() == n
        assert c.rewritten().count() == 2 * n
        return sent, len(c.rewritten().inputFiles())

    few, many = compacted(20), compacted(600)
    assert many[0] < few[0] + 20_000
    assert many[1] <= 4


def test_a_lost_file_is_an_error(spark, tmp_path):
    _, _, resolved, e = fixture(spark, 20)
    c = C.Compactor(spark, f"file://{tmp_path}/c c").compact(resolved, e)
    next((tmp_path / "c c/data/000001").glob("*/*.parquet")).unlink()
    with pytest.raises(Exception, match="FileNotFoundError"):
        c.rewritten().count()


def test_files_of_outputs_in_several_batches(tmp_path):
    pa = C.pa
    rows = [(1, "a", i, i, False, "v", None, "w", out) for i, out in enumerate([-9, -9, -9, -5, -3, -3])]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*part)) or [()] * 9, C._arrow(C.ENTRIES))], schema=C._arrow(C.ENTRIES)) for part in (rows[:2], [], rows[2:5], rows[5:])]
    named = list(C.write_files(f"file://{tmp_path}", iter(batches)))
    assert [(r["out_run_id"], r["rows"]) for b in named for r in b.to_pylist()] == [(-9, 3), (-5, 1), (-3, 2)]
    got = [tuple(r.values()) for b in C.read_files(f"file://{tmp_path}", iter(named)) for r in b.to_pylist()]
    assert got == rows and len(list(tmp_path.glob("*/*.parquet"))) == 3


def test_entries_of_other_runs_are_dropped_before_the_shuffle(spark, tmp_path, monkeypatch):
    """Where the targets are too large to be broadcast."""
    from tidelog.operators import joins as J

    runs, entries, resolved, e = fixture(spark)
    whole = C.Compactor(spark, f"file://{tmp_path}/a").compact(resolved, e)
    shuffled = []
    real = J.sift
    monkeypatch.setattr(J, "sift", lambda big, small, on: shuffled.append(real(big, small, on)) or shuffled[-1])
    monkeypatch.setattr(C, "lookup_join", lambda *a, **k: J.lookup_join(*a, **{**k, "limit": 0}))
    apart = C.Compactor(spark, f"file://{tmp_path}/b").compact(resolved, e)
    assert held_after(apart) == held_after(whole) and held_after(whole)
    moved = {r for r, o in outs(whole).items() if r != o}
    # few others are let through by chance
    assert moved <= {r.run_id for r in shuffled[0].select("run_id").collect()} < {r[0] for r in entries}
    ids = spark.range(1000).withColumnRenamed("id", "k")
    assert J.lookup_join(ids, ids.where("k % 7 = 0"), ["k"], "left_semi", spread="k", limit=0, sifted=True).count() == 143
    assert J.sift(ids, ids.select(C.F.col("k").cast("int")), ["k"]).count() == 1000
