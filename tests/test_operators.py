"""Folds and set operators against plain Python."""

import math
import random

import pytest

from tidelog.model import IOFailure
from tidelog.operators import bloom as B
from tidelog.operators import runs as R
from tidelog.operators import state as S
from tidelog.operators import wal as W

LOG = "seq_no bigint, key string, value string, tombstone boolean, m int, run_id bigint"


def log(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], LOG)


def random_log(n=300, seed=5):
    rng = random.Random(seed)
    rows = []
    for q in range(1, n + 1):
        dead = rng.random() < 0.25
        rows.append((q, rng.choice(["hot"] * 5 + [f"k{i}" for i in range(12)]), None if dead else rng.choice(["", "x", "yy" * 9]), dead))
    rng.shuffle(rows)
    return rows


def model_state(rows):
    out = {}
    for q, k, v, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        out[k] = (q, v, t)
    return {k: (q, v) for k, (q, v, t) in out.items() if not t}


def as_dict(df):
    return {r.key: (r.seq_no, r.value) for r in df.collect()}


def test_state(spark):
    rows = random_log() + [(None, "n", "x", False), (900, None, "x", False)]
    df = log(spark, rows)
    assert as_dict(S.latest_state(df)) == model_state(rows)
    assert as_dict(S.state_as_of(df, 100)) == model_state([r for r in rows if r[0] is not None and r[0] <= 100])
    assert as_dict(S.prefix_scan(df, "k1")) == {k: v for k, v in model_state(rows).items() if k.startswith("k1")}
    assert as_dict(S.range_scan(df, "k2", "k5")) == {k: v for k, v in model_state(rows).items() if "k2" <= k < "k5"}
    assert as_dict(S.point_get(df, "hot")) == {k: v for k, v in model_state(rows).items() if k == "hot"}
    probes = spark.createDataFrame([("hot",), ("none",), ("",), (None,), ("hot",)], "key string")
    got = {r.key: r.status for r in S.multi_get(df, probes).collect()}
    assert got == {"hot": "ok" if "hot" in model_state(rows) else "not_found", "none": "not_found", "": "invalid_argument", None: "invalid_argument"}


def test_state_of_nothing(spark):
    df = log(spark, [])
    assert S.latest_state(df).count() == S.tombstoned_keys(df).count() == S.key_history(df).count() == 0
    assert S.point_get(df, "k").count() == 0 and S.validate(df, 1, 1).count() == 0
    e = R.flush(df, R.fixed_run_id(5))
    assert R.run_metadata(e).count() == R.sparse_index(e, 4).count() == R.block_layout(e, 512, 10).count() == 0
    assert B.fill(e, 10, 7).count() == 0 and W.offsets(df).count() == 0 and R.cut_exact(df, 90).count() == 0
    assert R.size_tier_pick(R.run_metadata(e).selectExpr("run_id", "data_bytes as size", "0 as level")).count() == 0


def test_merging_runs_never_changes_the_state(spark):
    rows = random_log()
    df = log(spark, rows)
    for size in (1, 7, 50, 1000):
        e = R.flush(df, R.fixed_run_id(size))
        r = R.merge_invariance(df, e).first()
        assert (r.only_log, r.only_runs) == (0, 0)
    lost = R.flush(df.where("seq_no > 20"), R.fixed_run_id(10))
    assert as_dict(R.merge_runs(lost).where("not tombstone")) == model_state([r for r in rows if r[0] > 20])


def cut(sizes, limit):
    return list(R.cut_positions(iter(sizes), limit))


def test_cutting_rule():
    e = lambda k, v: (k, 41 + len(k) + len(v))
    assert cut([e("k1", "v1"), e("k2", "v2")], 90) == [0, 0]
    assert cut([e("dup", "old"), e("trigger1", "x"), e("dup", "new"), e("trigger2", "x")], 90) == [0, 1, 2, 3]
    assert cut([e(f"k{i}", f"v{i}") for i in range(16)], 90) == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9, 10]
    # an overwrite gives its space back
    assert cut([("a", 40), ("a", 40), ("a", 40), ("b", 40)], 100) == [0, 0, 0, 0]
    with pytest.raises(IOFailure):
        cut([("a", 91)], 90)
    with pytest.raises(IOFailure):
        cut([("a", 50), ("b", 91)], 90)


def test_cutting_with_spark_equals_the_fold(spark):
    rows = random_log(200)
    got = {(r.store, r.seq_no): r.run_id for r in R.cut_exact(log(spark, rows).withColumn("s", S.F.col("seq_no") % 3), 300, "s").collect()}
    for s in range(3):
        mine = sorted(r for r in rows if r[0] % 3 == s)
        want = cut([(k, 41 + len(k) + (0 if t else len(v))) for _, k, v, t in mine], 300)
        assert [got[s, r[0]] for r in mine] == want


def bins(sizes, capacity):
    out, at = [], 0
    for n in sizes:
        if out and at + n <= capacity:
            out.append(out[-1])
            at += n
        else:
            out.append(out[-1] + 1 if out else 0)
            at = n
    return out


@pytest.mark.parametrize("per_part", [16, 0.3])
def test_packing_in_parallel_equals_the_fold(spark, monkeypatch, per_part):
    monkeypatch.setattr(R, "BINS_PER_PART", per_part)
    rng = random.Random(8)
    rows = [(s, 3 * q, rng.choice([1, 7, 30, 59, 60])) for s, n in ((1, 900), (2, 3), (-5, 40), (9, 300)) for q in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "store bigint, seq_no bigint, bytes bigint").repartition(3)
    got = {(r.store, r.seq_no): r.bin for r in R.greedy_packing(df, 60).collect()}
    for s in (1, 2, -5, 9):
        mine = sorted(r for r in rows if r[0] == s)
        assert [got[s, r[1]] for r in mine] == bins([r[2] for r in mine], 60)
    assert len(got) == len(rows) and R.greedy_packing(df.where("bytes > 99"), 60).count() == 0
    with pytest.raises(Exception, match="exceeds"):
        R.greedy_packing(df, 59).count()


def test_cutting_in_parallel_equals_the_fold(spark):
    rows = [(q, f"{k}#{q}", v, t) for q, k, v, t in random_log(200)]
    got = {r.seq_no: r.run_id for r in R.cut_exact(log(spark, rows), 300, overwrites=False).collect()}
    assert [got[r[0]] for r in sorted(rows)] == cut([(k, 41 + len(k) + (0 if t else len(v))) for _, k, v, t in sorted(rows)], 300)


def test_segments_and_offsets(spark):
    rows = random_log(60)
    total, want = 8, {}
    for q, k, v, t in sorted(rows):
        total += 25 + len(k) + (0 if t else len(v))
        want[q] = total
    assert {r.seq_no: r.end_offset for r in W.offsets(log(spark, rows)).collect()} == want


def test_blocks_hold_what_fits():
    sizes = [(3, 5)] * 40
    blocks = list(R.pack_blocks(iter(sizes), 128, 10))
    assert blocks[0] == 0 and sorted(blocks) == blocks
    # first: 49 + 11 + 12 of 128; then 103 left, 49 + 11 + 12 needed; then 78; then 53 < 72
    assert blocks[:4] == [0, 0, 0, 1]
    with pytest.raises(IOFailure):
        list(R.pack_blocks(iter([(60, 60)]), 128, 10))


def hashed(key, base, m):
    h = 0
    for b in key.encode():
        h = (h * base + (b - 256 if b > 127 else b) + 128) % m
    return h


def test_bloom(spark):
    rows = [(i, f"clé{i}", "v", False) for i in range(1, 90)]
    e = R.flush(log(spark, rows), R.fixed_run_id(30))
    got = {(r.run_id, r.m): r.bits_set for r in B.fill(e, 10, 7).collect()}
    want = {}
    for run in range(3):
        keys = [k for q, k, _, _ in rows if (q - 1) // 30 == run]
        m = math.ceil(len(keys) * 10 / 8) * 8
        bits = {(hashed(k, 257, m) + i * max(1, hashed(k, 263, m))) % m for k in keys for i in range(1, 8)}
        want[run, m] = len(bits)
    assert got == want
    asked = spark.createDataFrame([(r, k) for r in range(3) for k in [f"clé{i}" for i in range(1, 90)] + ["other", ""]], "run_id bigint, key string")
    effect = B.effect(e, asked, 10, 7).agg({"false_negatives": "sum", "checked": "sum"}).first()
    assert sorted(effect) == [0, 273]


def test_golden_filter_counts(spark):
    """Every key against every run of the event log, numbers computed beforehand."""
    from tidelog.plans.catalogue import flushed

    d = "/root/testdata/sf0.01"
    e = flushed(spark, d)
    asked = e.select("run_id").distinct().crossJoin(e.select("key").distinct())
    r = B.effect(e, asked, 10, 7).selectExpr("sum(checked)", "sum(negatives)", "sum(false_positives)", "sum(false_negatives)").first()
    assert tuple(r) == (21000, 12482, 569, 0)
    f = B.fill(e, 10, 7).selectExpr("sum(m)", "sum(bits_set)").first()
    assert tuple(f) == (79544, 36082)


def test_zone_maps_and_floor(spark):
    rows = random_log(200)
    e = R.flush(log(spark, rows), R.fixed_run_id(25))
    meta = {r.run_id: (r.min_key, r.max_key) for r in R.run_metadata(e).collect()}
    probes = spark.createDataFrame([("a",), ("hot",), ("k11",), ("k5",), ("zz",), (None,)], "key string")
    got = {r.key: r.candidates for r in R.zone_map_candidates(R.run_metadata(e), probes).collect()}
    assert got == {k: sum(a <= k <= b for a, b in meta.values()) for k in ("a", "hot", "k11", "k5", "zz")}
    index = R.sparse_index(e, 3)
    probes = probes.crossJoin(e.select("run_id").distinct())
    starts = {}
    for r in index.collect():
        starts.setdefault(r.run_id, []).append((r.first_key, r.block_no))
    found = {(r.run_id, r.key): r.block_no for r in R.floor_seek(index, probes).collect()}
    for (run, key), block in found.items():
        assert block == max([b for f, b in starts[run] if f <= key], default=-1)
    assert len(found) == 5 * len(starts)
    assert R.index_is_sorted(index).where("not valid").count() == 0


def test_pickers(spark):
    r = lambda rows: spark.createDataFrame(rows, "run_id bigint, size bigint, level int")
    ids = lambda df: sorted(x.run_id for x in df.collect())
    assert ids(R.size_tier_pick(r([(1, 10, 0), (2, 100, 0), (3, 110, 0), (4, 150, 0), (5, 200, 0), (6, 900, 1)]))) == [2, 3, 4, 5]
    assert ids(R.size_tier_pick(r([(1, 1, 0), (2, 10, 0), (3, 100, 1), (4, 1000, 0), (5, 10000, 0)]))) == [1, 2, 4, 5]
    assert ids(R.size_tier_pick(r([(1, 1, 0), (2, 10, 0), (3, 100, 0)]))) == []
    assert ids(R.level0_trigger(r([(i, 1, 0) for i in range(9)]), 8)) == list(range(1, 9))
    assert ids(R.level0_trigger(r([(i, 1, int(i == 3)) for i in range(8)]), 8)) == []
    stores = spark.createDataFrame([(s, i, 10, 0) for s in (1, 2) for i in range(5 - s)], "store_id bigint, run_id bigint, size bigint, level int")
    assert {(x.store_id, x.run_id) for x in R.size_tier_pick(stores).collect()} == {(1, i) for i in range(4)}
    assert "SinglePartition" not in R.size_tier_pick(stores)._jdf.queryExecution().executedPlan().toString()
    history = [tuple(x) for x in R.manifest_history(stores, 3).orderBy("store_id", "epoch").collect()]
    assert history == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 0), (1, 4, 1, 1), (1, 5, 2, 1), (2, 1, 1, 0), (2, 2, 2, 0), (2, 3, 3, 0), (2, 4, 1, 1)]


def test_recovery(spark):
    schema = "segment_id bigint, at bigint, seq_no bigint, key string, value string, tombstone boolean, bad boolean"
    rows = [(0, 0, 1, "a", "1", False, False), (0, 1, 2, "b", "2", False, True), (0, 2, 3, "c", "3", False, False), (1, 0, 3, "c", "3", False, False), (1, 1, 4, "a", None, True, False)]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.seq_no for r in W.replay(df, S.F.col("bad")).collect()) == [1, 3, 4]
    assert tuple(W.recovery_report(df, S.F.col("bad")).first()) == (2, 3, 1, 4, True)
    none = spark.createDataFrame([], schema)
    assert tuple(W.recovery_report(none, S.F.col("bad")).first()) == (0, 0, 0, None, False)


def test_cache(spark):
    rng = random.Random(2)
    trace = [(i, rng.randint(0, 9)) for i in range(300)]
    held, want = [], {}
    for i, b in trace:
        want[i] = b in held
        held = [x for x in held if x != b] + [b]
        held = held[-4:]
    df = spark.createDataFrame(trace, "at bigint, block bigint")
    assert {r.at: r.hit for r in W.cache_hits(df, 4).collect()} == want


def test_stream_equals_batch(spark):
    from tidelog.plans.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    assert as_dict(QUERIES["x4_streaming_state"](spark, d)) == as_dict(QUERIES["q01_latest_state_users"](spark, d))


def test_work_folders_end_with_their_scope(spark):
    from tidelog.storage import workspace

    with workspace.scope(spark):
        df = workspace.materialise(spark.range(5), "scoped")
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert df.count() == 5 and workspace.folder_bytes(spark, path) > 0
    assert workspace.folder_bytes(spark, path) == 0 and not workspace._scopes
