"""The store and the shell against the scenarios of a single-node engine."""

import json

import pytest

from tidelog import model as M
from tidelog.cli import Shell, flags, tokenize
from tidelog.engine import Store
from tidelog.functions.checksum import crc32c, crc32c_column, crc32c_many


def config(tmp_path, **kw):
    return M.Config(**{"data_dir": f"file://{tmp_path}/store", "max_immutable_tables": 0, **kw})


def missing(store, key):
    with pytest.raises(M.NotFound):
        store.get(key)


def test_basic(spark, tmp_path):
    s = Store.open(spark, config(tmp_path))
    s.put(b"name", b"first")
    s.put(b"name", b"second")
    s.put(b"empty", b"")
    s.put(b"deleted", b"x")
    s.delete(b"deleted")
    s.delete(b"never")
    assert s.get(b"name") == b"second" and s.get(b"empty") == b""
    missing(s, b"deleted")
    missing(s, b"other")
    for bad in (lambda: s.put(b"", b"x"), lambda: s.put(None, b"x"), lambda: s.put(b"k", None), lambda: s.get(b""), lambda: s.delete(None)):
        with pytest.raises(M.InvalidArgument):
            bad()
    assert s.stats()["last_seqno"] == 6
    s.close()
    for call in (s.stats, s.close, lambda: s.get(b"name")):
        with pytest.raises(M.StoreClosed):
            call()


def test_recovery_and_a_bad_tail(spark, tmp_path):
    c = config(tmp_path)
    s = Store.open(spark, c)
    s.put(b"survives", b"restart")
    s.put(b"gone", b"old")
    s.delete(b"gone")
    s.close()
    tail = next((tmp_path / "store/wal").iterdir()) / f"{4:020d}.json"
    tail.write_bytes(b"\x01\x02\x03")
    s = Store.open(spark, c)
    assert s.get(b"survives") == b"restart"
    missing(s, b"gone")
    assert s.wal_verify() == {"segments": 1, "records": 3, "truncated": 1, "last_seqno": 3, "gap": False}
    s.put(b"later", b"1")
    s.close()
    assert Store.open(spark, c).get(b"later") == b"1"


def test_runs_survive_without_the_log(spark, tmp_path):
    c = config(tmp_path, memtable_max_bytes=90)
    s = Store.open(spark, c)
    s.put(b"k1", b"v1")
    s.put(b"k2", b"v2")
    (run,) = s.list_sst()
    assert (run["entry_count"], run["min_seq_no"], run["max_seq_no"], run["level"]) == (2, 1, 2, 0)
    s.close()
    import shutil

    shutil.rmtree(tmp_path / "store/wal", ignore_errors=True)
    s = Store.open(spark, c)
    assert s.get(b"k1") == b"v1" and s.next_seq == 3
    assert s.sst_info("000001.sst")["intact"]


def test_overwrite_and_tombstone_cuts(spark, tmp_path):
    s = Store.open(spark, config(tmp_path / "a", memtable_max_bytes=90))
    for k, v in ((b"dup", b"old"), (b"trigger1", b"x"), (b"dup", b"new"), (b"trigger2", b"x")):
        s.put(k, v)
    assert [r["entry_count"] for r in s.runs] == [1, 1, 1] and set(s.active) == {b"trigger2"}
    assert s.get(b"dup") == b"new"
    s = Store.open(spark, config(tmp_path / "b", memtable_max_bytes=90))
    s.put(b"gone", b"old")
    s.put(b"trigger1", b"x")
    s.delete(b"gone")
    s.put(b"trigger2", b"x")
    assert len(s.runs) == 3
    missing(s, b"gone")


def test_segments_roll(spark, tmp_path):
    s = Store.open(spark, config(tmp_path, roll_size=64))
    for i in range(10):
        s.put(b"k%d" % i, b"v%d" % i)
    assert len(s._segments()) == 10
    assert all(s.get(b"k%d" % i) == b"v%d" % i for i in range(10))


def test_oversized(spark, tmp_path):
    s = Store.open(spark, config(tmp_path, block_size=80))
    for bad in (lambda: s.put(b"k" * 11, b""), lambda: s.delete(b"k" * 11), lambda: s.put(b"k", b"v" * 21)):
        with pytest.raises(M.InvalidArgument):
            bad()


def test_compaction(spark, tmp_path):
    c = config(tmp_path, memtable_max_bytes=90)
    s = Store.open(spark, c)
    for i in range(16):
        s.put(b"k%d" % i, b"v%d" % i)
    assert any(r["level"] == 1 for r in s.runs) and set(s.active) == {b"k15"}
    assert all(s.get(b"k%d" % i) == b"v%d" % i for i in range(16))
    assert s.state().count() == 16 and s.state(as_of=4).count() == 4
    assert s.vacuum() and s.get(b"k3") == b"v3"
    s.close()
    assert Store.open(spark, c).get(b"k7") == b"v7"


def test_missing_run_is_corruption(spark, tmp_path):
    c = config(tmp_path, memtable_max_bytes=90)
    s = Store.open(spark, c)
    s.put(b"k1", b"v1")
    s.put(b"k2", b"v2")
    import shutil

    (tmp_path / "store/runs/000009").mkdir()
    s = Store.open(spark, c)
    assert not (tmp_path / "store/runs/000009").exists()
    shutil.rmtree(tmp_path / "store/runs/000001")
    with pytest.raises(M.CorruptionDetected):
        Store.open(spark, c)


def test_bulk_load_and_multi_get(spark, tmp_path):
    s = Store.open(spark, config(tmp_path))
    s.put(b"a", b"0")
    rows = [(1, bytearray(b"a"), bytearray(b"1"), False), (2, bytearray(b"b"), bytearray(b"2"), False), (3, bytearray(b"b"), None, True)]
    s.load(spark.createDataFrame(rows, "n int, key binary, value binary, tombstone boolean"), "n")
    assert s.get(b"a") == b"1" and s.next_seq == 5
    probes = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"b"),), (bytearray(b""),)], "key binary")
    got = {bytes(r.key): r.status for r in s.multi_get(probes).collect()}
    assert got == {b"a": "ok", b"b": "not_found", b"": "invalid_argument"}


def test_tokenize():
    assert tokenize("x put  --key a --value 'b c'") == ["x", "put", "--key", "a", "--value", "b c"]
    assert tokenize("ab\"cd\" \"cd\"ab '' 'it \"is\"'") == ["abcd", "cd", "ab", "", 'it "is"']
    with pytest.raises(ValueError):
        tokenize("x 'open")
    assert flags(["x", "put", "--key", "a", "--value", "--b"]) == {"key": "a"}


def test_shell(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"data_dir": f"file://{tmp_path}/s", "memtable_max_bytes": 90, "max_immutable_tables": 1, "other": 1}))
    sh = Shell(spark)
    run = sh.execute
    assert run("kv get --key a")[0].startswith("InvalidArgument")
    assert run(f"kv INIT --config {path}") == ["ok"]
    assert run(f"kv init --config {path}")[0].startswith("InvalidArgument")
    assert run("kv put --key k1 --value v1") == run("kv put --key k2 --value v2") == ["ok"]
    assert run("kv get --key k1") == ["v1"] and run("kv get --key none")[0].startswith("NotFound")
    assert run("kv flush-now")[0].startswith("1 ") and run("kv flush-now") == ["nothing to flush"]
    assert run("kv list-sst")[0].startswith("id=1") and "intact=true" in run("kv sst-info --filename 000001.sst")[1]
    assert run("kv sst-info --filename 000001.sst")[2:] == ["block 0: size=64, Checksum OK"]
    assert run("kv manifest-info")[0] == "1" and run("kv version-info")[0] == "epoch: 1"
    assert {"block_cache_misses=0", "blooms_checked=0", "disk_block_reads=0"} <= set(run("kv stats"))
    assert "sst_live=1" in run("kv stats") and run("kv other") == [] and run("") == []
    assert run("kv del --key k1") == ["ok"] and run("kv get --key k1")[0].startswith("NotFound")
    assert run("kv close") == ["ok"] and sh.done


def test_config():
    assert M.bloom_parameters(0.01) == (10, 7) and M.bloom_parameters(0.1) == (5, 3) and M.bloom_parameters(0.001) == (15, 10)
    c = M.Config()
    assert (c.memtable_max_bytes, c.block_size, c.max_immutable_tables, c.bloom_bits_per_key) == (67108864, 8192, 4, 10)


def test_crc32c(spark):
    assert crc32c(b"123456789") == 0xE3069283
    values = [b"", b"a", b"123456789", bytes(range(256))]
    assert list(crc32c_many(values)) == [crc32c(v) for v in values] and len(crc32c_many([])) == 0
    df = spark.createDataFrame([(bytearray(b"123456789"),), (None,)], "v binary")
    assert [r[0] for r in df.select(crc32c_column("v")).collect()] == [0xE3069283, None]


def test_size_tier_falls_back_to_levels():
    from tidelog.engine import pick_size_tier

    runs = [{"id": i, "size": 10**i, "level": i % 2} for i in range(1, 6)]
    assert [r["id"] for r in pick_size_tier(runs, 3, 2)] == [4, 2, 5]
    assert pick_size_tier(runs[:2], 3, 2) == []


def test_counters_of_reads(spark, tmp_path):
    s = Store.open(spark, config(tmp_path, memtable_max_bytes=90, block_size=90))
    for k, v in ((b"a1", b"1"), (b"a9", b"2"), (b"a3", b"3"), (b"a7", b"4")):
        s.put(k, v)
    s.flush()
    assert s.get(b"a1") == b"1" and s.get(b"a1") == b"1" and s.get(b"a7") == b"4"
    missing(s, b"a5")
    missing(s, b"zz")
    n = s.stats()
    assert n["block_cache_hits"] >= 1 and n["block_cache_misses"] == n["disk_block_reads"] >= 2
    assert n["blooms_checked"] >= 3 and n["blooms_negative"] >= 1 and n["runs_pruned"] >= len(s.runs)
    off = Store.open(spark, config(tmp_path, cache_index_blocks=False))
    assert off.get(b"a1") == off.get(b"a1") == b"1" and off.stats()["disk_block_reads"] == 2 and off.stats()["block_cache_hits"] == 0


def test_a_damaged_block_is_told(spark, tmp_path):
    s = Store.open(spark, config(tmp_path, memtable_max_bytes=200, block_size=120))
    for i in range(6):
        s.put(b"k%d" % i, b"v" * 20)
    s.flush()
    run = s.list_sst()[-1]
    info = s.sst_info(f"{run['id']:06d}.sst")
    assert info["intact"] and len(info["block_sizes"]) == info["blocks"] == len(info["checksums"]) and all(info["checksums"])
    folder = f"file://{tmp_path}/store/runs/{run['id']:06d}"
    rows = [(r.key, r.seq_no, bytearray(b"x" * 20) if bytes(r.key) == bytes.fromhex(run["max_key"]) else r.value, r.tombstone) for r in spark.read.parquet(folder).collect()]
    spark.createDataFrame(rows, "key binary, seq_no bigint, value binary, tombstone boolean").write.mode("overwrite").parquet(folder)
    info = s.sst_info(f"{run['id']:06d}.sst")
    assert not info["intact"] and info["checksums"][-1] is False and all(info["checksums"][:-1])
    run["min_seq_no"] = 0
    s.manifest.commit(s.epoch + 1, {"runs": s.runs})
    with pytest.raises(M.CorruptionDetected):
        Store.open(spark, config(tmp_path))


def test_recovery_cuts_runs(spark, tmp_path):
    s = Store.open(spark, config(tmp_path))
    for i in range(7):
        s.put(b"k%d" % i, b"v%d" % i)
    s = Store.open(spark, config(tmp_path, memtable_max_bytes=90))
    # as when written: a table of 90 bytes takes two entries of 45
    assert [r["entry_count"] for r in s.runs] == [2, 2, 2] and set(s.active) == {b"k6"} and s.stats()["last_seqno"] == 7
    again = Store.open(spark, config(tmp_path, memtable_max_bytes=90))
    assert all(again.get(b"k%d" % i) == b"v%d" % i for i in range(7)) and len(again.runs) == 3


def test_grouped_log_writes_and_stops(spark, tmp_path):
    c = config(tmp_path, wal_fsync_every_n=3, memtable_max_bytes=90, l0_compaction_trigger=50, l0_stop_writes=3)
    s = Store.open(spark, c)
    for i in range(9):
        s.put(b"k%d" % i, b"v%d" % i)
    assert sum(r["level"] == 0 for r in s.runs) <= 4 and any(r["level"] == 1 for r in s.runs)
    s.close()
    s = Store.open(spark, c)
    assert all(s.get(b"k%d" % i) == b"v%d" % i for i in range(9))
    s.interval = 0.0
    s.put(b"last", b"1")
    assert s.compact_all() >= 0 and s.get(b"k0") == b"v0"
    s.config.max_merge_entries = 1
    with pytest.raises(M.InvalidArgument):
        s._merge(s.runs[:1] * 2)
