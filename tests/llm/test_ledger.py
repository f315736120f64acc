import random

from tidelog.llm.ledger import KeyLedger

PROBE = "probe_id bigint, store_id bigint, key string, bucket int, first_id bigint, held boolean"


def probes(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, True) for r in rows], PROBE)


def history(spark, rows):
    return spark.createDataFrame([(s, k, 9) for s, k in rows], "store_id bigint, key string, bucket int")


def test_batches_against_a_set(spark, tmp_path):
    rng = random.Random(4)
    keys = ["hot"] * 20 + ["a", "A", "a ", "", "é", "é", None] + [f"k{i}" for i in range(30)]
    old = [(rng.choice([1, 2]), rng.choice(keys)) for _ in range(25)] + [(None, "hot")]
    rows = [(i, rng.choice([1, 2, None]), rng.choice(keys)) for i in range(1, 301)]
    seen = {x for x in old if None not in x}
    want = set()
    for i, s, k in rows:
        if s is None or k is None:
            continue
        if (s, k) in seen:
            want.add(i)
        seen.add((s, k))
    ledger = KeyLedger(spark, f"file://{tmp_path}/l", 3)
    ledger.load(history(spark, old))
    ledger.load(history(spark, old))
    got = set()
    for n, (a, b) in enumerate(((0, 100), (100, 200), (200, 300))):
        batch = rows[a:b] + rows[a : a + 5]
        rng.shuffle(batch)
        first = {r.probe_id for r in ledger.check(probes(spark, batch), "probe_id", f"b{n}").collect()}
        again = {r.probe_id for r in KeyLedger(spark, f"file://{tmp_path}/l").check(probes(spark, batch), "probe_id", f"b{n}").collect()}
        assert first == again
        got |= first
    assert got == want
    assert {(r.store_id, r.key) for r in ledger.keys().collect()} == seen and ledger.keys().count() == len(seen)


def test_empty(spark, tmp_path):
    ledger = KeyLedger(spark, f"file://{tmp_path}/l", 2)
    assert ledger.keys().count() == 0
    assert ledger.check(probes(spark, []), "probe_id", "none").count() == 0
    assert ledger.check(probes(spark, [(1, 1, "k"), (None, 1, "k"), (2, 1, "k")]), "probe_id", "one").collect()[0].probe_id == 2


def test_layers_are_merged_and_split(spark, tmp_path):
    ledger = KeyLedger(spark, f"file://{tmp_path}/l", 2, layers=2, max_bucket_bytes=1)
    met = 0
    for n in range(7):
        rows = [(n * 100 + i, 1, f"k{(n * 7 + i) % 60}") for i in range(20)]
        met += ledger.check(probes(spark, rows), "probe_id", f"b-{n}").count()
        held = ledger.store.read()
        assert len(held["layers"]) <= 2
    assert met == 140 - ledger.keys().count() and ledger.keys().distinct().count() == ledger.keys().count() == 60
    assert held["buckets"] > 2 and ledger.store.versions() == [7]
    again = [(600 + i, 1, f"k{(42 + i) % 60}") for i in range(20)]
    assert ledger.check(probes(spark, again), "probe_id", "b-6").count() == 15 and ledger.store.versions() == [7]


def test_only_touched_buckets_are_read_and_nothing_stored_is_moved(spark, tmp_path, monkeypatch):
    from tidelog.storage.buckets import Buckets

    ledger = KeyLedger(spark, f"file://{tmp_path}/l", 16)
    ledger.load(history(spark, [(1, f"k{i}") for i in range(500)]))
    opened, plans = [], []
    real_opened, real_write = Buckets.opened, Buckets.write
    monkeypatch.setattr(Buckets, "opened", lambda self, *v: opened.append([len(f) for f in v]) or real_opened(self, *v))
    monkeypatch.setattr(Buckets, "write", lambda self, rows, folder: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or real_write(self, rows, folder))
    assert ledger.check(probes(spark, [(1, 1, "k7")]), "probe_id", "one").count() == 1
    assert opened == [[1, 1]]
    joined = plans[-1]
    assert "SortMergeJoin" in joined and "Exchange" not in joined and "Sort [" not in joined
