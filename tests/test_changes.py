import random

from tidelog.operators.changes import SCHEMA, BucketedTable

DELIVERY = "delivery_id bigint, " + SCHEMA + ", bucket int, m int"


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, 7, 8) for i, r in enumerate(rows)], DELIVERY)


def state(table):
    return {(r.store_id, r.key): (r.seq_no, r.value) for r in table.state().collect()}


def model(rows):
    whole = {}
    for s, k, q, t, v in rows:
        if s is None or q is None:
            continue
        old = whole.get((s, q), (None, None, None))
        whole[s, q] = tuple(a if a is not None else b for a, b in zip(old, (k, t, v)))
    out = {}
    for (s, q), (k, t, v) in whole.items():
        if k is None or t is None or (not t and v is None):
            continue
        if (s, k) not in out or q > out[s, k][0]:
            out[s, k] = (q, t, v)
    return {key: (q, v) for key, (q, t, v) in out.items() if not t}


def test_batches_in_any_order_equal_the_model(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for store in (1, 2):
        for q in range(1, 120):
            k = "hot" if rng.random() < 0.4 else rng.choice(["a", "A", "a ", "", "é"])
            t = rng.random() < 0.3
            v = None if t else rng.choice(["", "x", "y"])
            for _ in range(rng.choice([1, 1, 2])):
                rows.append((store, k, q, t, v))
            if rng.random() < 0.3:  # a mutation whose deliveries are incomplete by themselves
                rows = [r for r in rows if r[:1] + r[2:3] != (store, q)]
                rows += [(store, k, q, None, None), (store, None, q, t, v)]
    rows += [(None, "n", 5, False, "x"), (1, "n", None, False, "x"), (1, None, 500, False, "x"), (2, "lost", 501, None, "x")]
    rng.shuffle(rows)
    t = BucketedTable(spark, f"file://{tmp_path}/t", 3)
    cut = len(rows) // 3
    for i in range(3):
        t.apply(frame(spark, rows[i * cut : (i + 1) * cut if i < 2 else None]), f"b{i}")
    assert state(t) == model(rows)
    again = t.apply(frame(spark, rows), "b1")
    assert again.skipped and t.store.read()["version"] == 3
    assert t.apply(frame(spark, rows), "all again").skipped is False and state(t) == model(rows)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 8)
    t.apply(frame(spark, [(1, f"k{i}", i, False, "v") for i in range(1, 60)]), "base")
    before = t.store.read()["files"]
    report = t.apply(frame(spark, [(1, "k1", 100, True, None)]), "one")
    after = t.store.read()["files"]
    assert len(report.touched) == 1
    assert {b for b in after if after[b] != before.get(b)} == {str(report.touched[0])}
    assert t.state().count() == 58 and t.state(version=1).count() == 59


def test_a_failure_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 2)
    t.apply(frame(spark, [(1, "k", 1, False, "v")]), "base")
    real = t.store.commit
    monkeypatch.setattr(t.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        t.apply(frame(spark, [(1, "k", 2, True, None)]), "next")
    except RuntimeError:
        pass
    assert state(t) == {(1, "k"): (1, "v")}
    monkeypatch.setattr(t.store, "commit", real)
    t.apply(frame(spark, [(1, "k", 2, True, None)]), "next")
    assert state(t) == {}


def test_empty(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 2)
    assert t.state().count() == 0
    t.apply(frame(spark, []), "none")
    assert t.state().count() == 0 and t.rows().columns == ["store_id", "key", "seq_no", "tombstone", "value"]


def test_ties_prefer_deletes(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 2)
    t.apply(frame(spark, [(1, "k", 5, False, "v"), (1, "k", 5, True, None)]), "tie")
    assert state(t) == {}


def test_the_stored_side_is_neither_exchanged_nor_sorted(spark, tmp_path):
    from tidelog.storage.buckets import Buckets

    b = Buckets(spark, f"file://{tmp_path}/b", "store_id bigint, key string, v bigint", ["store_id", "key"], 5)
    rows = spark.range(300).selectExpr("id % 3 as store_id", "concat('k', id) as key", "id as v")
    files = b.write(b.dealt(rows), "data/1")
    with b.opened(files, files) as (x, y):
        joined = x.hint("merge").join(y.withColumnRenamed("v", "w"), ["store_id", "key"], "full_outer")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert joined.where("v = w").count() == 300
    twice, split = b.split(files, "data/2")
    assert twice.count == 10 and twice.read(split).count() == 300
    assert all(len(list((tmp_path / "b" / f[0]).glob("*.parquet"))) == 1 for f in [*files.values(), *split.values()])
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidelog_")]


def test_every_bucket_is_one_file_whatever_the_partitions(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 7)
    t.apply(frame(spark, [(1, f"k{i}", i, False, "v") for i in range(1, 200)]).repartition(9), "b-0")
    t.apply(frame(spark, [(1, f"k{i}", 500 + i, False, "w") for i in range(1, 200)]).repartition(9), "b-1")
    files = t.store.read()["files"]
    assert len(files) == 7 and all(len(list((tmp_path / "t" / f).glob("*.parquet"))) == 1 for f, _ in files.values())
    assert t.state().where("value = 'w'").count() == 199


def test_pending_is_emptied_by_whole_deliveries(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 2)
    t.apply(frame(spark, [(1, "a", 1, None, None), (1, None, 1, False, "x"), (1, "b", 2, None, None), (1, None, 3, None, "late"), (1, "c", 9000, False, "v")]), "b-0")
    assert sorted(r.seq_no for r in t.pending().collect()) == [2, 3]
    # the whole deliveries of 2 in the same batch as a fragment, and of 9000 before one
    t.apply(frame(spark, [(1, "b", 2, False, "y"), (1, "b", 2, None, None), (1, None, 9000, None, "v"), (1, "c", 1, None, None)]), "b-1")
    assert sorted(r.seq_no for r in t.pending().collect()) == [3]
    assert state(t) == {(1, "a"): (1, "x"), (1, "b"): (2, "y"), (1, "c"): (9000, "v")}


def test_old_versions_are_deleted_and_large_buckets_split(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", 2, max_bucket_bytes=1, retain=2)
    for i in range(4):
        t.apply(frame(spark, [(1, f"k{j}", i * 100 + j, False, f"v{i}") for j in range(1, 40)]), f"b-{i}")
    assert t.buckets == 16 and t.store.versions() == [3, 4] and t.store.read()["batches"] == {"b-": [[0, 3]]}
    assert t.state().where("value = 'v3'").count() == 39 and t.state(version=3).where("value = 'v2'").count() == 39
    named = {f for v in (3, 4) for f, _ in [*t.store.read(v)["files"].values(), *t.store.read(v)["seen"].values()]}
    there = {f"{p.parent.parent.name}/{p.parent.name}/{p.name}" for p in (tmp_path / "t").glob("*/*/bucket=*")}
    assert {x.split("/", 1)[1] if x.startswith("t/") else x for x in there} == named
    assert t.apply(frame(spark, []), "b-2").skipped


def test_seen_numbers(spark, tmp_path):
    from tidelog.operators.seen import SeenNumbers

    rng = random.Random(9)
    seen = SeenNumbers(spark, f"file://{tmp_path}/s", 3)
    met, files = set(), {}
    for version in range(1, 4):
        new = [(rng.choice([1, 2, None]), rng.choice([None, -5, 63, 64, 4095, 4096, rng.randint(-9000, 9000)])) for _ in range(60)]
        files = seen.added(files, spark.createDataFrame(new, "store_id bigint, seq_no bigint"), version)
        met |= {x for x in new if None not in x}
        asked = sorted(met)[::3] + [(1, n) for n in range(-70, 70)]
        left = seen.missing(files, spark.createDataFrame(sorted(set(asked)), "store_id bigint, seq_no bigint"), f"left/{version}")
        assert {(r.store_id, r.seq_no) for r in left.collect()} == set(asked) - met
