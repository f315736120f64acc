import random
import struct

import pytest

from tidelog.functions.checksum import crc32c
from tidelog.model import CorruptionDetected
from tidelog.operators import bloom as B
from tidelog.operators import state as S
from tidelog.sources import native as N

ROWS = [(1, b"k1", b"v1", False), (2, b"k2", b"", False), (3, b"k1", None, True), (4, b"\xff", b"x" * 30, False)]
LOG = "seq_no bigint, key binary, value binary, tombstone boolean"


def log(spark, rows):
    return spark.createDataFrame([(s, bytearray(k), None if v is None else bytearray(v), t) for s, k, v, t in rows], LOG)


def test_a_segment_round_trip():
    content = N.encode_records(ROWS)
    assert N.decode_records(content) == (ROWS, True)
    # the first record by hand
    body = b"\x01" + struct.pack(">qii", 1, 2, 2) + b"k1v1"
    assert content[8:].startswith(struct.pack(">i", 21) + body + struct.pack(">I", crc32c(body)))
    assert len(content) == 8 + sum(25 + len(k) + len(v or b"") for _, k, v, _ in ROWS)


def test_bad_segments():
    content = N.encode_records(ROWS)
    assert N.decode_records(content + b"\x01\x02\x03\x04\x05") == (ROWS, False)
    assert N.decode_records(content[:-1]) == (ROWS[:3], False)
    damaged = bytearray(content)
    damaged[8 + 29 + 6] ^= 1
    assert N.decode_records(bytes(damaged)) == (ROWS[:1], False)
    assert N.decode_records(content, max_key=10, max_value=20) == (ROWS[:3], False)
    assert N.decode_records(N.encode_records([])) == ([], True)
    for bad in (b"", b"WAL2\x01\x00\x00\x00", b"WAL1\x02\x00\x00\x00"):
        with pytest.raises(CorruptionDetected):
            N.decode_records(bad)


def entries(n, seed=1):
    rng = random.Random(seed)
    keys = sorted({bytes(rng.randrange(256) for _ in range(rng.randint(1, 9))) for _ in range(n)})
    return [(k, i, b"" if i % 5 == 0 else bytes(rng.randint(0, 40)), i % 5 == 0) for i, k in enumerate(keys)]


@pytest.mark.parametrize("block", [256, 8192])
def test_a_run_round_trip(block):
    given = entries(120)
    content = N.encode_run(given, block)
    got = N.decode_run(content)
    assert [(k, s, v, t) for _, k, s, v, t in got] == given
    assert [b for b, *_ in got] == list(N.R.pack_blocks(((len(k), len(v)) for k, _, v, _ in given), block, 10))


def test_every_damage_is_found():
    content = N.encode_run(entries(40), 256)
    bloom_at, bloom_bytes = struct.unpack_from(">qi", content, len(content) - 12)
    for at in [*range(0, bloom_at, 7), len(content) - 20, len(content) - 9]:
        damaged = bytearray(content)
        damaged[at] ^= 0x55
        try:
            assert N.decode_run(bytes(damaged)) == N.decode_run(content) or at >= bloom_at - 200
        except CorruptionDetected:
            pass
    with pytest.raises(CorruptionDetected):
        N.decode_run(content[:-1])


def test_spark_round_trips(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, b"k%d" % rng.randint(0, 20), None if i % 4 == 0 else b"v%d" % i, i % 4 == 0) for i in range(1, 101)]
    df = log(spark, rows)
    assert N.save(N.wal_segments(df, 300), f"file://{tmp_path}/wal") > 5
    back = N.read_wal(spark, f"file://{tmp_path}/wal")
    assert sorted((r.seq_no, bytes(r.key), None if r.value is None else bytes(r.value), r.tombstone) for r in back.collect()) == rows
    runs = S.newest(df.withColumn("run_id", S.F.floor(S.F.col("seq_no") / 30).cast("bigint") + 1), ("run_id", "key"))
    assert N.save(N.run_files(runs, 512), f"file://{tmp_path}/sst") == 4
    key = lambda r: (r.run_id, bytes(r.key), r.seq_no, None if r.value is None else bytes(r.value), r.tombstone)
    read = N.read_runs(spark, f"file://{tmp_path}/sst")
    assert sorted(map(key, read.collect()), key=str) == sorted(map(key, runs.collect()), key=str)
    state = {bytes(r.key): r.seq_no for r in S.latest_state(read).collect()}
    assert state == {bytes(r.key): r.seq_no for r in S.latest_state(df).collect()}


def test_filter_bits_equal_the_relation(spark):
    keys = [f"clé{i}" for i in range(40)]
    df = spark.createDataFrame([(0, k) for k in keys], "run_id bigint, key string")
    bits = {r.word * 64 + i for r in B.packed_filters(df, 10, 7).collect() for i in range(64) if r.bits >> i & 1}
    packed = N.filter_bits([k.encode() for k in keys], 10, 7)
    assert bits == {i for i in range(len(packed) * 8) if packed[i // 8] >> (i % 8) & 1}
