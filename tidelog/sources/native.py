"""Files of single-node stores of this kind: binary log segments and sorted run files.

Reading goes through Spark's ``binaryFile`` source, a file per row, so many files are
decoded in parallel; a file must fit a task. Numbers are big-endian. Writing gives rows of
(name, content), one per segment or run, which ``save`` puts on a file system.

Defined results: a segment's records end before the first bad one; a bad header, or
anything bad in a run file, raises CorruptionDetected; a run keeps deletes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.checksum import crc32c_many
from tidelog.model import RUN_FOOTER, RUN_HEADER, WAL_HEADER, CorruptionDetected
from tidelog.operators import runs as R
from tidelog.operators.bloom import BASE_1, BASE_2, SHIFT
from tidelog.operators import wal as W

# The two file headers.
WAL_MAGIC, RUN_MAGIC = b"WAL1\x01\x00\x00\x00", b"SSTB\x01\x00\x00\x00"


# -- log segments


def encode_records(records: list[tuple[int, bytes, bytes | None, bool]]) -> bytes:
    """A segment of (number, key, value, tombstone) records."""
    bodies = []
    for seq, key, value, dead in records:
        value = b"" if dead else value or b""
        bodies.append(struct.pack(">bqii", 2 if dead else 1, seq, len(key), len(value)) + key + value)
    sums = crc32c_many(bodies)
    return WAL_MAGIC + b"".join(struct.pack(">i", len(b)) + b + struct.pack(">I", int(c)) for b, c in zip(bodies, sums))


def decode_records(content: bytes, max_key: int | None = None, max_value: int | None = None) -> tuple[list[tuple], bool]:
    """The records before the first bad one, and whether the segment was whole."""
    if content[:WAL_HEADER] != WAL_MAGIC:
        raise CorruptionDetected("the header of a log segment is bad")
    bodies, sums, at, whole = [], [], WAL_HEADER, True
    while at < len(content):
        n = struct.unpack_from(">i", content, at)[0] if len(content) - at >= 4 else -1
        if n < 18 or at + 8 + n > len(content):
            whole = False
            break
        bodies.append(content[at + 4 : at + 4 + n])
        sums.append(struct.unpack_from(">I", content, at + 4 + n)[0])
        at += 8 + n
    out = []
    for body, want, have in zip(bodies, sums, crc32c_many(bodies).tolist()):
        kind, seq, k, v = struct.unpack_from(">bqii", body)
        long = (max_key is not None and k > max_key) or (max_value is not None and v > max_value)
        if want != have or kind not in (1, 2) or k <= 0 or v < 0 or 17 + k + v != len(body) or (kind == 2 and v) or long:
            return out, False
        out.append((seq, body[17 : 17 + k], None if kind == 2 else body[17 + k :], kind == 2))
    return out, whole


def _number(path: str) -> int:
    found = re.search(r"(\d+)\.\w+$", path)
    return int(found[1]) if found else -1


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def read_wal(spark: SparkSession, path: str, max_key: int | None = None, max_value: int | None = None) -> DataFrame:
    """(segment_id, at, seq_no, key, value, tombstone) of all valid records."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                records, _ = decode_records(bytes(content), max_key, max_value)
                yield pd.DataFrame(
                    [(_number(name), i, *r) for i, r in enumerate(records)],
                    columns=["segment_id", "at", "seq_no", "key", "value", "tombstone"],
                )

    return _files(spark, path, "*.wal").mapInPandas(
        decode, "segment_id bigint, at bigint, seq_no bigint, key binary, value binary, tombstone boolean"
    )


def wal_segments(log: DataFrame, roll_size: int) -> DataFrame:
    """(name, content): the log, with binary keys and values, as segments under the exact
    rolling rule; a segment is one row."""
    placed = log.join(W.segments(log, roll_size).select("seq_no", "segment_id"), "seq_no")

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq_no")
        rows = [(int(s), bytes(k), None if v is None else bytes(v), bool(t)) for s, k, v, t in zip(pdf["seq_no"], pdf["key"], pdf["value"], pdf["tombstone"])]
        return pd.DataFrame([(f"{int(key[0]) + 1:06d}.wal", encode_records(rows))], columns=["name", "content"])

    return placed.select("segment_id", "seq_no", "key", "value", "tombstone").groupBy("segment_id").applyInPandas(encode, "name string, content binary")


# -- run files


def filter_positions(key: bytes, m: int, hash_count: int) -> list[int]:
    h = [0, 0]
    for i, base in enumerate((BASE_1, BASE_2)):
        for b in key:
            h[i] = (h[i] * base + (b + SHIFT) % 256) % m
    return [(h[0] + i * max(1, h[1])) % m for i in range(1, hash_count + 1)]


def filter_bits(keys: list[bytes], bits_per_key: int, hash_count: int) -> bytes:
    out = bytearray(-(-bits_per_key * len(keys) // 8))
    for key in keys:
        for bit in filter_positions(key, len(out) * 8, hash_count):
            out[bit // 8] |= 1 << (bit % 8)
    return bytes(out)


def may_have(bits: bytes, key: bytes, hash_count: int) -> bool:
    return all(bits[bit // 8] >> (bit % 8) & 1 for bit in filter_positions(key, len(bits) * 8, hash_count))


def packed_blocks(entries: list[tuple[bytes, int, bytes | None, bool]], block_size: int, refresh_n: int) -> list[tuple[list, bytes]]:
    """(entries, content without checksum) of each block of a run, by the exact packing rule."""
    places = R.pack_blocks(((len(k), len(v or b"")) for k, _, v, _ in entries), block_size, refresh_n)
    blocks: list[list] = []
    for entry, block in zip(entries, places):
        if block == len(blocks):
            blocks.append([])
        blocks[-1].append(entry)
    out = []
    for block in blocks:
        body, restarts = bytearray(), bytearray()
        for i, (k, seq, v, dead) in enumerate(block):
            if i % refresh_n == 0:
                restarts += struct.pack(">i", len(k)) + k + struct.pack(">i", len(body))
            v = v or b""
            body += struct.pack(">i", len(k)) + k + struct.pack(">i", len(v)) + v + struct.pack(">qb", seq, int(dead))
        end = len(body)
        body += struct.pack(">i", -(-len(block) // refresh_n)) + restarts + struct.pack(">i", end)
        out.append((block, bytes(body)))
    return out


def encode_run(entries: list[tuple[bytes, int, bytes | None, bool]], block_size: int = 8192, refresh_n: int = 10, bits_per_key: int = 10, hash_count: int = 7) -> bytes:
    """A run file of (key, number, value, tombstone) entries in key order."""
    out, index = bytearray(RUN_MAGIC), bytearray()
    blocks = packed_blocks(entries, block_size, refresh_n)
    for (block, body), crc in zip(blocks, crc32c_many([b for _, b in blocks])):
        index += struct.pack(">i", len(block[0][0])) + block[0][0] + struct.pack(">q", len(out))
        out += body + struct.pack(">I", int(crc))
    bloom = filter_bits([e[0] for e in entries], bits_per_key, hash_count)
    at = len(out)
    return bytes(out + index + bloom + struct.pack(">qiqi", at, len(blocks), at + len(index), len(bloom)))


def decode_run(content: bytes) -> list[tuple[int, bytes, int, bytes, bool]]:
    """(block, key, number, value, tombstone) of a run file, with everything checked."""

    def check(good: bool, what: str) -> None:
        if not good:
            raise CorruptionDetected(f"the {what} of a run file is bad")

    check(content[:RUN_HEADER] == RUN_MAGIC and len(content) >= RUN_HEADER + RUN_FOOTER, "header")
    index_at, n, bloom_at, bloom_bytes = struct.unpack_from(">qiqi", content, len(content) - RUN_FOOTER)
    check(RUN_HEADER <= index_at <= bloom_at and n >= 0 and bloom_bytes >= 0 and bloom_at + bloom_bytes + RUN_FOOTER == len(content), "footer")
    starts, firsts, at = [], [], index_at
    for _ in range(n):
        check(bloom_at - at >= 4, "index")
        k = struct.unpack_from(">i", content, at)[0]
        check(k > 0 and at + 12 + k <= bloom_at, "index")
        firsts.append(content[at + 4 : at + 4 + k])
        starts.append(struct.unpack_from(">q", content, at + 4 + k)[0])
        at += 12 + k
    check(at == bloom_at and firsts == sorted(set(firsts)), "index")
    ends = [*starts[1:], index_at]
    check(all(RUN_HEADER <= a and a + 8 < b <= index_at for a, b in zip(starts, ends)), "index")
    blocks = [content[a : b - 4] for a, b in zip(starts, ends)]
    sums = [struct.unpack_from(">I", content, b - 4)[0] for b in ends]
    check(crc32c_many(blocks).tolist() == sums, "checksum")
    out = []
    for no, block in enumerate(blocks):
        end = struct.unpack_from(">i", block, len(block) - 4)[0]
        check(0 < end <= len(block) - 8, "block")
        restarts, place = {}, end + 4
        for _ in range(struct.unpack_from(">i", block, end)[0]):
            check(place + 4 <= len(block) - 4, "restart")
            k = struct.unpack_from(">i", block, place)[0]
            check(k > 0 and place + 8 + k <= len(block) - 4, "restart")
            restarts[struct.unpack_from(">i", block, place + 4 + k)[0]] = block[place + 4 : place + 4 + k]
            place += 8 + k
        check(place == len(block) - 4 and 0 in restarts and list(restarts.values()) == sorted(set(restarts.values())), "restart")
        at = 0
        while at < end:
            met = restarts.pop(at, None)
            k = struct.unpack_from(">i", block, at)[0]
            check(0 < k <= end - at - 17, "entry")
            v = struct.unpack_from(">i", block, at + 4 + k)[0]
            check(0 <= v <= end - at - 17 - k, "entry")
            seq, dead = struct.unpack_from(">qb", block, at + 8 + k + v)
            check(met is None or met == block[at + 4 : at + 4 + k], "restart")
            out.append((no, block[at + 4 : at + 4 + k], seq, block[at + 8 + k : at + 8 + k + v], bool(dead)))
            at += 17 + k + v
        check(not restarts, "restart")
    return out


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, block_no, key, seq_no, value, tombstone) of all published run files."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = [(_number(name), b, k, s, None if t else v, t) for b, k, s, v, t in decode_run(bytes(content))]
                yield pd.DataFrame(rows, columns=["run_id", "block_no", "key", "seq_no", "value", "tombstone"])

    return _files(spark, path, "*.sst").mapInPandas(
        decode, "run_id bigint, block_no bigint, key binary, seq_no bigint, value binary, tombstone boolean"
    )


def run_files(entries: DataFrame, block_size: int = 8192, refresh_n: int = 10, bits_per_key: int = 10, hash_count: int = 7) -> DataFrame:
    """(name, content): each run, with binary keys and values, as one file."""

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted((bytes(k), int(s), None if v is None else bytes(v), bool(t)) for k, s, v, t in zip(pdf["key"], pdf["seq_no"], pdf["value"], pdf["tombstone"]))
        return pd.DataFrame([(f"{int(key[0]):06d}.sst", encode_run(rows, block_size, refresh_n, bits_per_key, hash_count))], columns=["name", "content"])

    return entries.select("run_id", "key", "seq_no", "value", "tombstone").groupBy("run_id").applyInPandas(encode, "name string, content binary")


def save(files: DataFrame, folder: str) -> int:
    """Write (name, content) rows as files of a shared folder, from the executors, each
    under a temporary name first; returns their number."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with system.open_output_stream(f"{base}/{name}.tmp") as out:
                    out.write(bytes(content))
                system.move(f"{base}/{name}.tmp", f"{base}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})

    return files.mapInPandas(put, "n bigint").agg(F.sum("n")).first()[0] or 0
