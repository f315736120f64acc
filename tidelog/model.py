"""Schemas, sizes, configuration and errors of the mutation-log engine."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, fields

MUTATION = "seq_no bigint, key string, value string, tombstone boolean"

# Sizes of the on-disk layouts, in bytes.
ENTRY_OVERHEAD = 41  # accounting size of an entry besides key and value
WAL_HEADER = 8
WAL_RECORD_OVERHEAD = 25
RUN_HEADER = 8
RUN_ENTRY_OVERHEAD = 17
RUN_FOOTER = 24


class EngineError(RuntimeError):
    """Base of all errors of the engine."""


class InvalidArgument(EngineError):
    """A key, value or call that the engine doesn't take."""


class NotFound(EngineError):
    """No visible value for the key."""


class StoreClosed(EngineError):
    """The store was closed."""


class CorruptionDetected(EngineError):
    """A file isn't what the manifest says."""


class IOFailure(EngineError):
    """A record that fits nowhere, or storage that failed."""


@dataclass
class Config:
    """Settings of a store; the names are those of the JSON file."""

    data_dir: str = "./data"
    memtable_max_bytes: int = 67108864
    block_size: int = 8192
    bloom_false_positive: float = 0.01
    wal_fsync_every_n: int = 1
    compression: str = "off"
    log_level: str = "info"
    roll_size: int = 67108864
    max_immutable_tables: int = 4
    refresh_n: int = 10
    block_cache_mb: int = 64
    cache_index_blocks: bool = True
    max_open_files: int = 1024
    size_tiered_fan_in: int = 4
    size_tiered_size_ratio: float = 2.0
    tombstone_grace_seconds: int = 86400
    compaction_max_concurrent: int = 1
    compaction_io_mb_per_s: int = 0
    l0_compaction_trigger: int = 8
    l0_stop_writes: int = 20
    max_merge_entries: int = 2147483647  # of all inputs of a merge

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """From a JSON file; class defaults for what it lacks, unknown names ignored."""
        if path is None:
            return cls()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in names})

    @property
    def max_key_bytes(self) -> int:
        return self.block_size // 8

    @property
    def max_value_bytes(self) -> int:
        return 2 * (self.block_size // 8)

    @property
    def bloom_bits_per_key(self) -> int:
        return bloom_parameters(self.bloom_false_positive)[0]

    @property
    def bloom_hash_count(self) -> int:
        return bloom_parameters(self.bloom_false_positive)[1]


def bloom_parameters(false_positive: float) -> tuple[int, int]:
    """(bits per key, number of hashes) for a rate of false positives."""
    if not 0 < false_positive < 1:
        raise InvalidArgument("the rate of false positives must lie between 0 and 1")
    bits = math.ceil(-math.log(false_positive) / math.log(2) ** 2)
    return bits, round(bits * math.log(2))


def entry_size(key: bytes, value: bytes) -> int:
    return ENTRY_OVERHEAD + len(key) + len(value)
