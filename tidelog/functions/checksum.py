"""CRC32C, which Spark lacks: for single values, and as a vectorised function of columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the reflected polynomial of CRC32C.
POLYNOMIAL = 0x82F63B78


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


TABLE = _table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = int(TABLE[(c ^ b) & 0xFF]) ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """All checksums at once: one step per byte position over the values that reach it,
    so the work is that of the bytes, however unequal the lengths."""
    sizes = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(values) else np.zeros(0, np.int64)
    data = np.frombuffer(b"".join(values), np.uint8)
    c = np.full(len(values), 0xFFFFFFFF, np.uint32)
    sizes_down, starts_down = sizes[order], starts[order]
    live = len(values)
    i = 0
    while True:
        while live and sizes_down[live - 1] <= i:
            live -= 1
        if not live:
            break
        byte = data[starts_down[:live] + i]
        head = c[:live]
        c[:live] = TABLE[(head ^ byte) & 0xFF] ^ (head >> np.uint32(8))
        i += 1
    out = np.empty(len(values), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_column(value: Column | str) -> Column:
    """CRC32C of a binary column; null for null."""

    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series([None] * len(s), index=s.index, dtype="Int64")
        out[known] = crc32c_many([bytes(x) for x in s[known]]).astype(np.int64)
        return out

    return run(value)
