"""Stable ids: 64-bit FNV-1a of a path as 16 hex digits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the public FNV-1a 64 definition.
OFFSET, PRIME, MASK = 14695981039346656037, 1099511628211, (1 << 64) - 1


def fnv1a64(path: str) -> str:
    h = OFFSET
    for b in path.encode():
        h = ((h ^ b) * PRIME) & MASK
    return f"{h:016x}"


def hashes(paths: list[bytes]) -> list[str]:
    """fnv1a64 of many paths: each step takes in one byte of all of them that are as long."""
    order = sorted(range(len(paths)), key=lambda i: -len(paths[i]))
    sizes = np.array([len(paths[i]) for i in order], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.frombuffer(b"".join(paths[i] for i in order), dtype=np.uint8)
    h = np.full(len(paths), OFFSET, dtype=np.uint64)
    n = len(paths)
    for at in range(int(sizes[0]) if n else 0):
        while sizes[n - 1] <= at:
            n -= 1
        h[:n] = (h[:n] ^ flat[starts[:n] + at]) * np.uint64(PRIME)
    out = [""] * len(paths)
    for i, x in zip(order, h.tolist(), strict=True):
        out[i] = f"{x:016x}"
    return out


def path_id(path: Column) -> Column:
    """The stable id of a path column; null stays null. BIGINT products overflow under ANSI rules, hence Arrow batches."""

    @F.pandas_udf("string")
    def hashed(paths: pd.Series) -> pd.Series:
        known = paths.notna().to_numpy()
        out = np.full(len(paths), None, dtype=object)
        out[known] = hashes([p.encode() for p in paths[known]])
        return pd.Series(out, dtype=object)

    return hashed(path)
