"""A bitmap of fixed size over 64-bit keys: a first sieve that may let others through, but never drops a member."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One megabyte, whatever the number of keys.
BITS = 23


def build(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """Words of the bitmap, made by Spark; at most 2**(bits - 6) rows reach the driver."""
    top = f"shiftrightunsigned(`{column}`, {64 - bits})"
    rows = keys.select(F.expr(f"shiftright({top}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({top} & 63 as int))").alias("bit"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for r in rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = int(words.size * 64).bit_length() - 1
    top = keys >> np.uint64(64 - bits)
    return (words[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1) != 0
