"""A broadcast filter of 64-bit values that keeps rows out of a pass which no wanted value can be among."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter at most (16 MB), bits for each value.
MOST_BITS, PER_VALUE = 1 << 27, 16


def sieve(values: DataFrame, column: str):
    """Of the values in a column of longs, as a broadcast bitmap sized by their number; None where they are too many for one."""
    n = values.count()
    if n > MOST_BITS // PER_VALUE:
        return None
    bits = max(1 << 16, 1 << (PER_VALUE * n - 1).bit_length()) if n else 1 << 16
    h = f"pmod({column}, {bits})"
    words = values.selectExpr(f"cast({h} div 32 AS int) AS w", f"shiftleft(1L, cast({h} % 32 AS int)) AS bit").groupBy("w").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("bit").to_numpy().astype(np.uint32)
    return values.sparkSession.sparkContext.broadcast(out)


def passes(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the filter: all that are, and a few others."""
    h = values % (len(bitmap) * 32)
    return (bitmap[h // 32] >> (h % 32).astype(np.uint32) & 1).astype(bool)
