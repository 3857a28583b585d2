"""Look-ups of keys and key ranges in a manifest's closed key ranges, by binary search.

A manifest has one row for each run and lives on the driver, as it decides which files are read at all; what is shipped
to tasks is two sorted lists of its boundaries.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType


class Intervals:
    """Closed ranges with a weight each."""

    def __init__(self, rows: list[tuple]):
        """rows: (lo, hi, weight)."""
        by_lo, by_hi = sorted((lo, w) for lo, _, w in rows), sorted((hi, w) for _, hi, w in rows)
        self.lo, self.hi = [x for x, _ in by_lo], [x for x, _ in by_hi]
        self.weight_lo = [0, *accumulate(w for _, w in by_lo)]
        self.weight_hi = [0, *accumulate(w for _, w in by_hi)]

    @staticmethod
    def of(files: DataFrame, weight: str | None = None) -> Intervals:
        return Intervals([(r[0], r[1], r[2]) for r in files.select("lo", "hi", F.lit(1) if weight is None else F.col(weight)).collect()])

    def touching(self, lo, hi) -> int:
        """The weight of the ranges that share a key with [lo, hi]: those that start at or before hi, less those that end before lo."""
        return self.weight_lo[bisect_right(self.lo, hi)] - self.weight_hi[bisect_left(self.hi, lo)]

    def column(self, lo: Column | str, hi: Column | str | None = None) -> Column:
        """:meth:`touching` of a key, or of a range of keys, as a long; null for null."""
        own = self

        @F.arrow_udf(LongType())
        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([None if x is None or y is None else own.touching(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())

        return run(lo, lo if hi is None else hi)
