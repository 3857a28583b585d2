"""Atomic batches: building, checking and numbering of mutations."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..errors import InvalidArgument
from ..functions.codec import entry_size, varint_length
from ..options import DELETE, MAX_BATCH_BYTES, MAX_BATCH_COUNT, MAX_KEY_BYTES, MAX_SEQUENCE, PUT
from .ordering import global_row_number


class WriteBatch:
    """An ordered list of puts and deletes that become visible together. Keys are str, bytes or int; values are tuples or single values."""

    def __init__(self) -> None:
        self._entries: list[tuple[int, Any, Any]] = []
        self.sequence = 0

    def put(self, key, value) -> WriteBatch:
        if len(self._entries) < MAX_BATCH_COUNT:
            self._entries.append((PUT, key, value))
        return self

    def delete(self, key) -> WriteBatch:
        if len(self._entries) < MAX_BATCH_COUNT:
            self._entries.append((DELETE, key, None))
        return self

    def clear(self) -> None:
        self._entries, self.sequence = [], 0

    def __len__(self) -> int:
        return len(self._entries)

    def byte_size(self) -> int:
        """12 bytes of header and the entries."""
        return 12 + sum(entry_size(t, _raw(k), _raw(v)) for t, k, v in self._entries)

    def iterate(self, put: Callable, delete: Callable) -> None:
        """Call put(key, value) or delete(key) for each entry, in order."""
        for t, k, v in self._entries:
            put(k, v) if t == PUT else delete(k)

    def validate(self) -> tuple[int, int, int]:
        """(entries, entry bytes, key and value bytes); raises InvalidArgument for an empty or oversized batch or a bad key."""
        if not self._entries:
            raise InvalidArgument("the batch is empty")
        size = user = 0
        for t, k, v in self._entries:
            key, value = _raw(k), _raw(v)
            if not 1 <= len(key) <= MAX_KEY_BYTES:
                raise InvalidArgument(f"a key has {len(key)} bytes")
            size += entry_size(t, key, value)
            user += len(key) + len(value)
        if size + 16 > MAX_BATCH_BYTES:
            raise InvalidArgument(f"the batch has {size} bytes")
        return len(self._entries), size, user

    def frame(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The mutations as a DataFrame: ord, t and the columns of ``schema`` (the key, then the payload)."""
        width = len(schema.fields) - 1
        rows = []
        for i, (t, k, v) in enumerate(self._entries):
            payload = (None,) * width if t == DELETE else tuple(v) if width > 1 or isinstance(v, (tuple, list)) else (v,)
            rows.append((i, t, k, *payload))
        fields = [StructField("ord", LongType(), False), StructField("t", IntegerType(), False), *[StructField(f.name, f.dataType, True) for f in schema.fields]]
        return spark.createDataFrame(rows, StructType(fields))


def _raw(x) -> bytes:
    if x is None:
        return b""
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, int) and not isinstance(x, bool):
        return (x & (1 << 64) - 1).to_bytes(8, "big")
    return str(x).encode()


def batch_summary(mutations: DataFrame, key: str, value: str, kind: str = "t") -> DataFrame:
    """One row about a batch: entries, entry bytes, key and value bytes, the longest key, and whether it is within all limits."""
    k, v = F.octet_length(key), F.coalesce(F.octet_length(value), F.lit(0))
    size = 1 + varint_length(k) + k + F.when(F.col(kind) == PUT, varint_length(v) + v).otherwise(0)
    user = k + F.when(F.col(kind) == PUT, v).otherwise(0)
    found = mutations.agg(
        F.count(F.lit(1)).alias("n_entries"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("entry_bytes"), F.coalesce(F.sum(user), F.lit(0)).cast("long").alias("user_bytes"),
        F.coalesce(F.max(k), F.lit(0)).cast("long").alias("longest_key"), F.coalesce(F.min(k), F.lit(0)).cast("long").alias("shortest_key"),
    )
    fine = F.col("n_entries").between(1, MAX_BATCH_COUNT) & (F.col("entry_bytes") + 16 <= MAX_BATCH_BYTES) & (F.col("shortest_key") >= 1) & (F.col("longest_key") <= MAX_KEY_BYTES)
    return found.withColumn("valid", fine)


def assign_sequences(mutations: DataFrame, order: list[str], last: int, name: str = "seq") -> DataFrame:
    """The mutations with consecutive sequences from last + 1, in the order given; numbered in parallel over ranges."""
    if last < 0 or last > MAX_SEQUENCE:
        raise InvalidArgument("the last sequence is out of range")
    return global_row_number(mutations, order, name, base=last)
