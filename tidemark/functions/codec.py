"""Byte formats: fixed and variable-length integers, internal keys, CRC-32C and Bloom filters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BinaryType, LongType

from ..errors import Corruption, InvalidArgument
from ..options import DELETE, MAX_SEQUENCE, PUT

# The Castagnoli polynomial (reflected), the key hash's seed and multiplier, and the step of a hash without one.
CASTAGNOLI = 0x82F63B78
HASH_SEED = 0xBC9F1D34
HASH_FACTOR = 0xC6A4A793
BLOOM_STEP = 0x9E3779B9
BLOOM_LEAST_BITS, BLOOM_MOST_PROBES = 64, 30


def put_fixed(x: int, size: int) -> bytes:
    """A little-endian number of 4 or 8 bytes."""
    return x.to_bytes(size, "little")


def put_varint(x: int) -> bytes:
    """Seven bits a byte, from the lowest; the high bit says that more follow."""
    out = bytearray()
    while x >= 128:
        out.append(x & 127 | 128)
        x >>= 7
    out.append(x)
    return bytes(out)


def get_varint(raw: bytes, bits: int = 64) -> tuple[int, int]:
    """(number, bytes read); raises Corruption if it is cut off or needs more than ``bits`` bits."""
    value = 0
    for i, b in enumerate(raw[: -(-bits // 7)]):
        value |= (b & 127) << 7 * i
        if b < 128:
            if value >> bits:
                break
            return value, i + 1
    raise Corruption("bad variable-length integer")


def varint_length(x: Column, most: int = 9) -> Column:
    """Bytes of a non-negative number as a variable-length integer, up to nine; numbers that need more than ``most`` count as that."""
    out = F.lit(most)
    for n in range(most - 1, 0, -1):
        out = F.when(x < F.lit(1 << 7 * n), n).otherwise(out)
    return out


def put_slice(raw: bytes) -> bytes:
    return put_varint(len(raw)) + raw


def get_slice(raw: bytes) -> tuple[bytes, bytes]:
    """(bytes, rest) of a length-prefixed run of bytes."""
    n, used = get_varint(raw, 32)
    if len(raw) < used + n:
        raise Corruption("a slice is cut off")
    return raw[used : used + n], raw[used + n :]


def entry_size(kind: int, key: bytes, value: bytes) -> int:
    """Bytes of one mutation in a batch."""
    return 1 + len(put_slice(key)) + (len(put_slice(value)) if kind == PUT else 0)


def pack_trailer(seq: Column, kind: Column) -> Column:
    """Sequence and kind in one number, ordered by sequence, then kind."""
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long"))


def trailer_sequence(trailer: Column) -> Column:
    return F.shiftrightunsigned(trailer, 8)


def trailer_kind(trailer: Column) -> Column:
    return trailer.bitwiseAND(F.lit(255)).cast("int")


def internal_key(key: bytes, seq: int, kind: int) -> bytes:
    """The key, then eight little-endian bytes of its trailer."""
    if not 0 <= seq <= MAX_SEQUENCE or kind not in (PUT, DELETE):
        raise InvalidArgument("bad sequence or kind")
    return key + put_fixed(seq << 8 | kind, 8)


def parse_internal_key(raw: bytes) -> tuple[bytes, int, int]:
    if len(raw) < 8 or raw[-8] not in (PUT, DELETE):
        raise Corruption("bad internal key")
    return raw[:-8], int.from_bytes(raw[-7:], "little"), raw[-8]


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> 1 ^ np.uint32(CASTAGNOLI), x >> 1).astype(np.uint32)
    return x


def crc32c(data: bytes, start: int = 0) -> int:
    """CRC-32C of ``data``, going on from the checksum of what came before."""
    table, x = _crc_table().tolist(), start ^ 0xFFFFFFFF
    for b in data:
        x = x >> 8 ^ table[(x ^ b) & 255]
    return x ^ 0xFFFFFFFF


def _padded(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(r) for r in rows], np.int64)
    wide = -(-int(lengths.max(initial=0)) // 4) * 4
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rows), np.uint8).reshape(len(rows), wide), lengths


def crc32c_batch(rows: list[bytes]) -> np.ndarray:
    """CRC-32C of many rows at once, one byte column at a time."""
    raw, lengths = _padded(rows)
    table, x = _crc_table(), np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for i in range(raw.shape[1]):
        x = np.where(i < lengths, x >> 8 ^ table[(x ^ raw[:, i]) & 255], x)
    return (x ^ np.uint32(0xFFFFFFFF)).astype(np.int64)


def key_hashes(rows: list[bytes]) -> np.ndarray:
    """The 32-bit key hash of many rows at once: words of four bytes are added, multiplied and folded; up to three bytes that are left, once more."""
    raw, lengths = _padded(rows)
    factor = np.uint32(HASH_FACTOR)
    words = raw.view("<u4") if raw.shape[1] else np.zeros((len(rows), 0), np.uint32)
    with np.errstate(over="ignore"):
        h = np.uint32(HASH_SEED) ^ lengths.astype(np.uint32) * factor
        for i in range(words.shape[1]):
            step = (h + words[:, i]) * factor
            whole = 4 * (i + 1) <= lengths
            partial = ~whole & (4 * i < lengths)  # zero padding adds nothing
            h = np.where(whole, step ^ step >> np.uint32(16), np.where(partial, step ^ step >> np.uint32(24), h))
    return h


def bloom_probes(bits_per_key: int) -> int:
    """Probes for a number of bits a key: bits * ln 2, rounded, 1 to 30."""
    return min(max(round(bits_per_key * 0.693147), 1), BLOOM_MOST_PROBES)


def _positions(hashes: np.ndarray, probes: int, bits: int) -> np.ndarray:
    step = hashes >> np.uint32(17) | hashes << np.uint32(15)
    step = np.where(step == 0, np.uint32(BLOOM_STEP), step)
    with np.errstate(over="ignore"):
        return (hashes[:, None] + step[:, None] * np.arange(probes, dtype=np.uint32)[None, :]) % np.uint32(bits)


def bloom_build(keys: list[bytes], bits_per_key: int) -> bytes:
    """A Bloom filter of the keys: its bits, then a byte with the number of probes. Nothing for no keys."""
    if not 1 <= bits_per_key <= 64:
        raise InvalidArgument("bits per key must be 1 to 64")
    if not keys:
        return b""
    size = -(-max(len(keys) * bits_per_key, BLOOM_LEAST_BITS) // 8)
    set_ = np.zeros(8 * size, np.uint8)
    set_[_positions(key_hashes(keys), bloom_probes(bits_per_key), 8 * size)] = 1
    return np.packbits(set_, bitorder="little").tobytes() + bytes([bloom_probes(bits_per_key)])


def bloom_may_hold(keys: list[bytes], filter_: bytes) -> np.ndarray:
    """May each key be in the filter? An empty filter holds nothing; one that can't be understood may hold all."""
    if len(filter_) < 2 or filter_[-1] > BLOOM_MOST_PROBES:
        return np.full(len(keys), len(filter_) > 0)
    set_ = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little")
    return set_[_positions(key_hashes(keys), filter_[-1], len(set_))].all(axis=1)


def crc32c_column(column: Column | str) -> Column:
    """CRC-32C of a binary column, as a long."""

    @F.arrow_udf(LongType())
    def run(batch: pa.Array) -> pa.Array:
        found = crc32c_batch([x or b"" for x in batch.to_pylist()])
        return pa.array(found, mask=np.array(batch.is_null()))

    return run(column)


def key_hash_column(column: Column | str) -> Column:
    """The key hash of a binary column, as an unsigned number in a long."""

    @F.arrow_udf(LongType())
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(key_hashes([x or b"" for x in batch.to_pylist()]).astype(np.int64), mask=np.array(batch.is_null()))

    return run(column)


def internal_key_column(key: Column | str, seq: Column | str, kind: Column | str) -> Column:
    """The internal keys of a log's rows, as binary."""

    @F.arrow_udf(BinaryType())
    def run(k: pa.Array, s: pa.Array, t: pa.Array) -> pa.Array:
        rows = zip(k.to_pylist(), s.to_pylist(), t.to_pylist(), strict=True)
        return pa.array([None if None in r else internal_key(*r) for r in rows], pa.binary())

    return run(key, seq, kind)
