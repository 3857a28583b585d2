"""Byte formats: fixed vectors, round trips and damage."""

import random

import numpy as np
import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from tidemark.errors import Corruption, InvalidArgument
from tidemark.functions import codec


def test_crc32c_vectors():
    for raw, want in ((b"", 0), (b"123456789", 0xE3069283), (b"The quick brown fox jumps over the lazy dog", 0x22620404)):
        assert codec.crc32c(raw) == want == codec.crc32c_batch([raw, b"x" * 70])[0]
    assert codec.crc32c(b"6789", codec.crc32c(b"12345")) == 0xE3069283


@given(st.integers(0, 2**64 - 1))
def test_varints(x):
    raw = codec.put_varint(x)
    assert codec.get_varint(raw + b"\x81") == (x, len(raw))
    with pytest.raises(Corruption):
        codec.get_varint(raw[:-1] if len(raw) > 1 else b"")


def test_varints_that_are_too_large():
    with pytest.raises(Corruption):
        codec.get_varint(codec.put_varint(2**32), 32)
    with pytest.raises(Corruption):
        codec.get_varint(b"\xff" * 11)


@given(st.binary(max_size=300), st.binary(max_size=9))
def test_slices(a, b):
    assert codec.get_slice(codec.put_slice(a) + b) == (a, b)
    with pytest.raises(Corruption):
        codec.get_slice(codec.put_slice(a + b"x")[:-1])


def test_internal_keys():
    for n in (1, 7, 8, 63, 65536):
        for seq in (0, 1, 42, 2**56 - 1):
            for kind in (0, 1):
                assert codec.parse_internal_key(codec.internal_key(b"k" * n, seq, kind)) == (b"k" * n, seq, kind)
    for bad in (b"short", b"key" + bytes([2]) + bytes(7)):
        with pytest.raises(Corruption):
            codec.parse_internal_key(bad)
    with pytest.raises(InvalidArgument):
        codec.internal_key(b"k", 2**56, 1)


def test_bloom_filters():
    held = [i.to_bytes(8, "big") for i in range(20000)]
    made = codec.bloom_build(held, 10)
    assert len(made) == 25001 and made[-1] == 7
    assert codec.bloom_may_hold(held, made).all()
    absent = codec.bloom_may_hold([(i + 2**40).to_bytes(8, "big") for i in range(20000)], made)
    assert 0 < absent.mean() <= 0.02
    assert not codec.bloom_may_hold([b"a"], b"")[0] and codec.bloom_may_hold([b"a"], b"\x07")[0] and codec.bloom_may_hold([b"a"], bytes(8) + b"\x1f")[0]
    assert len(codec.bloom_build([b"a"], 1)) == 9
    with pytest.raises(InvalidArgument):
        codec.bloom_build([b"a"], 65)
    assert [codec.bloom_probes(n) for n in (1, 10, 64)] == [1, 7, 30]


def test_key_hashes_do_not_depend_on_the_batch():
    random.seed(1)
    keys = [random.randbytes(n) for n in range(40)]
    assert (codec.key_hashes(keys) == np.array([codec.key_hashes([k])[0] for k in keys])).all()


def test_columns(spark):
    rows = spark.createDataFrame([(bytearray(b"123456789"), 5, 1), (None, 6, 0)], "k binary, seq long, t int")
    found = rows.select(codec.crc32c_column("k").alias("c"), codec.internal_key_column("k", "seq", "t").alias("i"), codec.pack_trailer(F.col("seq"), F.col("t")).alias("p"), codec.key_hash_column("k").alias("h")).collect()
    assert found[0]["c"] == 0xE3069283 and found[1]["c"] is None and found[1]["h"] is None
    assert bytes(found[0]["i"]) == codec.internal_key(b"123456789", 5, 1) and found[0]["p"] == 5 * 256 + 1
    lengths = spark.createDataFrame([(2**p - 1,) for p in range(0, 63)], "x long").select("x", codec.varint_length(F.col("x")).alias("n")).collect()
    assert all(len(codec.put_varint(r["x"])) == r["n"] for r in lengths)
