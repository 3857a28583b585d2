"""Packing of documents into training sequences by best-fit decreasing.

Documents longer than a window are first cut into full windows. What is left, and every shorter document, is a piece
of 1 to ``window`` tokens. Best-fit decreasing takes pieces from long to short and puts each in the open sequence with
the least room that still holds it; a segment tree indexed by remaining capacity finds that sequence.

Pieces of one length are alike, so the packing is computed from the count of each length alone (at most ``window``
numbers, whatever the input): a run of sequences with the same room takes pieces as a block. Each piece then looks its
place up by its length and its rank among the pieces of that length. The result is the one that piece-by-piece
best-fit decreasing gives.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ._common import flat, lower_ascii, save, slices, span_hashes, texts

WINDOW = 2048
#: Runs that a Python worker remembers; beyond them it starts anew. Bounds memory only, never results.
CACHED_RUNS = 1_500_000
_PART = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


_LETTER, _DIGIT, _MARK = 1, 2, 3
_CLASS = np.full(256, _MARK, np.int8)
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
#: Bytes of words that are kept in one piece: apostrophes, and all but ASCII and the two-byte letters from U+00C0 to U+024F.
_ODD = np.zeros(256, bool)
_ODD[[39, *range(0xC0, 0xC3), *range(0xCA, 256)]] = True


class WordTokenizer:
    """Ids of whole texts by a tokenizer file that lower-cases, parts runs of letters, digits and other marks, and never
    joins across a space.

    Each Arrow batch is cut at those places with numpy (words with apostrophes or letters beyond Latin only at spaces),
    and only runs that this worker has not met are tokenized, many at a time, with a special token between them that
    ordinary text can't produce. Known runs are found by a 64-bit hash in one sorted array, and a second one must agree; both
    have keys that each worker draws. Where they don't agree, the batch is tokenized text by text. Strings of special tokens
    in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.mark, self.mark_id = min(special.items(), key=lambda x: x[1])
        self.secret = secrets.randbits(64), secrets.randbits(64)
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, runs: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(0, len(runs), 1000):
            part = runs[i : i + 1000]
            if any(self.mark[:2] in x and len(x) > 2 for x in part):  # could be taken for a special token
                self.tokenizer.encode_special_tokens = True
                out += [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in part]
                continue
            self.tokenizer.encode_special_tokens = False
            ids = np.array(self.tokenizer.encode(self.mark.join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == self.mark_id)
            out += [ids[a:b] for a, b in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        return out

    def _learn(self, keys: np.ndarray, checks: np.ndarray, runs: list[str]) -> None:
        found = self._encode(runs)
        count = np.array([len(x) for x in found], np.int64)
        first = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate([self.pool, *found])
        keys, checks = np.concatenate([self.keys, keys]), np.concatenate([self.checks, checks])
        order = np.argsort(keys, kind="stable")
        self.checks = checks[order]
        self.keys, self.first, self.count = keys[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers; a null is empty."""
        if len(self.keys) > CACHED_RUNS or len(self.pool) > 8 * CACHED_RUNS:
            self.clear()
        data, offsets = flat(column)
        kind = _CLASS[data]
        before = np.zeros_like(kind)
        before[1:] = kind[:-1]
        edge = offsets[1:-1][offsets[1:-1] < len(data)]  # where a text starts
        before[edge] = 0
        starts = (kind != 0) & (kind != before)
        odd = _ODD[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0)
        if odd.any():
            word = np.cumsum((kind != 0) & (before == 0))
            starts &= (before == 0) | ~np.isin(word, np.unique(word[odd]))
        stops = kind != 0
        stops[:-1] &= (kind[1:] == 0) | starts[1:]
        start, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        lowered = lower_ascii(data)
        inverse, unique = pd.factorize(span_hashes(lowered, start, end, self.secret[0]))
        checks = span_hashes(lowered, start, end, self.secret[1])
        at = np.empty(len(unique), np.int64)
        at[inverse[::-1]] = np.arange(len(inverse))[::-1]
        place = np.searchsorted(self.keys, unique)
        new = np.ones(len(unique), bool)
        new[place < len(self.keys)] = self.keys[place[place < len(self.keys)]] != unique[place < len(self.keys)]
        if new.any():
            raw = data.tobytes()
            runs = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            self._learn(unique[new], checks[at[new]], runs)
            place = np.searchsorted(self.keys, unique)
        if (self.checks[place][inverse] != checks).any():
            self.tokenizer.encode_special_tokens = True
            return [np.array(self.tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts(column)]
        lengths = self.count[place][inverse]
        upto = np.r_[0, np.cumsum(lengths)]
        ids = self.pool[np.repeat(self.first[place][inverse] - upto[:-1], lengths) + np.arange(upto[-1])].astype("<u4").tobytes()
        rows = (4 * upto[np.searchsorted(start, offsets)]).tolist()
        return [ids[a:b] for a, b in zip(rows, rows[1:])]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each file and Python worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path if os.path.exists(path) else SparkFiles.get(path.rsplit("/", 1)[-1]))


def pieces(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, part and nth (the piece's rank in
    its partition among those of its length); with_ids adds ids, little-endian 32-bit numbers in one binary."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = tokenizer(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches, "text"):
            rows: list[tuple] = []
            ids_of: list[bytes] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, window):
                    own = raw[4 * start : 4 * (start + window)]
                    length = len(own) // 4
                    rows.append((doc, start, length, zlib.crc32(own), total, part, int(seen[length])))
                    seen[length] += 1
                    if with_ids:
                        ids_of.append(own)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.int32() if i == 5 else pa.int64()) for i, c in enumerate(columns)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            if with_ids:
                arrays.append(pa.array(ids_of, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PART + (", ids binary" if with_ids else ""))


class RoomTree:
    """A segment tree over remaining capacities 0 to ``window``: is there an open sequence with such room?"""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.has = [False] * (2 * self.size)

    def mark(self, room: int, present: bool) -> None:
        node = room + self.size
        self.has[node] = present
        while node > 1:
            node //= 2
            self.has[node] = self.has[2 * node] or self.has[2 * node + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest room of ``least`` or more, or None."""
        node = least + self.size
        if self.has[node]:
            return least
        while node > 1:
            if node % 2 == 0 and self.has[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.has[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


@dataclass
class Plan:
    """Where pieces go. Block i holds the pieces of one length with ranks from ``rank[i]`` on (blocks are ordered by
    length, then rank): ``each[i]`` of them in every sequence from ``sequence[i]`` on, the first at ``offset[i]``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence_id, offset) of pieces by their length and rank."""
        first = np.searchsorted(self.length, length, side="left")
        last = np.searchsorted(self.length, length, side="right")
        while len(length) and (first + 1 < last).any():  # binary search for the last block whose rank isn't larger
            middle = (first + last) // 2
            up = (first + 1 < last) & (self.rank[np.minimum(middle, len(self.rank) - 1)] <= rank)
            last = np.where((first + 1 < last) & ~up, middle, last)
            first = np.where(up, middle, first)
        nth = rank - self.rank[first]
        return self.sequence[first] + nth // self.each[first], self.offset[first] + nth % self.each[first] * length


def best_fit_decreasing(counts: dict[int, int], window: int = WINDOW) -> Plan:
    """Pack ``counts[length]`` pieces of each length. Work and result grow with the number of lengths, not of pieces."""
    tree, open_ = RoomTree(window), {}
    blocks: list[tuple[int, int, int, int, int]] = []  # length, rank, sequence, each, offset
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_.setdefault(room, []).append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # as many new sequences as the rest needs
                room, n = window, -(-left // (window // length))
                first, made = made, made + n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            blocks.append((length, rank, first, each, window - room))
            if full:
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, full)
            if full < n:
                if left:  # one sequence takes the last few
                    if full:
                        blocks.append((length, rank, first + full, each, window - room))
                    put(room - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                put(room, first + full, n - full)
    blocks.sort()
    columns = [np.array(c, np.int64) for c in zip(*blocks, strict=True)] if blocks else [np.zeros(0, np.int64)] * 5
    return Plan(*columns, sequences=made)


def pack(docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pack all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids), a row per piece.

    A null text is empty and is packed as its end id alone; a null doc_id stays null; documents with the same doc_id are
    packed each on its own; other columns are ignored; an empty table gives no rows. Sequences are numbered from 0
    without gaps and no piece is larger than a sequence. The tokenized pieces are written once (a lost task is redone
    with its own ranks); only the counts by length (at most ``window`` rows) reach the driver. The look-up table
    that is broadcast holds a few blocks per length, whatever the number of pieces.
    """
    spark = docs.sparkSession
    cut = save(pieces(docs, path, end_id, window, with_ids), "pieces", spark)
    by_part = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(best_fit_decreasing(counts, window))
    before = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("earlier"))
    ranked = cut.join(before, ["length", "part"]).withColumn("rank", F.col("earlier") + F.col("nth"))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        found = plan.value.place(length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    out = ranked.withColumn("at", place("length", "rank"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def op2(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, tokenizers.path("word_bpe_49k.json"), with_ids=False)
