"""Removal of passages that already stand in an earlier document.

A window is a run of ``width`` words. Every window of every document gets a Rabin-Karp hash; a window is a repeat if
the same one starts in a document with a smaller id, and the words that repeats cover, merged into maximal
intervals, go.

Shuffling every window's hash would move many times the input, so a first pass leaves out windows that can't be
repeats: each window is stood for by the smallest hash of the shorter runs (``anchor`` words) inside it. Equal windows
have equal smallest runs, so a window whose smallest run stands in one document only has no equal elsewhere. Runs
are about a sixteenth as many as windows, as neighbours share them. The windows that are left are hashed
whole and counted in Spark; the first pass never decides that a window is a repeat.

Whole windows are hashed twice, modulo the prime 2 ** 61 - 1, with bases and word hashes that are drawn anew for every run: windows that
differ agree in both with a probability of about 2 ** -110, whatever the texts.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import PRIME, Rolling, Words, drop, mix, save, slices, span_hashes, texts as strings, window_hashes

WIDTH, ANCHOR = 50, 18
_RUNS = Rolling(0xD1342543DE82EF95)


def _windows(words: Words, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window that lies in one row: its first word, and its smallest run's hash."""
    n = len(words.start)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = _RUNS.prefix(words.hashes())
    at = np.arange(n - anchor + 1)
    low = mix(_RUNS.runs(sums, at, at + anchor))
    span, have = width - anchor + 1, 1
    while have < span:  # smallest of 1, 2, 4, ... neighbours
        step = min(have, span - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    first = np.arange(n - width + 1)
    inside = words.row[first] == words.row[first + width - 1]
    return first[inside], low[inside]


def _whole(words: Words, first: np.ndarray, width: int, draws: list[tuple[int, int]]) -> list[np.ndarray]:
    """The hashes of the windows that start at the words ``first``, one for each (key, base)."""
    n = len(words.start)
    marks = np.zeros(n + 1, np.int64)
    marks[first] += 1
    marks[first + width] -= 1
    covered = np.cumsum(marks[:n]) > 0  # only words of these windows, which stay next to each other
    at = (np.cumsum(covered) - 1)[first]
    start, end = words.start[covered], words.end[covered]
    return [window_hashes(span_hashes(words.data, start, end, key), width, base)[at] for key, base in draws] if len(first) else [np.zeros(0, np.uint64)] * 2


def _unique(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Indices of one of each (row, value)."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    return order[np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (v[1:] != v[:-1])])] if len(order) else order


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _first_pass(width: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            first, low = _windows(words, width, anchor)
            row = words.row[first]
            change = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (row[1:] != row[:-1])]) if len(low) else np.zeros(0, np.int64)
            row, low = row[change], low[change]
            keep = _unique(row, low)
            yield pa.RecordBatch.from_arrays([_long(low[keep]), batch.column("digest").take(pa.array(row[keep]))], ["h", "digest"])

    return run


def _second_pass(width: int, anchor: int, draws: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"))
            first, low = _windows(words, width, anchor)
            row = words.row[first]
            flags = batch.column("flags")
            ends = flags.offsets.to_numpy()
            values = flags.values.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows, dtype=np.uint64), np.diff(ends))
            with np.errstate(over="ignore"):
                hit = np.isin(mix(row.astype(np.uint64) + _SALT) ^ low, mix(owner + _SALT) ^ values)
            first, row = first[hit], row[hit]
            whole = _whole(words, first, width, draws)
            at = pa.array(row)
            position = (first - words.first[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*map(_long, whole), batch.column("doc_id").take(at), batch.column("digest").take(at), pa.array(position)], ["h", "i", "doc_id", "digest", "position"])

    return run


_SALT = np.uint64(0xA24BAED4963EE407)


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, digest, copy, starts): what is repeated in each row of ``docs`` (doc_id, text, digest), where anything is.

    copy: the whole text stands in an earlier document (by its SHA-256). starts: else, the first words of its windows that start in an
    earlier document too. Of equal texts the one with the smallest doc_id stands for all, so large groups of copies
    cost as much as one text. All counts are grouped minima and maxima (combined before the shuffle), all look-ups
    equality joins whose hot keys Spark splits.
    """
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null")
    ids = save(known.select("doc_id", "digest", F.unhex(F.sha2("text", 256)).alias("whole")).distinct(), "ids", spark)
    firsts = save(ids.groupBy("whole").agg(F.min("doc_id").alias("first_id"), F.min("digest").alias("digest")), "firsts", spark)

    # Runs that stand in two texts or more, and for each text the ones it has.
    anchors = save(known.mapInArrow(_first_pass(width, anchor), "h long, digest long"), "anchors", spark)
    shared = anchors.groupBy("h").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select(F.col("h").alias("k"))
    shared = save(shared, "anchors-shared", spark)  # written, so that Spark can split hot keys of the join
    flags = anchors.join(shared, F.col("h") == F.col("k")).groupBy("digest").agg(F.collect_set("h").alias("flags"))
    flags = save(flags.join(firsts.drop("whole"), "digest").select(F.col("first_id").alias("d"), F.col("digest").alias("g"), "flags"), "flags", spark)
    drop(anchors, shared)

    # The windows that may be repeats, whole.
    draws = [(secrets.randbits(64), secrets.randbelow(PRIME - 2) + 2) for _ in range(2)]
    marked = known.join(flags.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("digest") == F.col("g"))).select("doc_id", "text", "digest", "flags")
    windows = save(marked.mapInArrow(_second_pass(width, anchor, draws), "h long, i long, doc_id long, digest long, position int"), "windows", spark)
    drop(flags)
    earliest = windows.groupBy("h", "i").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(F.col("h").alias("k"), F.col("i").alias("l"), "a")
    earliest = save(earliest, "windows-earliest", spark)
    found = windows.join(earliest, (F.col("h") == F.col("k")) & (F.col("i") == F.col("l"))).where("doc_id > a")
    starts = found.groupBy("doc_id", "digest").agg(F.collect_set("position").alias("starts"))
    copies = ids.join(firsts.drop("digest"), "whole").where("doc_id > first_id").select("doc_id", "digest", F.lit(None).cast("array<int>").alias("starts"))
    out = save(starts.union(copies).select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("starts").isNull().alias("copy"), "starts"), "repeats", spark)
    drop(windows, earliest, ids, firsts)
    return out


def remove_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text, n_words, n_removed, removed): every row of ``docs`` without the words of repeated passages.

    Words are ``[^\x20\x09-\x0D]+``, unchanged; text is the kept words joined by one space; removed lists the
    maximal intervals of words that went, as structs of start and end (exclusive). Texts of fewer words than a
    window stay. Rows of one doc_id don't make each other repeats. A null doc_id is before and after no other, so
    such rows keep all words and make no repeats; a null text has no words and gives an empty text; an empty table gives an empty
    one; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text", F.md5("text")).alias("digest"))
    found = repeats(rows, width, anchor)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            kept, n_words, n_removed, removed = [], [], [], []
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            for text, copy, starts in zip(raw, batch.column("copy").to_pylist(), batch.column("starts"), strict=True):
                words = text.split() if text else []
                spans = []
                if copy and len(words) >= width:
                    spans = [(0, len(words))]
                elif starts.is_valid:
                    first = np.sort(starts.values.to_numpy())
                    cuts = np.flatnonzero(first[1:] > first[:-1] + width)
                    spans = list(zip(first[np.r_[0, cuts + 1]].tolist(), (first[np.r_[cuts, len(first) - 1]] + width).tolist(), strict=True))
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
                for a, b in reversed(spans):
                    del words[a:b]
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "text", "n_words", "n_removed", "removed"],
            )

    both = rows.join(found.hint("shuffle_hash"), (F.col("doc_id") == F.col("d")) & (F.col("digest") == F.col("g")), "left").select("doc_id", "text", "copy", "starts")
    return both.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:int,end:int>>")


def op6(spark, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))
