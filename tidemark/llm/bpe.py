"""Byte-level BPE encoding and decoding.

Each piece of a text (a match of the pre-tokenizer's pattern) is merged on its own. A segment tree over the piece's
byte positions keeps, at every node, the leftmost smallest pair rank below it; a merge takes the root's pair, then
makes point updates, each as long as the tree is high, for the pair that starts at the merged token, the pair that
ends there and the position that is gone. Trees of many pieces of like length are worked in lockstep by numpy.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ._common import slices, texts

#: Pieces remembered by a Python worker; when full it starts anew. Bounds memory only, never results.
CACHED_PIECES = 300_000
#: Cells (pieces times positions) of the trees that are worked at once.
CELLS = 1 << 16
#: Fewer pieces than this are merged one by one.
ALONE = 8
_NONE = np.int64(1) << np.int64(62)


class BytePairEncoder:
    """Encodes as a rank file says: ``ranks`` maps a token's bytes to its rank, which is also its id.

    Every single byte must have a rank. A piece that is a token as a whole is that token. Empty texts have no ids.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.cache: dict[str, tuple[int, ...]] = {}
        # every way to put a token together from two: (left id, right id) -> id
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; a very large one where they don't make a token. -1: no token there."""
        key = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == key), self.values[at], _NONE)

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each non-empty piece, by one tree for each; all pieces should be of like length."""
        if len(pieces) < ALONE:
            return [self.merge_one(p) for p in pieces]
        count, size = len(pieces), 1 << max(1, (max(map(len, pieces)) - 1).bit_length())
        lengths = np.array([len(p) for p in pieces], np.int64)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(count, size)
        place = np.arange(size, dtype=np.int64)
        ids = np.where(place < lengths[:, None], self.byte[raw], -1)
        after = np.tile(place + 1, (count, 1))  # the next live position; size: none
        before = np.tile(place - 1, (count, 1))
        shift = np.int64(size.bit_length())
        tree = np.full((count, 2 * size), _NONE, np.int64)  # rank and position in one number: the least is the leftmost of the smallest
        right = np.concatenate([ids[:, 1:], np.full((count, 1), -1)], axis=1)
        pair = self._rank(ids, right)
        tree[:, size:] = np.where(pair < _NONE, pair << shift | place, _NONE)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        live = np.flatnonzero(tree[:, 1] < _NONE)
        last = np.int64(size - 1)
        while len(live):
            top = tree[live, 1]
            at = top & (np.int64(1) << shift) - 1
            gone = after[live, at]
            follows = after[live, gone]
            ids[live, at], ids[live, gone] = top >> shift, -1
            after[live, at] = follows
            inner = follows < size
            before[live[inner], follows[inner]] = at[inner]
            leads = before[live, at]
            nxt = np.where(inner, ids[live, np.minimum(follows, last)], -1)
            own = self._rank(ids[live, at], nxt)
            left = np.where(leads >= 0, ids[live, np.maximum(leads, 0)], -1)
            prior = self._rank(left, ids[live, at])
            lead = leads >= 0
            rows = np.concatenate([live, live, live[lead]])
            node = np.concatenate([gone, at, leads[lead]]) + size
            tree[rows, node] = np.concatenate([np.full(len(live), _NONE), np.where(own < _NONE, own << shift | at, _NONE), np.where(prior < _NONE, prior << shift | leads, _NONE)[lead]])
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            live = live[tree[live, 1] < _NONE]
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one piece, by the same tree in plain Python."""
        n, none, rank_of = len(piece), 1 << 62, self.ranks.get
        size = 1 << max(1, (n - 1).bit_length())
        shift = size.bit_length()
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank << shift | i
        for node in range(size - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b

        def update(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                value = a if a < b else b
                if tree[node] == value:
                    break
                tree[node] = value

        while tree[1] < none:
            at = tree[1] & (1 << shift) - 1
            gone = after[at]
            follows = after[at] = after[gone]
            update(gone, none)
            rank = None
            if follows < n:
                before[follows] = at
                rank = rank_of(piece[at : after[follows]])
            update(at, none if rank is None else rank << shift | at)
            lead = before[at]
            if lead >= 0:
                rank = rank_of(piece[lead:follows])
                update(lead, none if rank is None else rank << shift | lead)
        out, at = [], 0
        while at < n:
            out.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of pieces in the cache."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.cache[piece] = (whole,)
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, group in by_size.items():
            step = max(1, CELLS >> bits)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                for (piece, _), found in zip(part, self.merge([raw for _, raw in part]), strict=True):
                    self.cache[piece] = tuple(found)

    def encode_batch(self, batch: list[str | None]) -> list[list[int]]:
        split = [self.pattern.findall(t) if t else [] for t in batch]
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        cache = self.cache
        self.learn(set(chain.from_iterable(split)).difference(cache))
        return [list(chain.from_iterable(map(cache.__getitem__, pieces))) for pieces in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> BytePairEncoder:
    """One encoder for each file and Python worker. The path is that of an installed vocabulary or of a file added to the job."""
    try:
        return BytePairEncoder(read_ranks(ranks_path), pattern)
    except FileNotFoundError:
        return BytePairEncoder(read_ranks(SparkFiles.get(ranks_path.rsplit("/", 1)[-1])), pattern)


def encode_batches(batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text) as (key, ids); about a megabyte of text at a time."""
    coder = encoder(ranks_path, pattern)
    for part in slices(batches, "text"):
        ids = coder.encode_batch(texts(part.column("text")))
        ends = np.cumsum([0, *map(len, ids)])
        values = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], [part.schema.names[0], "ids"])


def decode_batches(batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of (key, ids) as (key, text), the bytes that the ids stand for; null for null."""
    coder = encoder(ranks_path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else coder.decode(x) for x in part.column("ids").to_pylist()], pa.binary())], [part.schema.names[0], "text"])


def digest_batches(batches: Iterable[pa.RecordBatch], ranks_path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Batches of (key, ids) as (key, n_tokens, ids_sha256, decoded_sha256)."""
    coder = encoder(ranks_path, pattern)
    names = _decimal(len(coder.table))
    for batch in batches:
        ends, values = batch.column("ids").offsets.to_numpy().tolist(), batch.column("ids").values
        counts, shas, decoded = [], [], []
        for a, b in zip(ends, ends[1:]):
            own = values.slice(a, b - a).to_numpy().tolist()
            counts.append(len(own))
            shas.append(hashlib.sha256(b" ".join(map(names.__getitem__, own))).hexdigest())
            decoded.append(hashlib.sha256(coder.decode(own)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())], [batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every document; other columns are ignored. A null text has no ids; a null key and
    repeated rows are kept as they are; an empty table gives an empty one. Narrow: no shuffle."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda batches: encode_batches(batches, ranks_path, pattern), f"key {rows.dtypes[0][1]}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from :func:`encode`'s result: the exact bytes of every text that is valid UTF-8; null for null."""
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    found = rows.mapInArrow(lambda batches: decode_batches(batches, ranks_path, pattern), f"key {rows.dtypes[0][1]}, text binary")
    return found.select(F.col("key").alias(key), F.col("text").cast("string").alias("text"))


@lru_cache(maxsize=2)
def _decimal(n: int) -> list[bytes]:
    return [b"%d" % i for i in range(n)]


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document. Encoding, decoding and digests share one pass, so that ids don't leave Python."""
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rows.mapInArrow(lambda batches: digest_batches(encode_batches(batches, path, pattern), path, pattern), f"doc_id {rows.dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
