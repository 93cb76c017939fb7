"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's adjacent pairs wait in buckets, one per merge rank. Two levels of
bitmaps say which buckets hold something, so find-first-set names the next rank in
constant time; a bucket gives its leftmost position first. Parts form a linked list.
An entry whose pair has changed since is stale and skipped. Work grows as the merges
(times the bucket's logarithm), which suits pre-tokens of any length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.llm.common import in_turn, kept

_LEAF = 8  # bits of a rank that its leaf bitmap tells apart
_LOW = (1 << _LEAF) - 1
_CACHED = 300_000  # pre-tokens of a generation; a worker process remembers the ids of two


class Vocabulary(dict):
    """Pre-token -> its ids as little-endian 32-bit numbers; encodes on first sight.

    The rank file is read from `path`, which all executors must have; it isn't part
    of the repository.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = dict(zip(self.ranks.values(), self.ranks, strict=True))
        self.split = regex.compile(pattern).findall
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= _CACHED:
            self.older = dict(self)  # what is used again comes over from there, the rest goes with the next generation
            self.clear()
        packed = self.older.pop(piece, None)
        if packed is None:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            ids = [whole] if whole is not None else self.merge(raw)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token."""
        ranks, n = self.ranks.get, len(raw)
        after = list(range(1, n + 1))  # linked list of parts by their first byte
        before = list(range(-1, n - 1))
        pair: list[int | None] = [None] * n  # rank of a part and the next one
        buckets: dict[int, list[int]] = {}
        leaves: dict[int, int] = {}
        top = 0

        for at in range(n - 1):
            rank = ranks(raw[at : at + 2])
            if rank is not None:
                pair[at] = rank
                if rank in buckets:
                    buckets[rank].append(at)  # ascending, so a heap already
                else:
                    buckets[rank] = [at]
                    leaf = rank >> _LEAF
                    leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & _LOW)
                    top |= 1 << leaf
        while top:
            leaf = (top & -top).bit_length() - 1
            low = leaves[leaf]
            rank = leaf << _LEAF | (low & -low).bit_length() - 1
            bucket = buckets[rank]
            at = heappop(bucket)
            if not bucket:
                leaves[leaf] = low & low - 1
                if not leaves[leaf]:
                    top &= top - 1
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            after[at] = follows = after[gone]
            pair[gone] = None
            pair[at] = None
            changed = []
            if follows < n:
                before[follows] = at
                changed.append((at, after[follows]))
            if at:
                changed.append((before[at], follows))
            for at, end in changed:
                pair[at] = rank = ranks(raw[at:end])
                if rank is not None:
                    if buckets.get(rank):
                        heappush(buckets[rank], at)
                    else:
                        buckets[rank] = [at]
                        leaf = rank >> _LEAF
                        leaves[leaf] = leaves.get(leaf, 0) | 1 << (rank & _LOW)
                        top |= 1 << leaf
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[raw[at : after[at]]])
            at = after[at]
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, packed."""
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encoded(texts: DataFrame, path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) per row; ids only if asked for.

    A null text is empty and has no ids. Every row is encoded by itself, so repeated
    rows and ids give repeated results; other columns are not read.
    """
    fields = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def rows(vocabulary: Vocabulary, items: Iterable[pa.Scalar]) -> Iterator[tuple]:
        for item in items:
            packed = vocabulary.encode(item.as_py() or "")
            back = hashlib.sha256(vocabulary.decode(packed)).hexdigest()
            yield (len(packed) // 4, hashlib.sha256(packed).hexdigest(), back, *([np.frombuffer(packed, "<i4")] * keep_ids))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = kept(("bpe", path, pattern), lambda: Vocabulary(path, pattern))
        for some in in_turn(parts, 512):
            n, ids, decoded, *lists = zip(*rows(vocabulary, some.column(1)), strict=True)
            arrays = [some.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded), *(pa.array(x, pa.list_(pa.int32())) for x in lists)]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in fields.split(", ")])

    return texts.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(batches, fields)
