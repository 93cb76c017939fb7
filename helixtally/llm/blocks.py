"""Repeated word windows by fixed-block anchors.

The reference index holds every document's non-overlapping blocks of 7 words. Every
rolling window of 7 words probes it; a repeat of 13 words contains a whole block,
wherever it begins. Hits are then extended to maximal exact repeats: around each, the
13-word windows are compared, and neighbouring repeated windows make one span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from helixtally.llm.common import partitions
from helixtally.llm.slices import Sent, Slice, aligned, answered, answers, bits, bounds_of, cut, first_names, more_names

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
_CACHED = 1_000_000  # words whose hashes a task remembers
_ODD = np.random.default_rng(7).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class _Text:
    """The words of a slice in a row: hashes, and where each document begins and ends."""

    def __init__(self, made: Slice, known: _Words) -> None:
        self.words = [t.split() for t in made.texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        self.hash = np.fromiter((known[w] for words in self.words for w in words), np.uint64, int(sizes.sum()))
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.left = self.stops[self.doc] - np.arange(len(self.doc))  # words from here to the document's end
        self.valid = made.valid[self.doc]

    def windows(self, n: int) -> np.ndarray:
        """The hash of the n words from each position on; only right where the document has them."""
        total = len(self.hash)
        out = np.zeros(total, np.uint64)
        for j in range(n):
            out[: max(0, total - j)] += self.hash[j:] * _ODD[j]
        out ^= out >> np.uint64(32)
        out *= np.uint64(0x9E3779B97F4A7C15)
        return out ^ (out >> np.uint64(29))


_FLAGS = np.uint64(3)


def _block_names(text: _Text) -> tuple[np.ndarray, Sent]:
    """Names of all 7-word windows (two low bits free), and what is sent: whether a name is a block, whether it repeats here."""
    names = text.windows(BLOCK) & ~_FLAGS
    at = np.nonzero((text.left >= BLOCK) & text.valid)[0]
    block = ((at - text.starts[text.doc[at]]) % BLOCK == 0).astype(np.uint64)
    keys = np.sort(names[at] | block)
    own = keys & ~_FLAGS
    first = np.nonzero(np.concatenate(([True], own[1:] != own[:-1])))[0] if len(own) else np.zeros(0, np.int64)
    last = np.concatenate((first[1:], [len(own)])) - 1 if len(own) else first
    distinct = own[first]
    body = (distinct | (keys[last] & np.uint64(1)) << np.uint64(1) | (last > first).astype(np.uint64)).astype("<u4")
    return names, (distinct, body)


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))[0]


def _hits(bodies: list[bytes]) -> list[bytes]:
    """A name is hit if it is a block somewhere and occurs twice or more."""
    parts = [np.frombuffer(b, "<u4") for b in bodies]
    every = np.concatenate(parts)
    order = np.argsort(every >> 2, kind="stable")
    found = every[order]
    first = _groups(found >> 2)
    size = np.diff(np.concatenate((first, [len(found)])))
    hit = (np.bitwise_or.reduceat(found, first) & 2 > 0) & ((size > 1) | (found[first] & 1 > 0))
    mask = np.empty(len(every), np.bool_)
    mask[order] = np.repeat(hit, size)
    return [bits(m) for m in np.split(mask, np.cumsum([len(p) for p in parts])[:-1])]


_PAIR = np.dtype([("name", "<u8"), ("doc", "<i8")])


def _window_names(made: Slice, text: _Text, hits: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray, Sent]:
    """Positions and names of the 13-word windows with a hit inside; sent: each name's smallest doc_id here."""
    names, (distinct, _) = _block_names(text)
    mask = aligned(distinct, hits, buckets)
    hit = np.zeros(len(names) + 1, np.int64)
    if mask.any():
        wanted = distinct[mask]
        place = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
        hit[1:] = np.cumsum((wanted[place] == names) & (text.left >= BLOCK) & text.valid)
    at = np.nonzero((text.left >= WINDOW) & text.valid)[0]
    at = at[hit[at + WINDOW - BLOCK + 1] > hit[at]]
    own = text.windows(WINDOW)[at]
    docs = made.ids[text.doc[at]]
    order = np.lexsort((docs, own))
    first = _groups(own[order]) if len(own) else np.zeros(0, np.int64)
    body = np.zeros(len(first), _PAIR)
    body["name"], body["doc"] = own[order][first], docs[order][first]
    return at, own, (body["name"].copy(), body)


def _smallest(bodies: list[bytes]) -> list[bytes]:
    """Each slice's names for which another slice has a smaller doc_id: a bit per name, then those ids."""
    parts = [np.frombuffer(b, _PAIR) for b in bodies]
    every = np.concatenate(parts)
    order = np.lexsort((every["doc"], every["name"]))
    first = _groups(every["name"][order])
    least = np.empty(len(every), np.int64)
    least[order] = np.repeat(every["doc"][order][first], np.diff(np.concatenate((first, [len(every)]))))
    out, at = [], 0
    for part in parts:
        own = least[at : at + len(part)]
        at += len(part)
        less = own < part["doc"]
        out.append(np.packbits(less).tobytes() + own[less].tobytes() if less.any() else b"")
    return out


def _least(names: np.ndarray, own: np.ndarray, given: list[dict] | None, buckets: int) -> np.ndarray:
    """The smallest doc_id of each name over all slices."""
    bounds, least = bounds_of(names, buckets), own.copy()
    for row in answered(given):
        a, z = bounds[row["bucket"]], bounds[row["bucket"] + 1]
        cut_at = (z - a + 7) // 8
        less = np.unpackbits(np.frombuffer(row["answer"][:cut_at], np.uint8), count=z - a).astype(bool)
        least[a:z][less] = np.frombuffer(row["answer"][cut_at:], np.int64)
    return least


def removed_words(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256, kept) per row of docs; kept only if asked for.

    Removed is each word in a 13-word window whose words also start in a document
    with a smaller doc_id; spans are the removed runs (first word, words). Rows of the
    same doc_id don't take words from each other. Null texts have no words. A null
    doc_id is neither smaller nor larger than another: such a row keeps its words and
    takes none. docs must be a table; other columns are not read.
    """
    buckets = 4 * partitions(docs)
    known = _Words()
    slices = cut(docs)
    hits = answers(first_names(docs, lambda made: _block_names(_Text(made, known))[1], buckets), _hits, "hits", buckets)
    asked = slices.join(hits, "slice", "left")
    second = more_names(asked, lambda made, given: _window_names(made, _Text(made, known), given, buckets)[2], buckets)
    asked = asked.join(answers(second, _smallest, "smaller", buckets), "slice", "left")

    def results(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                made = Slice.unpacked(row["body"])
                text = _Text(made, known)
                at, own, (names, body) = _window_names(made, text, row["hits"], buckets)
                least = _least(names, body["doc"], row["smaller"], buckets)
                repeated = at[least[np.searchsorted(names, own)] < made.ids[text.doc[at]]] if len(at) else at
                edge = np.zeros(len(text.hash) + 1, np.int64)
                np.add.at(edge, repeated, 1)
                np.add.at(edge, repeated + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                yield _documents(made, text, gone, keep_text)

    fields = "doc_id bigint, n_words bigint, n_removed bigint, spans array<array<bigint>>, kept_sha256 string" + ", kept string" * keep_text
    return asked.select("slice", "body", "hits", "smaller").mapInArrow(results, fields)


def _documents(made: Slice, text: _Text, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    kinds = {
        "doc_id": pa.int64(),
        "n_words": pa.int64(),
        "n_removed": pa.int64(),
        "spans": pa.list_(pa.list_(pa.int64())),
        "kept_sha256": pa.string(),
    } | ({"kept": pa.string()} if keep_text else {})
    rows: list[list] = [[] for _ in kinds]
    for i, words in enumerate(text.words):
        mask = gone[text.starts[i] : text.stops[i]]
        turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2).tolist()
        kept, last = [], 0
        for a, z in turns:
            kept += words[last:a]
            last = z
        body = b" ".join(kept + words[last:])
        doc_id = int(made.ids[i]) if made.valid[i] else None
        values = (doc_id, len(words), int(mask.sum()), [[a, z - a] for a, z in turns], hashlib.sha256(body).hexdigest(), body)
        for column, value in zip(rows, values, strict=False):
            column.append(value)
    if keep_text:
        rows[-1] = [x.decode() for x in rows[-1]]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds.values(), strict=True)], list(kinds))
