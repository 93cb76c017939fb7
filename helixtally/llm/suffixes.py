"""Repeated byte strings by distributed prefix doubling over sampled suffixes.

Names (64-bit hashes) stand for ranks. A task doubles them locally: the name of
2n bytes from a position joins those of n bytes there and n bytes further on, from 8
bytes up to 50, and where needed 100 and 200. Spark sorts names between the rounds and says
which are unique:

1. Of each 200-byte window, the position with the smallest 50-byte name is its sample
   (some 1.5 positions in 100). Rank pairs (50 bytes at the sample, all windows of the
   sample together) are sorted. Samples with a unique first rank end here, and all
   windows of a sample whose second rank repeats are past the threshold.
2. What is left, windows at the edges of repeats, is ranked at 200 bytes and sorted.

Equal windows have equal samples at equal places, so nothing is lost by sampling, and
200-byte names decide alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixtally.llm.common import partitions
from helixtally.llm.slices import Sent, Slice, aligned, answered, answers, bits, bounds_of, cut, first_names, more_names

LENGTH = 200
SAMPLED = LENGTH // 4
SLICE_BYTES = 4 << 20
_STARTS = LENGTH - SAMPLED + 1  # 50-byte strings of a window
_ODD = np.random.default_rng(11).integers(0, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _double(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of the strings made of one string and the one that begins `offset` later."""
    out = names[: max(0, len(names) - offset)] * _ODD[0]
    out += names[offset:] * _ODD[1]
    out ^= out >> np.uint64(31)
    return out


def _names(raw: bytes) -> np.ndarray:
    """Of the SAMPLED bytes from each position on."""
    if len(raw) < SAMPLED:
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.as_strided(np.frombuffer(raw, np.uint8), (len(raw) - 7, 8), (1, 1))
    names = np.ascontiguousarray(eight).view("<u8").reshape(-1)
    names ^= names >> np.uint64(32)
    names *= _MIX
    names ^= names >> np.uint64(29)
    for have, want in ((8, 16), (16, 32), (32, SAMPLED)):
        names = _double(names, want - have)
    names *= _MIX
    return names ^ (names >> np.uint64(32))


def _full(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of LENGTH bytes, at some positions: two more doublings."""
    half = lambda p: names[p] * _ODD[0] + names[p + SAMPLED] * _ODD[1]
    whole = half(at)
    whole ^= whole >> np.uint64(31)
    later = half(at + 2 * SAMPLED)
    later ^= later >> np.uint64(31)
    whole = whole * _ODD[0] + later * _ODD[1]
    whole *= _MIX
    return whole ^ (whole >> np.uint64(29))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest key of each window: minima within blocks from both sides."""
    n = len(keys) - width + 1
    rows = -(-len(keys) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    block = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


_RANKS = np.dtype([("sample", "<u8"), ("windows", "<u8"), ("often", "u1")])


@dataclass
class _Suffixes:
    """A slice's samples in text order: windows from `low` to `high` belong to each; names of 50 bytes at all positions."""

    names: np.ndarray
    low: np.ndarray
    high: np.ndarray
    pairs: np.ndarray  # _RANKS per sample


def _suffixes(made: Slice) -> _Suffixes:
    sizes = np.array([len(t) for t in made.texts], np.int64)
    names = _names(b"".join(made.texts))
    stops = np.cumsum(sizes)
    if len(names) < _STARTS:
        none = np.zeros(0, np.int64)
        return _Suffixes(names, none, none, np.zeros(0, _RANKS))
    places = np.arange(len(names), dtype=np.uint64)
    sample = (_least((names & np.uint64(0xFFFFFFFF00000000)) | places, _STARTS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = np.zeros(len(sample), np.bool_)  # windows within one document
    for start, stop in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
        if stop - start >= LENGTH:
            inside[start : stop - LENGTH + 1] = True
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.zeros(0, np.int64)
        return _Suffixes(names, none, none, np.zeros(0, _RANKS))
    turn = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(sample[at]) != 0))))
    low, high = at[turn], at[np.concatenate((turn[1:], [len(at)])) - 1]
    pairs = np.zeros(len(low), _RANKS)
    pairs["sample"] = names[sample[low]] * _MIX  # samples have small names; this spreads them over the buckets
    pairs["windows"] = (_full(names, low) * _ODD[0] + _full(names, high) * _ODD[1]) ^ (high - low).astype(np.uint64)
    return _Suffixes(names, low, high, pairs)


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    turn = np.zeros(len(columns[0]) - 1, np.bool_)
    for c in columns:
        turn |= c[1:] != c[:-1]
    return np.flatnonzero(np.concatenate(([True], turn)))


def _distinct_pairs(found: _Suffixes) -> tuple[np.ndarray, Sent]:
    """For each sample its place among the distinct pairs, and those as they are sent."""
    order = np.lexsort((found.pairs["windows"], found.pairs["sample"]))
    ranked = found.pairs[order]
    first = _groups(ranked["sample"], ranked["windows"])
    size = np.diff(np.concatenate((first, [len(ranked)])))
    place = np.empty(len(ranked), np.int64)
    place[order] = np.repeat(np.arange(len(first)), size)
    sent = ranked[first]
    sent["often"] = size > 1
    return place, (sent["sample"].copy(), sent)


def _judge_pairs(bodies: list[bytes]) -> list[bytes]:
    """Two bits per pair: its windows repeat; its sample repeats with other windows."""
    parts = [np.frombuffer(b, _RANKS) for b in bodies]
    every = np.concatenate(parts)
    order = np.lexsort((every["windows"], every["sample"]))
    ranked = every[order]
    pair, sample = _groups(ranked["sample"], ranked["windows"]), _groups(ranked["sample"])
    size = np.diff(np.concatenate((pair, [len(ranked)])))
    repeats = np.repeat((size > 1) | (ranked["often"][pair] > 0), size)
    kinds = np.add.reduceat(np.isin(np.arange(len(ranked)), pair, assume_unique=True).astype(np.int64), sample)
    mixed = np.repeat(kinds > 1, np.diff(np.concatenate((sample, [len(ranked)]))))
    said = np.empty((len(every), 2), np.bool_)
    said[order] = np.stack((repeats, mixed), 1)
    return [bits(m.reshape(-1)) for m in np.split(said, np.cumsum([len(p) for p in parts])[:-1])]


def _said(names: np.ndarray, given: list[dict] | None, buckets: int) -> np.ndarray:
    bounds, out = bounds_of(names, buckets), np.zeros((len(names), 2), np.bool_)
    for row in answered(given):
        a, z = bounds[row["bucket"]], bounds[row["bucket"] + 1]
        out[a:z] = np.unpackbits(np.frombuffer(row["answer"], np.uint8), count=2 * (z - a)).reshape(-1, 2)
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions from each low to its high."""
    size = high - low + 1
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(low - ends + size, size) if len(size) else np.zeros(0, np.int64)


def _edge_names(found: _Suffixes, given: list[dict] | None, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sent]:
    """Which samples are past the threshold; positions and 200-byte names of windows still open; what is sent."""
    place, (names, _) = _distinct_pairs(found)
    said = _said(names, given, buckets)[place]
    past, mixed = said[:, 0], said[:, 1]
    at = _ranges(found.low[mixed], found.high[mixed])
    own = _full(found.names, at) & ~np.uint64(1)
    ranked = np.sort(own)
    first = _groups(ranked)
    size = np.diff(np.concatenate((first, [len(ranked)])))
    distinct = ranked[first]
    return past, at, own, (distinct, (distinct | (size > 1).astype(np.uint64)).astype("<u8"))


def _judge_names(bodies: list[bytes]) -> list[bytes]:
    """A bit per name: it occurs twice or more."""
    parts = [np.frombuffer(b, "<u8") for b in bodies]
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    first = _groups(ranked >> np.uint64(1))
    size = np.diff(np.concatenate((first, [len(ranked)])))
    often = np.maximum.reduceat(ranked & np.uint64(1), first) > 0
    said = np.empty(len(every), np.bool_)
    said[order] = np.repeat(often | (size > 1), size)
    return [bits(m) for m in np.split(said, np.cumsum([len(p) for p in parts])[:-1])]


def removed_bytes(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row of docs; kept (binary) only if asked for.

    Removed is each byte in a 200-byte string that also starts anywhere else in any
    row, the same one included; overlaps count. A null text is empty. Repeated rows
    lose what they share, so do rows with a null doc_id. docs must be a table; other
    columns are not read.
    """
    buckets = 4 * partitions(docs)
    slices = cut(docs, SLICE_BYTES)
    first = first_names(docs, lambda made: _distinct_pairs(_suffixes(made))[1], buckets, SLICE_BYTES)
    asked = slices.join(answers(first, _judge_pairs, "pairs", buckets), "slice", "left")
    second = more_names(asked, lambda made, given: _edge_names(_suffixes(made), given, buckets)[3], buckets)
    asked = asked.join(answers(second, _judge_names, "edges", buckets), "slice", "left")

    def results(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                made = Slice.unpacked(row["body"])
                found = _suffixes(made)
                past, at, own, (names, _) = _edge_names(found, row["pairs"], buckets)
                twice = aligned(names, row["edges"], buckets)
                repeated = at[twice[np.searchsorted(names, own)]] if len(at) else at
                change = np.zeros(sum(map(len, made.texts)) + 1, np.int32)
                np.add.at(change, found.low[past], 1)
                np.add.at(change, found.high[past] + LENGTH, -1)
                np.add.at(change, repeated, 1)
                np.add.at(change, repeated + LENGTH, -1)
                yield _documents(made, np.cumsum(change)[:-1] > 0, keep_text)

    fields = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_text
    return asked.select("slice", "body", "pairs", "edges").mapInArrow(results, fields)


def _documents(made: Slice, gone: np.ndarray, keep_text: bool) -> pa.RecordBatch:
    rows, start = [], 0
    for i, text in enumerate(made.texts):
        mask = gone[start : start + len(text)]
        start += len(text)
        turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).reshape(-1, 2).tolist()
        kept, last = [], 0
        for a, z in turns:
            kept.append(text[last:a])
            last = z
        body = b"".join(kept) + text[last:]
        doc_id = int(made.ids[i]) if made.valid[i] else None
        rows.append((doc_id, len(text), int(mask.sum()), len(turns), hashlib.sha256(body).hexdigest(), body))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    kinds |= {"kept": pa.binary()} if keep_text else {}
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds.values(), strict=False)], list(kinds))
