"""Slices of a corpus that ask all other slices which of their names are repeated.

A slice is some megabytes of consecutive documents, compressed. It sends the distinct
names (64-bit hashes) of what it holds, packed into one row per hash bucket; a bucket
sees all slices, decides, and answers each in its own order of names. Only then is
the slice's text moved, once, to meet its answers. A name that a third of the corpus
shares is sent once per slice, whatever the number of documents that hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20  # a longer document ends its slice, whole


@dataclass
class Slice:
    """ids: doc_id per document, valid: whether it has one, texts: their UTF-8 bytes."""

    ids: np.ndarray
    valid: np.ndarray
    texts: list[bytes]

    def key(self, place: int) -> int:
        """Of the documents and the slice's place in the scan, as a signed number."""
        digest = xxhash.xxh64(seed=place)
        digest.update(self.ids.tobytes() + self.valid.tobytes())
        digest.update(np.array([len(t) for t in self.texts], np.int64).tobytes())
        return np.uint64(digest.intdigest()).astype(np.int64).item()

    def packed(self) -> bytes:
        sizes = np.array([len(t) for t in self.texts], np.int64)
        head = np.array([len(self.ids)], np.int64).tobytes() + self.ids.tobytes() + self.valid.tobytes() + sizes.tobytes()
        return zstandard.compress(head + b"".join(self.texts), 3)

    @staticmethod
    def unpacked(body: bytes) -> Slice:
        raw = zstandard.decompress(body)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        ids = np.frombuffer(raw, np.int64, n, 8)
        valid = np.frombuffer(raw, np.bool_, n, 8 + 8 * n)
        stops = np.cumsum(np.frombuffer(raw, np.int64, n, 8 + 9 * n)) + 8 + 17 * n
        starts = [8 + 17 * n, *stops[:-1].tolist()]
        return Slice(ids, valid, [raw[a:z] for a, z in zip(starts, stops.tolist(), strict=False)] if n else [])


def _cut(parts: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, Slice]]:
    place, ids, valid, texts, size = TaskContext.get().partitionId() << 24, [], [], [], 0
    for part in parts:
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
            ids.append(doc_id or 0)
            valid.append(doc_id is not None)
            texts.append(text or b"")
            size += len(texts[-1]) + 32
            if size >= most:
                made = Slice(np.array(ids, np.int64), np.array(valid, np.bool_), texts)
                yield made.key(place), made
                place, ids, valid, texts, size = place + 1, [], [], [], 0
    if ids:
        made = Slice(np.array(ids, np.int64), np.array(valid, np.bool_), texts)
        yield made.key(place), made


def cut(docs: DataFrame, most: int = SLICE_BYTES) -> DataFrame:
    """(slice, body) from documents (doc_id, text); docs must be a table, so that a second read gives the same slices."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, made in _cut(parts, most):
            yield pa.RecordBatch.from_pydict({"slice": pa.array([key], pa.int64()), "body": pa.array([made.packed()], pa.binary())})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "slice bigint, body binary")


#: What a slice sends: its sorted distinct names, and for each the bytes that go with it.
Sent = tuple[np.ndarray, np.ndarray]


def bounds_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's names begin; a bucket is a range of hashes."""
    edges = (np.arange(1, buckets, dtype=np.uint64) * np.uint64((1 << 64) // buckets)).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(names, edges), [len(names)]))


def _rows(key: int, sent: Sent, buckets: int) -> pa.RecordBatch:
    bounds = bounds_of(sent[0], buckets)
    full = np.union1d(np.nonzero(np.diff(bounds))[0], [key % buckets])  # one bucket answers in any case
    bodies = [sent[1][bounds[b] : bounds[b + 1]].tobytes() for b in full]
    columns = [pa.array(full, pa.int32()), pa.array([key] * len(full), pa.int64()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "slice", "body"])


def first_names(docs: DataFrame, emit: Callable[[Slice], Sent], buckets: int, most: int = SLICE_BYTES) -> DataFrame:
    """(bucket, slice, body) of what slices send, straight from the documents."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, made in _cut(parts, most):
            yield _rows(key, emit(made), buckets)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "bucket int, slice bigint, body binary")


def more_names(asked: DataFrame, emit: Callable[..., Sent], buckets: int) -> DataFrame:
    """The same for slices that have answers (slice, body, answers...); emit gets them after the slice."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row in part.to_pylist():
                key, body, *answers = row.values()
                yield _rows(key, emit(Slice.unpacked(body), *answers), buckets)

    return asked.mapInArrow(batches, "bucket int, slice bigint, body binary")


def answers(names: DataFrame, decide: Callable[[list[bytes]], list[bytes]], called: str, buckets: int) -> DataFrame:
    """(slice, <called>): per slice its buckets' answers; decide gets a bucket's bodies and gives one answer each, or b"".

    Every slice has an answer, be it empty; one that finds none was not cut as before.
    """

    def bucket(rows: pa.Table) -> pa.Table:
        slices, bodies = rows.column("slice").to_pylist(), rows.column("body").to_pylist()
        sent = iter(decide([b for b in bodies if b]) if any(bodies) else [])
        said = [(s, next(sent) if b else b"") for s, b in zip(slices, bodies, strict=True)]
        number = rows.column("bucket")[0].as_py()
        said = [(s, a) for s, a in said if a or s % buckets == number]
        columns = [pa.array([s for s, _ in said], pa.int64()), pa.array([number] * len(said), pa.int32()), pa.array([a for _, a in said], pa.binary())]
        return pa.Table.from_arrays(columns, ["slice", "bucket", "answer"])

    given = names.groupBy("bucket").applyInArrow(bucket, "slice bigint, bucket int, answer binary")
    return given.groupBy("slice").agg(F.collect_list(F.struct("bucket", "answer")).alias(called))


def answered(given: list[dict] | None) -> list[dict]:
    """The answers that say something; it is an error to have none at all."""
    if given is None:
        raise ValueError("a second read of the documents gave other slices; write them to a table first")
    return [row for row in given if row["answer"]]


def aligned(names: np.ndarray, given: list[dict] | None, buckets: int) -> np.ndarray:
    """Answers of one bit per name, in the order of names."""
    bounds, mask = bounds_of(names, buckets), np.zeros(len(names), np.bool_)
    for row in answered(given):
        a, z = bounds[row["bucket"]], bounds[row["bucket"] + 1]
        mask[a:z] = np.unpackbits(np.frombuffer(row["answer"], np.uint8), count=z - a)
    return mask


def bits(mask: np.ndarray) -> bytes:
    """A mask as an answer; empty if nothing is set."""
    return np.packbits(mask).tobytes() if mask.any() else b""
