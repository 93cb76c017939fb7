"""Running counts with one state entry per minimizer bucket, or a few.

The stream moves packed super-k-mers; the state of a bucket is a stack of sorted arrays of
k-mers with their counts, differences of neighbours in as few bytes as they need. What a
micro-batch brings is a new array on top: it is written once, and what is below is only read,
to tell which k-mers are new. Small arrays are merged at once, others when there are RUNS of
about one size, so a k-mer is written again a logarithm of times and not by every micro-batch.
A state store that holds one entry per k-mer pays for a look-up and a log record each; here
both are paid per array, and the state itself is the count table: it is read back with Spark's
state reader, so no micro-batch writes counts anywhere else.

``buckets`` is fixed when a folder is first used. Some 4 bytes per k-mer lie in an array, 16
when it is read, so take one bucket per million expected k-mers or so. A bucket that is hot
within one slice of the input is salted as in a batch count and has several stacks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import MapState, StatefulProcessor, StatefulProcessorHandle

from helixtally.functions import bases
from helixtally.operators import codes, superkmers
from helixtally.operators.windows import tallies
from helixtally.sources.fastq import as_ranges, one_by_one, range_super_kmers, register_sources
from helixtally.streaming.incremental import Each, planned_ranges, run, written, writer

BUCKETS = 128
LARGEST = 1 << 26  # k-mers of one array
SMALL, RUNS = 1 << 12, 16  # arrays below SMALL k-mers are merged at once, others when RUNS of one size have come
_ROWS = 1 << 18  # of a batch that is read off the state
REPORT = "bucket int, salt int, new_kmers bigint, touched bigint, occurrences bigint"
PACKED_REPORT = "bucket int, batch int, new_kmers bigint"
_STATE = "size int, kmers binary, n binary"
_PACKED = "bucket int, batch int, kmers binary, n binary"
_PACK_ROWS, _ROW_KMERS = 1 << 20, 1 << 10
_EMPTY = (np.empty(0, np.int64), np.empty(0, np.int64))


def merged(old: tuple[np.ndarray, np.ndarray], kmers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted count arrays as one."""
    held, counts = old
    at = np.searchsorted(held, kmers)
    known = np.zeros(len(kmers), np.bool_)
    inside = at < len(held)
    known[inside] = held[at[inside]] == kmers[inside]
    counts = counts.copy()
    counts[at[known]] += n[known]
    return np.insert(held, at[~known], kmers[~known]), np.insert(counts, at[~known], n[~known])


def shrunk(values: np.ndarray) -> bytes:
    """Numbers from 0 as zstd of their bytes, place by place; the first byte says how many places there are."""
    places = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8)[:, :places].T)
    return bytes([places]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def grown(blob: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob[1:], size * blob[0], "zstd", asbytes=True), np.uint8).reshape(blob[0], size)
    values = np.zeros((size, 8), np.uint8)
    values[:, : blob[0]] = planes.T
    return values.view("<i8").reshape(-1)


def stored(kmers: np.ndarray, n: np.ndarray) -> tuple[int, bytes, bytes]:
    """A sorted count array as it lies in the state."""
    return len(kmers), shrunk(np.diff(kmers, prepend=0)), shrunk(n)


def restored(size: int, kmers: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(grown(kmers, size)), grown(n, size)


def _level(size: int) -> int:
    level = 0
    while size >= SMALL * RUNS**level:
        level += 1
    return level


def add(entry: MapState, kmers: np.ndarray, n: np.ndarray, bucket: int) -> np.ndarray:
    """Puts a sorted count array on the stack of an entry, whose arrays are numbered from 0; which of the k-mers are new to it."""
    new, sizes = np.ones(len(kmers), np.bool_), []
    while entry.containsKey((len(sizes),)):
        size, held, _ = entry.getValue((len(sizes),))
        held = np.cumsum(grown(held, size))
        if size:
            at = np.minimum(np.searchsorted(held, kmers), size - 1)
            new &= held[at] != kmers
        sizes.append(size)
    top = len(sizes)
    if top and not len(kmers):
        return new
    while top:  # sizes get smaller from 0 on, so what is merged lies on top
        own, levels = _level(len(kmers)), [_level(size) for size in sizes[:top]]
        whole = own == 0 or levels.count(own) + 1 >= RUNS
        if not (levels[-1] < own or whole and levels[-1] == own):
            break
        top -= 1
        kmers, n = merged(restored(*entry.getValue((top,))), kmers, n)
    if len(kmers) > LARGEST:
        raise ValueError(f"bucket {bucket} holds {len(kmers)} k-mers; start again with more buckets")
    entry.updateValue((top,), stored(kmers, n))
    for number in range(top + 1, len(sizes)):
        entry.removeKey((number,))
    return new


class BucketCounts(StatefulProcessor):
    """Adds a micro-batch's super-k-mers of one bucket to its entry, and reports what they were."""

    def __init__(self, k: int) -> None:
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getMapState("counts", "run int", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        stretches = (pa.array(part["stretches"], pa.binary()) for part in rows)
        found = tallies(itertools.chain.from_iterable(superkmers.codes_of(s, self.k) for s in stretches))
        table, touched, occurrences = _EMPTY, 0, 0
        for part in found:
            kmers, n = part.column(0).to_numpy(), part.column(1).to_numpy()
            table = merged(table, kmers, n)
            touched, occurrences = touched + len(kmers), occurrences + int(n.sum())
        new = int(add(self.entry, *table, key[0]).sum())
        yield pd.DataFrame({"bucket": [key[0]], "salt": [key[1]], "new_kmers": [new], "touched": [touched], "occurrences": [occurrences]})

    def close(self) -> None:
        pass


class PackedCounts(StatefulProcessor):
    """Adds a micro-batch's packed k-mers of one bucket to its entry, and reports how many of each batch are new: in an earlier batch or micro-batch there are none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getMapState("counts", "run int", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        found: dict[int, list] = {}
        for part in rows:
            for number, *pair in zip(part["batch"], part["kmers"], part["n"], strict=True):
                found.setdefault(number, []).append([np.frombuffer(x, np.int64) for x in pair])
        each, table = {}, _EMPTY
        for number in sorted(found):
            before, kmers, n = table[0], *combined(*map(np.concatenate, zip(*found.pop(number), strict=True)))
            table, each[number] = merged(table, kmers, n), np.setdiff1d(kmers, before, assume_unique=True)
        new = table[0][add(self.entry, *table, key[0])]
        report = [(key[0], number, len(np.intersect1d(kmers, new, assume_unique=True))) for number, kmers in each.items()]
        yield pd.DataFrame(report, columns=["bucket", "batch", "new_kmers"])

    def close(self) -> None:
        pass


def combined(kmers: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-mers with the sums of their counts."""
    order = np.argsort(kmers, kind="stable")
    kmers, n = kmers[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], kmers[1:] != kmers[:-1]]))
    return kmers[first], np.add.reduceat(n, first)


def packed(kmers: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (batch, kmer, part) as rows of up to 2^10 k-mers of one bucket: the state is then asked once per bucket, not per k-mer."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for part in parts:
            held.append(part)
            rows += part.num_rows
            if rows >= _PACK_ROWS:
                yield _packed(held, buckets)
                held, rows = [], 0
        if rows:
            yield _packed(held, buckets)

    return kmers.select("batch", "kmer", "part").mapInArrow(pack, _PACKED)


def _packed(held: list[pa.RecordBatch], buckets: int) -> pa.RecordBatch:
    batch, kmers, n = (np.concatenate([part.column(c).to_numpy(zero_copy_only=False) for part in held]) for c in range(3))
    bucket = (kmers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)
    order = np.lexsort((bucket, batch))
    batch, bucket, kmers, n = batch[order], bucket[order], kmers[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (batch[1:] != batch[:-1])]))
    sizes = np.diff(np.append(first, len(kmers)))
    pieces = -(-sizes // _ROW_KMERS)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(first, pieces) + place * _ROW_KMERS
    offsets = pa.py_buffer((np.append(first, len(kmers)) * 8).astype(np.int32))
    blobs = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(np.ascontiguousarray(x, np.int64))]) for x in (kmers, n)]
    columns = [pa.array(bucket[first].astype(np.int32)), pa.array(batch[first].astype(np.int32)), *blobs]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "batch", "kmers", "n"])


def stream_packed(kmers: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Streaming (bucket, batch, new_kmers): the state counts the k-mers, the rows say how many of them each batch brought."""
    return packed(kmers, buckets).groupBy("bucket").transformWithStateInPandas(PackedCounts(), PACKED_REPORT, "Update", "None")


def buckets_for(total: int) -> int:
    """Buckets for so many bytes of FASTQ: an entry of some megabytes at most."""
    return max(BUCKETS, 1 << max(0, total >> 21).bit_length())


def stream_super_kmers(
    spark: SparkSession, folder: str, k: int = bases.DEFAULT_K, u_as_t: bool = True, batches_per_trigger: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """Streaming (bucket INT, salt INT, stretches BINARY) of the planned batches."""
    bases.check_k(k)
    table = codes.base_table(u_as_t)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from range_super_kmers([r for batch in batches for r in as_ranges(batch)], k, table, buckets)

    return one_by_one(planned_ranges(spark, folder, batches_per_trigger)).mapInArrow(extract, superkmers.SCHEMA)


def stream_source_counts(
    spark: SparkSession, paths: str | list[str], folder: str, k: int = bases.DEFAULT_K, bytes_per_trigger: int = 1 << 30, buckets: int = BUCKETS, each: Each | None = None
) -> DataFrame:
    """The same straight from folders in which FASTQ files arrive, in mode "records", without planned batches."""
    register_sources(spark)
    options = {"superkmers": k, "buckets": buckets, "bytesPerTrigger": bytes_per_trigger}
    stretches = spark.readStream.format("fastq").options(**options).load(paths)
    return stream_bucket_counts(stretches, folder, k, each, until_empty=True)


def stream_bucket_counts(stretches: DataFrame, folder: str, k: int = bases.DEFAULT_K, each: Each | None = None, until_empty: bool = False) -> DataFrame:
    """Run the count over the stream of super-k-mers; returns the count table (kmer, n).

    A later call with the same folder goes on from the state it finds there. ``each``
    gets Spark's report of every micro-batch as it ends, with the sums of its figures as the
    observed metrics "batch"; by bucket they lie in ``batch_reports(spark, folder)``.
    """
    sums = [F.sum(c).alias(c) for c in ("new_kmers", "touched", "occurrences")]
    counted = stretches.groupBy("bucket", "salt").transformWithStateInPandas(BucketCounts(k), REPORT, "Update", "None").observe("batch", *sums)
    run(counted, writer(f"{folder}/reports"), f"{folder}/checkpoint", "update", each, until_empty)
    return bucket_table(stretches.sparkSession, folder)


def bucket_table(spark: SparkSession, folder: str) -> DataFrame:
    """The count table (kmer, n) as the state holds it after the last micro-batch.

    The arrays of a bucket are merged where they are read; only those of salted buckets, which
    may hold a k-mer more than once, are added up behind an exchange.
    """
    reports = written(spark, f"{folder}/reports/epoch=*", "bucket int, salt int")
    if not reports.take(1):
        return spark.createDataFrame([], "kmer bigint, n bigint")
    salted = frozenset(r.bucket for r in reports.where("salt > 0").select("bucket").distinct().collect())

    def unpacked(of_salted: bool):
        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket, runs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if (bucket in salted) != of_salted:
                        continue
                    arrays = [restored(**run) for run in runs.as_py()]
                    kmers, n = arrays[0] if len(arrays) == 1 else combined(*map(np.concatenate, zip(*arrays, strict=True)))
                    for lo in range(0, len(kmers), _ROWS):
                        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + _ROWS]) for x in (kmers, n)], ["kmer", "n"])

        return unpack

    state = spark.read.format("statestore").option("stateVarName", "counts").option("flattenCollectionTypes", "false").load(f"{folder}/checkpoint")
    stacks = state.select("key.bucket", F.map_values("map_value").alias("runs"))
    table = stacks.mapInArrow(unpacked(False), "kmer bigint, n bigint")
    if not salted:
        return table
    parts = stacks.mapInArrow(unpacked(True), "kmer bigint, n bigint")
    return table.unionByName(parts.groupBy("kmer").agg(F.sum("n").alias("n")))


def batch_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(epoch, bucket, salt, new_kmers, touched, occurrences) of all micro-batches so far.

    new_kmers and touched count a k-mer once per entry; for a bucket without salt these are distinct k-mers.
    """
    return written(spark, f"{folder}/reports/epoch=*", f"{REPORT}, epoch int", folder=f"{folder}/reports")
