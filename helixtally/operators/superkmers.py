"""K-mer counting that shuffles stretches of bases instead of single k-mers.

Neighbouring k-mers mostly share their minimizer, the m-mer of least hash inside
them. A maximal stretch of windows with one minimizer is a super-k-mer: one
short row that stands for several k-mers. Both strands of a k-mer have the same
minimizer, so partitioning super-k-mers by it brings all copies of a k-mer
together while moving several times fewer rows and bytes than one row per k-mer.

A row of the exchange holds up to 128 super-k-mers that one slice of the input has for
one bucket, packed into a binary column: handing rows from the JVM to Python
costs far more than the bytes in them, and rows of any size would make batches of any size.

The exchange is hashed by minimizer bucket, so all copies of a k-mer meet in one
partition. Only a bucket that is hot within one slice of the input (a repeat that
fills a third of it) is salted: each slice then sends its share to another partition.
The grouped sum behind it makes the counts right either way, and moves about one row
per distinct k-mer, and a few more for the k-mers of a hot bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.functions import bases
from helixtally.operators import codes
from helixtally.operators.windows import characters, sorted_runs, tallies

SCHEMA = "bucket int, salt int, stretches binary"
# A packed super-k-mer. head: code of its first k bases; rest: the next bases, left-aligned in
# TAIL places of 2 bits, above 8 bits for the number of k-mers (so that number - 1 bases count).
RECORD = np.dtype([("head", "<u8"), ("rest", "<u8")])
TAIL = 20
BUCKETS = 1 << 12  # where no session says how many partitions there are
HOT_SHARE, HOT_ROWS = 16, 1 << 12  # a hot bucket has so many times its even share of a slice, and so many records
SALTS = 1 << 10
_STEP = 1 << 17
_PACK_ROWS = 1 << 18
_TALLY_ROWS = 1 << 21  # windows that a task of the count sorts at once
_ROW_RECORDS = 1 << 7  # of a row of the exchange: a batch of Spark's 10,000 rows then stays below 21 MB
_WHOLE = 1 << 23  # windows of a bucket that are sorted at once


def minimizer_length(k: int, m: int | None = None) -> int:
    """Default 11 bases, fewer for small k."""
    m = max(1, min(11, k - 4)) if m is None else m
    if not 1 <= m <= min(bases.check_k(k), 16):
        raise ValueError(f"m must lie in [1, {min(k, 16)}]")
    return m


def _scatter(values: np.ndarray) -> np.ndarray:
    """Pseudo-random order of m-mers (odd multiplier, modulo 2^32), so that no repeat is favoured."""
    mixed = values.astype(np.uint32) * np.uint32(2654435761)
    return mixed ^ (mixed >> np.uint32(15))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, by doubling."""
    length = 1
    while length * 2 <= width:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    rest = width - length
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def cut(
    data: np.ndarray, ends: np.ndarray | None, k: int, m: int, table: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(minimizer hash, record) of the super-k-mers of reads that lie back to back.

    Arguments as for ``canonical_slices``.
    """
    for digits, keep in codes.slices(data, ends, k, table, _STEP):
        if not keep.any():
            continue
        least = np.minimum(codes.windows(digits, m, True), codes.windows(3 - digits, m, False))
        order = _sliding_least(_scatter(least), k - m + 1)
        # a stretch starts at a kept window whose predecessor is not kept or has another minimizer
        first = keep.copy()
        first[1:] &= ~keep[:-1] | (order[1:] != order[:-1])
        starts = np.flatnonzero(first)
        lengths = np.add.reduceat(keep, starts, dtype=np.int64)
        # a repeat may hold one minimizer for long: cut it to the room of the tail
        pieces = -(-lengths // (TAIL + 1))
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts = np.repeat(starts, pieces) + part * (TAIL + 1)
        lengths = np.minimum(np.repeat(lengths, pieces) - part * (TAIL + 1), TAIL + 1)
        padded = np.concatenate([digits, np.zeros(k + TAIL, np.uint8)])
        records = np.empty(len(starts), RECORD)
        records["head"] = codes.windows(digits, k, True)[starts]
        tail = codes.windows(padded, TAIL, True)[starts + k]
        records["rest"] = (tail << np.uint64(8)) | lengths.astype(np.uint64)
        yield order[starts], records


def pack(cuts: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, salt, records) of the buckets that occur in about 2^18 super-k-mers, up to 128 records each."""
    held, rows = [], 0
    for order, records in cuts:
        held.append(((order % np.uint32(buckets)).astype(np.uint32), records))
        rows += len(records)
        if rows >= _PACK_ROWS:
            yield _packed(held, buckets)
            held, rows = [], 0
    if held:
        yield _packed(held, buckets)


def _packed(held: list[tuple[np.ndarray, np.ndarray]], buckets: int) -> pa.RecordBatch:
    bucket = np.concatenate([b for b, _ in held])
    records = np.concatenate([r for _, r in held])
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    stops = np.append(first, len(bucket))
    sizes = np.diff(stops)
    hot = (sizes > HOT_ROWS) & (sizes * buckets > HOT_SHARE * len(bucket))
    # the salt follows from the slice's content, so a repeated task sends the same rows
    salt = np.where(hot, 1 + int(records["head"][:: max(1, len(records) // 64)].sum() % np.uint64(SALTS)), 0)
    marks = bucket[first][hot].astype(np.int32)  # an empty row tells the task of the unsalted rest that the bucket has more elsewhere
    pieces = -(-sizes // _ROW_RECORDS)
    part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, salt = np.repeat(first, pieces) + part * _ROW_RECORDS, np.repeat(salt, pieces)
    offsets = (np.append(first, len(bucket)) * RECORD.itemsize).astype(np.int32)
    blobs = pa.BinaryArray.from_buffers(
        pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(records.view(np.uint8))]
    )
    names = ["bucket", "salt", "stretches"]
    columns = [pa.array(bucket[first].astype(np.int32)), pa.array(salt.astype(np.int32)), blobs]
    if len(marks):
        empty = [pa.array(marks), pa.array(np.zeros(len(marks), np.int32)), pa.array([b""] * len(marks), pa.binary())]
        columns = [pa.concat_arrays(pair) for pair in zip(columns, empty, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def bucket_count(partitions: int) -> int:
    """Several buckets per shuffle partition, so that partitions come out even."""
    return 16 * partitions


def super_kmers(reads: DataFrame, k: int, m: int | None = None, seq: str = "seq", u_as_t: bool = True) -> DataFrame:
    """(bucket, salt, stretches): every window of k valid bases lies in exactly one packed record."""
    m = minimizer_length(k, m)
    table = codes.base_table(u_as_t)
    buckets = bucket_count(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads_of = (characters(batch.column(0)) for batch in batches)
        yield from pack((c for data, ends in reads_of for c in cut(data, ends, k, m, table)), buckets)

    return reads.select(seq).mapInArrow(extract, SCHEMA)


def expand(records: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Canonical codes of all windows, one array per window number."""
    counts = (records["rest"] & np.uint64(255)).astype(np.uint8)
    records = records[np.argsort(TAIL + 1 - counts, kind="stable")]
    active = len(counts) - np.cumsum(np.bincount(counts, minlength=TAIL + 2))  # records with more than i windows
    mask, top = np.uint64(bases.kmer_mask(k)), np.uint64(2 * (k - 1))
    two, three = np.uint64(2), np.uint64(3)
    forward, tail = records["head"].copy(), records["rest"] >> np.uint64(8)
    reverse = _reverse_complement(forward, k)
    yield np.minimum(forward, reverse)
    for i in range(1, TAIL + 1):
        n = active[i]
        if not n:
            return
        base = (tail[:n] >> np.uint64(2 * (TAIL - i))) & three
        forward = ((forward[:n] << two) | base) & mask
        reverse = (reverse[:n] >> two) | ((three - base) << top)
        yield np.minimum(forward, reverse)


def codes_of(stretches: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Canonical codes of a column of packed records."""
    records = characters(stretches)[0].view(RECORD)
    for lo in range(0, len(records), _STEP):
        yield from expand(records[lo : lo + _STEP], k)


_codes_of = codes_of  # its name in earlier tests


def _reverse_complement(code: np.ndarray, k: int) -> np.ndarray:
    """Reverse the order of the 2-bit digits of the complement, by swapping ever larger blocks."""
    code = ~code
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        shift, mask = np.uint64(bits), np.uint64(mask)
        code = ((code >> shift) & mask) | ((code & mask) << shift)
    return code.byteswap() >> np.uint64(64 - 2 * k)


def count_super_kmers(stretches: DataFrame, k: int) -> DataFrame:
    """Count table of super-k-mers; copies meet in one task and are combined by sorting there.

    A task takes its buckets one after the other, so the copies of a k-mer come close together
    and a short stretch of windows, sorted at a time, combines most of them.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from tallies((values for batch in batches for values in codes_of(batch.column(0), k)), _TALLY_ROWS)

    moved = stretches.repartition(F.col("bucket"), F.col("salt")).sortWithinPartitions("bucket").drop("bucket", "salt")
    tallied = moved.mapInArrow(tally, "kmer bigint, part bigint")
    return tallied.groupBy("kmer").agg(F.sum("part").alias("n"))


def count_repeated(stretches: DataFrame, k: int, least: int = 2) -> DataFrame:
    """The rows of the count table with n >= least; k-mers that occur less are dropped before the second exchange.

    All copies of a k-mer whose bucket is nowhere salted meet in one task, which knows its
    whole count; only counts from salted buckets, and from buckets of more than _WHOLE
    windows, which are combined piece by piece, are added up behind the exchange.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, whole, held, rows, done = None, True, [], 0, []

        def pieces() -> Iterator[pa.RecordBatch]:
            if rows:
                for found in sorted_runs(np.concatenate(held).view(np.int64)):
                    yield found.filter(pc.greater_equal(found.column(1), least)) if whole else found

        for batch in batches:
            for i in range(batch.num_rows):
                number, salt, body = (batch.column(c)[i].as_py() for c in range(3))
                if number != bucket:
                    done += pieces()
                    bucket, whole, held, rows = number, True, [], 0
                whole &= salt == 0 and len(body) > 0
                for values in codes_of(pa.array([body], pa.binary()), k) if body else ():
                    held.append(values)
                    rows += len(values)
                    if rows >= _WHOLE:
                        whole = False
                        done += pieces()
                        held, rows = [], 0
            if sum(len(d) for d in done) >= _STEP:
                yield from done
                done = []
        yield from (*done, *pieces())

    moved = stretches.repartition(F.col("bucket"), F.col("salt")).sortWithinPartitions("bucket")
    tallied = moved.mapInArrow(tally, "kmer bigint, part bigint")
    return tallied.groupBy("kmer").agg(F.sum("part").alias("n")).where(F.col("n") >= least)
