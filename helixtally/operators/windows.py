"""K-mer generation: reads in, one row per window of k valid bases out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixtally.functions import bases
from helixtally.operators import codes


TALLY_SCHEMA = "kmer bigint, part bigint"
_SORT_ROWS, _OUT_ROWS = 1 << 23, 1 << 18
PIECE = 1 << 8  # windows of a piece of a run: substr walks from the start of its text


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Character buffer and read ends of an Arrow string column; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets[1:] - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def kmers(
    reads: DataFrame, k: int = bases.DEFAULT_K, keep: tuple[str, ...] = (), seq: str = "seq", u_as_t: bool = True
) -> DataFrame:
    """Canonical k-mer codes of a ``seq`` column, one row (..keep.., kmer BIGINT) per window.

    Narrow and streaming: each Arrow batch is cut into slices of at most
    2^17 windows, so a very long read never becomes one oversized batch.
    """
    bases.check_k(k)
    fields = [reads.schema[c] for c in keep]
    table = codes.base_table(u_as_t)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = characters(batch.column(len(keep)))
            for starts, values in codes.canonical_slices(data, ends, k, table):
                columns = []
                if keep:
                    owner = pa.array(np.searchsorted(ends, starts, "right"))
                    columns = [batch.column(i).take(owner) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values)], names=[*keep, "kmer"])

    schema = T.StructType([*fields, T.StructField("kmer", T.LongType(), False)])
    return reads.select(*keep, seq).mapInArrow(extract, schema)


def tallies(parts: Iterator[np.ndarray], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Combine codes within a task: (kmer, part) per run of equal codes in about 2^23 (or `most`) sorted ones.

    The codes lie in one array that is filled again and again; it and the places of its runs are all that is held.
    """
    most = most or _SORT_ROWS
    held, rows = np.empty(0, np.int64), 0
    for values in parts:
        done = 0
        while done < len(values):
            if rows == most:
                yield from sorted_runs(held)
                rows = 0
            some = values[done : done + most - rows]
            if rows + len(some) > len(held):
                held = np.concatenate([held[:rows], np.empty(min(most, max(2 * len(held), rows + len(some), 1 << 16)) - rows, np.int64)])
            held[rows : rows + len(some)] = some.view(np.int64)
            rows, done = rows + len(some), done + len(some)
    if rows:
        yield from sorted_runs(held[:rows])


def sorted_runs(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(kmer, part) of the codes, which are sorted in place, some 2^18 rows at a time."""
    values.sort()
    change = np.empty(len(values), np.bool_)
    change[:1] = True
    np.not_equal(values[1:], values[:-1], out=change[1:])
    first = np.flatnonzero(change)
    del change
    for lo in range(0, len(first), _OUT_ROWS):
        some = first[lo : lo + _OUT_ROWS]
        part = np.diff(some, append=first[lo + _OUT_ROWS] if lo + _OUT_ROWS < len(first) else len(values))
        yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(part)], ["kmer", "part"])


def labelled_tallies(reads: DataFrame, k: int, label: str, seq: str = "seq", u_as_t: bool = True) -> DataFrame:
    """(label INT, kmer BIGINT, part BIGINT): the same for the reads of each label (a batch, a mate) apart."""
    bases.check_k(k)
    table = codes.base_table(u_as_t)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = characters(batch.column(1))
            owners = batch.column(0).to_numpy(zero_copy_only=False)
            for starts, values in codes.canonical_slices(data, ends, k, table):
                own = owners[np.searchsorted(ends, starts, "right")]
                order = np.lexsort((values, own))
                own, values = own[order], values[order]
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (values[1:] != values[:-1])]))
                part = np.diff(np.append(first, len(values)))
                columns = [pa.array(own[first], pa.int32()), pa.array(values[first]), pa.array(part)]
                yield pa.RecordBatch.from_arrays(columns, [label, "kmer", "part"])

    return reads.select(F.col(label).cast("int"), seq).mapInArrow(extract, f"{label} int, {TALLY_SCHEMA}")


def tallied_kmers(reads: DataFrame, k: int, seq: str = "seq", u_as_t: bool = True) -> DataFrame:
    """(kmer BIGINT, part BIGINT): k-mers with the counts of one stretch of input, combined in the task."""
    table = codes.base_table(u_as_t)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reads_of = (characters(batch.column(0)) for batch in batches)
        yield from tallies(
            values for data, ends in reads_of for _, values in codes.canonical_slices(data, ends, bases.check_k(k), table)
        )

    return reads.select(seq).mapInArrow(extract, TALLY_SCHEMA)


def runs(reads: DataFrame, k: int = 1, keep: tuple[str, ...] = (), seq: str = "seq", u_as_t: bool = True) -> DataFrame:
    """Maximal stretches of valid bases of at least k, as (..keep.., run STRING)."""
    bases.check_k(k)
    stretches = F.split(bases.normalize(F.col(seq), u_as_t), "[^ACGT]+")
    # the outer form keeps Catalyst from evaluating the split a second time in an inferred filter
    return reads.select(*keep, F.explode_outer(stretches).alias("run")).where(F.length("run") >= k)


def kmer_strings(reads: DataFrame, k: int, keep: tuple[str, ...] = (), seq: str = "seq", u_as_t: bool = True) -> DataFrame:
    """Built-ins only: (..keep.., run, pos, kmer, canon) per window, in text form.

    ``run`` numbers the stretches of at least k bases of a read from 0, ``pos``
    the windows of a stretch from 1. Runs are cut into pieces, and both strands of
    a piece are spelled once, so a window costs two short substrings.
    """
    bases.check_k(k)
    stretches = F.split(bases.normalize(F.col(seq), u_as_t), "[^ACGT]+")
    return (
        reads.select(*keep, F.posexplode_outer(F.filter(stretches, lambda s: F.length(s) >= k)).alias("run", "bases"))
        .where(F.col("bases").isNotNull())
        .select(*keep, "run", F.inline_outer(_pieces("bases", k, PIECE * PIECE)).alias("far", "slice"))
        .select(*keep, "run", "far", F.inline_outer(_pieces("slice", k, PIECE)).alias("near", "piece"))
        .select(*keep, "run", (F.col("far") + F.col("near")).alias("at"), "piece", bases.revcomp(F.col("piece")).alias("other"))
        .select(*keep, "run", "at", "piece", "other", F.explode_outer(F.sequence(F.lit(1), F.length("piece") - (k - 1))).alias("p"))
        .select(
            *keep,
            "run",
            (F.col("at") + F.col("p")).alias("pos"),
            F.substr("piece", "p", F.lit(k)).alias("kmer"),
            F.substr("other", F.length("piece") - F.col("p") - (k - 2), F.lit(k)).alias("mirror"),
        )
        .select(*keep, "run", "pos", "kmer", F.least("kmer", "mirror").alias("canon"))
    )


def _pieces(text: str, k: int, size: int) -> Column:
    """(place from 0, piece) of a text of k characters or more: every window of k lies in one piece, `size` in each but the last."""
    starts = F.sequence(F.lit(0), F.length(text) - k, F.lit(size))
    return F.transform(starts, lambda f: F.struct(f.alias("at"), F.substr(F.col(text), f + 1, F.lit(size + k - 1)).alias("piece")))


def total_kmers(reads: DataFrame, k: int = bases.DEFAULT_K, seq: str = "seq", u_as_t: bool = True) -> DataFrame:
    """Number of k-mer occurrences, from the mask of valid windows alone: no k-mer is built, one row per task moves."""
    bases.check_k(k)
    table = codes.base_table(u_as_t)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            data, ends = characters(batch.column(0))
            total += sum(int(np.count_nonzero(keep)) for _, keep in codes.slices(data, ends, k, table, codes._STEP))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], names=["part"])

    parts = reads.select(seq).mapInArrow(count, "part bigint")
    return parts.agg(F.coalesce(F.sum("part"), F.lit(0)).cast("bigint").alias("n_total"))
