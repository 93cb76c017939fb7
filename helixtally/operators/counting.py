"""Exact k-mer counts and everything read off the count table.

The count table has one row (kmer BIGINT, n BIGINT) per distinct k-mer. Copies of
a k-mer are combined within each task before they are shuffled, so a k-mer that
makes up a third of the input crosses the network a few times per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.functions import bases
from helixtally.operators import superkmers
from helixtally.operators.windows import kmers, tallied_kmers

# The count caps of a 10-bit and of a 22-bit counter, and the last histogram bin.
CAP_10_BIT, CAP_22_BIT, TOP_BIN = 1023, 4194303, 255


def count_codes(codes: DataFrame) -> DataFrame:
    """Group-count of a ``kmer`` column."""
    return codes.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


def count_kmers(
    reads: DataFrame, k: int = bases.DEFAULT_K, seq: str = "seq", u_as_t: bool = True, shuffle: str = "superkmers"
) -> DataFrame:
    """Count table of the canonical k-mers of ``reads``.

    ``shuffle`` says what crosses the network: "kmers" (one row per k-mer, combined
    by Spark's partial aggregation), "tallies" (k-mers combined by sorting in the
    task first) or "superkmers" (packed stretches of bases; see ``superkmers``), the default.
    """
    bases.check_k(k)
    if shuffle == "kmers":
        return count_codes(kmers(reads, k, seq=seq, u_as_t=u_as_t))
    if shuffle == "tallies":
        return count_tallies(tallied_kmers(reads, k, seq, u_as_t))
    if shuffle == "superkmers":
        return superkmers.count_super_kmers(superkmers.super_kmers(reads, k, seq=seq, u_as_t=u_as_t), k)
    raise ValueError('shuffle must be "kmers", "tallies" or "superkmers"')


def count_tallies(tallied: DataFrame) -> DataFrame:
    """Count table from partial counts (kmer, part)."""
    return tallied.groupBy("kmer").agg(F.sum("part").alias("n"))


def unique_kmers(counts: DataFrame) -> DataFrame:
    """Number of distinct k-mers, one row."""
    return counts.agg(F.count(F.lit(1)).alias("n_unique"))


def saturate(counts: DataFrame, cap: int) -> DataFrame:
    """Counts as a bounded counter would report them."""
    if cap < 1:
        raise ValueError("cap must be positive")
    return counts.withColumn("n", F.least(F.col("n"), F.lit(cap).cast("bigint")))


def threshold(counts: DataFrame, at_least: int = 1, at_most: int | None = None) -> DataFrame:
    """Keep k-mers whose count lies in [at_least, at_most]."""
    kept = counts.where(F.col("n") >= at_least)
    return kept if at_most is None else kept.where(F.col("n") <= at_most)


def threshold_report(counts: DataFrame, at_least: int, cap: int) -> DataFrame:
    """How many k-mers a minimum count keeps and drops, and how many exceed a counter cap."""
    n = F.col("n")
    return counts.agg(
        F.count_if(n >= at_least).alias("kept"),
        F.count_if(n < at_least).alias("below"),
        F.count_if(n > cap).alias("above"),
        F.coalesce(F.sum(F.when(n >= at_least, n)), F.lit(0).cast("bigint")).alias("kept_total"),
    )


def sort_counts(reads: DataFrame, k: int = bases.DEFAULT_K, seq: str = "seq") -> DataFrame:
    """The count table by sorting and run lengths instead of hashing.

    Each task sorts its codes, some 8 million at a time, and emits one row per run
    of equal ones, which shrinks a hot k-mer to a few rows before anything moves.
    The runs are then shuffled by k-mer and sorted, and equal neighbours are merged.
    """

    def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sums = np.add.reduceat(n, first)
            keys = keys[first]
            if last_key is not None:
                if keys[0] == last_key:
                    sums[0] += last_n
                else:
                    keys, sums = np.insert(keys, 0, last_key), np.insert(sums, 0, last_n)
            last_key, last_n = keys[-1], sums[-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(sums[:-1])], names=["kmer", "n"])
        if last_key is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([last_key], pa.int64()), pa.array([last_n], pa.int64())], names=["kmer", "n"]
            )

    return (
        tallied_kmers(reads, k, seq)
        .repartition("kmer")
        .sortWithinPartitions("kmer")
        .mapInArrow(merge_runs, "kmer bigint, n bigint")
    )


def approx_unique(codes: DataFrame, rsd: float = 0.02) -> DataFrame:
    """HyperLogLog estimate of the distinct k-mers: one pass, no k-mer is shuffled."""
    return codes.agg(F.approx_count_distinct("kmer", rsd).alias("n_unique_est"))


def mate_unique(tallied: DataFrame, mate: str = "mate") -> DataFrame:
    """Occurrences and distinct k-mers of mate 1, mate 2 and both together, from rows (mate, kmer, part), in one shuffle."""
    of = lambda number: F.sum(F.when(F.col(mate) == number, F.col("part")).otherwise(0))
    per_kmer = tallied.groupBy("kmer").agg(of(1).alias("n1"), of(2).alias("n2"))
    sides = [("mate1", F.col("n1")), ("mate2", F.col("n2")), ("both", F.col("n1") + F.col("n2"))]
    wide = per_kmer.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("part"),
                    F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_total"),
                    F.count_if(n > 0).alias("n_unique"),
                )
                for name, n in sides
            ]
        ).alias("parts")
    )
    return wide.select(F.inline("parts"))
