"""Sketches of sets of k-mers that can be united without counting again.

One HyperLogLog sketch per label (a batch, a mate, a port) answers for any union of
labels how many distinct k-mers it has, within three standard errors of the sketch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LG_SIZE = 14  # of a sketch: 2^14 registers, some 16 KB


def standard_error(lg_size: int = LG_SIZE) -> float:
    return 1.04 / 2 ** (lg_size / 2)


def label_sketches(tallied: DataFrame, label: str, lg_size: int = LG_SIZE) -> DataFrame:
    """(label, sketch) of rows (label, kmer): each task sketches what it has, and sketches meet instead of k-mers."""
    return tallied.groupBy(label).agg(F.hll_sketch_agg("kmer", F.lit(lg_size)).alias("sketch"))


def union_estimate(sketches: DataFrame) -> DataFrame:
    """How many distinct k-mers the labels of these sketches have together, one row."""
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique_est"))


def running_unions(sketches: DataFrame, label: str) -> DataFrame:
    """(label, n_unique_est): distinct k-mers of this label and all lower ones; a row per label goes through the window."""
    upto = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    return sketches.select(label, F.hll_sketch_estimate(F.hll_union_agg("sketch").over(upto)).alias("n_unique_est"))
