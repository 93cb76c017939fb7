"""Frequency spectrum of a count table: histograms, summaries, exact medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtally.operators.counting import TOP_BIN


def histogram(counts: DataFrame, dense: bool = False, top: int = TOP_BIN) -> DataFrame:
    """Distinct k-mers per count, (bin INT, freq BIGINT) in bin order; the last bin is open.

    ``dense`` lists every bin from 1 to ``top``, empty ones as 0.
    """
    if top < 1:
        raise ValueError("top must be positive")
    binned = counts.groupBy(F.least(F.col("n"), F.lit(top)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("freq")
    )
    if dense:
        zeros = counts.sparkSession.range(1, top + 1, 1, 1).select(
            F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint").alias("freq")
        )
        binned = binned.unionByName(zeros).groupBy("bin").agg(F.sum("freq").alias("freq"))
    return binned.orderBy("bin")


def summary(counts: DataFrame, first_peak_bin: int = 4, top: int = TOP_BIN) -> DataFrame:
    """One row: distinct, total, singletons, largest and mean count, fullest bin from ``first_peak_bin`` on.

    Works on the exact count spectrum (count value -> k-mers), which has at most
    about sqrt(2 * total) rows however large the input is.
    """
    spectrum = _exact_spectrum(counts, F.col("n"))
    bins = spectrum.withColumn("bin", F.least(F.col("value"), F.lit(top)).cast("int"))
    bins = bins.groupBy("bin").agg(
        F.sum("freq").alias("freq"),
        F.sum(F.col("freq") * F.col("value")).alias("occurrences"),
        F.max("value").alias("largest"),
    )
    peak = F.max_by("bin", F.when(F.col("bin") >= first_peak_bin, F.struct("freq", -F.col("bin"))))
    return bins.agg(
        F.coalesce(F.sum("freq"), F.lit(0).cast("bigint")).alias("n_unique"),
        F.coalesce(F.sum("occurrences"), F.lit(0).cast("bigint")).alias("n_total"),
        F.coalesce(F.sum(F.when(F.col("bin") == 1, F.col("freq"))), F.lit(0).cast("bigint")).alias("singletons"),
        F.max("largest").alias("max_n"),
        peak.alias("peak_bin"),
    ).withColumn("mean_n", F.round(F.try_divide(F.col("n_total"), F.col("n_unique")), 6))


def exact_median(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Exact median through a frequency table, so only distinct values reach the last step."""
    return _exact_spectrum(df, value).agg(F.expr("percentile(value, 0.5, freq)").alias(name))


def _exact_spectrum(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("freq"))
