"""Count tables that grow: bucketed and sorted by k-mer, so that adding counts moves the new ones only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixtally.session import delete, shared_folder

BUCKETS = 64
_BUCKET_ROWS = 1 << 23


def buckets_for(kmers: int) -> int:
    """Buckets for a table of so many k-mers at most: a task sorts one, which so stays below some hundred megabytes."""
    return max(16, 1 << max(0, kmers // _BUCKET_ROWS).bit_length())


def save_counts(counts: DataFrame, name: str, buckets: int = BUCKETS) -> None:
    """Write a count table (kmer, n) as the bucketed table ``name``; one file per bucket, sorted."""
    _save(counts.select("kmer", "n").repartition(buckets, "kmer"), name, buckets)


def _save(counts: DataFrame, name: str, buckets: int) -> None:
    folder = shared_folder(counts.sparkSession, "table")
    writer = counts.write.format("parquet").option("path", folder).bucketBy(buckets, "kmer").sortBy("kmer")
    writer.saveAsTable(name)


def buckets_of(spark: SparkSession, name: str) -> int:
    """Number of buckets of a saved count table."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Num Buckets'").collect()
    if not rows:
        raise ValueError(f"{name} is not bucketed")
    return int(rows[0].data_type)


def merged_counts(spark: SparkSession, name: str, new: DataFrame) -> DataFrame:
    """The saved counts and new ones (kmer, n) added up; only the new side is moved."""
    buckets = buckets_of(spark, name)
    old = spark.table(name).withColumnRenamed("n", "held")
    moved = new.select("kmer", "n").repartition(buckets, "kmer")
    both = old.join(moved.hint("merge"), "kmer", "full_outer")
    return both.select("kmer", (F.coalesce("held", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("bigint").alias("n"))


def add_counts(spark: SparkSession, name: str, new: DataFrame) -> None:
    """Add new counts to the saved table ``name``, which then is the sum.

    The sum is written beside the old table, each task its own bucket, and takes its name
    when it is whole; a run that fails before leaves the old table as it was.
    """
    following = f"{name}_{uuid.uuid4().hex}"
    _save(merged_counts(spark, name, new), following, buckets_of(spark, name))
    old = {f.rsplit("/", 1)[0] for f in spark.table(name).inputFiles()}
    spark.sql(f"DROP TABLE {name}")
    spark.sql(f"ALTER TABLE {following} RENAME TO {name}")
    for folder in old:
        delete(spark, folder)
