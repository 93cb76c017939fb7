"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set the tables, the cores and the runs per
query (the median counts). Every query is warmed once and the runs are interleaved, so
that the order of the list says nothing. The documents table is first laid out over one
file per core, as any large table is (layout_sec); its source is a single row group,
which a scan can't divide. Results go to Spark's no-op sink: whole tables
are computed but not collected. BENCH_READS=N also counts N pairs of simulated reads
of 101 bases (750000 is the baseline's size) at several shares of repeated reads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from helixtally.plans.catalogue import CATALOGUE  # noqa: E402
from helixtally.session import delete, local_session, shared_folder  # noqa: E402
from helixtally.sources.fastq import count_fastq  # noqa: E402

HEADLINE = (
    "unique_kmers",
    "total_kmers",
    "kmer_counts",
    "kmer_counts_k31",
    "kmers_k5",
    "grouped_counts",
    "tallied_counts",
    "sort_runlength_counts",
    "kmer_counts_builtin",
    "histogram_dense",
    "spectrum_summary",
    "hash64",
    "mix64",
    "virtual_buckets_3072",
    "paired_union",
    "batch_new_unique",
    "approx_unique",
    "fastq_roundtrip",
    "fastq_wrapped_roundtrip",
    "repeated_counts",
    "merged_count_table",
    "stream_bucket_counts",
    "stream_counts",
    "stream_delta_counts",
)
LENGTH, K = 101, 21
BASELINE_KMERS_PER_SEC = 57e6


def run(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    CATALOGUE[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def simulated(spark: SparkSession, pairs: int, fresh: float) -> DataFrame:
    """(mate, value): FASTQ records of random reads, made from hashes of their numbers; a share of 1 - fresh repeats others."""
    number = F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(max(1, int(2 * pairs * fresh))))
    bits = F.concat(*[F.lpad(F.bin(F.xxhash64(number, F.lit(7 + i))), 64, "0") for i in range(4)])
    letters = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(bits, "(..)", "$1 "), "00 ", "A"), "01 ", "C"), "10 ", "G")
    seq = F.substr(F.regexp_replace(letters, "11 ", "T"), F.lit(1), F.lit(LENGTH))
    record = F.concat(F.lit("@r"), F.col("id").cast("string"), F.lit("\n"), seq, F.lit("\n+\n"), F.lit("I" * LENGTH))
    return spark.range(2 * pairs, numPartitions=8).select((F.col("id") % 2 + 1).alias("mate"), record.alias("value"))


def at_size(spark: SparkSession, pairs: int) -> dict[str, float]:
    """K-mers per second of counting simulated pairs, per share of reads that aren't repeats."""
    rates = {}
    for fresh in (1.0, 0.3, 0.05):
        work = shared_folder(spark, "simulated")
        simulated(spark, pairs, fresh).write.partitionBy("mate").text(work)
        seconds = []
        for _ in range(3):
            start = time.perf_counter()
            count_fastq(spark, work, K, mode="records", splitBytes=16 << 20).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        rates[f"fresh_{fresh}"] = round(2 * pairs * (LENGTH - K + 1) / statistics.median(seconds[1:]))
        delete(spark, work)
    return rates


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    start = time.perf_counter()
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    spark.range(1).count()
    setup = time.perf_counter() - start
    start, tables = time.perf_counter(), shared_folder(spark, "bench")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{tables}/documents.parquet")
    layout = time.perf_counter() - start
    for name in HEADLINE:
        run(spark, name, tables)
    times: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for turn in range(runs):
        for name in HEADLINE if turn % 2 == 0 else reversed(HEADLINE):
            times[name].append(run(spark, name, tables))
    seconds = {name: statistics.median(t) for name, t in times.items()}
    total = CATALOGUE["total_kmers"](spark, tables).first().n_total
    report = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(s, 3) for name, s in seconds.items()},
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "runs": runs,
        "session_start_sec": round(setup, 3),
        "layout_sec": round(layout, 3),
        "kmers": total,
        "kmers_per_sec": round(total / seconds["kmer_counts"]),
        "baseline_kmers_per_sec": BASELINE_KMERS_PER_SEC,
    }
    if pairs := int(os.environ.get("BENCH_READS", "0")):
        report["simulated_kmers_per_sec"] = at_size(spark, pairs)
    delete(spark, tables)
    print(json.dumps(report))


if __name__ == "__main__":
    main()
