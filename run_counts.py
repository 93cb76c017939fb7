"""Count the canonical k-mers of FASTQ or FASTA files from the shell.

    spark-submit run_counts.py reads_1.fastq reads_2.fastq -k 21 --hist
"""

from __future__ import annotations

import argparse
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import helixtally as ht  # noqa: E402
from helixtally.functions import bases  # noqa: E402
from helixtally.session import delete, shared_folder  # noqa: E402
from helixtally.sources.fastq import range_table  # noqa: E402
from helixtally.streaming import buckets, incremental  # noqa: E402

MIB = 1 << 20


def arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("files", nargs="+", help="FASTQ files, folders or patterns; both mates of a pair together")
    parser.add_argument("-k", type=int, default=bases.DEFAULT_K, help="k-mer length, 1 to 31")
    parser.add_argument("-b", type=int, metavar="MIB", help="count as a stream in batches of this size")
    parser.add_argument("--buckets", type=int, default=buckets.BUCKETS, help="state entries of a stream, one per million distinct k-mers or so")
    parser.add_argument("-n", type=int, default=1, metavar="RUNS", help="repeat and report the median time")
    parser.add_argument("--fasta", action="store_true", help="the files are FASTA")
    parser.add_argument("--u-breaks", action="store_true", help="U ends a window instead of counting as T")
    parser.add_argument("--hist", action="store_true", help="print the non-empty bins of the spectrum")
    parser.add_argument("--hist-all", action="store_true", help="print bins 1 to 255, empty ones too")
    parser.add_argument("--mode", default="lines", choices=("lines", "records", "wrapped"), help="FASTQ by line numbers, checked four-line records, or records over several lines")
    parser.add_argument("--min", type=int, default=1, metavar="N", help="keep k-mers that occur at least N times")
    parser.add_argument("--max", type=int, metavar="N", help="keep k-mers that occur at most N times")
    parser.add_argument("-o", metavar="FOLDER", help="write the count table as parquet")
    args = parser.parse_args(argv)
    bases.check_k(args.k)
    if args.n < 1 or (args.b is not None and args.b < 1):
        parser.error("-n and -b must be positive")
    if args.b and args.fasta:
        parser.error("batches need FASTQ input")
    return args


def said(text: str) -> None:
    """Progress goes out as it happens, also into a pipe."""
    print(text, flush=True)


class Phases:
    """Says how long each phase took as soon as it ends."""

    def __init__(self) -> None:
        self.start = time.perf_counter()

    def end(self, name: str) -> None:
        now = time.perf_counter()
        said(f"phase {name}\t{now - self.start:.2f} s")
        self.start = now


def count(spark: SparkSession, args: argparse.Namespace, work: str, phases: Phases) -> DataFrame:
    as_t = str(not args.u_breaks).lower()
    if args.b:
        batches = incremental.plan_batches(spark, f"{work}/plan", args.files, batch_bytes=args.b * MIB)
        phases.end(f"planning {batches} batches")
        stream = buckets.stream_super_kmers(spark, f"{work}/plan", args.k, not args.u_breaks, buckets=args.buckets)
        counts = buckets.stream_bucket_counts(stream, work, args.k, print_batch)
        phases.end("counting batches")
        return counts
    if args.fasta:
        return ht.count_kmers(ht.read_fasta(spark, args.files, args.k), args.k, u_as_t=not args.u_breaks)
    return ht.count_fastq(spark, args.files, args.k, mode=args.mode, uAsT=as_t)


def print_batch(report: dict) -> None:
    """A line for a micro-batch that just ended: what it brought, and where its time went."""
    if report["numInputRows"]:
        figures = report["observedMetrics"].get("batch") or {}
        brought = "\t".join(f"{name.replace('_', ' ')} {n or 0}" for name, n in figures.items())
        times = "\t".join(f"{name} {ms / 1000:.2f} s" for name, ms in report["durationMs"].items() if ms)
        said(f"batch {report['batchId']}\t{brought}\t{times}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = arguments(argv)
    phases = Phases()
    spark = spark or SparkSession.builder.appName("helixtally").getOrCreate()
    phases.end("session")
    megabytes = range_table(spark, args.files, splittable=False).agg(F.sum("size")).first()[0] or 0
    phases.end("listing files")
    seconds, folders = [], []
    for run in range(args.n):
        start = time.perf_counter()
        folders.append(shared_folder(spark, "counts"))
        named = args.o if args.o and run == args.n - 1 else f"{folders[-1]}/result"
        figures = Observation()
        counts = ht.threshold(count(spark, args, folders[-1], phases), args.min, args.max)
        counts = counts.observe(figures, F.count(F.lit(1)).alias("unique"), F.sum("n").alias("total"))
        counts.write.mode("errorifexists").parquet(named)  # the figures come with the write, the table isn't read for them
        seconds.append(time.perf_counter() - start)
        phases.end("counts and table" if not args.b else "table")
    median = statistics.median(seconds)
    said(f"unique {args.k}-mers\t{figures.get['unique']}")
    said(f"total {args.k}-mers\t{figures.get['total'] or 0}")
    said(f"seconds (median of {args.n})\t{median:.3f}")
    said(f"MB/s\t{megabytes / MIB / median:.2f}")
    if args.hist or args.hist_all:
        for r in ht.histogram(spark.read.parquet(named), dense=args.hist_all).toLocalIterator():
            said(f"{r.bin}\t{r.freq}")
        phases.end("spectrum")
    for folder in folders:
        delete(spark, folder)


if __name__ == "__main__":
    main()
