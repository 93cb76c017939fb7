"""Exact k-mer counting and k-mer analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from helixtally.functions.sql import register  # noqa: E402
from helixtally.operators.counting import (  # noqa: E402
    approx_unique,
    count_kmers,
    mate_unique,
    saturate,
    sort_counts,
    threshold,
    unique_kmers,
)
from helixtally.operators.spectrum import histogram, summary  # noqa: E402
from helixtally.operators.windows import kmer_strings, kmers, runs, total_kmers  # noqa: E402
from helixtally.sources.fasta import read_fasta  # noqa: E402
from helixtally.sources.fastq import (  # noqa: E402
    count_fastq,
    fastq_kmers,
    fastq_lines,
    read_fastq,
    read_pair,
    register_sources,
)

__all__ = [
    "approx_unique",
    "count_fastq",
    "count_kmers",
    "fastq_kmers",
    "fastq_lines",
    "histogram",
    "kmer_strings",
    "kmers",
    "mate_unique",
    "read_fasta",
    "read_fastq",
    "read_pair",
    "register",
    "register_sources",
    "runs",
    "saturate",
    "sort_counts",
    "summary",
    "threshold",
    "total_kmers",
    "unique_kmers",
]
