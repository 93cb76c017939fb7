"""The query catalogue: every analytic of the package over the ``documents`` table.

Each query takes (spark, folder of parquet tables) and returns a DataFrame. Reads
are derived from the texts by ``text_reads``; all queries use every row and the
whole text. k is 21 unless the name says otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixtally.functions import bases
from helixtally.functions.sql import call, register
from helixtally.functions.tables import register_count_kmers
from helixtally.operators import counting, routing, sketches, spectrum, superkmers, tables, windows
from helixtally.session import delete, shared_folder, short_shuffles
from helixtally.sources.fasta import read_fasta
from helixtally.sources.fastq import count_fastq, fastq_kmers, fastq_lines, range_table, read_pair
from helixtally.sources.ranges import DEFAULT_SPLIT
from helixtally.sources.text_reads import text_reads
from helixtally.streaming import buckets, incremental

K = 21
BATCHES = 9

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}


def query(fn: Query) -> Query:
    CATALOGUE[fn.__name__] = fn
    return fn


def reads(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, seq) of the documents table."""
    return text_reads(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))


def counts(spark: SparkSession, folder: str, k: int = K) -> DataFrame:
    return counting.count_kmers(reads(spark, folder), k)


def spelled(table: DataFrame, k: int = K) -> DataFrame:
    """Count table with the k-mer spelled out; done on distinct k-mers only."""
    return table.select(bases.decode(F.col("kmer"), k).alias("canon"), "n")


def write_fastq(source: DataFrame, target: str, *parts: str) -> None:
    """Four-line records through Spark's text sink, one file per task.

    Characters that mean something in FASTQ become N, which ends a window like any other; a null is empty.
    """
    seq = F.coalesce(F.translate("seq", "@+\r", "NNN"), F.lit(""))
    record = F.concat_ws(
        "\n",
        F.concat(F.lit("@"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
        seq,
        F.lit("+"),
        F.repeat(F.lit("I"), F.octet_length(seq)),
    )
    out = source.select(record.alias("value"), *parts).write
    (out.partitionBy(*parts) if parts else out).text(target)


# --- reads and runs -------------------------------------------------------------------------------


@query
def read_scan(spark, folder):
    """Length of every read."""
    return reads(spark, folder).select("doc_id", F.length("seq").cast("bigint").alias("seq_len"))


@query
def base_composition(spark, folder):
    """Totals of A, C, G, T and of everything else."""
    seq = F.col("seq")
    per_base = [F.sum(bases.base_total(seq, b)).cast("bigint").alias(b.lower()) for b in "ACGT"]
    other = F.sum(F.length(seq) - bases.valid_bases(seq)).cast("bigint").alias("other")
    return reads(spark, folder).agg(*per_base, other)


@query
def invalid_breaks(spark, folder):
    """Characters per read that end a window."""
    seq = F.col("seq")
    return reads(spark, folder).select(
        "doc_id", (F.length(seq) - bases.valid_bases(seq)).cast("bigint").alias("n_invalid")
    )


@query
def acgt_runs(spark, folder):
    """How many runs of valid bases have each length."""
    lengths = windows.runs(reads(spark, folder)).select(F.length("run").cast("bigint").alias("run_len"))
    return lengths.groupBy("run_len").agg(F.count(F.lit(1)).alias("n_runs"))


@query
def short_reads(spark, folder):
    """Reads and runs that are too short to hold a k-mer."""
    stretches = F.filter(F.split(bases.normalize(F.col("seq")), "[^ACGT]+"), lambda s: F.length(s) >= 1)
    long_ones = F.size(F.filter(F.col("stretches"), lambda s: F.length(s) >= K))
    per_read = reads(spark, folder).select("seq", stretches.alias("stretches"))
    return per_read.agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.count_if(F.length("seq") < K).alias("short_reads"),
        F.count_if(long_ones == 0).alias("reads_without_kmer"),
        F.sum(F.size("stretches")).cast("bigint").alias("n_runs"),
        F.sum(F.size("stretches") - long_ones).cast("bigint").alias("short_runs"),
    )


# --- k-mer generation and codes -------------------------------------------------------------------


@query
def kmers_k5(spark, folder):
    """All canonical 5-mers with their counts."""
    return spelled(counts(spark, folder, 5), 5)


@query
def kmer_positions(spark, folder):
    """Every 21-mer with its read, run number and place in the run."""
    return windows.kmer_strings(reads(spark, folder), K, keep=("doc_id",)).drop("canon")


@query
def sql_table_function(spark, folder):
    """Canonical 6-mer counts through the SQL functions alone."""
    register(spark)
    return spark.sql(
        "SELECT canon, count(*) AS n FROM"
        " (SELECT kmer_canonical(w.kmer) AS canon FROM {r} r, LATERAL kmers(r.seq, 6) w) GROUP BY canon",
        r=reads(spark, folder),
    )


@query
def sql_count_kmers(spark, folder):
    """Canonical 21-mer counts through the table function over a table argument."""
    register_count_kmers(spark)
    reads(spark, folder).createOrReplaceTempView("reads_to_count")
    return spelled(spark.sql(f"SELECT kmer, sum(n) AS n FROM count_kmers(TABLE(reads_to_count), {K}) GROUP BY kmer"))


@query
def revcomp(spark, folder):
    """Distinct 5-mers and their reverse complements."""
    words = windows.kmer_strings(reads(spark, folder), 5).select("kmer").distinct()
    return words.select("kmer", bases.revcomp(F.col("kmer")).alias("rc"))


@query
def canonical(spark, folder):
    """Distinct 6-mers and their canonical forms (even k: palindromes occur)."""
    words = windows.kmer_strings(reads(spark, folder), 6).select("kmer").distinct()
    return words.select("kmer", bases.canonical(F.col("kmer")).alias("canon"))


@query
def encode_2bit(spark, folder):
    """Distinct k-mers spelled out, and encoded again from the spelling."""
    words = spelled(counts(spark, folder)).select("canon")
    return words.select("canon", bases.encode(F.col("canon")).alias("y"))


@query
def hash64(spark, folder):
    """Invertible hash of every distinct k-mer."""
    return routing.with_hash64(counts(spark, folder), K).select(F.col("kmer").alias("y"), "h")


@query
def hash_fe(spark, folder):
    """XOR-shift hash of every distinct k-mer."""
    return routing.with_hash_fe(counts(spark, folder), K).select(F.col("kmer").alias("y"), "h")


@query
def mix64(spark, folder):
    """XOR-shift hash of every distinct k-mer, and its 64-bit finalizer."""
    hashed = routing.with_hash_fe(counts(spark, folder), K)
    return hashed.select("h", call("kmer_mix64", F.col("h")).alias("mixed"))


@query
def murmur64(spark, folder):
    """Invertible hash of every distinct k-mer, and the other 64-bit finalizer of it."""
    hashed = routing.with_hash64(counts(spark, folder), K)
    return hashed.select("h", call("kmer_murmur64", F.col("h")).alias("mixed"))



# --- counts and spectrum --------------------------------------------------------------------------


@query
def unique_kmers(spark, folder):
    """Number of distinct canonical k-mers."""
    return counting.unique_kmers(counts(spark, folder))


@query
def total_kmers(spark, folder):
    """Number of k-mer occurrences, without building any."""
    return windows.total_kmers(reads(spark, folder), K)


@query
def kmer_counts(spark, folder):
    """The count table."""
    return spelled(counts(spark, folder))


@query
def kmer_counts_k31(spark, folder):
    """The count table at the largest k."""
    return spelled(counts(spark, folder, 31), 31)


@query
def kmer_counts_builtin(spark, folder):
    """The count table from built-in text functions only."""
    words = windows.kmer_strings(reads(spark, folder), K)
    return words.groupBy("canon").agg(F.count(F.lit(1)).alias("n"))


@query
def sort_runlength_counts(spark, folder):
    """The count table by sorting and run lengths."""
    return spelled(counting.sort_counts(reads(spark, folder), K))


@query
def tallied_counts(spark, folder):
    """The count table with k-mers combined in the task as the unit of the shuffle."""
    return spelled(counting.count_kmers(reads(spark, folder), K, shuffle="tallies"))


@query
def grouped_counts(spark, folder):
    """The count table with single k-mers as the unit of the shuffle."""
    return spelled(counting.count_kmers(reads(spark, folder), K, shuffle="kmers"))


@query
def histogram_dense(spark, folder):
    """Bins 1 to 255 of the spectrum, empty ones included."""
    return spectrum.histogram(counts(spark, folder), dense=True)


@query
def histogram_sparse(spark, folder):
    """Non-empty bins of the spectrum."""
    return spectrum.histogram(counts(spark, folder))


@query
def spectrum_summary(spark, folder):
    """Key figures of the spectrum."""
    return spectrum.summary(counts(spark, folder))


@query
def saturating_counts(spark, folder):
    """Sum of counts under counters of several widths."""
    caps = {"cap_7": 7, "cap_1023": counting.CAP_10_BIT, "cap_4194303": counting.CAP_22_BIT}
    table = counts(spark, folder)
    return table.agg(
        *[F.sum(F.least(F.col("n"), F.lit(c).cast("bigint"))).alias(name) for name, c in caps.items()],
        F.sum("n").alias("uncapped"),
    )


@query
def min_count_filter(spark, folder):
    """What a minimum count of 2 keeps and drops, and what exceeds 255."""
    return counting.threshold_report(counts(spark, folder), 2, 255)


@query
def min_count_table(spark, folder):
    """The k-mers that occur 2 to 255 times."""
    return spelled(counting.threshold(counts(spark, folder), 2, 255))


@query
def repeated_counts(spark, folder):
    """The k-mers that occur twice or more; what occurs once is dropped before the second exchange."""
    return spelled(superkmers.count_repeated(superkmers.super_kmers(reads(spark, folder), K), K))


@query
def merged_count_table(spark, folder):
    """A saved count table to which two more batches of reads are added; only new counts are moved."""
    name = f"counts_{uuid.uuid4().hex}"
    letters = reads(spark, folder).agg(F.sum(F.length("seq").cast("bigint"))).first()[0] or 0
    for i in range(3):
        part = counting.count_kmers(reads(spark, folder).where(F.pmod("doc_id", F.lit(3)) == i), K)
        tables.add_counts(spark, name, part) if i else tables.save_counts(part, name, tables.buckets_for(letters))
    return spelled(spark.table(name))


@query
def sketch_unions(spark, folder):
    """Exact distinct k-mers of the batches up to each one, and whether the union of their sketches says so within three standard errors."""
    batched = reads(spark, folder).withColumn("batch", F.pmod("doc_id", F.lit(BATCHES)).cast("int"))
    tallied = windows.labelled_tallies(batched, K, "batch")
    upto = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)  # a row per batch
    exact = incremental.first_seen(tallied).select("batch", F.sum("new_unique").over(upto).alias("n_unique"))
    both = exact.join(sketches.running_unions(sketches.label_sketches(tallied, "batch"), "batch"), "batch")
    near = F.abs(F.col("n_unique_est") - F.col("n_unique")) <= 3 * sketches.standard_error() * F.col("n_unique")
    return both.select("batch", "n_unique", near.alias("near"))


@query
def median_summary(spark, folder):
    """Exact medians of run length and of k-mer count."""
    missing = F.lit(None).cast("double")
    runs = spectrum.exact_median(windows.runs(reads(spark, folder)), F.length("run"), "median_run_len")
    table = spectrum.exact_median(counts(spark, folder), F.col("n"), "median_n")
    both = runs.withColumn("median_n", missing).unionByName(table.withColumn("median_run_len", missing))
    return both.agg(F.max("median_run_len").alias("median_run_len"), F.max("median_n").alias("median_n"))


@query
def approx_unique(spark, folder):
    """Exact number of distinct k-mers, and whether the HyperLogLog estimate lies within three of its deviations."""
    rsd = 0.02
    tallied = windows.tallied_kmers(reads(spark, folder), K)
    estimate = counting.approx_unique(tallied, rsd)
    both = counting.unique_kmers(counts(spark, folder)).join(estimate)  # one row each
    near = F.abs(F.col("n_unique_est") - F.col("n_unique")) <= 3 * rsd * F.col("n_unique")
    return both.select("n_unique", near.alias("near"))


def _mates(spark, folder):
    """Even documents as mate 1, odd ones as mate 2."""
    return reads(spark, folder).withColumn("mate", (F.pmod("doc_id", F.lit(2)) + 1).cast("int"))


@query
def paired_union(spark, folder):
    """Both mates together and each by itself, in one scan."""
    return counting.mate_unique(windows.labelled_tallies(_mates(spark, folder), K, "mate"))


@query
def u_breaks_counts(spark, folder):
    """Canonical 6-mer counts where U ends a window; every tenth letter A of the source is a U here."""
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    with_u = text_reads(texts).withColumn("seq", F.regexp_replace("seq", "A(.{9})A", "U$1A"))
    return spelled(counting.count_kmers(with_u, 6, u_as_t=False), 6)



# --- routing and balance --------------------------------------------------------------------------


@query
def unique_by_cu4(spark, folder):
    return routing.units4(counts(spark, folder), K)


@query
def unique_by_port8(spark, folder):
    return routing.ports8(counts(spark, folder), K)


@query
def virtual_buckets_1024(spark, folder):
    return routing.segments(counts(spark, folder), K)


@query
def virtual_buckets_3072(spark, folder):
    return routing.segment_rollup(counts(spark, folder), K)


@query
def subbins_8x64(spark, folder):
    return routing.subbins(counts(spark, folder), K)


@query
def suffix_partitions(spark, folder):
    return routing.suffixes(counts(spark, folder), K)


@query
def partition_balance(spark, folder):
    return routing.balance(counts(spark, folder), K)


# --- files and streams ----------------------------------------------------------------------------


@query
def fastq_roundtrip(spark, folder):
    """Counts after writing the reads as FASTQ and scanning those files."""
    target = shared_folder(spark, "fastq")
    write_fastq(reads(spark, folder), target)
    return spelled(count_fastq(spark, target, K))


@query
def paired_files(spark, folder):
    """The mates written to two FASTQ folders and read as a pair: per mate and together."""
    work = shared_folder(spark, "pair")
    for mate in (1, 2):
        write_fastq(_mates(spark, folder).where(F.col("mate") == mate), f"{work}/reads_{mate}")
    pair = read_pair(spark, f"{work}/reads_1", f"{work}/reads_2", columns="mate,seq")
    return counting.mate_unique(windows.labelled_tallies(pair, K, "mate"))


@query
def fastq_split_invariance(spark, folder):
    """Distinct and all k-mers of the same files in either mode at several split sizes.

    The counts follow one another, so that only one of them has its exchanges on disk.
    """
    target = shared_folder(spark, "fastq")
    write_fastq(reads(spark, folder), target)
    rows = []
    with short_shuffles(spark):
        for mode in ("lines", "records"):
            for split in (64 << 10, 1 << 20, DEFAULT_SPLIT):
                table = count_fastq(spark, target, K, mode=mode, splitBytes=split)
                figures = table.agg(F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_total"))
                figures = figures.select(F.lit(mode).alias("mode"), F.lit(split).cast("bigint").alias("split"), "n_unique", "n_total")
                rows += figures.collect()  # one row
    delete(spark, target)
    return spark.createDataFrame(rows, figures.schema)


@query
def fastq_kmer_scan(spark, folder):
    """The same with the scan emitting single k-mers."""
    target = shared_folder(spark, "fastq")
    write_fastq(reads(spark, folder), target)
    return spelled(counting.count_codes(fastq_kmers(spark, target, K)))


@query
def fastq_lines_roundtrip(spark, folder):
    """The same through the reader that follows line numbers only."""
    target = shared_folder(spark, "fastq")
    write_fastq(reads(spark, folder), target)
    return spelled(counting.count_kmers(fastq_lines(spark, target, 4 << 20), K))


@query
def fastq_wrapped_roundtrip(spark, folder):
    """The same through records whose sequences and qualities run over lines of 60 and 47; characters with a meaning there become N."""
    target = shared_folder(spark, "fastq")
    seq = F.coalesce(F.translate("seq", "@+>\r", "NNNN"), F.lit(""))
    lines = lambda text, width: F.regexp_replace(text, f"(?s)(.{{{width}}})(?=.)", "$1\n")
    quality = F.repeat(F.lit("@I+"), F.ceil(F.octet_length("seq") / 3).cast("int"))
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), lines(F.col("seq"), 60), F.lit("+"), lines(F.substring(quality, F.lit(1), F.octet_length("seq")), 47))
    reads(spark, folder).select("doc_id", seq.alias("seq")).select(record.alias("value")).write.text(target)
    return spelled(count_fastq(spark, target, K, mode="wrapped", splitBytes=1 << 20))


@query
def fasta_roundtrip(spark, folder):
    """The same through FASTA; characters with a meaning there become N."""
    target = shared_folder(spark, "fasta")
    seq = F.translate("seq", ">\r", "NN")
    record = F.concat_ws("\n", F.concat(F.lit(">"), F.col("doc_id").cast("string")), seq)
    reads(spark, folder).select(record.alias("value")).write.text(target)
    return spelled(counting.count_kmers(read_fasta(spark, target, K), K))


def _five_batches(spark, folder) -> tuple[str, int]:
    """A work folder with the reads planned as five batches or more, and the buckets that suit their bytes."""
    work = shared_folder(spark, "stream")
    write_fastq(reads(spark, folder), f"{work}/reads")
    sizes = range_table(spark, f"{work}/reads", splittable=False)
    total = sizes.agg(F.sum("size")).first()[0] or 0
    batch = max(1, total // 5)
    incremental.plan_batches(spark, f"{work}/plan", f"{work}/reads", batch, split_bytes=min(DEFAULT_SPLIT, -(-batch // 8)))
    return work, buckets.buckets_for(total)


@query
def stream_bucket_counts(spark, folder):
    """Counts from such a stream with one state entry per minimizer bucket, read off the state itself."""
    work, many = _five_batches(spark, folder)
    counted = buckets.stream_bucket_counts(buckets.stream_super_kmers(spark, f"{work}/plan", K, buckets=many), work, K)
    delete(spark, f"{work}/reads")
    return spelled(counted)


@query
def stream_source_counts(spark, folder):
    """Counts from format("fastq") as a stream over a folder of files, a fifth of the bytes admitted at a time."""
    work = shared_folder(spark, "stream")
    write_fastq(reads(spark, folder), f"{work}/reads")
    total = range_table(spark, f"{work}/reads", splittable=False).agg(F.sum("size")).first()[0] or 0
    counted = buckets.stream_source_counts(spark, f"{work}/reads", work, K, max(1, -(-total // 5)), buckets.buckets_for(total))
    delete(spark, f"{work}/reads")
    return spelled(counted)


@query
def stream_counts(spark, folder):
    """Counts from a stream that takes the reads in at least five micro-batches."""
    work, many = _five_batches(spark, folder)
    stream = incremental.stream_kmers(spark, f"{work}/plan", K)
    counted = incremental.stream_counts(stream, work, buckets=many)
    delete(spark, f"{work}/reads")
    return spelled(counted)


@query
def batch_new_unique(spark, folder):
    """Distinct k-mers not seen in an earlier batch; the batch of a read is its id modulo 9."""
    batched = reads(spark, folder).withColumn("batch", F.pmod("doc_id", F.lit(BATCHES)).cast("int"))
    return incremental.first_seen(windows.labelled_tallies(batched, K, "batch"))


def _nine_batches(spark, folder) -> tuple[str, list[list[str]]]:
    """The reads as FASTQ files in nine folders."""
    work = shared_folder(spark, "stream")
    batched = reads(spark, folder).withColumn("batch", F.pmod("doc_id", F.lit(BATCHES)).cast("int"))
    write_fastq(batched, f"{work}/reads", "batch")
    return work, [[f"{work}/reads/batch={i}"] for i in range(BATCHES)]


@query
def stream_new_unique(spark, folder):
    """The same as a stream: nine batches arrive one after the other at a stateful de-duplication."""
    work, batches = _nine_batches(spark, folder)
    many = buckets.buckets_for(range_table(spark, f"{work}/reads", splittable=False).agg(F.sum("size")).first()[0] or 0)
    for i, batch in enumerate(batches):
        incremental.plan_batches(spark, f"{work}/plan", [batch], first=i)
        result = incremental.stream_new_unique(incremental.stream_kmers(spark, f"{work}/plan", K), work, buckets=many)
        delete(spark, *batch)
    return result


@query
def stream_delta_counts(spark, folder):
    """Counts from per-batch count tables, summed afterwards; no state store."""
    work, batches = _nine_batches(spark, folder)
    incremental.plan_batches(spark, f"{work}/plan", batches)
    stream = incremental.stream_kmers(spark, f"{work}/plan", K)
    return spelled(incremental.merge_deltas(incremental.stream_deltas(stream, work)))
