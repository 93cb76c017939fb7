"""Incremental counting: FASTQ byte ranges arrive in batches, counts build up.

A batch is a file of byte ranges. Spark's file stream takes those files one by
one, so offsets, restart after a failure and ``availableNow`` come from Spark;
the tasks of a micro-batch read the ranges themselves. Ranges are fixed once
planned, so a repeated micro-batch reads the same records.

Two ways to keep counts:

* ``stream_counts`` holds the running counts in the state store (RocksDB, on disk),
  a few arrays of them per bucket of k-mers, and reads the count table off it;
* ``stream_deltas`` keeps no state: it writes every batch's own count table, to be
  summed when asked for. It suits inputs whose distinct k-mers outgrow a state store.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from helixtally.functions import bases
from helixtally.operators import codes
from helixtally.operators.windows import tallies
from helixtally.session import CLEANUP_KEY, settings
from helixtally.sources import ranges as br
from helixtally.sources.fastq import RANGE_SCHEMA, as_ranges, number_lines, numbered_ranges, one_by_one, range_kmers, range_table

BATCH_SCHEMA = f"{RANGE_SCHEMA}, before bigint, upto bigint, batch int"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",  # of all stores of an executor together
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "512",
}


def plan_batches(
    spark: SparkSession,
    folder: str,
    paths: str | list[str] | list[list[str]],
    batch_bytes: int | None = None,
    split_bytes: int = br.DEFAULT_SPLIT,
    splittable: bool = True,
    first: int = 0,
) -> int:
    """Add batch files for ``paths`` to ``folder``, numbered from ``first``; returns how many.

    ``paths`` may be a list of lists: one batch per inner list. Otherwise the
    byte ranges are grouped in order, about ``batch_bytes`` each (None: all in one).
    Ranges carry line numbers, so a file means the same as outside a stream.
    Spark takes batch files by modification time; those written by one call may
    be taken in any order.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if paths and not isinstance(paths[0], str):
        every = [range_table(spark, group, split_bytes, splittable).withColumn("batch", F.lit(i)) for i, group in enumerate(paths, first)]
        planned = number_lines(reduce(DataFrame.unionByName, every))
    else:
        step = min(split_bytes, batch_bytes or split_bytes)
        earlier = F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(Window.orderBy("path", "lo").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        batch = F.floor(earlier / F.lit(batch_bytes)).cast("int") + first if batch_bytes else F.lit(first)
        planned = numbered_ranges(spark, paths, step, splittable).withColumn("batch", batch)  # the window sees a row per range
    names = [x.split()[0] for x in BATCH_SCHEMA.split(", ")]
    numbers = planned.select(*names).repartition("batch").persist()  # what the line counts have cost
    found = numbers.agg(F.count_distinct("batch")).first()[0]
    if found:
        numbers.select("*", F.col("batch").alias("file")).write.mode("append").partitionBy("file").json(folder)
    numbers.unpersist()
    return found


def stream_kmers(
    spark: SparkSession, folder: str, k: int = bases.DEFAULT_K, u_as_t: bool = True, batches_per_trigger: int = 1
) -> DataFrame:
    """Streaming (batch INT, kmer BIGINT, part BIGINT) of the planned batches: k-mers combined within each range."""
    bases.check_k(k)
    table = codes.base_table(u_as_t)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, r in zip(batch.column("batch").to_pylist(), as_ranges(batch), strict=True):
                for part in tallies(range_kmers(r, k, table)):
                    owner = pa.repeat(pa.scalar(number, pa.int32()), part.num_rows)
                    yield pa.RecordBatch.from_arrays([owner, *part.columns], names=["batch", "kmer", "part"])

    return one_by_one(planned_ranges(spark, folder, batches_per_trigger)).mapInArrow(extract, "batch int, kmer bigint, part bigint")


def planned_ranges(spark: SparkSession, folder: str, batches_per_trigger: int) -> DataFrame:
    """The planned batches as a stream of byte ranges."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    planned = spark.readStream.schema(BATCH_SCHEMA).option("maxFilesPerTrigger", batches_per_trigger)
    return planned.option("recursiveFileLookup", "true").json(folder)


#: Gets Spark's report of a micro-batch: rows, durations, state size.
Each = Callable[[dict], None]


class Reports(StreamingQueryListener):
    """Hands every report of one query on as it comes; ``ended`` is set behind the last one."""

    def __init__(self, each: Each) -> None:
        self.each, self.run_id, self.early, self.ended = each, None, [], threading.Event()

    def of(self, run_id: str) -> None:
        """The query is known only after its start, when reports may be here already."""
        self.run_id = run_id
        early, self.early = self.early, []
        for kind, owner, report in early:
            self._take(kind, owner, report)

    def _take(self, kind: str, owner: str, report: dict | None) -> None:
        if self.run_id is None:
            self.early.append((kind, owner, report))
        elif owner == self.run_id and kind == "ended":
            self.ended.set()
        elif owner == self.run_id:
            self.each(report)

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        self._take("progress", str(event.progress.runId), json.loads(event.progress.json))

    def onQueryTerminated(self, event: object) -> None:
        self._take("ended", str(event.runId), None)


def run(stream: DataFrame, write: Callable, checkpoint: str, mode: str, each: Each | None = None, until_empty: bool = False) -> None:
    """Work off everything planned so far; a later call with the same checkpoint goes on from there.

    ``each`` gets the report of a micro-batch while the next one runs, however many there are.
    ``until_empty`` asks the source again and again until it has nothing more, for sources that
    admit a part of what they have at a time.
    """
    spark = stream.sparkSession
    reports = Reports(each or (lambda report: None))
    spark.streams.addListener(reports)
    try:
        with settings(spark, STATE_STORE | {CLEANUP_KEY: "true"}):  # the query starts with a copy of the session's
            writing = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
            query = (writing if until_empty else writing.trigger(availableNow=True)).start()
        reports.of(str(query.runId))
        if until_empty:
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        else:
            query.awaitTermination()
        reports.ended.wait(60)
    finally:
        spark.streams.removeListener(reports)


def writer(out: str, prepare=lambda df: df):
    """Write a micro-batch to its own folder; a repeated micro-batch replaces it."""

    def write(df: DataFrame, epoch: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return write


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    """Existing folders that match a pattern."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or ()]


def written(spark: SparkSession, out: str, schema: str, folder: str | None = None) -> DataFrame:
    """Everything written to folders that match; empty before the first. ``folder``: where the names of partitions begin."""
    found = _folders(spark, out)
    reader = spark.read.option("basePath", folder) if folder else spark.read
    return reader.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def stream_counts(kmers: DataFrame, folder: str, each: Each | None = None, buckets: int | None = None) -> DataFrame:
    """Run the stateful count over the stream; returns the count table (kmer, n).

    The state holds a few sorted arrays of k-mers with their counts per bucket, and is
    the count table. ``buckets`` is fixed when a folder is first used; see ``streaming.buckets``.
    """
    from helixtally.streaming import buckets as state  # which builds on this module

    run(state.stream_packed(kmers, buckets or state.BUCKETS), writer(f"{folder}/reports"), f"{folder}/checkpoint", "update", each)
    return state.bucket_table(kmers.sparkSession, folder)


def stream_new_unique(kmers: DataFrame, folder: str, each: Each | None = None, buckets: int | None = None) -> DataFrame:
    """Run stateful de-duplication; returns (batch, new_unique): k-mers first seen in each batch.

    Batches of one trigger count in the order of their numbers. First means first to arrive, so
    where batch numbers have to follow arrival, add and run one batch at a time:
    the checkpoint carries the k-mers already seen from run to run. The state is that of ``stream_counts``.
    """
    from helixtally.streaming import buckets as state

    def per_batch(df: DataFrame) -> DataFrame:
        return df.groupBy("batch").agg(F.sum("new_kmers").alias("new_unique"))

    run(state.stream_packed(kmers, buckets or state.BUCKETS), writer(f"{folder}/new", per_batch), f"{folder}/checkpoint", "update", each)
    found = written(kmers.sparkSession, f"{folder}/new/epoch=*", "batch int, new_unique bigint")
    return found.groupBy("batch").agg(F.sum("new_unique").alias("new_unique")).where("new_unique > 0")


def stream_deltas(kmers: DataFrame, folder: str, each: Each | None = None) -> DataFrame:
    """Count every batch on its own, without a state store; returns (batch, kmer, n)."""

    def per_batch(df: DataFrame) -> DataFrame:
        return df.groupBy("batch", "kmer").agg(F.sum("part").alias("n"))

    run(kmers, writer(f"{folder}/deltas", per_batch), f"{folder}/checkpoint", "append", each)
    return written(kmers.sparkSession, f"{folder}/deltas/epoch=*", "batch int, kmer bigint, n bigint")


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Count table of all batches together."""
    return deltas.groupBy("kmer").agg(F.sum("n").alias("n"))


def first_seen(batched: DataFrame, batch: str = "batch") -> DataFrame:
    """(batch, new_unique) from rows (batch, kmer): k-mers whose lowest batch number is this one."""
    return (
        batched.groupBy("kmer")
        .agg(F.min(batch).alias("batch"))
        .groupBy("batch")
        .agg(F.count(F.lit(1)).alias("new_unique"))
    )
