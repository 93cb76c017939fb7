"""Incremental counting equals counting in one go, also over a restart."""

import gzip
import random

import numpy as np
import pytest
from conftest import brute_counts, collected

from pyspark.sql import functions as F

from helixtally.operators import superkmers
from helixtally.sources.fastq import register_sources
from helixtally.streaming import buckets, incremental


def write(path, seqs):
    path.write_text("".join(f"@r\n{s}\n+\n{'I' * len(s)}\n" for s in seqs))
    return str(path)


def make(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("ACGTN") for _ in range(60)) for _ in range(n)]


def test_stream_counts_any_batch_size(spark, tmp_path):
    seqs = make(1, 60)
    path = write(tmp_path / "x.fastq", seqs)
    want = brute_counts(seqs, 4)
    for size in (1500, 10**9):
        folder = str(tmp_path / f"work{size}")
        batches = incremental.plan_batches(spark, f"{folder}/plan", path, batch_bytes=size)
        assert (batches > 1) == (size == 1500)
        reports = []
        counts = incremental.stream_counts(incremental.stream_kmers(spark, f"{folder}/plan", 4), folder, reports.append)
        assert collected(counts, 4) == want
        assert len([r for r in reports if r["numInputRows"]]) == batches


def test_arrivals_restart_and_new_unique(spark, tmp_path):
    """Each call is a restarted query: the checkpoint must carry counts and seen k-mers over."""
    parts = [make(i, 12) for i in (1, 2, 3)]
    seen, expected, everything = set(), {}, []
    folder, other, third = (str(tmp_path / name) for name in ("new", "counts", "deltas"))
    for i, seqs in enumerate(parts):
        path = write(tmp_path / f"part{i}.fastq", seqs)
        everything += seqs
        fresh = set(brute_counts(seqs, 5)) - seen
        seen |= fresh
        expected[i] = len(fresh)
        for work in (folder, other, third):
            incremental.plan_batches(spark, f"{work}/plan", [[path]], first=i)
        found = incremental.stream_new_unique(incremental.stream_kmers(spark, f"{folder}/plan", 5), folder)
        assert {r.batch: r.new_unique for r in found.collect()} == expected
        counts = incremental.stream_counts(incremental.stream_kmers(spark, f"{other}/plan", 5), other)
        assert collected(counts, 5) == brute_counts(everything, 5)
        deltas = incremental.stream_deltas(incremental.stream_kmers(spark, f"{third}/plan", 5), third)
        assert collected(incremental.merge_deltas(deltas), 5) == brute_counts(everything, 5)
        assert {r.batch: r.new_unique for r in incremental.first_seen(deltas).collect()} == expected
    before = incremental.stream_counts(incremental.stream_kmers(spark, f"{other}/plan", 5), other)
    assert collected(before, 5) == brute_counts(everything, 5)  # nothing new: nothing is counted twice


def test_stream_without_batches(spark, tmp_path):
    folder = str(tmp_path)
    assert incremental.plan_batches(spark, f"{folder}/plan", write(tmp_path / "x.fastq", [])) == 0
    stream = incremental.stream_kmers(spark, f"{folder}/plan", 5)
    assert incremental.stream_counts(stream, folder).count() == 0


def bucket_counts(spark, work, k, each=None):
    return buckets.stream_bucket_counts(buckets.stream_super_kmers(spark, f"{work}/plan", k, buckets=16), work, k, each)


def test_bucket_state_over_restarts(spark, tmp_path):
    """Each call is a restarted query that goes on from the bucket entries; repeated text makes a hot bucket."""
    work, everything, new = str(tmp_path / "work"), [], []
    for i in range(3):
        seqs = [*make(i, 12), "ACGT" * 40]
        everything += seqs
        incremental.plan_batches(spark, f"{work}/plan", [[write(tmp_path / f"part{i}.fastq", seqs)]], first=i)
        reports = []
        assert collected(bucket_counts(spark, work, 9, reports.append), 9) == brute_counts(everything, 9)
        new += [r["observedMetrics"]["batch"]["new_kmers"] for r in reports if r["numInputRows"]]
    assert sum(new) == len(brute_counts(everything, 9))
    assert collected(bucket_counts(spark, work, 9), 9) == brute_counts(everything, 9)  # nothing new: nothing is counted twice
    found = buckets.batch_reports(spark, work)
    assert found.agg(F.sum("occurrences")).first()[0] == brute_counts(everything, 9).total()
    assert found.select("epoch").distinct().count() == 3
    state = spark.read.format("statestore").option("stateVarName", "counts").load(f"{work}/checkpoint")
    assert state.count() == found.select("bucket", "salt").distinct().count() <= 16  # one entry per bucket


def test_bucket_state_with_salts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(superkmers, "HOT_ROWS", 4)
    monkeypatch.setattr(superkmers, "HOT_SHARE", 2)
    work, seqs = str(tmp_path / "work"), ["ACGTTGCA" * 30] * 40 + make(5, 20)
    path = write(tmp_path / "x.fastq", seqs)
    incremental.plan_batches(spark, f"{work}/plan", path, batch_bytes=3000)
    assert collected(bucket_counts(spark, work, 7), 7) == brute_counts(seqs, 7)
    assert buckets.batch_reports(spark, work).where("salt > 0").count()


def test_bucket_state_without_batches(spark, tmp_path):
    work = str(tmp_path)
    incremental.plan_batches(spark, f"{work}/plan", write(tmp_path / "x.fastq", []))
    assert bucket_counts(spark, work, 5).count() == 0


def test_merged_arrays():
    rng = np.random.default_rng(0)
    old = (np.empty(0, np.int64), np.empty(0, np.int64))
    want = {}
    for _ in range(20):
        kmers = np.unique(rng.integers(0, 200, rng.integers(0, 60)))
        n = rng.integers(1, 9, len(kmers))
        for a, b in zip(kmers.tolist(), n.tolist(), strict=True):
            want[a] = want.get(a, 0) + b
        old = buckets.merged(old, kmers, n)
        assert (np.diff(old[0]) > 0).all()
    assert dict(zip(old[0].tolist(), old[1].tolist(), strict=True)) == want


def test_a_report_for_every_batch_while_it_runs(spark, tmp_path):
    """150 micro-batches give 150 reports, each before the query has ended."""
    folder = str(tmp_path / "many")
    paths = [[write(tmp_path / f"{i}.fastq", ["ACGTACGTAA"])] for i in range(2)]
    incremental.plan_batches(spark, f"{folder}/plan", paths)
    one = spark.read.schema(incremental.BATCH_SCHEMA).json(f"{folder}/plan").drop("file").limit(1).collect()[0]
    for i in range(150):
        spark.createDataFrame([one], incremental.BATCH_SCHEMA).coalesce(1).write.mode("append").json(f"{folder}/more/{i}")
    seen, last = [], []
    stream = incremental.planned_ranges(spark, f"{folder}/more", 1)
    incremental.run(stream, lambda df, epoch: last.append((epoch, len(seen))), str(tmp_path / "checkpoint"), "append", lambda r: seen.append(r["batchId"]))
    assert sorted(seen) == list(range(150))
    assert last[-1][1] > 100  # most lines were out before the last batch began


def take_all(spark, paths, work, batches, **options):
    """Work off what has arrived as a query that starts (again), and stop it; the rows of each micro-batch."""
    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{work}/out/epoch={epoch}")
        batches.add(epoch)

    stream = spark.readStream.format("fastq").options(**options).load(paths)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{work}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_fastq_source_as_a_stream(spark, tmp_path):
    """Arrivals, restarts and any admission give each record once."""
    register_sources(spark)
    records = [(f"r{i}", s) for i, s in enumerate(make(3, 90))]
    text = lambda rows: "".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in rows)
    for size, split in ((1500, 300), (40, 1 << 20), (1 << 20, 997)):
        folder, work, batches = tmp_path / f"in{size}", str(tmp_path / f"work{size}"), set()
        folder.mkdir()
        arrivals = (records[:4], [], records[4:6]) if size == 40 else (records[:40], [], records[40:70], records[70:])
        for i, part in enumerate(arrivals):
            if part:
                (folder / f"{9 - i}.fastq").write_text(text(part))
            if i == 2:
                with gzip.open(folder / "0.fastq.gz", "wt") as packed:
                    packed.write(text([("z", "ACGT")]))
            options = {"bytesPerTrigger": size, "splitBytes": split, "columns": "read_id,seq"}
            take_all(spark, str(folder), work, batches, **options)
        got = sorted(tuple(r) for r in spark.read.parquet(f"{work}/out").select("read_id", "seq").collect())
        assert got == sorted([*(r for part in arrivals for r in part), ("z", "ACGT")])
        assert len(batches) > (4 if size < 1 << 20 else 2)
    counted = buckets.stream_source_counts(spark, str(folder), str(tmp_path / "counts"), 5, bytes_per_trigger=2000)
    assert collected(counted, 5) == brute_counts([*(s for part in arrivals for _, s in part), "ACGT"], 5)
    with pytest.raises(Exception, match="bytesPerTrigger"):
        take_all(spark, str(folder), str(tmp_path / "bad"), set(), bytesPerTrigger=0)
