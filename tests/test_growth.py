"""What grows with the input: plans, rows of the exchange, files of other people's characters."""

import random
import re

import numpy as np
import pytest
import pyarrow as pa
from conftest import brute_counts, collected

from helixtally.functions.sql import register
from helixtally.operators import codes, superkmers, tables, windows
from helixtally.plans import catalogue
from helixtally.plans.catalogue import CATALOGUE, write_fastq
from helixtally.session import CLEANUP_KEY
from helixtally.sources.fastq import SPREAD, count_fastq, number_lines, range_table
from helixtally.sources.text_reads import BASES, LETTERS
from helixtally.streaming import buckets, incremental


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_table_function_is_a_step_of_the_plan(spark):
    """no join back to the reads, so no read beside each of its windows."""
    register(spark)
    reads = ["ACGTNACGTTT" * 3, "ACGTNACGTTT" * 3, "", "AC", None]
    df = spark.createDataFrame([(r,) for r in reads], "seq string")
    found = spark.sql("SELECT kmer_canonical(w.kmer) AS canon, count(*) AS n FROM {r} r, LATERAL kmers(r.seq, 4) w GROUP BY 1", r=df)
    assert "Join" not in plan(found)
    assert {r.canon: r.n for r in found.collect()} == brute_counts([r or "" for r in reads], 4)


def test_written_records_are_proper(spark, tmp_path):
    """reads that begin with a mark of the format, hold a carriage return or are null; checked by mode "records"."""
    reads = ["@ACGTACGT", "+ACGTTT", "ACGT\rACGTA\r", None, "", "ACG+@TACG", "ACGTTGCA"]
    df = spark.createDataFrame([(None if i == 6 else i, r) for i, r in enumerate(reads)], "doc_id bigint, seq string")
    write_fastq(df.repartition(2), str(tmp_path / "x"))
    want = brute_counts([r or "" for r in reads], 3)
    for mode in ("records", "lines"):
        for split in (20, 1 << 20):
            assert collected(count_fastq(spark, str(tmp_path / "x"), 3, mode=mode, splitBytes=split), 3) == want


def test_byte_ranges_stay_apart(spark, tmp_path):
    """Rows of a few numbers that stand for much work aren't joined into one task by their bytes."""
    text = "".join(f"@{i}\nACGTACGT\n+\nIIIIIIII\n" for i in range(400))
    (tmp_path / "x.fastq").write_text(text)
    ranges = number_lines(range_table(spark, str(tmp_path / "x.fastq"), 200))
    apart = ranges.mapInArrow(lambda parts: (pa.RecordBatch.from_arrays([pa.array([n])], ["n"]) for n in [sum(p.num_rows for p in parts)] if n), "n bigint")
    held = [r.n for r in apart.collect()]
    assert sum(held) == -(-len(text) // 200) and len(held) > SPREAD


def test_rows_of_the_exchange_are_bounded():
    """F10 and those like it: a batch of Spark's rows may hold so many of them that their size has to have a bound."""
    data = np.frombuffer(b"ACGTTGCATGCCATTTAGGACC" * 20000, np.uint8)
    found = list(superkmers.pack(superkmers.cut(data, None, 21, 11, codes.base_table()), 4))
    sizes = [len(x.as_py()) for b in found for x in b.column(2)]
    assert max(sizes) <= superkmers._ROW_RECORDS * superkmers.RECORD.itemsize
    got = np.concatenate([v for b in found for v in superkmers.codes_of(b.column(2), 21)])
    assert len(got) == len(data) - 20


def test_tallies_of_pieces(monkeypatch):
    """one array is filled again and again, and comes out in batches of bounded length."""
    monkeypatch.setattr(windows, "_SORT_ROWS", 50)
    monkeypatch.setattr(windows, "_OUT_ROWS", 7)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 30, n) for n in (0, 1, 49, 120, 3, 77)]
    found = list(windows.tallies(iter(parts)))
    assert max(len(b) for b in found) <= 7
    total = np.zeros(30, np.int64)
    for b in found:
        np.add.at(total, b.column(0).to_numpy(), b.column(1).to_numpy())
    assert total.tolist() == np.bincount(np.concatenate(parts), minlength=30).tolist()


def test_buckets_follow_the_input():
    """what one task holds at once is a bucket."""
    assert tables.buckets_for(0) == 16
    assert buckets.buckets_for(0) == buckets.BUCKETS
    for total in (10**9, 6 * 10**9, 10**11):
        assert total / tables.buckets_for(total) <= tables._BUCKET_ROWS
        assert total / buckets.buckets_for(total) <= 1 << 21


def test_packed_k_mers(spark):
    """k-mers of a stream come as a row per bucket and batch."""
    rows = [(b, k * 7919, 1 + k % 3) for b in (0, 1) for k in range(3000)]
    found = buckets.packed(spark.createDataFrame(rows, "batch int, kmer bigint, part bigint").coalesce(1), 8).collect()
    assert len(found) == 16
    got = [(r.batch, k, n) for r in found for k, n in zip(np.frombuffer(r.kmers, np.int64).tolist(), np.frombuffer(r.n, np.int64).tolist())]
    assert sorted(got) == sorted(rows)


def test_text_windows_come_from_pieces(spark, monkeypatch):
    """a window is cut out of a short piece of its run, and its other strand out of the piece's."""
    reads = ["ACGTTGCATGCCATTTAGGACCA" * 9, "ACGTNACGTTTGGG", "ACG", "", None, "acguACGU" * 5]
    df = spark.createDataFrame(list(enumerate(reads)), "doc_id bigint, seq string")
    for piece in (windows.PIECE, 1, 3):
        monkeypatch.setattr(windows, "PIECE", piece)
        for k in (1, 4, 7):
            want = []
            for i, r in enumerate(reads):
                runs = [x for x in re.split("[^ACGT]+", (r or "").upper().replace("U", "T")) if len(x) >= k]
                want += [(i, n, p + 1, x[p : p + k]) for n, x in enumerate(runs) for p in range(len(x) - k + 1)]
            found = windows.kmer_strings(df, k, keep=("doc_id",)).collect()
            assert sorted((r.doc_id, r.run, r.pos, r.kmer) for r in found) == sorted(want)
            assert all(r.canon == min(r.kmer, r.kmer[::-1].translate(str.maketrans("ACGT", "TGCA"))) for r in found)


def test_count_takes_buckets_in_order(spark):
    """A task sorts few windows at a time, since the copies of a k-mer come close together."""
    df = spark.createDataFrame([("ACGTTGCATGCCATTTAGGACC" * 30,)] * 40, "seq string").repartition(4)
    counted = superkmers.count_super_kmers(superkmers.super_kmers(df, 21), 21)
    assert "Sort [bucket" in plan(counted)
    assert superkmers._TALLY_ROWS * 8 <= 16 << 20 and superkmers._PACK_ROWS * superkmers.RECORD.itemsize <= 4 << 20
    assert collected(counted, 21) == brute_counts(["ACGTTGCATGCCATTTAGGACC" * 30] * 40, 21)


def test_one_count_at_a_time_is_on_disk(spark, tmp_path, monkeypatch):
    """the six counts of the split sizes follow one another, and each one's shuffle files and the FASTQ go."""
    texts = [("ACGTTGCATGCCATTTAGGACCAgtacca" * 3,), ("TTGACCATGCAGGCATTACGCA",), (None,), ("ACGTTGCATGCCATTTAGGACCAgtacca" * 2,)]
    spark.createDataFrame(texts, "text string").selectExpr("monotonically_increasing_id() AS doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    fleeting = []
    count = lambda *a, f=catalogue.count_fastq, **b: (fleeting.append(spark.conf.get(CLEANUP_KEY, "false")), f(*a, **b))[1]
    monkeypatch.setattr(catalogue, "count_fastq", count)
    monkeypatch.setattr(catalogue, "shared_folder", lambda *a: f"{tmp_path}/fastq")
    found = CATALOGUE["fastq_split_invariance"](spark, str(tmp_path))
    assert "Exchange" not in plan(found) and not (tmp_path / "fastq").exists()
    assert fleeting == ["true"] * 6 and spark.conf.get(CLEANUP_KEY, "false") == "false"
    rows = found.collect()
    want = brute_counts([catalogue_reads(t) for (t,) in texts], 21)
    assert {(r.mode, r.split) for r in rows} == {(m, s) for m in ("lines", "records") for s in (1 << 16, 1 << 20, 1 << 27)}
    assert {(r.n_unique, r.n_total) for r in rows} == {(len(want), want.total())} and len(rows) == 6


def catalogue_reads(text):
    return "".join(BASES[LETTERS.index(c)] for c in text or "" if c in LETTERS)


@pytest.mark.parametrize("kind", ["new_unique", "counts", "source"])
def test_a_micro_batch_writes_what_it_brings(spark, tmp_path, kind):
    """The state's log of a later micro-batch is no larger than the first one's, nor are its shuffle files kept."""
    rng, work, everything = random.Random(3), str(tmp_path / "work"), []
    (tmp_path / "reads").mkdir()
    for i in range(3):
        seqs = ["".join(rng.choice("ACGT") for _ in range(220)) for _ in range(100)]
        path = tmp_path / "reads" / f"{i}.fastq"
        path.write_text("".join(f"@r\n{s}\n+\n{'I' * len(s)}\n" for s in [*everything[:5], *seqs]))
        everything += [*everything[:5], *seqs]
        if kind == "source":
            counted = buckets.stream_source_counts(spark, str(tmp_path / "reads"), work, 21, buckets=1)
        else:
            incremental.plan_batches(spark, f"{work}/plan", [[str(path)]], first=i)
            run = {"new_unique": incremental.stream_new_unique, "counts": incremental.stream_counts}[kind]
            counted = run(incremental.stream_kmers(spark, f"{work}/plan", 21), work, buckets=1)
    logs = [sum(f.stat().st_size for f in tmp_path.glob(f"work/checkpoint/state/0/*/{v}*.changelog")) for v in (1, 2, 3)]
    assert logs[0] > 20000 * 3 and max(logs) < 1.2 * logs[0]
    want = brute_counts(everything, 21)
    if kind == "new_unique":
        assert sum(r.new_unique for r in counted.collect()) == len(want)
    else:
        assert collected(counted, 21) == want
        assert "Exchange" not in plan(counted)


class Stack(dict):
    containsKey, getValue, updateValue, removeKey = dict.__contains__, dict.get, dict.__setitem__, dict.__delitem__


def test_stack_of_count_arrays(monkeypatch):
    """arrays of all sizes, merged or not, tell new k-mers from known ones and add up to the counts."""
    monkeypatch.setattr(buckets, "SMALL", 20)
    monkeypatch.setattr(buckets, "RUNS", 3)
    rng, stack, want = np.random.default_rng(0), Stack(), {}
    for _ in range(200):
        kmers = np.unique(rng.integers(0, 1 << rng.integers(3, 62), rng.integers(0, 200)))
        n = rng.integers(1, 1 << rng.integers(1, 40), len(kmers))
        assert buckets.add(stack, kmers, n, 0).tolist() == [x not in want for x in kmers.tolist()]
        for x, y in zip(kmers.tolist(), n.tolist(), strict=True):
            want[x] = want.get(x, 0) + y
        assert sorted(stack) == [(i,) for i in range(len(stack))] and len(stack) < 12
    found = {}
    for value in stack.values():
        kmers, n = buckets.restored(*value)
        assert (np.diff(kmers) > 0).all()
        for x, y in zip(kmers.tolist(), n.tolist(), strict=True):
            found[x] = found.get(x, 0) + y
    assert found == want
