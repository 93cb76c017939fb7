"""Operators against brute force on small fixtures, and properties that must hold."""

import random
import re

import numpy as np
import pytest
from conftest import brute_counts, collected, text_codes
from hypothesis import given, settings
from hypothesis import strategies as st

from helixtally.functions import bases
from helixtally.functions.sql import MURMUR_A, MURMUR_B, SPLITMIX_A, SPLITMIX_B, call, register
from helixtally.functions.tables import register_count_kmers
from helixtally.operators import codes, counting, routing, sketches, spectrum, superkmers, tables, windows
from pyspark.sql import functions as F

SHUFFLES = ("kmers", "tallies", "superkmers")


def make_reads(seed, n=120, alphabet="ACGTACGTACGTacgtNU-"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 150))) for _ in range(n)]


def frame(spark, reads):
    return spark.createDataFrame(list(enumerate(reads)), "doc_id bigint, seq string").repartition(3)


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 8, 13, 16, 17, 21, 30, 31])
@pytest.mark.parametrize("shuffle", SHUFFLES)
def test_counts(spark, k, shuffle):
    reads = make_reads(k, alphabet="ACGTACGTACGTacgtacgtU" if k > 12 else "ACGTacgtNU-é")
    got = collected(counting.count_kmers(frame(spark, reads), k, shuffle=shuffle), k)
    assert got == brute_counts(reads, k)


@given(st.lists(st.text("ACGTNacgtU\r", max_size=80), max_size=6), st.integers(1, 31), st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_extraction_is_independent_of_slicing(reads, k, step):
    data = np.frombuffer("".join(reads).encode(), np.uint8)
    ends = np.cumsum([len(r) for r in reads], dtype=np.int64)
    table = codes.base_table()
    want = brute_counts(reads, k)
    before, codes._STEP, superkmers._STEP = (codes._STEP, superkmers._STEP), step, step
    try:
        plain = [v for _, values in codes.canonical_slices(data, ends, k, table) for v in values.tolist()]
        m = superkmers.minimizer_length(k)
        packed = [b for b in superkmers.pack(superkmers.cut(data, ends, k, m, table), 64)]
        again = [
            v for b in packed for values in superkmers._codes_of(b.column(2), k) for v in values.tolist()
        ]
    finally:
        codes._STEP, superkmers._STEP = before
    expected = sorted(text_codes(w) for w, n in want.items() for _ in range(n))
    assert sorted(plain) == expected
    assert sorted(again) == expected


def test_one_kmer_has_one_bucket():
    """The bucket is a function of the k-mer, on either strand."""
    reads = make_reads(1, 60, "ACGT")
    reads += [r[::-1].translate(str.maketrans("ACGT", "TGCA")) for r in reads]
    seen = {}
    for read in reads:
        data = np.frombuffer(read.encode(), np.uint8)
        for batch in superkmers.pack(superkmers.cut(data, None, 21, 11, codes.base_table()), 4096):
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for values in superkmers.expand(np.frombuffer(blob, superkmers.RECORD), 21):
                    for v in values.tolist():
                        assert seen.setdefault(v, bucket) == bucket
    assert len(set(seen.values())) > 100


@pytest.mark.parametrize("shuffle", SHUFFLES)
def test_hot_kmer(spark, shuffle):
    """A third of all rows is one k-mer."""
    reads = make_reads(2, 200, "ACGT") + ["A" * 130] * 60
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        df = spark.createDataFrame(list(enumerate(reads)), "doc_id bigint, seq string").repartition(12)
        counts = counting.count_kmers(df, 21, shuffle=shuffle)
        got = collected(counts, 21)
    finally:
        spark.conf.set(key, before)
    want = brute_counts(reads, 21)
    assert got == want and got["A" * 21] > want.total() / 4
    assert collected(counting.sort_counts(df, 21), 21) == want


def test_second_exchange_moves_distinct_kmers(spark, monkeypatch):
    """Copies of a k-mer meet before the grouped sum, whatever the partition size; only a hot bucket is spread."""
    reads = (make_reads(11, 150, "ACGT") + ["A" * 140] * 400) * 16
    table, m = codes.base_table(), superkmers.minimizer_length(21)
    monkeypatch.setattr(superkmers, "HOT_ROWS", 200)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "2k")
    try:
        parts = []
        for i in range(12):  # twelve slices of the input
            data = np.frombuffer("N".join(reads[i::12]).encode(), np.uint8)
            for b in superkmers.pack(superkmers.cut(data, None, 21, m, table), 64):
                parts += [(bucket, salt, bytes(blob)) for bucket, salt, blob in zip(*b.to_pydict().values(), strict=True)]
        packed = spark.createDataFrame(parts, superkmers.SCHEMA)
        counts = superkmers.count_super_kmers(packed, 21)
        assert collected(counts, 21) == brute_counts(reads, 21)
        written = [int(x) for x in re.findall(r"\d+", metrics(counts))]
    finally:
        spark.conf.set(key, before)
    assert len({salt for _, salt, _ in parts}) > 4  # the repeat is spread over several partitions
    distinct = counts.count()
    assert written and written[-1] <= 1.2 * distinct


def test_repeated_counts_drop_before_the_second_exchange(spark, monkeypatch):
    """Also with a hot bucket, whose single k-mers can't be told from parts, and with buckets counted piece by piece."""
    reads = make_reads(11, 300, "ACGT") + make_reads(12, 60, "ACGT") * 2 + ["A" * 140] * 400
    df = spark.createDataFrame([(r,) for r in reads], "seq string").repartition(5)
    whole = brute_counts(reads, 21)
    for least in (2, 3):
        want = {w: n for w, n in whole.items() if n >= least}
        found = superkmers.count_repeated(superkmers.super_kmers(df, 21), 21, least)
        assert collected(found, 21) == want
        if least == 2:
            written = [int(x) for x in re.findall(r"\d+", metrics(found))]
            assert written[-1] <= 1.2 * len(want) < len(whole)
    for name, value in (("HOT_ROWS", 4), ("HOT_SHARE", 1), ("_WHOLE", 50)):
        monkeypatch.setattr(superkmers, name, value)
        assert collected(superkmers.count_repeated(superkmers.super_kmers(df, 21), 21), 21) == {w: n for w, n in whole.items() if n >= 2}
    assert superkmers.count_repeated(superkmers.super_kmers(df.limit(0), 21), 21).count() == 0


def test_adding_to_a_saved_table_moves_only_the_new_counts(spark):
    every, name = [], "saved_counts_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    for i in range(3):
        reads = make_reads(20 + i, 40, "ACGTN")
        every += reads
        new = counting.count_kmers(spark.createDataFrame([(r,) for r in reads], "seq string"), 9)
        if i:
            above = ancestors(plan(tables.merged_counts(spark, name, new)), "Bucketed: true")
            assert any("SortMergeJoin" in line for line in above)
            assert not any("Exchange" in line for line in above)
            tables.add_counts(spark, name, new)
        else:
            tables.save_counts(new, name, 4)
        assert collected(spark.table(name), 9) == brute_counts(every, 9)
    assert tables.buckets_of(spark, name) == 4
    tables.add_counts(spark, name, new.limit(0))
    assert collected(spark.table(name), 9) == brute_counts(every, 9)
    spark.sql(f"DROP TABLE {name}")


def ancestors(text, mark):
    """The nodes of a printed plan above the one that holds the mark."""
    lines = text[: text.index("== Initial Plan ==")].splitlines() if "== Initial Plan ==" in text else text.splitlines()
    depth = lambda line: len(re.match(r"[\s:|+*\-]*", line)[0])
    at = next(i for i, line in enumerate(lines) if mark in line)
    found, limit = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < limit:
            found.append(line)
            limit = depth(line)
    return found


def test_sketches_of_any_union(spark):
    reads = [(i % 4, r) for i, r in enumerate(make_reads(30, 400, "ACGT"))]
    tallied = windows.labelled_tallies(spark.createDataFrame(reads, "port int, seq string"), 15, "port")
    found = sketches.label_sketches(tallied, "port")
    assert found.count() == 4
    for chosen in ([0], [1, 3], [0, 1, 2, 3]):
        exact = len(brute_counts([r for p, r in reads if p in chosen], 15))
        estimate = sketches.union_estimate(found.where(F.col("port").isin(chosen))).first()[0]
        assert abs(estimate - exact) <= 3 * sketches.standard_error() * exact
    assert sketches.union_estimate(found.where("port > 9")).first()[0] in (0, None)


def test_table_function_over_a_table(spark):
    register_count_kmers(spark)
    reads = make_reads(8, 50, "ACGTNu")
    spark.createDataFrame([(i, r, "x") for i, r in enumerate(reads)], "id int, seq string, other string").createOrReplaceTempView("some_reads")
    spark.createDataFrame([(r,) for r in reads], "dna string").createOrReplaceTempView("one_column")
    for call in ("TABLE(some_reads), 7", "TABLE(one_column), 7", "TABLE(one_column), 7, 'dna'"):
        assert collected(spark.sql(f"SELECT kmer, sum(n) AS n FROM count_kmers({call}) GROUP BY kmer"), 7) == brute_counts(reads, 7)
    for bad in ("TABLE(some_reads), 40", "TABLE(some_reads), 7, 'id'", "TABLE(SELECT 1 AS x), 5"):
        with pytest.raises(Exception, match="k must|name the text"):
            spark.sql(f"SELECT * FROM count_kmers({bad})").collect()


def metrics(df):
    """Rows that each exchange of an executed plan wrote, the second exchange last."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))
        if "ShuffleExchange" in node.getClass().getSimpleName():
            found.append(f"shuffle records written: {node.metrics().apply('shuffleRecordsWritten').value()}")

    walk(df._jdf.queryExecution().executedPlan())
    return "\n".join(found)


def test_strand_and_order_do_not_matter(spark):
    reads = make_reads(4, 80, "ACGTN")
    turned = [r[::-1].translate(str.maketrans("ACGT", "TGCA")) for r in reversed(reads)]
    one = collected(counting.count_kmers(frame(spark, reads), 15), 15)
    assert one == collected(counting.count_kmers(frame(spark, turned), 15), 15)


def test_null_and_empty_input(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "NN"), (4, "ACGTA")], "doc_id bigint, seq string")
    assert collected(counting.count_kmers(df, 3), 3) == brute_counts(["ACGTA"], 3)
    nothing = df.where("doc_id < 4")
    for shuffle in SHUFFLES:
        counts = counting.count_kmers(nothing, 21, shuffle=shuffle)
        assert counting.unique_kmers(counts).first().n_unique == 0
        assert spectrum.histogram(counts).count() == 0
        dense = spectrum.histogram(counts, dense=True).collect()
        assert [r.bin for r in dense] == list(range(1, 256)) and not any(r.freq for r in dense)
        assert spectrum.summary(counts).first().n_total == 0
    assert windows.total_kmers(nothing, 21).first().n_total == 0
    assert counting.sort_counts(nothing, 21).count() == 0


def test_total_without_kmers(spark):
    reads = make_reads(5)
    for k in (1, 6, 21):
        assert windows.total_kmers(frame(spark, reads), k).first().n_total == brute_counts(reads, k).total()


def test_positions_and_builtin_counts(spark):
    reads = make_reads(6, 40)
    rows = windows.kmer_strings(frame(spark, reads), 4, keep=("doc_id",)).collect()
    for r in rows:
        clean = reads[r.doc_id].upper().replace("U", "T")
        stretches = [s for s in "".join(c if c in "ACGT" else " " for c in clean).split() if len(s) >= 4]
        assert stretches[r.run][r.pos - 1 : r.pos + 3] == r.kmer
        assert r.canon == min(r.kmer, r.kmer[::-1].translate(str.maketrans("ACGT", "TGCA")))
    assert len(rows) == brute_counts(reads, 4).total()


def test_histogram_invariants(spark):
    reads = make_reads(7) + ["A" * 400]
    counts = counting.count_kmers(frame(spark, reads), 5).cache()
    want = brute_counts(reads, 5)
    hist = {r.bin: r.freq for r in spectrum.histogram(counts).collect()}
    assert sum(hist.values()) == len(want)
    assert hist[255] == sum(n >= 255 for n in want.values())
    summary = spectrum.summary(counts).first()
    assert (summary.n_unique, summary.n_total, summary.max_n) == (len(want), want.total(), max(want.values()))
    capped = counting.saturate(counts, 7).agg(F.sum("n")).first()[0]
    assert capped == sum(min(n, 7) for n in want.values())
    kept = counting.threshold(counts, 2, 9)
    assert collected(kept, 5) == {w: n for w, n in want.items() if 2 <= n <= 9}


def test_parts_add_up(spark):
    counts = counting.count_kmers(frame(spark, make_reads(8, 300)), 21).cache()
    n, total = counts.count(), counts.agg(F.sum("n")).first()[0]
    for parts in (routing.units4(counts, 21), routing.segments(counts, 21), routing.suffixes(counts, 21)):
        assert tuple(parts.agg(F.sum("n_unique"), F.sum("n_total")).first()) == (n, total)
    grand = routing.segment_rollup(counts, 21).where("card is null").first()
    assert (grand.n_unique, grand.n_total) == (n, total)
    with pytest.raises(ValueError):
        routing.suffixes(counts, 21, bits=9)


def test_approximate_unique(spark):
    df = frame(spark, make_reads(9, 400, "ACGT"))
    exact = counting.count_kmers(df, 21).count()
    estimate = counting.approx_unique(windows.kmers(df, 21)).first().n_unique_est
    assert abs(estimate - exact) < 0.1 * exact


def wrap(x):
    return x & ((1 << 64) - 1)


def finalizer(x, shifts, factors):
    x ^= x >> shifts[0]
    x = wrap(x * factors[0])
    x ^= x >> shifts[1]
    x = wrap(x * factors[1])
    return x ^ (x >> shifts[2])


def hash64_model(x, k):
    """The hash as modular arithmetic: multiplications stand for sums of shifted copies."""
    m = (1 << (2 * k)) - 1
    x = (x * ((1 << 21) - 1) - 1) & m
    x ^= x >> 24
    x = x * 265 & m
    x ^= x >> 14
    x = x * 21 & m
    x ^= x >> 28
    return x * ((1 << 31) + 1) & m


def test_hashes(spark):
    register(spark)
    rng = random.Random(1)
    values = [rng.randrange(1 << 62) for _ in range(500)] + [0, 1, (1 << 62) - 1]
    x = F.col("x")
    ks = (1, 5, 21, 31)
    masked = {k: x.bitwiseAND(F.lit(bases.kmer_mask(k)).cast("bigint")) for k in ks}
    rows = spark.createDataFrame([(v,) for v in values], "x bigint").select(
        "x",
        call("kmer_mix64", x).alias("mix"),
        call("kmer_murmur64", x).alias("murmur"),
        *[call("kmer_hash64", masked[k], k).alias(f"h{k}") for k in ks],
        *[call("kmer_hash_fe", masked[k], k).alias(f"g{k}") for k in ks],
    )
    for r in rows.collect():
        assert wrap(r.mix) == finalizer(r.x, (30, 27, 31), (SPLITMIX_A, SPLITMIX_B))
        assert wrap(r.murmur) == finalizer(r.x, (33, 33, 33), (MURMUR_A, MURMUR_B))
        for k in ks:
            m = bases.kmer_mask(k)
            assert r[f"h{k}"] == hash64_model(r.x & m, k)
            y = (r.x & m) ^ ((r.x & m) >> 33)
            assert r[f"g{k}"] == (y ^ (y << 21)) & m
    assert spark.range(1).select(call("kmer_hash64", F.lit(0).cast("bigint"), 21)).first()[0] == 2057405897664


def test_hashes_are_bijections(spark):
    register(spark)
    for k in (1, 2, 4, 7):
        hashed = spark.range(4**k).select(call("kmer_hash64", F.col("id"), k).alias("h"), call("kmer_hash_fe", F.col("id"), k).alias("g"))
        assert hashed.agg(F.count_distinct("h"), F.count_distinct("g"), F.max("h")).first() == (4**k, 4**k, 4**k - 1)


def test_decode_every_k(spark):
    rng = random.Random(3)
    for k in range(1, 32):
        codes_ = [0, 4**k - 1] + [rng.randrange(4**k) for _ in range(20)]
        df = spark.createDataFrame([(c,) for c in codes_], "y bigint")
        for r in df.select("y", bases.decode(F.col("y"), k).alias("w")).collect():
            assert len(r.w) == k and text_codes(r.w) == r.y


def test_sql_surface(spark):
    register(spark)
    row = spark.sql(
        "SELECT kmer_revcomp('AACG') a, kmer_canonical('TTTA') b, kmer_encode('ACGT') c, kmer_decode(27, 4) d,"
        " kmer_decode(kmer_encode(repeat('T', 31)), 31) g"
    ).first()
    assert tuple(row) == ("CGTT", "TAAA", 27, "ACGT", "T" * 31)
    rows = spark.sql("SELECT w.* FROM VALUES ('ACGTNacgu'), ('AC') t(s), LATERAL kmers(t.s, 3) w").collect()
    assert sorted(tuple(r) for r in rows) == [(1, "ACG"), (1, "ACG"), (2, "CGT"), (2, "CGT")]


def test_sql_arguments_are_checked(spark):
    register(spark)
    for call_ in ("kmer_hash64(5L, 40)", "kmer_mask(0)", "kmer_decode(3L, 32)", "kmer_encode('ACGN')", "kmer_encode('')", "kmer_windows('ACGT', 0)"):
        with pytest.raises(Exception, match="1 to 31"):
            spark.sql(f"SELECT {call_}").collect()
    for k in (0, 40):
        with pytest.raises(Exception, match="1 to 31"):
            spark.sql(f"SELECT w.* FROM VALUES ('ACGTACGT') t(s), LATERAL kmers(t.s, {k}) w").collect()
    assert spark.sql("SELECT kmer_encode(NULL), kmer_hash64(NULL, 21)").first() == (None, None)
    assert spark.sql("SELECT w.* FROM VALUES (CAST(NULL AS STRING)) t(s), LATERAL kmers(t.s, 3) w").count() == 0


def test_sql_table_function_on_a_long_read(spark):
    """Three million bases: windows come out slice by slice."""
    register(spark)
    long = spark.sql("SELECT repeat('ACGTTGCAAC', 300000) AS s")
    rows = spark.sql("SELECT count(*) AS n, max(w.pos) AS last, count(DISTINCT w.kmer) AS kinds FROM {r} r, LATERAL kmers(r.s, 21) w", r=long)
    assert tuple(rows.first()) == (3 * 10**6 - 20, 3 * 10**6 - 20, 10)


def test_bad_arguments(spark):
    df = frame(spark, ["ACGT"])
    for k in (0, 32, -1, True, "21", 2.0):
        with pytest.raises(ValueError):
            counting.count_kmers(df, k)
    with pytest.raises(ValueError):
        counting.count_kmers(df, 21, shuffle="rows")
    with pytest.raises(ValueError):
        counting.saturate(df, 0)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path):
    """Only the read column is scanned, and the routing stays in the JVM behind the count."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "ACGT", "x")], "doc_id bigint, seq string, other string").write.parquet(path)
    reads = spark.read.parquet(path)
    counts = counting.count_kmers(reads, 21)
    text = plan(counts)
    assert "ReadSchema: struct<seq:string>" in text
    assert text.count("Exchange") == 2 and "RoundRobin" not in text
    assert text.count("MapInArrow") == 2
    routed = plan(routing.segments(counts, 21))
    assert "PythonUDF" not in routed and "Join" not in routed
    assert plan(windows.total_kmers(reads, 21)).count("Exchange SinglePartition") == 1
