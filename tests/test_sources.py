import gzip
import random
import re

import pytest
from conftest import brute_counts, collected

from helixtally.operators import codes
from helixtally.operators.counting import count_codes, count_kmers, mate_unique
from helixtally.operators.windows import kmers
from helixtally.sources import fasta, ranges
from helixtally.operators.windows import labelled_tallies
from helixtally.sources.fastq import count_fastq, fastq_kmers, fastq_lines, range_table, read_fastq, read_pair
from helixtally.streaming import incremental


def rec(*seqs):
    return "".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs))


# name -> (file contents, k, u_as_t, distinct, total, counts)
EDGE = {
    "basic": ([rec("ACGTACGT")], 3, True, {"ACG": 4, "GTA": 2}),
    "n_break": ([rec("ACGTNACGTT")], 3, True, {"AAC": 1, "ACG": 4}),
    "lower": ([rec("acgtACGT")], 3, True, {"ACG": 4, "GTA": 2}),
    "u_is_t": ([rec("ACGU")], 3, True, {"ACG": 2}),
    "u_breaks": ([rec("ACGU")], 3, False, {"ACG": 1}),
    "short_read": ([rec("AC", "ACG")], 3, True, {"ACG": 1}),
    "revcomp": ([rec("AAAC", "GTTT")], 3, True, {"AAA": 2, "AAC": 2}),
    "palindrome": ([rec("ACGT")], 4, True, {"ACGT": 1}),
    "crlf": (["@r\r\nACGT\r\n+\r\nIIII\r\n"], 3, True, {"ACG": 2}),
    "qual_at": (["@r\nACGT\n+\n@@@@\n@r\nTTTT\n+\n@II@\n"], 3, True, {"AAA": 2, "ACG": 2}),
    "no_trailing_nl": (["@r0\nACGT\n+\nIIII", rec("GGGG")], 3, True, {"ACG": 2, "CCC": 2}),
    "blank_line": ([rec("ACGT") + "\n" + rec("GGGG")], 3, True, {"ACG": 2}),
    "multiline": (["@r0\nACG\nTAC\n+\nIIIIII\n"], 3, True, {"ACG": 1}),
    "saturate": ([rec("A" * 302)], 3, True, {"AAA": 300}),
    "k_min": ([rec("ACGT")], 1, True, {"A": 2, "C": 2}),
    "k_max": ([rec("A" * 31, "T" * 31, "C" * 30)], 31, True, {"A" * 31: 2}),
    "empty": ([""], 3, True, {}),
    "cut_off_after_sequence": (["@r\nACGT"], 3, True, {"ACG": 2}),
}


@pytest.mark.parametrize("name", EDGE)
def test_edge_files(spark, tmp_path, name):
    contents, k, u_as_t, expected = EDGE[name]
    paths = []
    for i, text in enumerate(contents):
        path = tmp_path / f"{name}{i}.fastq"
        path.write_bytes(text.encode())
        paths.append(str(path))
    options = {"uAsT": str(u_as_t).lower(), "splittable": "false"}
    assert collected(count_codes(fastq_kmers(spark, paths, k, **options)), k) == expected
    records = read_fastq(spark, paths, splitBytes=3)
    assert collected(count_kmers(records, k, u_as_t=u_as_t), k) == expected


ODD = {
    "blank_inside": rec("ACGTACGTAC", "GGGTTTAA") + "\n" + rec("CCCTTTA"),
    "cut_off_quality": rec("ACGTAC", "GGGTTT")[:-4],
    "crlf_without_end": "@r\r\nACGT\r\n+\r\nIIII\r\n@s\r\nTTGA\r\n+\r\nIIII",
    "no_at": rec("ACGTAC") + "r1\nGGGTTT\n+\nIIIIII\n" + rec("AAACCC"),
    "blank_end": rec("ACGTAC", "GGGTTT") + "\n\n\n\n\n",
    "empty_read": "@r\n\n+\n\n" + rec("ACGTAC"),
    "plus_sequence": rec("ACGTAC", "+CGTAC", "GGGTTT"),
} | {name: EDGE[name][0][0] for name in EDGE if len(EDGE[name][0]) == 1}


def sequences(ranges_):
    """All sequence lines of some ranges, or the error."""
    try:
        return [
            data[a:b].tobytes().decode().rstrip("\r")
            for r in ranges_
            for data, starts, ends in ranges.quads(r)
            for a, b in zip(starts[1::4], ends[1::4])
        ]
    except ranges.MalformedRecord:
        return "malformed"


@pytest.mark.parametrize("name", ODD)
def test_one_meaning_at_every_split(tmp_path, name):
    """Both modes: every two-way cut and every even cut gives what the whole file gives."""
    data = ODD[name].encode()
    path, size = tmp_path / "x.fastq", len(data)
    path.write_bytes(data)
    edges = [[0, size], *([0, c, size] for c in range(1, size)), *([*range(0, size, step), size] for step in (1, 3, 7))]
    for mode in ("lines", "records"):
        seen = set()
        for cuts in edges:
            some = [ranges.ByteRange(str(path), lo, hi, size) for lo, hi in zip(cuts, cuts[1:]) if hi > lo]
            if mode == "lines":
                some = [ranges.ByteRange(r.path, r.lo, r.hi, size, data[: r.lo].count(b"\n"), data[: r.hi].count(b"\n")) for r in some]
            seen.add(str(sequences(some)))
        assert len(seen) == 1, (mode, seen)
        if mode == "lines":
            lines = [s.rstrip("\r") for i, s in enumerate(data.decode().split("\n")) if i % 4 == 1]
            if data.endswith(b"\n") and data.count(b"\n") % 4 == 1:
                lines.pop()  # what follows the last line end is no line
            got = sequences([ranges.ByteRange(str(path), 0, size, size, 0, 0)]) if size else []
            assert [s for s in got if s] == [s for s in lines if s]


@pytest.mark.parametrize("name", ["blank_inside", "cut_off_quality", "crlf_without_end", "no_at", "blank_end"])
def test_sources_agree_on_odd_files(spark, tmp_path, name):
    """count_fastq, read_fastq and the stream, at several splits and partitions: one result or one error per mode."""
    path = str(tmp_path / "x.fastq")
    (tmp_path / "x.fastq").write_bytes(ODD[name].encode())
    size = len(ODD[name])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = {"lines": [], "records": []}
    try:
        for parts, split in ((1, size), (2, -(-size // 2)), (8, 5)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            for mode in results:
                try:
                    one = collected(count_fastq(spark, path, 3, mode=mode, splitBytes=split), 3)
                    assert one == collected(count_kmers(read_fastq(spark, path, mode, splitBytes=split), 3), 3)
                except Exception as e:
                    assert mode == "records" and "four-line" in str(e)
                    one = "malformed"
                results[mode].append(one)
            work = str(tmp_path / f"work{parts}")
            incremental.plan_batches(spark, f"{work}/plan", path, split_bytes=split)
            results["lines"].append(collected(incremental.stream_counts(incremental.stream_kmers(spark, f"{work}/plan", 3), work), 3))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for seen in results.values():
        assert all(x == seen[0] for x in seen)


def random_records(seed, n=40):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(1, 60)))
        qual = "".join(rng.choice("@+IA") for _ in seq)
        out.append((f"r{i} {'@' * rng.randrange(3)}", seq, qual))
    return out


def test_record_split_at_every_byte(tmp_path):
    """Two ranges meeting at any byte hold every record once."""
    records = random_records(5)
    text = "".join(f"@{h}\n{s}\n+{h if i % 3 else ''}\n{q}\n" for i, (h, s, q) in enumerate(records))
    path = tmp_path / "x.fastq"
    path.write_text(text)
    size = len(text)
    for cut in range(1, size):
        got = []
        for lo, hi in ((0, cut), (cut, size)):
            for data, starts, ends in ranges.quads(ranges.ByteRange(str(path), lo, hi, size)):
                got += [data[a:b].tobytes().decode() for a, b in zip(starts[1::4], ends[1::4])]
        assert got == [s for _, s, _ in records]


@pytest.mark.parametrize("blank", ["\n", "\n\n\n"])
def test_blank_lines_at_the_end(tmp_path, blank):
    records = random_records(8, 12)
    text = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records) + blank
    path = tmp_path / "x.fastq"
    path.write_text(text)
    size = len(text)
    for cuts in [()] + [(c,) for c in range(1, size)]:
        edges, got = [0, *cuts, size], []
        for lo, hi in zip(edges, edges[1:]):
            for data, starts, ends in ranges.quads(ranges.ByteRange(str(path), lo, hi, size)):
                got += [data[a:b].tobytes().decode() for a, b in zip(starts[1::4], ends[1::4])]
        assert got == [s for _, s, _ in records], cuts


def test_listing(spark, tmp_path):
    """Hidden parts, patterns within one part, suffixes in any case, nothing found: both listings agree."""
    text = rec("ACGTAC")
    for name in ("a.fastq", "old/b.fastq", "_temporary/0/c.fastq", ".snap/d.fastq", "old/.e.fastq", "sub/f.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    with gzip.open(tmp_path / "G.FASTQ.GZ", "wt") as f:
        f.write(text)
    short = lambda paths: sorted(p.rsplit("/", 1)[1] for p in paths)
    for path, want in (("", ["G.FASTQ.GZ", "a.fastq", "b.fastq", "f.txt"]), ("*.fastq", ["a.fastq"]), ("o*/*.fastq", ["b.fastq"]), ("G.*", ["G.FASTQ.GZ"])):
        full = f"{tmp_path}/{path}".rstrip("/")
        assert short(p for p, _ in ranges.list_files([full])) == want, path
        assert short(r.path for r in range_table(spark, full).collect()) == want, path
    assert read_fastq(spark, f"{tmp_path}/G.FASTQ.GZ", splitBytes=3).count() == 1
    for bad in (f"{tmp_path}/no*", f"{tmp_path}/absent"):
        with pytest.raises(FileNotFoundError):
            ranges.list_files([bad])
        with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
            range_table(spark, bad).collect()


def test_small_blocks(tmp_path, monkeypatch):
    records = random_records(6)
    path = tmp_path / "x.fastq"
    path.write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records))
    size = path.stat().st_size
    for block in (1, 5, 50):
        monkeypatch.setattr(ranges.blocks, "__defaults__", (block,))
        got = []
        for r in ranges.plan_ranges([(str(path), size)], 97):
            for data, starts, ends in ranges.quads(r):
                got += [data[a:b].tobytes().decode() for a, b in zip(starts[1::4], ends[1::4])]
        assert got == [s for _, s, _ in records]


def test_records_columns_and_splits(spark, tmp_path):
    records = random_records(7, 300)
    path = tmp_path / "x_1.fastq"
    path.write_text("".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in records))
    df = read_fastq(spark, str(path), "records", splitBytes=500)
    assert df.columns == ["file", "mate", "read_id", "seq", "qual"]
    assert df.rdd.getNumPartitions() > 10
    rows = df.collect()
    assert sorted((r.read_id, r.seq, r.qual) for r in rows) == sorted(records)
    assert {r.mate for r in rows} == {1} and {r.file for r in rows} == {str(path)}
    assert read_fastq(spark, str(path), columns="seq").columns == ["seq"]
    brute = brute_counts([s for _, s, _ in records], 5)
    for split in (300, 1000, 10**6):
        assert collected(count_codes(fastq_kmers(spark, str(path), 5, splitBytes=split)), 5) == brute
    assert collected(count_kmers(fastq_lines(spark, str(path), 333), 5), 5) == brute


def test_irregular_file_is_refused_or_read_by_lines(spark, tmp_path):
    path = tmp_path / "x.fastq"
    path.write_text((rec("ACGTACGTAC") + "\n") * 50)
    for split in (100, 10**6):
        with pytest.raises(Exception, match="four-line"):
            fastq_kmers(spark, str(path), 3, mode="records", splitBytes=split).count()
    whole = fastq_kmers(spark, str(path), 3, splittable="false").count()
    assert kmers(fastq_lines(spark, str(path), 100), 3).count() == whole


def test_gzip_and_pairs(spark, tmp_path):
    one, two = rec("ACGTACGT", "TTTTT"), rec("GGGGNACGT")
    with gzip.open(tmp_path / "x_1.fastq.gz", "wt") as f:
        f.write(one)
    (tmp_path / "x_2.fastq").write_text(two)
    pair = read_pair(spark, str(tmp_path / "x_1.fastq.gz"), str(tmp_path / "x_2.fastq"))
    assert sorted((r.mate, r.seq) for r in pair.collect()) == [(1, "ACGTACGT"), (1, "TTTTT"), (2, "GGGGNACGT")]
    got = {r.part: (r.n_total, r.n_unique) for r in mate_unique(labelled_tallies(pair, 3, "mate")).collect()}
    first, second = brute_counts(["ACGTACGT", "TTTTT"], 3), brute_counts(["GGGGNACGT"], 3)
    assert got == {
        "mate1": (first.total(), len(first)),
        "mate2": (second.total(), len(second)),
        "both": ((first + second).total(), len(first + second)),
    }
    folder = read_fastq(spark, str(tmp_path))
    assert folder.count() == 3
    assert read_fastq(spark, str(tmp_path / "*_2.fastq")).count() == 1


def test_bad_arguments(spark, tmp_path):
    for k in (0, 32):
        with pytest.raises(ValueError):
            fastq_kmers(spark, str(tmp_path), k)
    with pytest.raises(Exception, match="columns"):
        read_fastq(spark, str(tmp_path), columns="seq,nope").count()
    for mode in ("lines", "records"):
        with pytest.raises(Exception, match="absent"):
            read_fastq(spark, str(tmp_path / "absent.fastq"), mode).count()
    with pytest.raises(ValueError):
        read_fastq(spark, str(tmp_path), "other")


def test_fasta_split_at_every_byte(tmp_path, monkeypatch):
    text = ">one x>y\nACGTA\nCGTNN\nACG\n\n>two\nTTTGA\r\nCCCA\r\n>three\n>four\nGGGTC"
    reads = ["ACGTACGTNNACG", "TTTGACCCA", "", "GGGTC"]
    path = tmp_path / "x.fa"
    path.write_bytes(text.encode())
    size = len(text)
    for k in (1, 2, 3, 5):
        want = brute_counts(reads, k)
        for fragment, block in ((1 << 20, 1 << 20), (4, 3)):
            monkeypatch.setattr(fasta, "FRAGMENT", fragment)
            monkeypatch.setattr(ranges.blocks, "__defaults__", (block,))
            for cuts in [(c,) for c in range(1, size)] + [tuple(range(1, size, 2)), tuple(range(1, size))]:
                edges = [0, *cuts, size]
                got = brute_counts([], k)
                for lo, hi in zip(edges, edges[1:]):
                    for piece in fasta.fragments(ranges.ByteRange(str(path), lo, hi, size), k - 1):
                        got += brute_counts([piece.decode()], k)
                assert got == want, (k, cuts)


def test_fasta_source(spark, tmp_path):
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 900))) for _ in range(20)]
    lines = "".join(f">s{i}\n" + "".join(s[j : j + 60] + "\n" for j in range(0, len(s), 60)) for i, s in enumerate(seqs))
    (tmp_path / "x.fa").write_text(lines)
    with gzip.open(tmp_path / "y.fa.gz", "wt") as f:
        f.write(lines)
    want = brute_counts(seqs, 7)
    for name in ("x.fa", "y.fa.gz"):
        got = collected(count_kmers(fasta.read_fasta(spark, str(tmp_path / name), 7, splitBytes=777), 7), 7)
        assert got == want


def test_base_table():
    table = codes.base_table()
    assert [table[ord(c)] for c in "ACGTUacgtuN\n-"] == [0, 1, 2, 3, 3, 0, 1, 2, 3, 3, 4, 4, 4]
    assert codes.base_table(False)[ord("U")] == codes.base_table(False)[ord("u")] == 4
    assert (table < 4).sum() == 10


def test_filters_reach_the_scan(spark, tmp_path):
    """Conditions on mate and read length are the scan's: files are skipped and rows don't leave Python."""
    for mate in (1, 2):
        (tmp_path / f"x_{mate}.fastq").write_text("".join(f"@m{mate}n{n}\n{'A' * n}\r\n+\n{'I' * n}\r\n" for n in range(60)))
    (tmp_path / "other.fastq").write_text("@o\nACGT\n+\nIIII\n")
    read = lambda **o: read_fastq(spark, str(tmp_path), mode="records", columns="mate,read_id,n_bases", **o)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    try:
        for condition in ("mate = 2 AND n_bases >= 50", "n_bases > 10 AND n_bases < 20", "mate IN (1, 2) AND n_bases <= 3", "n_bases = 4", "mate IS NOT NULL", "mate = 1 AND read_id LIKE '%7'", "mate <=> 1", "n_bases <> 5 AND n_bases < 9", "mate IS NULL"):
            plain = sorted((tuple(r) for r in read().where(condition).collect()), key=repr)
            pushed = read(pushFilters="true").where(condition)
            assert sorted((tuple(r) for r in pushed.collect()), key=repr) == plain, condition
            assert plain
        pushed = read(pushFilters="true").where("mate = 2 AND n_bases >= 50")
        assert pushed.collect()
        node = pushed._jdf.queryExecution().executedPlan()
        assert not re.search(r"\bFilter \(", node.toString())
        rows = []

        def walk(x):
            kind = x.getClass().getSimpleName()
            if kind == "AdaptiveSparkPlanExec":
                return walk(x.executedPlan())
            if "Scan" in kind:
                rows.append(x.metrics().apply("numOutputRows").value())
            for i in range(x.children().size()):
                walk(x.children().apply(i))

        walk(node)
        assert rows == [10]
        lengths = read_fastq(spark, str(tmp_path), columns="n_bases").agg({"n_bases": "sum"}).first()[0]
        assert lengths == 2 * sum(range(60)) + 4 == read_fastq(spark, str(tmp_path), "wrapped", columns="n_bases").agg({"n_bases": "sum"}).first()[0]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
