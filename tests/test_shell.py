import random

import pytest
from conftest import brute_counts

import run_counts


def numbers(text):
    return dict(line.split("\t")[:2] for line in text.splitlines() if "\t" in line)


def test_shell(spark, tmp_path, capsys):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACGTN") for _ in range(80)) for _ in range(50)] + ["A" * 300]
    one, two = tmp_path / "x_1.fastq", tmp_path / "x_2.fastq"
    for path, part in ((one, seqs[::2]), (two, seqs[1::2])):
        path.write_text("".join(f"@r\n{s}\n+\n{'I' * len(s)}\n" for s in part))
    want = brute_counts(seqs, 5)
    hist = {}
    for n in want.values():
        hist[str(min(n, 255))] = hist.get(str(min(n, 255)), 0) + 1
    for extra in (["-n", "2"], ["-b", "1"]):
        run_counts.main([str(one), str(two), "-k", "5", "--hist", *extra], spark)
        out = capsys.readouterr().out
        got = numbers(out)
        assert (got["unique 5-mers"], got["total 5-mers"]) == (str(len(want)), str(want.total()))
        assert {b: int(f) for b, f in got.items() if b.isdigit()} == hist
        assert ("batch 0\tnew kmers " in out) == (extra[0] == "-b")
        assert out.index("phase listing files") < out.index("unique 5-mers")
        assert ("phase planning 1 batches" in out) == (extra[0] == "-b")
    target = str(tmp_path / "out")
    run_counts.main([str(one), str(two), "-k", "5", "--min", "2", "--max", "9", "--hist-all", "-o", target], spark)
    got = numbers(capsys.readouterr().out)
    kept = {w: n for w, n in want.items() if 2 <= n <= 9}
    assert got["unique 5-mers"] == str(len(kept)) and spark.read.parquet(target).count() == len(kept)
    assert sum(b.isdigit() for b in got) == 255
    fasta = tmp_path / "x.fa"
    fasta.write_text("".join(f">r\n{s[:40]}\n{s[40:]}\n" for s in seqs))
    run_counts.main([str(fasta), "-k", "13", "--fasta"], spark)
    assert numbers(capsys.readouterr().out)["unique 13-mers"] == str(len(brute_counts(seqs, 13)))
    with pytest.raises(ValueError):
        run_counts.main([str(one), "-k", "32"], spark)
