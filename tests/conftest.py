import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from helixtally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, "6g")


def text_codes(word):
    """2-bit code of a base string, straight from the definition."""
    code = 0
    for letter in word:
        code = code * 4 + "ACGT".index(letter)
    return code


def brute_counts(reads, k, u_as_t=True):
    """Canonical k-mer strings and their counts, one window at a time."""
    counts = Counter()
    for read in reads:
        read = read.upper().replace("U", "T") if u_as_t else read.upper()
        for i in range(len(read) - k + 1):
            word = read[i : i + k]
            if set(word) <= set("ACGT"):
                counts[min(word, word[::-1].translate(str.maketrans("ACGT", "TGCA")))] += 1
    return counts


def collected(counts, k):
    """A count table as {k-mer string: n}."""
    letters = {}
    for row in counts.collect():
        word = "".join("ACGT"[row["kmer"] >> (2 * (k - 1 - i)) & 3] for i in range(k))
        assert word not in letters
        letters[word] = row["n"]
    return letters
