"""Column expressions on base strings and on 2-bit k-mer codes, all JVM-side."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest k whose 2-bit code fits a non-negative BIGINT, and the default k.
MIN_K, MAX_K = 1, 31
DEFAULT_K = 21
_FOUR_BASES = ["".join(letters) for letters in itertools.product("ACGT", repeat=4)]


def check_k(k: int) -> int:
    """Reject k outside [1, 31]."""
    if isinstance(k, bool) or not isinstance(k, int) or not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be an integer in [{MIN_K}, {MAX_K}], got {k!r}")
    return k


def kmer_mask(k: int) -> int:
    """All ones over the 2k bits of a k-mer code."""
    return (1 << (2 * check_k(k))) - 1


def normalize(seq: Column, u_as_t: bool = True) -> Column:
    """Upper-case the bases; U counts as T unless ``u_as_t`` is off. Other characters stay."""
    return F.translate(seq, "acgtuU", "ACGTTT") if u_as_t else F.translate(seq, "acgt", "ACGT")


def revcomp(kmer: Column) -> Column:
    """Reverse complement of an upper-case base string."""
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement (text order equals code order)."""
    return F.least(kmer, revcomp(kmer))


def encode(kmer: Column) -> Column:
    """2-bit code of an upper-case k-mer, A0 C1 G2 T3, first base highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("bigint")


def decode(code: Column, k: int) -> Column:
    """Base string of a 2-bit code, four bases per table look-up.

    Character-wise functions such as ``translate`` cost far more per row.
    """
    table = F.lit(_FOUR_BASES)
    lead = check_k(k) % 4
    pieces = []
    if lead:
        first = F.get(table, F.shiftrightunsigned(code, 2 * (k - lead)).cast("int"))
        pieces.append(F.substring(first, 5 - lead, lead))
    for shift in range(2 * (k - lead) - 8, -1, -8):
        byte = F.shiftrightunsigned(code, shift).bitwiseAND(F.lit(255).cast("bigint"))
        pieces.append(F.get(table, byte.cast("int")))
    return F.concat(*pieces)


def valid_bases(seq: Column) -> Column:
    """Number of A, C, G and T characters in a normalized sequence."""
    return F.length(F.regexp_replace(seq, "[^ACGT]+", ""))


def base_total(seq: Column, base: str) -> Column:
    """Number of times one base occurs in a sequence."""
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))
