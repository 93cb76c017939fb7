"""SQL functions for k-mer work, written in SQL so that Catalyst inlines them.

Every function is a temporary SQL function of the session: its body becomes a
projection of the calling plan and stays inside whole-stage codegen. Nested
calls become stacked projections, which keeps each step's input computed once.

ANSI mode raises on BIGINT overflow, so sums are kept below 2^63 by masking
every operand first and 64-bit products are assembled from 16/32-bit pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Multipliers and shifts of the two public 64-bit finalizers, and the shifts of the
# XOR-shift hash in order of use.
MURMUR_A, MURMUR_B, MURMUR_SHIFTS = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, (33, 33, 33)
SPLITMIX_A, SPLITMIX_B, SPLITMIX_SHIFTS = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (30, 27, 31)
HASH_FE_SHIFTS = (33, 21)

_LOW32 = 0xFFFFFFFF
_LOW16 = 0xFFFF


def _wide(constant: int) -> str:
    """The two 32-bit halves of a 64-bit constant, as SQL arguments."""
    return f"{constant >> 32}L, {constant & _LOW32}L"


def _finalizer(factors: tuple[int, int], shifts: tuple[int, int, int]) -> str:
    """Fold, multiply, fold, multiply, fold."""
    text = "x"
    for factor, shift in zip((*factors, None), shifts):
        text = f"kmer_fold({text}, {shift})"
        text = text if factor is None else f"kmer_mul64({text}, {_wide(factor)})"
    return text


_CHECKED_K = "CASE WHEN k IS NULL OR k BETWEEN 1 AND 31 THEN k ELSE raise_error('k must lie in 1 to 31') END"

# name -> (parameters, result type, body); later entries may call earlier ones.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "kmer_checked_k": ("k INT", "INT", _CHECKED_K),
    "kmer_mask": ("k INT", "BIGINT", "shiftleft(1L, 2 * kmer_checked_k(k)) - 1L"),
    "kmer_revcomp": ("kmer STRING", "STRING", "reverse(translate(kmer, 'ACGT', 'TGCA'))"),
    "kmer_canonical": ("kmer STRING", "STRING", "least(kmer, kmer_revcomp(kmer))"),
    "kmer_encode": (
        "kmer STRING",
        "BIGINT",
        "CASE WHEN kmer RLIKE '^[ACGT]{1,31}$' THEN CAST(conv(translate(kmer, 'ACGT', '0123'), 4, 10) AS BIGINT)"
        " WHEN kmer IS NOT NULL THEN raise_error('a k-mer has 1 to 31 of the letters ACGT') END",
    ),
    "kmer_decode": (
        "y BIGINT, k INT",
        "STRING",
        "translate(lpad(conv(CAST(y AS STRING), 10, 4), kmer_checked_k(k), '0'), '0123', 'ACGT')",
    ),
    # x ^ (x >>> n) and x plus shifted copies of itself, modulo the mask m
    "kmer_fold": ("x BIGINT, n INT", "BIGINT", "x ^ shiftrightunsigned(x, n)"),
    "kmer_add_shifted": ("x BIGINT, n INT, m BIGINT", "BIGINT", "(x + (shiftleft(x, n) & m)) & m"),
    "kmer_add_two_shifted": (
        "x BIGINT, a INT, b INT, m BIGINT",
        "BIGINT",
        "(((x + (shiftleft(x, a) & m)) & m) + (shiftleft(x, b) & m)) & m",
    ),
    "kmer_not_plus_shifted": ("x BIGINT, n INT, m BIGINT", "BIGINT", "((m - x) + (shiftleft(x, n) & m)) & m"),
    # the invertible hash, step by step; fixed values: its shifts
    "kmer_hash64_a": ("y BIGINT, m BIGINT", "BIGINT", "kmer_fold(kmer_not_plus_shifted(y, 21, m), 24)"),
    "kmer_hash64_b": ("y BIGINT, m BIGINT", "BIGINT", "kmer_fold(kmer_add_two_shifted(y, 3, 8, m), 14)"),
    "kmer_hash64_c": ("y BIGINT, m BIGINT", "BIGINT", "kmer_fold(kmer_add_two_shifted(y, 2, 4, m), 28)"),
    "kmer_hash64_d": ("y BIGINT, m BIGINT", "BIGINT", "kmer_add_shifted(y, 31, m)"),
    "kmer_hash64_masked": ("y BIGINT, m BIGINT", "BIGINT", "kmer_hash64_d(kmer_hash64_c(kmer_hash64_b(kmer_hash64_a(y, m), m), m), m)"),
    "kmer_hash64": ("y BIGINT, k INT", "BIGINT", "kmer_hash64_masked(y, kmer_mask(k))"),
    "kmer_xor_left": ("x BIGINT, n INT, m BIGINT", "BIGINT", "(x ^ shiftleft(x, n)) & m"),
    "kmer_hash_fe": (
        "y BIGINT, k INT",
        "BIGINT",
        f"kmer_xor_left(kmer_fold(y, {HASH_FE_SHIFTS[0]}), {HASH_FE_SHIFTS[1]}, kmer_mask(k))",
    ),
    # 64-bit wrapping product, from 32-bit halves; every intermediate stays below 2^50
    "kmer_sum_halves": (
        "p BIGINT, q BIGINT, s BIGINT",
        "BIGINT",
        f"shiftleft(shiftrightunsigned(p, 32) + shiftrightunsigned(q, 16) + shiftrightunsigned(s, 32), 32)"
        f" | (s & {_LOW32}L)",
    ),
    "kmer_join_products": (
        "p BIGINT, q BIGINT",
        "BIGINT",
        f"kmer_sum_halves(p, q, (p & {_LOW32}L) + shiftleft(q & {_LOW16}L, 16))",
    ),
    "kmer_mul32": (
        "a BIGINT, b BIGINT",
        "BIGINT",
        f"kmer_join_products((a & {_LOW16}L) * b, shiftrightunsigned(a, 16) * b)",
    ),
    "kmer_add_high": (
        "low BIGINT, high BIGINT",
        "BIGINT",
        f"shiftleft((shiftrightunsigned(low, 32) + (high & {_LOW32}L)) & {_LOW32}L, 32) | (low & {_LOW32}L)",
    ),
    "kmer_mul64_halves": (
        "xh BIGINT, xl BIGINT, ch BIGINT, cl BIGINT",
        "BIGINT",
        f"kmer_add_high(kmer_mul32(xl, cl),"
        f" (kmer_mul32(xl, ch) & {_LOW32}L) + (kmer_mul32(xh, cl) & {_LOW32}L))",
    ),
    "kmer_mul64": (
        "x BIGINT, ch BIGINT, cl BIGINT",
        "BIGINT",
        f"kmer_mul64_halves(shiftrightunsigned(x, 32), x & {_LOW32}L, ch, cl)",
    ),
    # the two finalizers; the full 64-bit pattern comes back as a signed BIGINT
    "kmer_murmur64": ("x BIGINT", "BIGINT", _finalizer((MURMUR_A, MURMUR_B), MURMUR_SHIFTS)),
    "kmer_mix64": ("x BIGINT", "BIGINT", _finalizer((SPLITMIX_A, SPLITMIX_B), SPLITMIX_SHIFTS)),
}

_SLICE, _PART = 1 << 17, 1 << 9  # windows of a slice of a run, and of a part of a slice: substr walks from the start of its text
# All windows of k valid bases of one read, as an array; for reads that fit in memory once per window.
_WINDOWS = (
    f"flatten(transform(filter(split(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]+'), b -> length(b) >= {_CHECKED_K}),"
    " b -> transform(sequence(1, length(b) - k + 1), p -> named_struct('pos', p, 'kmer', substr(b, p, k)))))"
)
FUNCTIONS["kmer_windows"] = ("seq STRING, k INT", "ARRAY<STRUCT<pos: INT, kmer: STRING>>", _WINDOWS)
# The same as a table function: SELECT ... FROM reads, LATERAL kmers(seq, 21).
# One generator is all there is to the body: Spark then makes it a step of the calling plan, where a body of several
# is joined back to the reads by their text, with that text beside every window. Runs are cut into slices and those
# into parts inside it; a read's windows are one array for a moment.
_RUNS = f"filter(split(translate(seq, 'acgtuU', 'ACGTTT'), '[^ACGT]+'), b -> length(b) >= {_CHECKED_K})"
_SLICES = f"flatten(transform({_RUNS}, b -> transform(sequence(0, length(b) - k, {_SLICE}), f -> named_struct('at', f, 's', substr(b, f + 1, {_SLICE} + k - 1)))))"
_PARTS = f"flatten(transform({_SLICES}, x -> transform(sequence(0, length(x.s) - k, {_PART}), f -> named_struct('at', x.at + f, 's', substr(x.s, f + 1, {_PART} + k - 1)))))"
_IN_PARTS = f"flatten(transform({_PARTS}, x -> transform(sequence(1, length(x.s) - k + 1), p -> named_struct('pos', x.at + p, 'kmer', substr(x.s, p, k)))))"
TABLE_FUNCTION = f"""
CREATE OR REPLACE TEMPORARY FUNCTION kmers(seq STRING, k INT)
RETURNS TABLE(pos INT, kmer STRING)
RETURN SELECT pos, kmer FROM inline({_IN_PARTS}) AS w(pos, kmer)
"""

_registered: set[str] = set()


def register(spark: SparkSession) -> None:
    """Make the k-mer functions and the ``kmers`` table function usable in SQL."""
    session = f"{spark.sparkContext.applicationId}/{spark._jsparkSession.sessionUUID()}"
    if session in _registered:
        return
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.sql(TABLE_FUNCTION)
    _registered.add(session)


def call(name: str, *args: Column | int) -> Column:
    """Call a registered function on columns and integer constants."""
    return F.call_function(name, *[a if isinstance(a, Column) else F.lit(a) for a in args])
