"""DuckDB SQL for the catalogue, written independently of the Spark plans.

Everything is spelled in text and HUGEINT arithmetic over exploded k-mers, so a
shared mistake in the 2-bit machinery would show.
"""

from __future__ import annotations

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "ACGTACGTACGTACGTACGTACGTAC" * 2

READS = f"""reads AS (
  SELECT doc_id, translate(replace(replace(text, ' ', ''), chr(10), ''), '{LETTERS}', '{BASES}') AS seq
  FROM documents)"""


def _words(k: int, columns: str = "doc_id") -> str:
    """reads -> runs of at least k bases -> all windows, forward and canonical."""
    return f"""{READS},
runs AS (SELECT {columns}, unnest(regexp_extract_all(seq, '[ACGT]{{{k},}}')) AS run FROM reads),
words AS (SELECT {columns}, substr(run, i, {k}) AS kmer
          FROM (SELECT {columns}, run, unnest(range(1, length(run) - {k} + 2)) AS i FROM runs)),
canons AS (SELECT {columns}, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canon FROM words)"""


def _counts(k: int = 21) -> str:
    return f"""{_words(k)},
cnt AS (SELECT canon, CAST(count(*) AS BIGINT) AS n FROM canons GROUP BY canon)"""


def _code(word: str, k: int) -> str:
    """2-bit code by place value."""
    places = [f"(strpos('ACGT', substr({word}, {i + 1}, 1)) - 1)::HUGEINT * {4 ** (k - 1 - i)}" for i in range(k)]
    return " + ".join(places)


_MASK42 = (1 << 42) - 1
_MASK64 = (1 << 64) - 1


def _steps(name: str, source: str, start: str, steps: list[str], keep: str) -> str:
    """A chain of CTEs that rewrite x step by step."""
    parts, previous = [f"{name}_0 AS (SELECT {keep}, {start} AS x FROM {source})"], f"{name}_0"
    for i, step in enumerate(steps, 1):
        parts.append(f"{name}_{i} AS (SELECT {keep}, {step} AS x FROM {previous})")
        previous = f"{name}_{i}"
    parts.append(f"{name} AS (SELECT {keep}, x FROM {previous})")
    return ",\n".join(parts)


def _coded() -> str:
    return f"{_counts()},\ncoded AS (SELECT canon, n, {_code('canon', 21)} AS y FROM cnt)"


def _hash64(table: str = "coded", name: str = "hashed", keep: str = "y, n") -> str:
    m = _MASK42
    return _steps(name, table, "y", [
        f"(({m} - x) + x * {1 << 21}) & {m}",
        "xor(x, x >> 24)",
        f"(x + x * 8 + x * 256) & {m}",
        "xor(x, x >> 14)",
        f"(x + x * 4 + x * 16) & {m}",
        "xor(x, x >> 28)",
        f"(x + x * {1 << 31}) & {m}",
    ], keep)


def _hash_fe(table: str = "coded", name: str = "mixed", keep: str = "y, n") -> str:
    return _steps(name, table, "y", ["xor(x, x >> 33)", f"xor(x, x * {1 << 21}) & {_MASK42}"], keep)


def _finalizer(table: str, name: str, keep: str, shifts: tuple[int, int, int], factors: tuple[int, int]) -> str:
    a, b, c = shifts
    return _steps(name, table, "h::UHUGEINT", [
        f"xor(x, x >> {a})",
        f"(x * {factors[0]}::UHUGEINT) & {_MASK64}::UHUGEINT",
        f"xor(x, x >> {b})",
        f"(x * {factors[1]}::UHUGEINT) & {_MASK64}::UHUGEINT",
        f"xor(x, x >> {c})",
    ], keep)


_MIX = ((30, 27, 31), (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_MURMUR = ((33, 33, 33), (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))

_H = f"WITH {_coded()},\n{_hash64()},\nhk AS (SELECT y, n, CAST(x AS BIGINT) AS h FROM hashed)"
_G = f"WITH {_coded()},\n{_hash_fe()},\ngk AS (SELECT y, n, CAST(x AS BIGINT) AS h FROM mixed)"
_TOTALS = "CAST(sum(n) AS BIGINT) AS n_total, CAST(count(*) AS BIGINT) AS n_unique"
_CARD = "CAST((h >> 27) % 3 AS INTEGER)"
_CU = "CAST(h & 3 AS INTEGER)"
_SEG = "CAST((h >> 2) & 255 AS INTEGER)"

_TABLE = f"WITH {_counts()} SELECT canon, n FROM cnt"
_NEW = f"""WITH {_words(21)},
first AS (SELECT canon, min(doc_id % 9) AS batch FROM canons GROUP BY canon)
SELECT CAST(batch AS INTEGER) AS batch, CAST(count(*) AS BIGINT) AS new_unique FROM first GROUP BY 1"""


def _signed(x: str) -> str:
    """A 64-bit pattern as BIGINT."""
    return f"CAST(CASE WHEN {x} >= {1 << 63}::UHUGEINT THEN {x}::HUGEINT - {1 << 64}::HUGEINT ELSE {x}::HUGEINT END AS BIGINT)"


_MIXED = ",\n" + _finalizer("gk", "mix", "h", *_MIX)

_PAIRED = f"""WITH {_words(21)},
per AS (SELECT canon, count(*) FILTER (doc_id % 2 = 0) AS n1, count(*) FILTER (doc_id % 2 = 1) AS n2
        FROM canons GROUP BY canon)
SELECT 'mate1' AS part, CAST(sum(n1) AS BIGINT) AS n_total, CAST(count(*) FILTER (n1 > 0) AS BIGINT) AS n_unique FROM per
UNION ALL
SELECT 'mate2', CAST(sum(n2) AS BIGINT), CAST(count(*) FILTER (n2 > 0) AS BIGINT) FROM per
UNION ALL
SELECT 'both', CAST(sum(n1 + n2) AS BIGINT), CAST(count(*) AS BIGINT) FROM per"""

ORACLE: dict[str, str] = {
    "read_scan": f"WITH {READS} SELECT doc_id, CAST(length(seq) AS BIGINT) AS seq_len FROM reads",
    "base_composition": f"""WITH {READS}, ch AS (SELECT unnest(string_split(seq, '')) AS c FROM reads)
SELECT CAST(count(*) FILTER (c = 'A') AS BIGINT) AS a, CAST(count(*) FILTER (c = 'C') AS BIGINT) AS c,
       CAST(count(*) FILTER (c = 'G') AS BIGINT) AS g, CAST(count(*) FILTER (c = 'T') AS BIGINT) AS t,
       CAST(count(*) FILTER (c NOT IN ('A', 'C', 'G', 'T', '')) AS BIGINT) AS other FROM ch""",
    "invalid_breaks": f"""WITH {READS}
SELECT doc_id, CAST(length(regexp_replace(seq, '[ACGT]', '', 'g')) AS BIGINT) AS n_invalid FROM reads""",
    "acgt_runs": f"""WITH {READS}, runs AS (SELECT unnest(regexp_extract_all(seq, '[ACGT]+')) AS run FROM reads)
SELECT CAST(length(run) AS BIGINT) AS run_len, CAST(count(*) AS BIGINT) AS n_runs FROM runs GROUP BY 1""",
    "short_reads": f"""WITH {READS},
per AS (SELECT length(seq) AS len, len(regexp_extract_all(seq, '[ACGT]+')) AS n_runs,
               len(regexp_extract_all(seq, '[ACGT]{{21,}}')) AS n_long FROM reads)
SELECT CAST(count(*) AS BIGINT) AS n_reads, CAST(count(*) FILTER (len < 21) AS BIGINT) AS short_reads,
       CAST(count(*) FILTER (n_long = 0) AS BIGINT) AS reads_without_kmer,
       CAST(sum(n_runs) AS BIGINT) AS n_runs, CAST(sum(n_runs - n_long) AS BIGINT) AS short_runs FROM per""",
    "kmers_k5": f"WITH {_counts(5)} SELECT canon, n FROM cnt",
    "kmer_positions": f"""WITH {READS},
lists AS (SELECT doc_id, regexp_extract_all(seq, '[ACGT]{{21,}}') AS runs FROM reads),
runs AS (SELECT doc_id, unnest(runs) AS bases, unnest(range(0, len(runs))) AS run FROM lists),
places AS (SELECT doc_id, run, bases, unnest(range(1, length(bases) - 21 + 2)) AS pos FROM runs)
SELECT doc_id, CAST(run AS INTEGER) AS run, CAST(pos AS INTEGER) AS pos, substr(bases, pos, 21) AS kmer FROM places""",
    "sql_table_function": f"WITH {_counts(6)} SELECT canon, n FROM cnt",
    "revcomp": f"""WITH {_words(5)}
SELECT DISTINCT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM words""",
    "canonical": f"""WITH {_words(6)}
SELECT DISTINCT kmer, least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canon FROM words""",
    "encode_2bit": f"WITH {_coded()} SELECT canon, CAST(y AS BIGINT) AS y FROM coded",
    "hash64": f"{_H} SELECT CAST(y AS BIGINT) AS y, h FROM hk",
    "hash_fe": f"{_G} SELECT CAST(y AS BIGINT) AS y, h FROM gk",
    "mix64": f"""{_G}{_MIXED}
SELECT h, {_signed("x")} AS mixed FROM mix""",
    "murmur64": f"""{_H},
{_finalizer("hk", "mur", "h", *_MURMUR)}
SELECT h, {_signed("x")} AS mixed FROM mur""",
    "unique_kmers": f"WITH {_counts()} SELECT CAST(count(*) AS BIGINT) AS n_unique FROM cnt",
    "total_kmers": f"WITH {_words(21)} SELECT CAST(count(*) AS BIGINT) AS n_total FROM words",
    "kmer_counts": _TABLE,
    "kmer_counts_k31": f"WITH {_counts(31)} SELECT canon, n FROM cnt",
    "kmer_counts_builtin": _TABLE,
    "sort_runlength_counts": _TABLE,
    "tallied_counts": _TABLE,
    "grouped_counts": _TABLE,
    "fastq_kmer_scan": _TABLE,
    "histogram_dense": f"""WITH {_counts()},
h AS (SELECT least(n, 255) AS bin, count(*) AS freq FROM cnt GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(h.freq, 0) AS BIGINT) AS freq
FROM range(1, 256) b(bin) LEFT JOIN h ON h.bin = b.bin ORDER BY 1""",
    "histogram_sparse": f"""WITH {_counts()}
SELECT CAST(least(n, 255) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS freq FROM cnt GROUP BY 1 ORDER BY 1""",
    "spectrum_summary": f"""WITH {_counts()},
peak AS (SELECT least(n, 255) AS bin, count(*) AS freq FROM cnt WHERE n >= 4 GROUP BY 1 ORDER BY freq DESC, bin LIMIT 1)
SELECT CAST(count(*) AS BIGINT) AS n_unique, CAST(sum(n) AS BIGINT) AS n_total,
       CAST(count(*) FILTER (n = 1) AS BIGINT) AS singletons, max(n) AS max_n,
       (SELECT CAST(bin AS INTEGER) FROM peak) AS peak_bin,
       round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS mean_n FROM cnt""",
    "saturating_counts": f"""WITH {_counts()}
SELECT CAST(sum(least(n, 7)) AS BIGINT) AS cap_7, CAST(sum(least(n, 1023)) AS BIGINT) AS cap_1023,
       CAST(sum(least(n, 4194303)) AS BIGINT) AS cap_4194303, CAST(sum(n) AS BIGINT) AS uncapped FROM cnt""",
    "min_count_filter": f"""WITH {_counts()}
SELECT CAST(count(*) FILTER (n >= 2) AS BIGINT) AS kept, CAST(count(*) FILTER (n < 2) AS BIGINT) AS below,
       CAST(count(*) FILTER (n > 255) AS BIGINT) AS above,
       CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS kept_total FROM cnt""",
    "sql_count_kmers": _TABLE,
    "repeated_counts": f"WITH {_counts()} SELECT canon, n FROM cnt WHERE n >= 2",
    "merged_count_table": _TABLE,
    "sketch_unions": f"""WITH {_words(21)},
first AS (SELECT canon, min(doc_id % 9) AS batch FROM canons GROUP BY canon),
new AS (SELECT CAST(batch AS INTEGER) AS batch, count(*) AS n FROM first GROUP BY 1)
SELECT batch, CAST(sum(n) OVER (ORDER BY batch) AS BIGINT) AS n_unique, true AS near FROM new""",
    "min_count_table": f"WITH {_counts()} SELECT canon, n FROM cnt WHERE n BETWEEN 2 AND 255",
    "median_summary": f"""WITH {_counts()},
every AS (SELECT unnest(regexp_extract_all(seq, '[ACGT]+')) AS run FROM reads)
SELECT (SELECT CAST(median(length(run)) AS DOUBLE) FROM every) AS median_run_len,
       (SELECT CAST(median(n) AS DOUBLE) FROM cnt) AS median_n""",
    "paired_union": _PAIRED,
    "paired_files": _PAIRED,
    "approx_unique": f"WITH {_counts()} SELECT CAST(count(*) AS BIGINT) AS n_unique, true AS near FROM cnt",
    "u_breaks_counts": f"""WITH {READS},
broken AS (SELECT regexp_replace(seq, 'A(.{{9}})A', 'U\\1A', 'g') AS seq FROM reads),
runs AS (SELECT unnest(regexp_extract_all(seq, '[ACGT]{{6,}}')) AS run FROM broken),
words AS (SELECT substr(run, i, 6) AS kmer FROM (SELECT run, unnest(range(1, length(run) - 4)) AS i FROM runs))
SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canon, CAST(count(*) AS BIGINT) AS n FROM words GROUP BY 1""",
    "fastq_split_invariance": f"""WITH {_counts()},
figures AS (SELECT CAST(count(*) AS BIGINT) AS n_unique, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_total FROM cnt)
SELECT mode, CAST(split AS BIGINT) AS split, n_unique, n_total
FROM figures, (VALUES ('lines'), ('records')) m(mode), (VALUES ({64 << 10}), ({1 << 20}), ({128 << 20})) s(split)""",
    "unique_by_cu4": f"{_H} SELECT {_CU} AS cu, {_TOTALS} FROM hk GROUP BY 1",
    "unique_by_port8": f"""{_H},
{_hash_fe("coded", "mixed2")}
SELECT 'hash64' AS route, CAST(h & 7 AS INTEGER) AS port, {_TOTALS} FROM hk GROUP BY 2
UNION ALL
SELECT 'hash_fe', CAST(x & 7 AS INTEGER), {_TOTALS} FROM mixed2 GROUP BY 2""",
    "virtual_buckets_1024": f"{_H} SELECT {_CU} AS cu, {_SEG} AS seg, {_TOTALS} FROM hk GROUP BY 1, 2",
    "virtual_buckets_3072": f"""{_H},
routed AS (SELECT {_CARD} AS card, {_CU} AS cu, {_SEG} AS seg, n FROM hk)
SELECT card, cu, seg, {_TOTALS} FROM routed GROUP BY ROLLUP (card, cu, seg)""",
    "subbins_8x64": f"""{_G},
sized AS (SELECT CAST(xor(y, y >> 21) & 7 AS INTEGER) AS cu, CAST((h >> 3) & 63 AS INTEGER) AS sbin, {_TOTALS}
          FROM gk GROUP BY 1, 2)
SELECT cu, sbin, n_total, n_unique, max(n_total) OVER () AS max_n FROM sized""",
    "suffix_partitions": f"{_H} SELECT CAST(h & 1023 AS INTEGER) AS suffix, {_TOTALS} FROM hk GROUP BY 1",
    "partition_balance": f"""{_H},
parts AS (
  SELECT 'units4' AS scheme, 4 AS parts, h & 3 AS part, count(*) AS u FROM hk GROUP BY 3
  UNION ALL SELECT 'units8', 8, h & 7, count(*) FROM hk GROUP BY 3
  UNION ALL SELECT 'suffixes1024', 1024, h & 1023, count(*) FROM hk GROUP BY 3
  UNION ALL SELECT 'segments3072', 3072, ((h >> 27) % 3) * 1024 + (h & 1023), count(*) FROM hk GROUP BY 3),
spans AS (SELECT scheme, parts, max(u) AS hi, CASE WHEN count(*) < parts THEN 0 ELSE min(u) END AS lo,
                 CAST(sum(u) AS DOUBLE) / parts AS mean FROM parts GROUP BY 1, 2)
SELECT scheme, parts, hi AS max_unique, lo AS min_unique,
       round((hi - mean) / mean, 6) AS over, round((mean - lo) / mean, 6) AS under FROM spans""",
    "fastq_roundtrip": _TABLE,
    "fastq_lines_roundtrip": _TABLE,
    "fastq_wrapped_roundtrip": _TABLE,
    "fasta_roundtrip": _TABLE,
    "stream_bucket_counts": _TABLE,
    "stream_source_counts": _TABLE,
    "stream_counts": _TABLE,
    "batch_new_unique": _NEW,
    "stream_new_unique": _NEW,
    "stream_delta_counts": _TABLE,
}
