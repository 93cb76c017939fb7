"""Hash routing of k-mers to units, segments, cards and bins, and its balance.

All routes are functions of the k-mer alone, so distinct k-mers of the parts add
up to those of the whole. Every query starts from the count table: the routed
groups are then summed over distinct k-mers, never over raw occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtally.functions.sql import call, register

# Fixed values of the routing layouts.
CARD_SHIFT, CARDS = 27, 3  # card = (h >> 27) mod 3
UNIT_BITS, SEGMENT_BITS = 2, 8  # 4 units of 256 segments per card
PORT_BITS, SUBBIN_SHIFT, SUBBIN_BITS = 3, 3, 6  # 8 ports, 64 sub-bins
ROUTER_SHIFT = 21  # port = (y ^ (y >> 21)) mod 8
SUFFIX_BITS = 10


def low_bits(value: Column, bits: int, shift: int = 0) -> Column:
    """``bits`` bits of a code above ``shift``, as INT."""
    shifted = F.shiftrightunsigned(value, shift) if shift else value
    return shifted.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")


def with_hash64(counts: DataFrame, k: int, name: str = "h") -> DataFrame:
    """Add the invertible multiply-free hash of the k-mer code."""
    register(counts.sparkSession)
    return counts.withColumn(name, call("kmer_hash64", F.col("kmer"), k))


def with_hash_fe(counts: DataFrame, k: int, name: str = "h") -> DataFrame:
    """Add the two-step XOR-shift hash of the k-mer code."""
    register(counts.sparkSession)
    return counts.withColumn(name, call("kmer_hash_fe", F.col("kmer"), k))


def router_port(code: Column) -> Column:
    """Port of an unhashed code: low bits of the code XOR its upper half."""
    return low_bits(code.bitwiseXOR(F.shiftrightunsigned(code, ROUTER_SHIFT)), PORT_BITS)


def part_totals(routed: DataFrame, *parts: str) -> DataFrame:
    """Occurrences and distinct k-mers per part."""
    return routed.groupBy(*parts).agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_unique"))


def units4(counts: DataFrame, k: int) -> DataFrame:
    """Per processing unit h mod 4."""
    return part_totals(with_hash64(counts, k).withColumn("cu", low_bits(F.col("h"), UNIT_BITS)), "cu")


def ports8(counts: DataFrame, k: int) -> DataFrame:
    """Per port h mod 8, for both hashes; one pass over the count table."""
    routed = with_hash_fe(with_hash64(counts, k, "h"), k, "g")
    pair = routed.groupBy(
        low_bits(F.col("h"), PORT_BITS).alias("a"), low_bits(F.col("g"), PORT_BITS).alias("b")
    ).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    routes = F.array(
        F.struct(F.lit("hash64").alias("route"), F.col("a").alias("port")),
        F.struct(F.lit("hash_fe").alias("route"), F.col("b").alias("port")),
    )
    return (
        pair.select("n", "u", F.inline(routes))
        .groupBy("route", "port")
        .agg(F.sum("n").alias("n_total"), F.sum("u").alias("n_unique"))
    )


def segments(counts: DataFrame, k: int, cards: bool = False) -> DataFrame:
    """Per unit and 256 segments; with ``cards`` also per card (3 x 4 x 256 parts)."""
    routed = (
        with_hash64(counts, k)
        .withColumn("cu", low_bits(F.col("h"), UNIT_BITS))
        .withColumn("seg", low_bits(F.col("h"), SEGMENT_BITS, UNIT_BITS))
    )
    if not cards:
        return part_totals(routed, "cu", "seg")
    card = F.pmod(F.shiftrightunsigned(F.col("h"), CARD_SHIFT), F.lit(CARDS)).cast("int")
    return part_totals(routed.withColumn("card", card), "card", "cu", "seg")


def segment_rollup(counts: DataFrame, k: int) -> DataFrame:
    """All levels card > unit > segment and the grand total.

    The rollup expands the at most 3,072 segment rows, not the k-mers: distinct
    k-mers of disjoint parts add up.
    """
    return (
        segments(counts, k, cards=True)
        .rollup("card", "cu", "seg")
        .agg(F.sum("n_total").alias("n_total"), F.sum("n_unique").alias("n_unique"))
    )


def subbins(counts: DataFrame, k: int) -> DataFrame:
    """Per port of the unhashed code and 64 sub-bins of the XOR-shift hash, with the fullest sub-bin."""
    routed = with_hash_fe(counts, k).select(
        router_port(F.col("kmer")).alias("cu"), low_bits(F.col("h"), SUBBIN_BITS, SUBBIN_SHIFT).alias("sbin"), "n"
    )
    sized = part_totals(routed, "cu", "sbin")
    return sized.withColumn("max_n", F.max("n_total").over(Window.partitionBy()))  # at most 8 x 64 rows


def balance(counts: DataFrame, k: int) -> DataFrame:
    """How far the fullest part lies above and the emptiest below the mean, per routing scheme.

    All schemes are coarser than (card, suffix), so the k-mers are grouped once
    into at most 3 x 1,024 rows, and the schemes are read off those.
    """
    card = F.pmod(F.shiftrightunsigned(F.col("h"), CARD_SHIFT), F.lit(CARDS)).cast("int")
    fine = (
        with_hash64(counts, k)
        .groupBy(card.alias("card"), low_bits(F.col("h"), SUFFIX_BITS).alias("suffix"))
        .agg(F.count(F.lit(1)).alias("n_unique"))
    )
    suffix = F.col("suffix")
    schemes = {
        "units4": (4, F.pmod(suffix, F.lit(4))),
        "units8": (8, F.pmod(suffix, F.lit(8))),
        "suffixes1024": (1 << SUFFIX_BITS, suffix),
        "segments3072": (CARDS << SUFFIX_BITS, F.col("card") * (1 << SUFFIX_BITS) + suffix),
    }
    labelled = F.array(
        *[
            F.struct(F.lit(name).alias("scheme"), F.lit(parts).alias("parts"), part.alias("part"))
            for name, (parts, part) in schemes.items()
        ]
    )
    sized = (
        fine.select("n_unique", F.inline(labelled))
        .groupBy("scheme", "parts", "part")
        .agg(F.sum("n_unique").alias("n_unique"))
    )
    mean = F.sum("n_unique") / F.col("parts")
    low = F.when(F.count(F.lit(1)) < F.col("parts"), F.lit(0).cast("bigint")).otherwise(F.min("n_unique"))
    return sized.groupBy("scheme", "parts").agg(
        F.max("n_unique").alias("max_unique"),
        low.alias("min_unique"),
        F.round((F.max("n_unique") - mean) / mean, 6).alias("over"),
        F.round((mean - low) / mean, 6).alias("under"),
    )


def suffixes(counts: DataFrame, k: int, bits: int = SUFFIX_BITS) -> DataFrame:
    """Per low ``bits`` bits of the hash, as a suffix-partitioned counter keeps its tables."""
    if bits < SUFFIX_BITS:
        raise ValueError(f"bits must be at least {SUFFIX_BITS}")
    return part_totals(with_hash64(counts, k).withColumn("suffix", low_bits(F.col("h"), bits)), "suffix")
