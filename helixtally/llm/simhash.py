"""SimHash near-duplicates by multi-index hashing.

Fingerprints have 64 bits; two link at two differing bits or fewer. The distinct ones are
indexed once per segment, by (segment, its 32 bits). Of two differing bits at most one lies
in the first segment or none in the second, so a fingerprint probes the first segment's
table with the Hamming ball of radius 1 around its bits there, and the second's with its
bits as they are; what it meets is verified by the whole distance.

A table entry may hold many fingerprints (copies of one page with different tails). Where
it holds more than HOT_ENTRY, the key is refined by the other segment: the entry's own
fingerprints take a ball of radius 1 around it, those that probe with a flipped bit take it
as it is. Fingerprints at two bits or fewer still meet, at the one halfway; all holders of
a refined key are one bit from it, 65 at most, and so linked with each other, and a chain
through them connects them without enumerating pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtally.llm.common import written
from helixtally.llm.components import components

SEED = 42
SHINGLE = 3
SEGMENT_BITS = 32
HOT_ENTRY = 256  # fingerprints of a table entry beyond which keys are refined
LINK_BITS = 2
_BLOCK = 1 << 16  # hashes whose bits are unpacked at once


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[at : at + _BLOCK].view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 255 * 255
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Of lower-cased words; a text of fewer words than a shingle is one shingle, one without words is 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return _majority(np.array([digest(joined[a:z], SEED) for a, z in zip(starts, stops, strict=True)], np.uint64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits) per row of docs; bits is the fingerprint as a signed number."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).cast(pa.binary())
            bits = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.int64())], ["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(batches, "doc_id bigint, bits bigint")


def ball(segment: Column) -> Column:
    """A segment's bits and, bit by bit, those with one flipped."""
    return F.array(segment, *[segment.bitwiseXOR(F.lit(1 << b)) for b in range(SEGMENT_BITS)])


def links(distinct: DataFrame) -> DataFrame:
    """(u, v), v < u: all pairs of distinct bits at LINK_BITS or fewer, but in hot entries only enough to connect them."""
    low = F.col("bits").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    segments = distinct.select("bits", F.shiftrightunsigned("bits", SEGMENT_BITS).alias("a"), low.alias("b"))
    entry = lambda number, value, rest: F.struct(F.lit(number).alias("segment"), value.alias("value"), F.col(rest).alias("rest"))
    table = segments.select("bits", F.inline(F.array(entry(0, F.col("a"), "b"), entry(1, F.col("b"), "a"))))
    probes = F.concat(F.transform(ball(F.col("a")), lambda x: entry(0, x, "b")), F.array(entry(1, F.col("b"), "a")))
    probes = segments.select("bits", F.inline(probes))
    place = ["segment", "value"]
    hot = written(table.groupBy(*place).count().where(F.col("count") > HOT_ENTRY).select(*place, F.lit(True).alias("hot")), "hot")

    def met(rows: DataFrame, name: str) -> DataFrame:
        """Rows of entries that aren't hot."""
        return rows.join(hot, place, "left_anti").select(F.col("bits").alias(name), *place)

    def refined(rows: DataFrame, fine: Column) -> DataFrame:
        return rows.join(hot, place, "left_semi").select("bits", *place, F.explode(fine).alias("fine"))

    pairs = met(probes, "u").join(met(table, "v"), place).select("u", "v")
    within = refined(probes, F.array("rest")).unionByName(refined(table, ball(F.col("rest")))).distinct()
    before = F.lag("bits").over(Window.partitionBy(*place, "fine").orderBy("bits"))
    pairs = pairs.unionByName(within.select(F.col("bits").alias("u"), before.alias("v")).where("v IS NOT NULL"))
    return pairs.where((F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= LINK_BITS) & (F.col("u") != F.col("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def roots(distinct: DataFrame) -> DataFrame:
    """(node, root) of all fingerprints of distinct (bits) that link with another one."""
    return components(written(links(distinct), "links"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, bits, component_id) per row of docs: the smallest doc_id reachable over links.

    A null text is empty; texts without words have fingerprint 0 and link like any
    other. Repeated rows stay repeated. Rows with a null doc_id take part and lend no
    id; a component of such rows only has a null id. Other columns are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("bits").agg(F.min("doc_id").alias("first")), "distinct")
    linked = roots(nodes)
    named = nodes.join(linked, nodes.bits == linked.node, "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(smallest, "root").select("bits", "component_id")
    return rows.join(ids, "bits").select("doc_id", "bits", "component_id")


def hex_bits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each group the row with the smallest doc_id stays, once.

    Rows with a null doc_id can't be named and all stay.
    """
    first = groups(docs.where("doc_id IS NOT NULL")).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id IS NULL"))
