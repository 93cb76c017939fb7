"""Near copies by exact set similarity: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Shingles stand in one order, those frequent in a sample last. Two sets that are similar
enough share a shingle among the first fifth of either (prefix filter), so the first
fifths are the keys of a join, whatever the edits. At first each holder of a key is held
against the smallest one only; what that leaves in different components is compared pair
by pair, so groups of copies cost no pairs among themselves. Keys that the sample shows to
be frequent are dealt out by salt, and the smallest holders of the salts meet afterwards.

Pairs that share a key are first told apart by 64 marks (a bit of the least shingle of each of
64 ranges of hashes): similar sets differ in a tenth of them, and a pair that differs in more
than 24 is let go, which happens to one similar pair in 10^8 at most. Then a pair's sketches (the least shingle of each of 128 ranges of hashes) are compared before
its sets: of the ranges in use, similar sets agree on four fifths; a pair that agrees on fewer
than two fifths of 48 or more is let go, which by Chernoff's bound happens to one similar
pair in 10^7 at most at exactly 48 ranges and to one in 10^19 where all are in use. All
others are verified on whole sets. The sample decides costs, not results.

The pipeline's stage goes by SimHash first: rows whose fingerprints link (simhash.py) are near
copies, and the exact similarity adds those that lie at more bits, in one search for components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtally.llm import simhash
from helixtally.llm.bits import passes, table_of
from helixtally.llm.common import delete, in_turn, kept, written, written_small
from helixtally.llm.components import components
from helixtally.llm.words import WordHashes

SHINGLE = 5
PERCENT = 80  # least similarity
SAMPLE, LISTED = 2000, 1 << 16  # rows in which frequent shingles are looked for, and how many of those are told to tasks
HOT_SHARE, SALTS = 100, 64  # a key that one sampled row in so many holds is dealt out
MOST_MARKS = 24  # of 64 in which similar sets differ
RANGES, FEW_RANGES, SAFE_PERCENT = 128, 48, 80  # of a sketch; fewer in use, or a lower similarity, and sets decide alone
_CACHED = 1 << 16  # sets that a task remembers
_ROWS = 1024  # texts whose sets are held at once
_PAIRS = 1 << 12  # pairs whose sketches are compared at once
_ODD = np.uint64(0x9E3779B97F4A7C15)


_Names = WordHashes


def _known() -> _Names:
    """Names of words; what another operator has left in this worker process goes."""
    return kept(("near_copies",), _Names)


def shingles(text: bytes | None, shingle: int, known: _Names) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, lower-cased; a text of fewer words is one shingle, one without words has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.int64)
    names = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    wide = min(shingle, len(words))
    mixed = np.full(len(words) - wide + 1, wide, np.uint64)
    for k in range(wide):
        mixed = (mixed ^ names[k : k + len(mixed)]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each range of hashes: 0 if the set has none there, else of the least one."""
    ranges = (hashes >> 57) + 64
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    out = np.zeros(RANGES, np.uint8)
    out[ranges[first]] = hashes[first].view(np.uint64) % np.uint64(255) + np.uint64(1)
    return out.tobytes()


def marks(hashes: np.ndarray) -> int:
    """A bit of the least hash of each of 64 ranges, as a signed number; similar sets differ in a tenth of them."""
    ranges = (hashes >> 58) + 32
    first = np.flatnonzero(np.diff(ranges, prepend=-1))
    return int(np.bitwise_or.reduce((hashes[first].view(np.uint64) >> np.uint64(17) & np.uint64(1)) << ranges[first].astype(np.uint64), initial=np.uint64(0)).astype(np.int64))


def plausible(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of sketches (rows) may belong to similar sets."""
    used = ((one > 0) | (two > 0)).sum(1)
    same = ((one == two) & (one > 0)).sum(1)
    return (used < FEW_RANGES) | (200 * same >= percent * used) | (percent < SAFE_PERCENT)


def _prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's first shingles, of which a similar set shares one, the sample's rare ones first; and how often the sample has them."""
    n = len(hashes)
    many = np.zeros(n, np.int64)
    if n and len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        many = np.where(frequent[at] == hashes, counts[at], 0)
    first = np.lexsort((hashes, many))[: n - -(-n * percent // 100) + 1] if n else np.empty(0, np.int64)
    return hashes[first], many[first]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    stops = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def _node(hashes: np.ndarray) -> int:
    """Names a set of shingles, as a signed number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _name(node: np.ndarray, doc_id: pa.Array) -> np.ndarray:
    """Names a doc_id, null included, with a set of shingles."""
    own = np.where(doc_id.is_null().to_numpy(False), 1, 2 * doc_id.fill_null(0).to_numpy()).view(np.uint64)
    mixed = (node.view(np.uint64) ^ (own * _ODD)) * _ODD
    return mixed ^ mixed >> np.uint64(29)


def _some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_turn(parts, _ROWS)


def _tags(docs: DataFrame, shingle: int, fingerprints: bool = False) -> DataFrame:
    """(doc_id, name, node, sketch, bits) per row; bits: the SimHash fingerprint, null unless asked for."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for part in _some(parts):
            texts = part.column(1).cast(pa.binary())
            sets = [shingles(t.as_py(), shingle, known) for t in texts]
            nodes = np.array([_node(s) for s in sets], np.int64)
            names = _name(nodes, part.column(0)).view(np.int64)
            bits = pa.nulls(len(sets), pa.int64())
            if fingerprints:
                bits = pa.array(np.array([simhash.fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))
            columns = [part.column(0), pa.array(names), pa.array(nodes), pa.array(list(map(sketch, sets)), pa.binary()), bits]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "name", "node", "sketch", "bits"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, "doc_id bigint, name bigint, node bigint, sketch binary, bits bigint")


def _sets(docs: DataFrame, shingle: int, wanted: np.ndarray | None = None) -> DataFrame:
    """(node, hashes) of texts, a task's copies once; of those that the bit table lets pass, if there is one."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _known(), set()
        for part in _some(parts):
            sets = [shingles(t.as_py(), shingle, known) for t in part.column(0).cast(pa.binary())]
            nodes = np.array([_node(s) for s in sets], np.int64)
            good = np.ones(len(sets), np.bool_) if shared.value is None else passes(shared.value, nodes.view(np.uint64))
            if shared.value is not None:
                seen = seen if len(seen) < _CACHED else set()
                for k in np.flatnonzero(good).tolist():
                    good[k] = (node := int(nodes[k])) not in seen
                    seen.add(node)
            chosen = np.flatnonzero(good).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(nodes[chosen]), _lists([sets[k] for k in chosen])], ["node", "hashes"])

    return docs.select("text").mapInArrow(batches, "node bigint, hashes array<bigint>")


def _frequent(docs: DataFrame, shingle: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample holds more than twice, in order, and how often."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(max(1, rows // SAMPLE))) == 0)
    sets = _sets(sample, shingle)
    counted = sets.select(F.explode("hashes").alias("key")).groupBy("key").count().where("count > 2")
    found = sorted(tuple(r) for r in counted.orderBy(F.desc("count"), "key").limit(LISTED).collect())
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)


def _keys(docs: DataFrame, shingle: int, percent: int, rows: int) -> DataFrame:
    """(key, salt, node, size, at) for the first shingles of each row's set, a task's copies once; at: the place among them; salt: -1 but for hot keys."""
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle, rows))
    hot = max(3, min(rows, SAMPLE) // HOT_SHARE)
    names = ["key", "salt", "node", "size", "at", "marks"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = _known(), set()
        for part in _some(parts):
            firsts, salts, nodes, sizes, places, signs = [], [], [], [], [], []
            for t in part.column(0).cast(pa.binary()):
                found = shingles(t.as_py(), shingle, known)
                node = _node(found)
                if node in seen:
                    continue
                seen = seen if len(seen) < _CACHED else set()
                seen.add(node)
                first, many = _prefix(found, *shared.value, percent)
                firsts.append(first)
                salts.append(np.where(many >= hot, node % SALTS, -1))
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), len(found)))
                places.append(np.arange(len(first)))
                signs.append(np.full(len(first), marks(found)))
            columns = (np.concatenate([np.empty(0, np.int64), *x]) for x in (firsts, salts, nodes, sizes, places, signs))
            yield pa.RecordBatch.from_arrays([pa.array(c if n in ("key", "node", "marks") else c.astype(np.int32)) for n, c in zip(names, columns, strict=True)], names)

    return docs.select("text").mapInArrow(batches, "key bigint, salt int, node bigint, size int, at int, marks bigint")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches don't speak against them."""
    one, two = (sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"of_{x}")) for x in "uv")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_turn(parts, _PAIRS):
            a, b = (np.frombuffer(b"".join(part.column(k).to_pylist()), np.uint8).reshape(-1, RANGES) for k in (2, 3))
            yield part.select(["u", "v"]).filter(pa.array(plausible(a, b, percent)))

    return pairs.join(one, "u").join(two, "v").select("u", "v", "of_u", "of_v").mapInArrow(batches, "u bigint, v bigint")


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar enough."""
    pairs = written_small(_likely(pairs, sketches, percent), "likely")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("name")).distinct()
    sets = _sets(docs, shingle, table_of(ends)).join(ends.withColumnRenamed("name", "node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written_small(sets, "sets")
    one, two = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("bigint")
    similar = both * (100 + percent) >= (F.size("a").cast("bigint") + F.size("b")) * percent
    found = written(pairs.join(one, "u").join(two, "v").where(similar).select("u", "v"), "similar")
    delete(sets)
    delete(pairs)
    return found


def _able(x: str, y: str, percent: int) -> str:
    """SQL: by their sizes, the places (from 0) of the shingle that is their first shared one, and their marks, x and y can be similar enough."""
    near = f"bit_count({x}.marks ^ {y}.marks) <= {MOST_MARKS if percent >= SAFE_PERCENT else 64}"
    return f"{near} AND least({x}.size - {x}.at, {y}.size - {y}.at) * {100 + percent} >= ({x}.size + {y}.size) * {percent}"


def _roots(docs: DataFrame, tags: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of all nodes that have a similar one."""
    same = Window.partitionBy("key", "salt")
    keys = _keys(docs, shingle, percent, tags.count()).select("key", "salt", F.struct("node", "size", "at", "marks").alias("x"))
    held = keys.select("*", F.min("x").over(same).alias("hub"), F.max("x.node").over(same).alias("last"))
    shared = written_small(held.where("hub.node < last OR salt >= 0").drop("last").distinct(), "shared")
    hubs = shared.where("salt >= 0").select("key", F.col("hub").alias("x")).distinct()
    tops = hubs.groupBy("key").agg(F.min("x").alias("hub"))
    nodes = shared.select(F.col("x.node").alias("node")).distinct()
    sketches = written(tags.select("node", "sketch").dropDuplicates(["node"]).join(nodes, "node", "left_semi"), "sketches")

    met = shared.select("x", "hub").unionByName(hubs.join(tops, "key").select("x", "hub"))
    first = met.where(f"x.node <> hub.node AND {_able('x', 'hub', percent)}").select(F.col("x.node").alias("u"), F.col("hub.node").alias("v"))
    first = written(first.distinct(), "first")
    links = _verified(first, sketches, docs, shingle, percent)
    roots = components(links)
    placed = shared.select("key", "x", F.col("x.node").alias("node")).join(roots, "node", "left")
    placed = placed.select("key", "x", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    apart = written(placed.join(mixed, "key", "left_semi"), "apart")
    pairs = apart.alias("l").join(apart.alias("r"), F.expr(f"l.key = r.key AND l.root <> r.root AND l.x.node > r.x.node AND {_able('l.x', 'r.x', percent)}"))
    rest = pairs.select(F.col("l.x.node").alias("u"), F.col("r.x.node").alias("v")).distinct().join(first, ["u", "v"], "left_anti")
    rest = _verified(rest, sketches, docs, shingle, percent)
    found = written(components(links.unionByName(rest)), "roots")
    for table in (shared, sketches, first, links, apart, rest):
        delete(table)
    return found


def _joined(found: DataFrame) -> DataFrame:
    """(doc_id, name, root) of found (doc_id, name, root, bits), roots whose fingerprints link made one."""
    found = written(found, "apart")
    alike = simhash.roots(written(found.select("bits").distinct(), "bits")).select(F.col("node").alias("bits"), F.col("root").alias("alike"))
    held = found.select("bits", "root").distinct().join(alike, "bits", "left").select(F.coalesce("alike", "bits").alias("alike"), "root")
    held = written(held.distinct(), "held")
    hubs = held.groupBy("alike").agg(F.min("root").alias("hub"))
    met = held.join(hubs, "alike").where("root <> hub").select(F.col("root").alias("u"), F.col("hub").alias("v"))
    tops = components(met.distinct()).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return found.join(tops, "root", "left").select("doc_id", "name", F.coalesce("top", "root").alias("root"))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, fingerprints: bool = False) -> DataFrame:
    """(doc_id, name, root) per row of docs: name stands for its doc_id with its set of shingles, root for its component over similar texts.

    With `fingerprints`, texts whose SimHash fingerprints link are similar too. A null text is empty, and empty ones are copies of each other. Repeated rows have one
    name. Columns beside doc_id and text are not read. docs must be a table.
    """
    tags = written_small(_tags(docs, shingle, fingerprints), "tags")
    roots = _roots(docs, tags, shingle, percent)
    found = tags.join(roots, "node", "left").select("doc_id", "name", F.coalesce("root", "node").alias("root"), "bits")
    return _joined(found) if fingerprints else found.drop("bits")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, fingerprints: bool = False) -> DataFrame:
    """docs without the near copies: one row of each component stays, that of the smallest doc_id; null comes last.

    All columns of docs are returned, whatever their names. Of rows that share doc_id and
    set of shingles one stays. docs must be a table.
    """
    found = written(groups(docs, shingle, percent, fingerprints), "groups")
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "name")).alias("x")).select("x.name")
    chosen = written(least, "chosen")
    often = found.groupBy("name").count().where("count > 1").select("name")
    doubtful = found.select("name").join(chosen, "name", "left_anti").unionByName(often.join(chosen, "name", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(table_of(doubtful))
    columns, own = docs.columns, "name"
    while own in columns:
        own += "_"
    kinds = docs.select("*", F.lit(0).cast("bigint").alias(own), F.lit(True).alias(f"{own}?")).schema
    for field in kinds.fields:
        field.nullable = True

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known()
        for part in _some(parts):
            texts, ids = part.column(columns.index("text")).cast(pa.binary()), part.column(columns.index("doc_id")).cast(pa.int64())
            names = _name(np.array([_node(shingles(t.as_py(), shingle, known)) for t in texts], np.int64), ids)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.view(np.int64)), pa.array(passes(shared.value, names))], [*columns, own, f"{own}?"])

    named = docs.mapInArrow(batches, kinds)
    sure, rest = named.where(~F.col(f"`{own}?`")), named.where(F.col(f"`{own}?`"))
    rest = rest.join(chosen.withColumnRenamed("name", own), own, "left_semi").dropDuplicates([own])
    return sure.select(*columns).unionByName(rest.select(*columns))
