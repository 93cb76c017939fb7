"""Benchmark passages in training text: rare n-gram seeds join passages to test items, then Smith-Waterman alignment.

A seed is four words (fewer where an item has fewer). The seeds of all items are a table,
and so are the documents' seeds: a bit table of fixed size lets those through that an item
may have, and the two tables are joined. A seed is rare if fewer than one chance occurrence
is expected in the corpus from the frequencies of its words. One rare seed, or two seeds
near one diagonal, call for an alignment of the item with the passage around them. Only
documents with such seeds are moved, as hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtally.llm.bits import passes, table_of
from helixtally.llm.common import delete, in_turn, written, written_small
from helixtally.llm.words import WordHashes, rolling

SEED = 4
LEAST_SIMILARITY = 0.8
_PUNCTUATION = b".,;:!?\"'()[]"
_SLACK = 4
_FEW = 1 << 16  # seeds of documents, of which one passes by chance at most while the items' seeds are few
_HELD = 1 << 20  # distinct words that a task counts before it hands them on
_ROWS = 512  # texts, or pairs of text and item, whose words are held at once


def _some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_turn(parts, _ROWS)


def normal_words(text: bytes | None) -> list[bytes]:
    """Words without punctuation, A-Z lower-cased."""
    return (text or b"").lower().translate(None, _PUNCTUATION).split()


def _hashes(texts: pa.Array, known: WordHashes) -> Iterator[np.ndarray]:
    for text in texts.cast(pa.binary()):
        yield np.fromiter(map(known.__getitem__, normal_words(text.as_py())), np.uint64)


def seeds_of(words: np.ndarray, n: int) -> np.ndarray:
    """The seeds of n words that begin at each word; those of other lengths have other names."""
    return rolling(words, n)[: max(0, len(words) - n + 1)] + np.uint64(n)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words (match 1, mismatch and gap -1): score, matches, begin and end in the passage."""
    n = len(passage)
    steps = np.arange(n + 1)
    table = np.zeros((len(item) + 1, n + 1), np.int32)
    for i, word in enumerate(item, 1):
        row = np.maximum(table[i - 1] - 1, 0)
        row[1:] = np.maximum(row[1:], table[i - 1, :-1] + np.where(passage == word, 1, -1))
        table[i] = np.maximum.accumulate(row + steps) - steps
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, end, matches = int(table[i, j]), int(j), 0
    while table[i, j] > 0:
        step = 1 if item[i - 1] == passage[j - 1] else -1
        if table[i, j] == table[i - 1, j - 1] + step:
            matches += step > 0
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, int(j), end


def best_passage(item: np.ndarray, words: np.ndarray, diagonals: np.ndarray, rare: np.ndarray, least: float) -> tuple[float, int, int, int] | None:
    """(similarity, score, first word, words) of the document's best passage for an item, from where their seeds meet.

    Similarity is the share of the item's words that the alignment matches.
    """
    order = np.argsort(diagonals, kind="stable")
    diagonals, rare, length = diagonals[order].tolist(), rare[order].tolist(), len(item)
    slack, best, at = length // 4 + _SLACK, None, 0
    while at < len(diagonals):
        first = last = diagonals[at]
        any_rare, stop = rare[at], at + 1
        while stop < len(diagonals) and diagonals[stop] - last <= slack and diagonals[stop] - first <= 2 * slack:
            any_rare |= rare[stop]
            last = diagonals[stop]
            stop += 1
        if any_rare or stop - at > 1:
            begin, end = max(0, first - slack), min(len(words), last + length + slack)
            score, same, a, z = align(item, words[begin:end])
            if same >= least * length and (best is None or best[1] < score):
                best = (same / length, score, begin + a, z - a)
        at = stop
    return best


def _lists(parts: list[np.ndarray]) -> pa.Array:
    stops = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) if p.dtype == np.uint64 else p for p in parts)])
    return pa.ListArray.from_arrays(pa.array(stops), pa.array(values))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words): the distinct test items that have an id and words."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in _some(parts):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _lists(list(_hashes(part.column(2), known)))], ["item", "item_id", "words"])

    rows = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("item_id IS NOT NULL").distinct()
    named = rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    return written(named.mapInArrow(batches, "item bigint, item_id bigint, words array<bigint>").where("size(words) > 0"), "items")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(name, item, place, length, words): each item's seeds with their words."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some(parts):
            for item, words in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                own = words.values.to_numpy().view(np.uint64)
                n = min(SEED, len(own))
                names = seeds_of(own, n)
                columns = [pa.array(names.view(np.int64)), pa.array(np.full(len(names), item)), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(np.full(len(names), n, np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, _lists([own[p : p + n] for p in range(len(names))])], ["name", "item", "place", "length", "words"])

    return items.select("item", "words").mapInArrow(batches, "name bigint, item bigint, place int, length int, words array<bigint>")


def _word_counts(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(word, n): how often the corpus has the words that a bit table lets through, and all words under a null word."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, total = WordHashes(), pd.Series(dtype=np.int64), 0

        def rows() -> pa.RecordBatch:
            words = pa.array([*found.index.to_numpy(np.int64).tolist(), None], pa.int64())
            return pa.RecordBatch.from_arrays([words, pa.array(np.append(found.to_numpy(np.int64), total))], ["word", "n"])

        for part in _some(parts):
            every = np.concatenate([np.empty(0, np.uint64), *_hashes(part.column(0), known)])
            total += len(every)
            some = pd.Series(every[passes(shared.value, every)].view(np.int64)).value_counts()
            found = found.add(some, fill_value=0)
            if len(found) > _HELD:
                yield rows()
                found, total = found.iloc[:0], 0
        yield rows()

    return docs.select("text").mapInArrow(batches, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _with_rarity(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, item, place, rare): rare where the words' frequencies foretell less than one occurrence; seeds shorter than SEED always."""
    total = max(1, counts.where("word IS NULL").agg(F.sum("n")).first()[0] or 0)
    each = seeds.select("name", "item", "place", "length", F.explode("words").alias("word")).join(counts.where("word IS NOT NULL"), "word", "left")
    share = F.log(F.greatest(F.lit(1), F.coalesce("n", F.lit(0))) / F.lit(total))
    expected = each.groupBy("name", "item", "place", "length").agg(F.sum(share).alias("share"))
    rare = (F.col("share") + float(np.log(total)) < 0) | (F.col("length") < SEED)
    return expected.select("name", "item", "place", rare.alias("rare"))


def _doc_seeds(docs: DataFrame, table: np.ndarray, lengths: list[int]) -> DataFrame:
    """(row, doc_id, text_name, words, names, at) of documents that may share a seed: their words, and the seeds that a bit table lets through."""
    shared, names = docs.sparkSession.sparkContext.broadcast(table), ["row", "doc_id", "text_name", "words", "names", "at"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = WordHashes(), TaskContext.get().partitionId() << 36
        for part in _some(parts):
            chosen, words, seeds, places = [], [], [], []
            for k, own in enumerate(_hashes(part.column(2), known)):
                found, at = [], []
                for n in lengths:
                    every = seeds_of(own, n)
                    place = np.flatnonzero(passes(shared.value, every))
                    found.append(every[place])
                    at.append(place)
                if any(map(len, found)):
                    chosen.append(k)
                    words.append(own)
                    seeds.append(np.concatenate(found))
                    places.append(np.concatenate(at))
            rows = pa.array(np.arange(row, row + len(chosen)))
            row += len(chosen)
            yield pa.RecordBatch.from_arrays([rows, *(part.column(c).take(pa.array(chosen, pa.int64())) for c in (0, 1)), *map(_lists, (words, seeds, places))], names)

    chosen = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_name"), "text")
    return chosen.mapInArrow(batches, "row bigint, doc_id bigint, text_name bigint, words array<bigint>, names array<bigint>, at array<bigint>")


_FOUND = "doc_id bigint, item_id bigint, similarity double, score bigint, first_word bigint, n_words bigint, text_name bigint"


def _found(docs: DataFrame, benchmark: DataFrame, least: float) -> DataFrame:
    """The columns of contaminated(), and a name of the text."""
    items = _items(benchmark)
    seeds = written(_item_seeds(items), "seeds")
    lengths = sorted(r.length for r in seeds.select("length").distinct().collect())  # 1 to SEED
    counts = written_small(_word_counts(docs, table_of(seeds.select(F.explode("words").alias("name")))), "counts")
    judged = written(_with_rarity(seeds, counts), "judged")
    own = written_small(_doc_seeds(docs, table_of(seeds.select("name"), _FEW), lengths), "own")
    met = own.select("row", F.inline(F.arrays_zip(F.col("names").alias("name"), "at"))).join(judged, "name")
    met = met.select("row", "item", F.struct((F.col("at") - F.col("place")).alias("diagonal"), "rare").alias("hit"))
    calls = met.groupBy("row", "item").agg(F.collect_list("hit").alias("hits"), F.max("hit.rare").alias("rare"))
    calls = calls.where("rare OR size(hits) > 1").select("row", "item", "hits")
    held = calls.join(own.select("row", "doc_id", "text_name", F.col("words").alias("passage")), "row").join(items, "item")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _some(parts):
            rows = []
            for k in range(part.num_rows):
                hits = part.column(2)[k].values
                item, passage = (part.column(c)[k].values.to_numpy() for c in (3, 4))
                best = best_passage(item, passage, hits.field(0).to_numpy(), hits.field(1).to_numpy(zero_copy_only=False), least)
                if best:
                    rows.append((part.column(0)[k].as_py(), part.column(1)[k].as_py(), *best, part.column(5)[k].as_py()))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _FOUND.split(", ")])

    held = held.select("doc_id", "item_id", "hits", "words", "passage", "text_name")
    found = written_small(held.mapInArrow(batches, _FOUND), "found")
    for table in (items, seeds, counts, judged, own):
        delete(table)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, score, first_word, n_words) for each test item that a row of docs holds: its best passage.

    Rows of docs are judged one by one, repeated ones alike; null and empty texts hold
    nothing. Items with a null item_id or without words are not looked for; repeated
    items are looked for once. Other columns are not read.
    """
    return _found(docs, benchmark, least).drop("text_name")


def without_items(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """docs without the rows that hold a test item; all columns and texts stay, whatever the columns' names.

    Null and empty texts hold nothing and stay; repeated rows go or stay together. A bit
    table of the texts that go lets almost all others pass where they are; only the rest is joined.
    """
    names = written(_found(docs, benchmark, least).select(F.col("text_name").alias("name")).distinct(), "names")
    shared, own = docs.sparkSession.sparkContext.broadcast(table_of(names)), "name"
    while own in docs.columns:
        own += "_"

    @F.pandas_udf("boolean")
    def may_go(text_names: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, text_names.to_numpy(np.int64).view(np.uint64)))

    def going() -> Column:
        return may_go(F.xxhash64("text"))

    rest = docs.where(going()).withColumn(own, F.xxhash64("text")).join(names.withColumnRenamed("name", own), own, "left_anti")
    return docs.where(~going()).unionByName(rest.select(*docs.columns))
