"""Collocations by prefix-free parsing.

The tokens of every document are parsed into chunks that a window of four words triggers
by its content, so equal passages fall into equal chunks wherever they stand. A chunk
begins at a trigger and reaches four tokens beyond the next one: it holds every n-gram of
up to five words that begins before the next trigger, and each such n-gram belongs to that
chunk alone. The distinct chunks of a language with their numbers are the dictionary;
n-grams are counted inside distinct chunks, weighted by these numbers.

A phrase is frequent only if all phrases inside it are. Words and bigrams are counted by
half hashes first, then longer n-grams all of whose bigrams may be frequent. "May be" is a
bit table of fixed size over hashes of what is frequent: it lets through too much, never
too little, and decides costs only. What passes, hardly more than what is frequent, is
counted exactly, text by text. A task sums up what it counts and sends a row per bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixtally.llm.bits import passes, table_of
from helixtally.llm.common import partitions, written
from helixtally.llm.slices import bounds_of
from helixtally.llm.words import WordHashes, rolling

LONGEST = 5
LEAST = 100  # occurrences of a candidate
FIRST = 2000  # phrases reported per language
INSIDE_PERCENT = 100  # of a candidate's occurrences in a longer one that drop it
TRIGGER = LONGEST - 1  # words of the window whose hash triggers
EVERY = 128  # one window in so many triggers
_SEGMENT = 1 << 20  # bytes after which a text is cut at the end of a piece
_TOKENS = 1 << 22  # that are counted at once
_TEXTS = 1 << 18  # distinct phrases that a task sums up at once
_END = b"."  # stands for the end of a piece; no word holds it

_PLAIN = bytes(0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256)).lower()


def _segments(text: bytes) -> Iterator[list[bytes]]:
    """Tokens of a text, ends of pieces among them, some at a time; a piece is never cut."""
    text = text.translate(_PLAIN)
    at = 0
    while at < len(text):
        stop = text.find(_END, at + _SEGMENT)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].replace(_END, b" . ").split()
        at = stop + 1


def _named(tokens: list[bytes], known: WordHashes) -> np.ndarray:
    """The hash of each token, 0 for the end of a piece."""
    out = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out[out == known[_END]] = 0
    return out


def parse(tokens: list[bytes], known: WordHashes) -> Iterator[bytes]:
    """The chunks of a run of tokens: how many tokens begin n-grams here, then the tokens."""
    names = _named(tokens, known)
    windows = rolling(names, TRIGGER)[: max(0, len(names) - TRIGGER + 1)]
    starts = np.flatnonzero(windows % np.uint64(EVERY) == 0)
    starts = [0, *starts[starts > 0].tolist()]
    for a, z in zip(starts, [*starts[1:], len(tokens)], strict=True):
        yield b"%d " % (z - a) + b" ".join(tokens[a : z + TRIGGER])


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, n): the distinct chunks of each language and how often the parse holds them."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found, held = WordHashes(), Counter(), 0

        def rows() -> pa.RecordBatch:
            langs, chunks = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(chunks, pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "chunk", "n"])

        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()), strict=True):
                for tokens in _segments(text.as_py() or b""):
                    found.update((lang, chunk) for chunk in parse(tokens, known) if tokens)
                    held += len(tokens)
                if held > _TOKENS:
                    yield rows()
                    found.clear()
                    held = 0
        yield rows()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")), "text")
    parsed = texts.mapInArrow(batches, "lang string, chunk binary, n bigint")
    return parsed.groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


class _Batch:
    """Chunks in a row: token hashes, which tokens begin n-grams, and how often; chunks end like pieces."""

    def __init__(self, part: pa.RecordBatch, known: WordHashes) -> None:
        heads, bodies = zip(*(c.split(b" ", 1) for c in part.column(1).to_pylist()), strict=True)
        self.langs = part.column(0).to_pylist()
        kinds = {x: np.uint64(xxhash.xxh64_intdigest(x)) for x in set(self.langs)}
        sizes = np.array([b.count(b" ") + 2 for b in bodies])
        self.tokens = b" ".join(x for b in bodies for x in (b, _END)).split(b" ")
        self.names = _named(self.tokens, known)
        starts = np.cumsum(sizes) - sizes
        self.chunk = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(self.tokens)) - starts[self.chunk]
        self.own = place < np.array(heads, np.int64)[self.chunk]
        self.times = part.column(2).to_numpy()[self.chunk]
        self.kind = np.array([kinds[x] for x in self.langs], np.uint64)[self.chunk]
        self.whole = {1: self.names != 0}  # the n tokens from here on are words

    def grams(self, n: int) -> np.ndarray:
        """The hash of the n-gram from each position on, by language."""
        return rolling(self.names, n) + self.kind * np.uint64(2 * n + 1)

    def words(self, n: int) -> np.ndarray:
        """Whether an n-gram of words begins at each position."""
        if n not in self.whole:
            self.whole[n] = self.words(n - 1) & np.append(self.whole[1][n - 1 :], np.zeros(n - 1, np.bool_))
        return self.whole[n]

    def text(self, at: int, n: int) -> bytes:
        return b" ".join(self.tokens[at : at + n])


def _weighted(names: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, where one of each stands, and the sum of its times."""
    order = np.argsort(names)
    names = names[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(names)), np.bool_), names[1:] != names[:-1])))
    sums = np.add.reduceat(times[order], first) if len(first) else times[:0]
    return names[first], order[first], sums


def _batches(parts: Iterator[pa.RecordBatch], known: WordHashes) -> Iterator[_Batch]:
    for part in parts:
        if part.num_rows:
            yield _Batch(part, known)


def _alive(made: _Batch, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For 3 words and more: which n-grams here have only bigrams that the table lets pass."""
    pairs = passes(inside, made.grams(2))
    alive = pairs
    for n in range(3, LONGEST + 1):
        alive = alive & np.append(pairs[n - 2 :], np.zeros(n - 2, np.bool_))
        yield n, made.words(n) & made.own & alive


def _table(chunks: DataFrame, inside: np.ndarray | None, least: int) -> np.ndarray:
    """The bit table of n-grams that occur `least` times or more: of words and bigrams, or of longer ones by the bigrams `inside` lets pass.

    Half of a hash names an n-gram here: those that share a name only let each other through.
    """
    shared = chunks.sparkSession.sparkContext.broadcast(inside)
    buckets = 4 * partitions(chunks)
    small = np.min_scalar_type(least)  # a sum beyond `least` says no more than `least`

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names, times, held = WordHashes(), [], [], 0

        def rows() -> pa.RecordBatch:
            found, _, sums = _weighted(np.concatenate(names), np.concatenate(times))
            sums, bounds = np.minimum(sums, least).astype(small), bounds_of(found.astype(np.uint64) << np.uint64(32), buckets)
            full = np.flatnonzero(np.diff(bounds))
            bodies = [found[bounds[b] : bounds[b + 1]].tobytes() + sums[bounds[b] : bounds[b + 1]].tobytes() for b in full]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "body"])

        for made in _batches(parts, known):
            good = ((n, made.words(n) & made.own) for n in (1, 2)) if shared.value is None else _alive(made, shared.value)
            for n, at in good:
                names.append(made.grams(n)[at].astype(np.uint32))
                times.append(made.times[at])
                held += len(names[-1])
            if held > _TOKENS:
                yield rows()
                names, times, held = [], [], 0
        if held:
            yield rows()

    def summed(rows: pa.Table) -> pa.Table:
        bodies = [(b, len(b) // (4 + small.itemsize)) for b in rows.column("body").to_pylist()]
        names = np.concatenate([np.frombuffer(b, np.uint32, n) for b, n in bodies])
        found, _, sums = _weighted(names, np.concatenate([np.frombuffer(b, small, n, 4 * n) for b, n in bodies]).astype(np.int64))
        return pa.table({"name": pa.array(found[sums >= least].astype(np.int64))})

    sent = chunks.mapInArrow(named, "bucket int, body binary")
    return table_of(sent.groupBy("bucket").applyInArrow(summed, "name bigint"))


def frequent(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): phrases of 1 to LONGEST words that occur `least` times or more, and a row of 0 words with the number of all words."""
    chunks = written(dictionary(docs), "chunks")
    short = _table(chunks, None, least)
    shared = chunks.sparkSession.sparkContext.broadcast((short, _table(chunks, short, least)))
    buckets = 4 * partitions(chunks)

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = WordHashes(), Counter()

        def rows() -> pa.RecordBatch:
            keys, counts = np.array(list(found), object), np.fromiter(found.values(), np.int64, len(found))
            bucket = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)) % np.uint64(buckets)
            order = np.argsort(bucket)
            stops = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)).astype(np.int32)
            full = np.flatnonzero(np.diff(stops))
            offsets = pa.array(np.append(stops[full], stops[-1]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(keys[order], pa.string()), pa.array(counts[order]))]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *lists], ["bucket", "keys", "counts"])

        def add(keys: list[str], sums: np.ndarray) -> None:
            for key, n in zip(keys, sums.tolist(), strict=True):
                found[key] += n

        for made in _batches(parts, known):
            every = np.flatnonzero(made.words(1) & made.own)
            _, place, sums = _weighted(made.kind[every], made.times[every])
            add([f"\n{made.langs[made.chunk[i]]}" for i in every[place]], sums)
            short, long = shared.value
            good = [(n, made.words(n) & made.own & passes(short, made.grams(n))) for n in (1, 2)]
            for n, at in (*good, *((n, at & passes(long, made.grams(n))) for n, at in _alive(made, short))):
                at = np.flatnonzero(at)
                _, place, sums = _weighted(made.grams(n)[at], made.times[at])
                add([f"{made.text(i, n).decode()}\n{made.langs[made.chunk[i]]}" for i in at[place].tolist()], sums)
            if len(found) > _TEXTS:
                yield rows()
                found.clear()
        if found:
            yield rows()

    def summed(rows: pa.Table) -> pa.Table:
        every = pa.table({"key": pc.list_flatten(rows.column("keys")), "n": pc.list_flatten(rows.column("counts"))})
        sums = every.group_by("key").aggregate([("n", "sum")]).select(["key", "n_sum"]).rename_columns(["key", "n"])
        return sums.filter(pc.or_(pc.greater_equal(sums.column("n"), least), pc.starts_with(sums.column("key"), "\n")))

    # one text per phrase: the phrase, which holds no line end, and its language
    sent = chunks.mapInArrow(counted, "bucket int, keys array<string>, counts array<bigint>")
    sums = sent.groupBy("bucket").applyInArrow(summed, "key string, n bigint")
    place = F.expr("instr(key, '\\n')")
    phrase, lang = F.expr("left(key, instr(key, '\\n') - 1)"), F.substr("key", place + 1)
    words = F.when(phrase == "", 0).otherwise(F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1)
    return sums.select(lang.alias("lang"), phrase.alias("phrase"), words.cast("int").alias("words"), "n")


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("w", F.lit(first) if isinstance(first, int) else first, F.lit(size) if isinstance(size, int) else size), " ")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of highest score.

    A null text has no words, a null lang is `und`, and repeated rows count as often as
    they occur. Equal scores stand by a, then by phrase. Scores are exact integers.
    doc_id and other columns are not read; a table without rows gives none.
    """
    table = written(frequent(docs, least), "frequent")
    whole = written(table.where("words = 0").select("lang", F.col("n").alias("all_words")), "totals")  # small, so Spark broadcasts it by its size
    counts = table.where("words > 0").select("lang", "phrase", "n")
    some = table.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("one", _part(1, F.col("k"))).withColumn("two", _part(F.col("k") + 1, F.col("words") - F.col("k")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("one"), F.col("n").alias("l")), ["lang", "one"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("two"), F.col("n").alias("r")), ["lang", "two"])
    cuts = cuts.join(whole, "lang")
    big = lambda name: f"CAST({name} AS DECIMAL(18,0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4,0)) * {big('a')} * CAST(all_words AS DECIMAL(15,0))) div ({big('l')} * {big('r')})")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a", F.col("all_words").alias("n")).agg(least_cut)

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: _part(i, m))))
    parts = some.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    longest = parts.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < F.lit(inside_percent) * F.col("a")))

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
