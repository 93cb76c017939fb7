"""Language-model scores of whole documents: a gated recurrent network over corpus counts.

Counts of all words of the training documents are gathered through packed slices: each
slice sends its distinct words once and is answered with their counts. The network
learns on all training documents in parallel, averaging weights after each
round; it starts as the unigram model. It predicts frequent words and classes of endings;
within a class of endings, the counts decide.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.llm.common import kept, partitions, written
from helixtally.llm.gru import Gru
from helixtally.llm.slices import Slice, answered, bounds_of, cut, first_names

FREQUENT, ENDINGS = 1024, 64
SMOOTH = 0.1
FOLDS = 10  # a document is held out if crc32 of its id leaves no remainder
ROUNDS = 1  # of all training documents
_LOW = np.uint64(ENDINGS - 1)
_CACHED = 400_000
_FAN, _LEVELS = 32, 4  # weights are averaged so many at a time, level by level


class _Names(dict):
    """Word -> hash, with the class of its ending in the low bits."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED:
            self.clear()
        ending = xxhash.xxh3_64_intdigest(word[-3:]) % ENDINGS
        self[word] = found = xxhash.xxh3_64_intdigest(word) // ENDINGS * ENDINGS + ending
        return found


def _known() -> _Names:
    """This process's names, so that the tasks of a worker share what they remember."""
    return kept(("lm",), _Names)


END = xxhash.xxh3_64_intdigest(b"\n") // ENDINGS * ENDINGS  # no word holds a line end


def _strings(column: pa.LargeStringArray) -> list[bytes]:
    """The column's strings as bytes, faster than to_pylist()."""
    _, bounds, body = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset :][: len(column) + 1].tolist() if len(column) else [0]
    body = body.to_pybytes() if body else b""
    return [body[a:z] for a, z in zip(bounds, bounds[1:], strict=False)]


def _tokens(texts: list[bytes], known: _Names) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of the texts in a row, each text closed by END; where each text stops."""
    lowered = pc.ascii_lower(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    split = pc.ascii_split_whitespace(lowered)
    words, bounds = split.flatten().dictionary_encode(), split.offsets.to_numpy()
    kinds = _strings(words.dictionary)  # distinct words, and what stands before a text's first white space or behind its last
    place = words.indices.to_numpy()
    real = np.fromiter(map(bool, kinds), np.bool_, len(kinds))[place]
    stops = np.concatenate(([0], np.cumsum(real)))[bounds[1:] - bounds[0]] + np.arange(1, len(texts) + 1)
    every = np.empty(int(stops[-1]) if len(stops) else 0, np.uint64)
    word = np.ones(len(every), np.bool_)
    word[stops - 1] = False
    every[word] = np.fromiter(map(known.__getitem__, kinds), np.uint64, len(kinds))[place[real]]
    every[stops - 1] = END
    return every, stops


def _held_out(made: Slice) -> np.ndarray:
    return np.array([v and zlib.crc32(b"%d" % i) % FOLDS == 0 for i, v in zip(made.ids.tolist(), made.valid.tolist(), strict=True)], np.bool_)


def _distinct(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens in order, and the place of each token among them; by a hash table, since texts repeat their words."""
    place, names = pd.factorize(tokens)
    order = np.argsort(names)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return names[order], rank[place]


_COUNT = np.dtype([("name", "<u8"), ("n", "<i8")])


def _slice_counts(made: Slice, known: _Names) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of a slice, and how often its training documents hold them."""
    tokens, stops = _tokens(made.texts, known)
    trained = np.repeat(~_held_out(made), np.diff(np.concatenate(([0], stops))))
    names, place = _distinct(tokens)
    body = np.zeros(len(names), _COUNT)
    body["name"], body["n"] = names, np.bincount(place, trained, len(names)).astype(np.int64)
    return names, body


def _summed(rows: pa.Table) -> pa.Table:
    """A bucket: totals for each slice in its order of names; and a row for all, with sums per ending and the most frequent words."""
    parts = [np.frombuffer(b, _COUNT) for b in rows.column("body").to_pylist()]
    every = np.concatenate(parts)
    names, place = np.unique(every["name"], return_inverse=True)
    totals = np.zeros(len(names), np.int64)
    np.add.at(totals, place, every["n"])
    answers = [t.astype("<i8") for t in np.split(totals[place], np.cumsum([len(p) for p in parts])[:-1])]
    packed = [(a.astype("<u4") if len(a) and a.max() < 1 << 32 else a).tobytes() for a in answers]
    seen = totals > 0
    kinds = (names & _LOW).astype(np.int64)
    sums = np.bincount(kinds, totals, ENDINGS).astype(np.int64), np.bincount(kinds, seen, ENDINGS).astype(np.int64)
    best = np.argsort(-totals, kind="stable")[: FREQUENT // 4 + 16]
    best = best[seen[best]]
    bucket = rows.column("bucket")[0].as_py()
    packed.append(np.concatenate((*sums, names[best].view(np.int64), totals[best])).tobytes())
    slices = rows.column("slice").to_pylist() + [0]
    buckets = [bucket] * len(parts) + [-1 - bucket]
    return pa.table({"slice": pa.array(slices, pa.int64()), "bucket": pa.array(buckets, pa.int32()), "answer": pa.array(packed, pa.binary())})


@dataclass(frozen=True)
class Corpus:
    """Sums over the training tokens: all, distinct; the same per ending; frequent words and their counts, END first."""

    total: int
    distinct: int
    ending_total: np.ndarray
    ending_distinct: np.ndarray
    frequent: np.ndarray
    counts: np.ndarray

    def ids(self, names: np.ndarray) -> np.ndarray:
        """Input ids: a frequent word's number, or that of its ending."""
        order = np.argsort(self.frequent)
        at = np.minimum(np.searchsorted(self.frequent[order], names), len(order) - 1)
        return np.where(self.frequent[order][at] == names, order[at], FREQUENT + (names & _LOW).astype(np.int64))


def _corpus(summaries: Iterator) -> Corpus:
    totals, distinct = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    names, counts = [np.array([END], np.uint64)], [np.zeros(1, np.int64)]
    for row in summaries:
        values = np.frombuffer(row.answer, np.int64)
        totals += values[:ENDINGS]
        distinct += values[ENDINGS : 2 * ENDINGS]
        words = values[2 * ENDINGS :].reshape(2, -1)
        names.append(words[0].view(np.uint64))
        counts.append(words[1])
    names, counts = np.concatenate(names), np.concatenate(counts)
    end = counts[names == np.uint64(END)].max()
    other = np.flatnonzero(names != np.uint64(END))
    order = other[np.lexsort((names[other], -counts[other]))][: FREQUENT - 1]
    frequent = np.concatenate(([np.uint64(END)], names[order]))
    chosen = np.concatenate(([end], counts[order]))
    every, kinds = (int(totals.sum()), int(distinct.sum())), (frequent & _LOW).astype(np.int64)
    totals -= np.bincount(kinds, chosen, ENDINGS).astype(np.int64)  # endings stand for the words that aren't frequent
    distinct -= np.bincount(kinds, chosen > 0, ENDINGS).astype(np.int64)
    return Corpus(*every, totals, distinct, frequent, chosen)


def _weights(corpus: Corpus) -> Gru:
    """The untrained network: the corpus's frequencies."""
    model = Gru(FREQUENT, ENDINGS)
    words = np.concatenate((corpus.counts, np.zeros(FREQUENT - len(corpus.counts), np.int64)))
    model.start_from(np.concatenate((words, corpus.ending_total)) + SMOOTH)
    return model


def _learn(docs: DataFrame, corpus: Corpus) -> np.ndarray:
    """The network's weights after all rounds."""
    spark = docs.sparkSession
    train = docs.where(f"crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % {FOLDS} <> 0 OR doc_id IS NULL")
    values = _weights(corpus).values
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((corpus, values))

        def batches(parts: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            corpus, start = shared.value
            model, seen = Gru(FREQUENT, ENDINGS, start.copy()), 0
            learner = model.learner(0)
            for part in parts:
                texts = [t.as_py() or b"" for t in part.column(0).cast(pa.binary())]
                tokens, _ = _tokens(texts, _known())
                learner.learn(corpus.ids(tokens))
                seen += len(tokens)
            if seen:
                group = TaskContext.get().partitionId() // _FAN
                columns = [pa.array([group], pa.int32()), pa.array([seen], pa.int64()), pa.array([model.values.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "seen", "weights"])

        def mean(rows: pa.Table) -> pa.Table:
            seen = rows.column("seen").to_numpy()
            total = sum(n * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for n, w in zip(seen, rows.column("weights"), strict=True))
            body = (total / seen.sum()).astype(np.float32).tobytes()
            part = rows.column("part")[0].as_py() // _FAN
            return pa.table({"part": pa.array([part], pa.int32()), "seen": pa.array([int(seen.sum())]), "weights": pa.array([body], pa.binary())})

        learned = train.select("text").mapInArrow(batches, "part int, seen bigint, weights binary")
        for _ in range(_LEVELS):
            learned = learned.groupBy("part").applyInArrow(mean, "part int, seen bigint, weights binary")
        found = learned.collect()  # one row for every million of tasks
        if found:
            total = sum(r.seen for r in found)
            values = sum(r.seen / total * np.frombuffer(r.weights, np.float32).astype(np.float64) for r in found).astype(np.float32)
    return values


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Scores are log10 probabilities of whole texts; base_score is the smoothed unigram
    model's, score the network's. A null text is empty: its only token is the end.
    Repeated rows count as often as they occur. A row with a null doc_id isn't held out.
    docs must be a table; other columns are not read.
    """
    buckets = 4 * partitions(docs)
    sent = first_names(docs, lambda made: _slice_counts(made, _known()), buckets)
    given = written(sent.groupBy("bucket").applyInArrow(_summed, "slice bigint, bucket int, answer binary"), "counts")
    corpus = _corpus(given.where("bucket < 0").select("answer").toLocalIterator())
    shared = docs.sparkSession.sparkContext.broadcast((corpus, _learn(docs, corpus)))
    told = given.where("bucket >= 0").groupBy("slice").agg(F.collect_list(F.struct("bucket", "answer")).alias("counts"))
    asked = cut(docs).join(told, "slice", "left")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, values = shared.value
        model = Gru(FREQUENT, ENDINGS, values)
        for part in parts:
            for row in part.to_pylist():
                yield _scored(Slice.unpacked(row["body"]), row["counts"], corpus, model, _known(), buckets)

    fields = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return asked.select("slice", "body", "counts").mapInArrow(batches, fields)


def _scored(made: Slice, given: list[dict], corpus: Corpus, model: Gru, known: _Names, buckets: int) -> pa.RecordBatch:
    tokens, stops = _tokens(made.texts, known)
    names, place = _distinct(tokens)
    bounds, totals = bounds_of(names, buckets), np.zeros(len(names), np.int64)
    for row in answered(given):
        a, z = bounds[row["bucket"]], bounds[row["bucket"] + 1]
        totals[a:z] = np.frombuffer(row["answer"], "<u4" if len(row["answer"]) == 4 * (z - a) else "<i8")
    starts = np.concatenate(([0], stops[:-1]))
    base = np.log10((totals + SMOOTH) / (corpus.total + SMOOTH * (corpus.distinct + 1)))
    ids = corpus.ids(names)
    kinds = (names & _LOW).astype(np.int64)
    inside = np.log10((totals + SMOOTH) / (corpus.ending_total + SMOOTH * (corpus.ending_distinct + 1))[kinds])
    inside[ids < FREQUENT] = 0
    by_text = lambda x: np.add.reduceat(x[place], starts)
    score = model.score(ids[place], stops, 0) / np.log(10) + by_text(inside)
    n = len(stops)
    columns = [
        pa.array(made.ids, pa.int64(), mask=~made.valid),
        pa.array(_held_out(made)),
        pa.array(stops - starts, pa.int64()),
        pa.array(by_text((totals > 0).astype(np.int64)), pa.int64()),
        pa.array(np.full(n, corpus.total), pa.int64()),
        pa.array(by_text(base)),
        pa.array(score),
    ]
    names_out = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return pa.RecordBatch.from_arrays(columns, names_out)
