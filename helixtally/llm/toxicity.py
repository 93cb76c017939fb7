"""Toxicity by weak supervision: many voters, a label model over them, a linear classifier on its posteriors.

Words and word beginnings that labelled toxic rows hold far more often than others
make the lexicon; its parts and some patterns of writing are voters, and so is the
annotator. The label model estimates each voter's accuracy for both classes, and from
the voters' correlations within a class how much each counts beside those it agrees
with. A logistic classifier then learns the posterior labels from lexicon counts and
scores every text by itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 20_000  # labelled rows that the model is fitted on, at most; by hash of doc_id
LEXICON = 512
LEAST_ROWS, LEAST_RATIO = 3, 8.0  # toxic rows that hold an entry; how much more often than other rows
BEGINNINGS = range(4, 11)  # bytes
PREDICTED_FROM = 0.3
ROUNDS, STEPS, RIDGE = 25, 300, 1e-3
ANNOTATOR_ERROR = 0.01  # share of labels taken to be wrong, either way
_FLUSH = 400_000
_SPACED = b".,;:!?\"'()[]{}*#$%&|<>_-/\\"
_TABLE = bytes.maketrans(_SPACED, b" " * len(_SPACED))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def _words(text: str) -> list[bytes]:
    return text.lower().encode().translate(_TABLE).split()


def _entries(word: bytes) -> list[bytes]:
    """A word and its beginnings, as lexicon entries."""
    return [b"=" + word, *(b"^" + word[:k] for k in BEGINNINGS if len(word) > k)]


def _lexicon(train: DataFrame) -> tuple[list[bytes], int, int]:
    """The entries, and how many toxic and other rows there are."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]

        def rows() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(names, pa.binary()), *(pa.array([c[n] for n in names], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["entry", "other", "toxic"])

        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                counts[toxic].update({e for w in set(_words(text or "")) for e in _entries(w)} | {b""})
                if len(counts[0]) > _FLUSH:
                    yield rows()
        yield rows()

    found = train.select("text", "toxic").mapInArrow(batches, "entry binary, other bigint, toxic bigint")
    found = found.groupBy("entry").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).where(f"toxic >= {LEAST_ROWS} OR entry = X''")
    every = found.where("entry = X''").first()
    other, toxic = (every.other, every.toxic) if every else (0, 0)
    if not toxic:
        return [], other, toxic
    ratio = (F.col("toxic") / F.lit(float(toxic))) / ((F.col("other") + 1) / F.lit(float(max(1, other))))
    gain = F.col("toxic") - F.col("other") * F.lit(toxic / max(1, other))
    best = found.where(F.length("entry") > 0).where(ratio > LEAST_RATIO).orderBy(gain.desc(), "entry").limit(LEXICON)
    return [bytes(r.entry) for r in best.select("entry").collect()], other, toxic


class _Hits(dict):
    """Word -> the numbers of the lexicon entries it matches."""

    def __init__(self, lexicon: list[bytes]) -> None:
        self.numbers = {e: i for i, e in enumerate(lexicon)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= _FLUSH:
            self.clear()
        get = self.numbers.get
        self[word] = found = tuple(i for e in _entries(word) if (i := get(e)) is not None)
        return found


def _counts(text: str, hits: _Hits, size: int) -> np.ndarray:
    """Per entry its count; then words hit, words, capitals and exclamation marks per 100 characters."""
    out = np.zeros(size + 4, np.float32)
    words = _words(text)
    for found in map(hits.__getitem__, words):
        if found:
            out[list(found)] += 1
            out[size] += 1
    out[size + 1] = len(words)
    if text:
        raw = np.frombuffer(text.encode(), np.uint8)
        out[size + 2] = 100 * np.count_nonzero((raw >= 65) & (raw <= 90)) / len(raw)
        out[size + 3] = 100 * np.count_nonzero(raw == 33) / len(raw)
    return out


def _inputs(counts: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: log counts, log words hit, share of words hit."""
    lexicon, hit, words = counts[:, :-4], counts[:, -4:-3], counts[:, -3:-2]
    return np.hstack((np.log1p(lexicon), np.log1p(hit), 100 * hit / (1 + words))).astype(np.float32)


def _votes(counts: np.ndarray, lexicon: list[bytes]) -> np.ndarray:
    """One column per voter, 1 for toxic: lexicon parts by kind and length, and patterns."""
    kinds: dict[tuple, list[int]] = {}
    for i, entry in enumerate(lexicon):
        kinds.setdefault((entry[:1], i % 4 if entry[:1] == b"=" else len(entry) - 1), []).append(i)
    columns = [counts[:, members].max(1) > 0 for members in kinds.values()]
    hit, words, capitals, shouts = counts[:, -4:].T
    columns += [hit >= 1, hit >= 3, hit > 0.01 * words, hit > 0.03 * words, capitals > 50, shouts > 2, words < 20]
    return np.stack(columns, 1).astype(np.float64)


def posteriors(votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(toxic) per row by the label model; the annotator's labels are one voter more, and start the estimate."""
    every, given = votes, labels.astype(np.float64)
    toxic = np.clip(given, ANNOTATOR_ERROR, 1 - ANNOTATOR_ERROR)
    said = (2 * given - 1) * np.log((1 - ANNOTATOR_ERROR) / ANNOTATOR_ERROR)
    for _ in range(ROUNDS):
        prior = (toxic.sum() + 1) / (len(toxic) + 2)
        rates = [((w[:, None] * every).sum(0) + 1) / (w.sum() + 2) for w in (1 - toxic, toxic)]
        # correlations within a class: a voter that agrees with n others by more than the class explains counts for less
        rest = [(every - r) * np.sqrt(w)[:, None] for r, w in zip(rates, (1 - toxic, toxic), strict=True)]
        both = sum(x.T @ x for x in rest)
        spread = np.sqrt(np.maximum(np.diag(both), 1e-9))
        related = np.maximum(both / np.outer(spread, spread), 0)
        weight = 1 / np.maximum(related.sum(1), 1)
        odds = np.log(prior / (1 - prior)) + said
        yes = np.log(rates[1] / rates[0]) * weight
        no = np.log((1 - rates[1]) / (1 - rates[0])) * weight
        toxic = 1 / (1 + np.exp(-np.clip(odds + every @ yes + (1 - every) @ no, -30, 30)))
    return toxic


@dataclass(frozen=True)
class Model:
    lexicon: list[bytes]
    weights: np.ndarray
    bias: float

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(counts).astype(np.float64) @ self.weights + self.bias, -30, 30)))


def _logistic(inputs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps on soft labels."""
    rows = np.hstack((inputs.astype(np.float64), np.ones((len(inputs), 1))))
    weights = np.zeros(rows.shape[1])
    ahead, before = weights, weights
    step = 4 * len(rows) / max(1e-9, float(np.linalg.norm(rows.T @ rows, 2)))
    for k in range(STEPS):
        error = 1 / (1 + np.exp(-np.clip(rows @ ahead, -30, 30))) - labels
        before, weights = weights, ahead - step * (rows.T @ error / len(rows) + RIDGE * np.append(ahead[:-1], 0))
        ahead = weights + k / (k + 3) * (weights - before)
    return weights[:-1], float(weights[-1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fitted on at most `rows` labelled rows that aren't held out; the smallest hashes of doc_id are taken."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # bounded by `rows`
    lexicon, other, toxic = _lexicon(train)
    if not toxic:
        return Model([], np.zeros(2), -30.0 if not other else -float(np.log(2 * other + 1)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(lexicon)
        for part in parts:
            packed = [_counts(t or "", hits, len(lexicon)) for t in part.column(0).to_pylist()]
            places = [np.flatnonzero(c) for c in packed]
            columns = [part.column(1), pa.array(places, pa.list_(pa.int32())), pa.array([c[p] for c, p in zip(packed, places, strict=True)], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["toxic", "places", "counts"])

    seen = train.select("text", F.col("toxic").cast("int")).mapInArrow(batches, "toxic int, places array<int>, counts array<float>").collect()
    seen.sort()
    counts = np.zeros((len(seen), len(lexicon) + 4), np.float32)
    for row, into in zip(seen, counts, strict=True):
        into[row.places] = row.counts
    soft = posteriors(_votes(counts, lexicon), np.array([r.toxic for r in seen]))
    return Model(lexicon, *_logistic(_inputs(counts), soft))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of docs.

    Null texts are empty, and empty texts get the score of no words. Rows are scored
    one by one, repeated ones alike; a null doc_id is not held out. Only the text is
    an input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(shared.value.lexicon)
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                counts = np.stack([_counts(t or "", hits, len(shared.value.lexicon)) for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(shared.value.scores(counts))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(batches, "doc_id bigint, score double")
    return rows.select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= PREDICTED_FROM).cast("int").alias("predicted"),
    )
