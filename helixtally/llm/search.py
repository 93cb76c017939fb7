"""Ranked lexical search with per-term geometric blocking.

Documents are cut into slices, each an inverted index of its own. A posting list is
clustered by the similarity of its documents into blocks, and a block keeps the
coordinatewise maximum of its documents' term impacts. The summary's product with a
query's weights is an upper bound of every score in the block, so a block is skipped
only if that bound is below a score that fifty documents are known to reach. A list is
left out as a whole by the same rule: while the bounds of a query's most common terms
add up to less than that score, no document is found by them alone.

The first such scores come from a sample of the slices. They, and the blocks, decide
costs and never results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixtally.llm.common import delete, written

TOP = 50
VOCABULARY, ITEMS = 1 << 18, 1 << 14  # distinct query terms and items that tasks hold; more are searched in blocks
CELLS = 1 << 23  # of a slice's table of impacts
ROWS = 4096  # documents of a slice at most
BLOCK = 32  # documents of a block, about
SHARE = 16  # one slice in so many gives the first scores to beat
_SKETCH = 16
_TURN = 8  # blocks whose documents are scored at once

#: Term characters are ASCII letters and digits and everything beyond ASCII; A-Z are lower-cased.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


class _Numbers(dict):
    """Term -> number, -1 for a term that no query has."""

    def __missing__(self, term: bytes) -> int:
        return -1


def terms(text: bytes | str | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TERM_BYTES).split()


FORWARD = "slice bigint, ids array<bigint>, n array<bigint>, stops array<bigint>, terms array<int>, tfs array<int>"


def forward(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """Slices of documents with the query terms they hold (FORWARD): per document its id, its terms with repeats, where its entries end."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)
    most = int(np.clip(CELLS // max(1, len(numbers)), 32, ROWS))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = _Numbers(shared.value), TaskContext.get().partitionId() << 32
        for part in parts:
            for at in range(0, part.num_rows, most):
                some = part.slice(at, most)
                found, sizes, rows = [], [], []
                for row, text in enumerate(some.column(1).cast(pa.binary())):
                    words = terms(text.as_py())
                    sizes.append(len(words))
                    own = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                    own, tf = np.unique(own[own >= 0], return_counts=True)
                    found.append((own, tf))
                    rows.append(len(own))
                own, tf = (np.concatenate([f[k] for f in found]).astype(np.int32) for k in (0, 1))
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x))
                arrays = [some.column(0), np.array(sizes, np.int64), np.cumsum(rows).astype(np.int64), own, tf]
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), *map(one, arrays)], [f.split()[0] for f in FORWARD.split(", ")])
                place += 1

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(batches, FORWARD)


@dataclass(frozen=True)
class Corpus:
    """N documents with a term, L terms with repeats, the weight of each query term."""

    documents: int
    length: int
    weights: np.ndarray


def corpus(slices: DataFrame, size: int) -> Corpus:
    """Statistics over all slices; `size` query terms."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, length = np.zeros(size, np.int64), 0, 0
        for part in parts:
            held += np.bincount(part.column(1).flatten().to_numpy(), minlength=size)
            n = part.column(0).flatten().to_numpy()
            documents, length = documents + int((n > 0).sum()), length + int(n.sum())
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"term": np.concatenate(([-2, -1], at)), "n": np.concatenate(([documents, length], held[at]))})

    found = slices.select("n", "terms").mapInArrow(batches, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    sums = {r.term: r.n for r in found}
    total = sums.get(-2, 0)
    held = np.array([sums.get(t, 0) for t in range(size)], np.float64)
    return Corpus(total, sums.get(-1, 0), np.floor(1000 * np.log((2 * total + 2) / (2 * held + 1))).astype(np.int64))


class Slice:
    """The inverted index of one slice: impacts, posting lists in blocks, summaries."""

    def __init__(self, row: dict[str, pa.Array], stats: Corpus) -> None:
        self.missing = row["ids"].is_null().to_numpy(False)
        self.ids = row["ids"].fill_null(0).to_numpy()
        n, stops, term, tf = (row[c].to_numpy().astype(np.int64) for c in ("n", "stops", "terms", "tfs"))
        size = 50 + 50 * n * stats.documents // max(1, stats.length)
        doc = np.repeat(np.arange(len(n)), np.diff(np.concatenate(([0], stops))))
        impact = 1_000_000_000 * tf // (1000 * tf + 20 * size[doc])
        self.weights = stats.weights
        self.impacts = np.zeros((len(n), len(stats.weights)), np.int32)
        self.impacts[doc, term] = impact
        order = np.argsort(term, kind="stable")
        self.lists, self.bounds = doc[order], np.searchsorted(term[order], np.arange(len(stats.weights) + 1))
        self.most = self.impacts.max(0, initial=0).astype(np.int64)
        signs = np.random.default_rng(5).choice(np.array([-1, 1], np.float32), (len(stats.weights), _SKETCH))
        sketch = np.zeros((len(n), _SKETCH), np.float32)
        np.add.at(sketch, doc, signs[term] * np.sqrt(impact * stats.weights[term]).astype(np.float32)[:, None])
        self.sketch = sketch / np.maximum(np.sqrt((sketch**2).sum(1, keepdims=True)), 1e-6)
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def scores(self, docs: np.ndarray, query: np.ndarray) -> np.ndarray:
        return self.impacts[docs[:, None], query].astype(np.int64) @ self.weights[query]

    def clustered(self, term: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A posting list: its documents cluster by cluster, where blocks begin and end, each block's largest impacts in `columns`."""
        if term not in self.blocks:
            docs = self.lists[self.bounds[term] : self.bounds[term + 1]]
            centres = self.sketch[docs[:: BLOCK]]
            nearest = np.argmax(self.sketch[docs] @ centres.T, 1)
            docs = docs[np.argsort(nearest, kind="stable")]
            edge = np.flatnonzero(np.diff(np.sort(nearest), prepend=-1))
            starts = np.concatenate([np.arange(a, z, 2 * BLOCK) for a, z in zip(edge, [*edge[1:], len(docs)], strict=True)])
            summary = np.maximum.reduceat(self.impacts[docs[:, None], columns], starts, 0).astype(np.int64)
            self.blocks[term] = docs, starts, np.append(starts[1:], len(docs)), summary
        return self.blocks[term]

    def best(self, docs: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[docs], self.missing[docs], -scores))[:top]
        order = order[scores[order] > 0]
        return docs[order], scores[order]

    def essential(self, query: np.ndarray, floor: int) -> np.ndarray:
        """The query's terms that this slice holds, rarest first, without the common ones that can't reach the floor together."""
        held = query[self.bounds[query + 1] > self.bounds[query]]
        common = held[np.lexsort((held, self.weights[held]))]
        reach = np.cumsum(self.weights[common] * self.most[common])
        return common[np.searchsorted(reach, floor) :][::-1]

    def search(self, query: np.ndarray, floor: int, columns: dict[int, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """The slice's best documents of a query and their scores; those below `floor` may be missing."""
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        seen = np.zeros(len(self.ids), np.bool_)
        for term in self.essential(query, floor).tolist():
            members, starts, stops, summary = self.clustered(term, columns[term])
            bound = summary[:, np.searchsorted(columns[term], query)] @ self.weights[query]
            order = np.argsort(-bound, kind="stable")
            for at in range(0, len(order), _TURN):
                if bound[order[at]] < floor:
                    break
                some = np.concatenate([members[starts[b] : stops[b]] for b in order[at : at + _TURN].tolist() if bound[b] >= floor])
                some = some[~seen[some]]
                seen[some] = True
                docs, scores = self.best(np.concatenate((docs, some)), np.concatenate((scores, self.scores(some, query))), top)
                if len(scores) == top:
                    floor = max(floor, int(scores[-1]))
        return docs, scores


_FOUND = "item int, doc_id bigint, score bigint"


def _searched(slices: DataFrame, queries: list[np.ndarray], stats: Corpus, floors: np.ndarray, top: int, whole: bool) -> DataFrame:
    """(item, doc_id, score): each slice's best documents; `whole` scores all of a slice instead of its blocks."""
    columns: dict[int, list] = {}
    for query in queries:
        for term in query.tolist():
            columns.setdefault(term, []).append(query)
    shared = slices.sparkSession.sparkContext.broadcast((queries, stats, floors, {t: np.unique(np.concatenate(q)) for t, q in columns.items()}))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, stats, floors, columns = shared.value
        for part in parts:
            for at in range(part.num_rows):
                made = Slice({c: part.column(c)[at].values for c in part.schema.names[1:]}, stats)
                for item, query in enumerate(queries):
                    if whole:
                        every = np.arange(len(made.ids))
                        docs, scores = made.best(every, made.scores(every, query), top)
                    else:
                        docs, scores = made.search(query, int(floors[item]), columns, top)
                        docs, scores = docs[scores >= floors[item]], scores[scores >= floors[item]]
                    if len(docs):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item, np.int32)), pa.array(made.ids[docs], pa.int64(), mask=made.missing[docs]), pa.array(scores)], ["item", "doc_id", "score"])

    return slices.mapInArrow(batches, _FOUND)


def _first(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[np.ndarray], dict[bytes, int]]]:
    """Item ids, their terms as numbers, and those numbers, for as many items as share a vocabulary of bounded size."""
    ids, queries, numbers = [], [], {}
    for row in items.select("item_id", "text").toLocalIterator():
        own = sorted(set(terms(row.text)))
        if ids and (len(numbers) + len(own) > VOCABULARY or len(ids) == ITEMS):
            yield ids, queries, numbers
            ids, queries, numbers = [], [], {}
        if not own:
            continue
        ids.append(row.item_id)
        queries.append(np.array(sorted(numbers.setdefault(t, len(numbers)) for t in own), np.int64))
    if ids:
        yield ids, queries, numbers


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the documents of highest score above 0 for each row of items (item_id, text).

    A document or item that is null or holds no term is found by nothing and finds
    nothing. Equal scores stand by ascending doc_id, a null one last. Repeated rows of
    docs are documents of their own, repeated rows of items are answered each. Other
    columns are not read; tables without rows give no rows.
    """
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for ids, queries, numbers in _blocks(items):
        slices = written(forward(docs, numbers), "forward")
        stats = corpus(slices, len(numbers))
        sample = slices.where(F.pmod(F.xxhash64("slice"), F.lit(SHARE)) == 0)
        floors = np.ones(len(ids), np.int64)
        best = _first(_searched(sample, queries, stats, floors, top, True), top)
        for row in best.where(F.col("rank") == top).select("item", "score").collect():
            floors[row.item] = row.score
        named = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        found = _first(_searched(slices, queries, stats, floors, top, False), top).join(F.broadcast(named), "item")
        found = written(found.select("item_id", "rank", "doc_id", "score"), "ranked")
        delete(slices)
        out = out.unionByName(found)
    return out
