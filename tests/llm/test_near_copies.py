"""Near copies of the pipeline against brute force over all pairs."""

import tracemalloc
from unittest.mock import MagicMock

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from helixtally.llm import common, decontaminate, near_copies, simhash

FOLDER = "/root/testdata/sf0.001"


def five_words(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    """Number of each row's component; rows: texts."""
    sets, root = [five_words(t) for t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or 9 * both >= 4 * (len(sets[a]) + len(sets[b])) > 0:
                root[top(a)] = top(b)
    return [top(i) for i in range(len(rows))]


def edited(k, at):
    return " ".join(f"w{i}" if i not in at else f"edit{k}x{i}" for i in range(100))


def awkward():
    """A chain whose ends are less alike, copies at the limit, a group with a shared passage, short and empty texts, one doc_id twice."""
    texts = [edited(0, ()), edited(1, (10,)), edited(2, (10, 50)), edited(2, (10, 50, 90)), edited(3, (20, 60)), edited(4, (20, 60, 95))]
    texts += ["a b c", "A  b c", "a b d", "", None, " \n", "one two three four five six", "one two three four five six seven"]
    texts += [" ".join(f"h{i}" for i in range(30)) + f" t{k}" * (k % 3) + " " + " ".join(f"k{k}n{i}" for i in range(6 * k)) for k in range(9)]
    return [(i if i % 5 else None, t) for i, t in enumerate(texts, 1)] + [(1, "another text of the same number"), (2, edited(0, ()))]


def test_groups_match_brute_force(spark, monkeypatch, tmp_path):
    con = duckdb.connect()
    table = con.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()
    for rows, sample, ranges in ((table, 2000, 48), (awkward(), 2000, 48), (awkward(), 3, 129)):
        monkeypatch.setattr(near_copies, "SAMPLE", sample)
        monkeypatch.setattr(near_copies, "FEW_RANGES", ranges)
        path = str(tmp_path / f"{len(rows)}-{sample}.parquet")
        kinds = "k int, doc_id bigint, text string, name string, node int, root string, sketch string"
        spark.createDataFrame([(k, i, t, "n", 1, "r", "s") for k, (i, t) in enumerate(rows)], kinds).repartition(3).write.parquet(path)
        docs = spark.read.parquet(path)
        names = near_copies._tags(docs, 5).select("doc_id", "name").collect()
        assert len(names) == len(rows)
        found = {(r.doc_id, r.name): r.root for r in near_copies.groups(docs).collect()}
        known = near_copies._Names()
        node = [near_copies._node(near_copies.shingles((t or "").encode(), 5, known)) for _, t in rows]
        name = near_copies._name(near_copies.np.array(node), near_copies.pa.array([i for i, _ in rows], near_copies.pa.int64())).view("int64").tolist()
        got = [found[i, n] for (i, _), n in zip(rows, name, strict=True)]
        want = components_of([t for _, t in rows])
        assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))
        kept_rows = near_copies.one_of_each_group(docs)
        assert kept_rows.dtypes == docs.dtypes
        kept = [r.k for r in kept_rows.collect()]
        assert sorted(want[k] for k in kept) == sorted(set(want))  # one row of each component
        for k in kept:
            least = min((i is None, i or 0) for (i, _), w in zip(rows, want, strict=True) if w == want[k])
            assert (rows[k][0] is None, rows[k][0] or 0) == least


def test_sketches_let_no_similar_pair_go():
    rnd = near_copies.np.random.default_rng(3)
    for size in (20, 60, 300, 3000):
        for _ in range(200):
            every = rnd.integers(-(1 << 63), (1 << 63) - 1, size, dtype="int64")
            only = size // 10  # of each: a similarity of 0.8
            one, two = (near_copies.np.unique(x) for x in (every[only:], every[: size - only]))
            pair = (near_copies.np.frombuffer(near_copies.sketch(x), "uint8")[None] for x in (one, two))
            assert near_copies.plausible(*pair, 80)[0]
            assert ((near_copies.marks(one) ^ near_copies.marks(two)) & (1 << 64) - 1).bit_count() <= near_copies.MOST_MARKS
    other = near_copies.np.frombuffer(near_copies.sketch(near_copies.np.unique(rnd.integers(-(1 << 63), (1 << 63) - 1, 3000, dtype="int64"))), "uint8")[None]
    assert not near_copies.plausible(other, near_copies.np.frombuffer(near_copies.sketch(one), "uint8")[None], 80)[0]


def test_stage_links_copies_at_many_bits(spark, tmp_path):
    """(6, 145) are 7 bits apart at a similarity of 0.83, (1, 177) 11 bits at 0.83."""
    spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id IN (1, 177, 6, 145)").write.parquet(str(tmp_path / "four"))
    docs = spark.read.parquet(str(tmp_path / "four"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()) == [1, 6]


def test_stage_links_by_simhash(spark, tmp_path):
    """1 and 2 share nothing but a passage said often, so their fingerprints link; 3 is like 2 only by similarity; 4 stands alone."""
    often = "one two three four five six seven " * 60
    own = [" ".join(f"{x}{i}" for i in range(14)) for x in "ab"]
    other = " ".join(f"w{i}" for i in range(40))
    rows = [(1, often + own[0]), (2, often + own[1]), (3, "one two three four five six seven " * 2 + own[1]), (4, other), (5, other)]
    bits = [simhash.fingerprint(t.encode()) for _, t in rows]
    assert (bits[0] ^ bits[1]).bit_count() <= 2 < min((bits[2] ^ b).bit_count() for b in bits[:2])
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "rows"))
    docs = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()) == [1, 4]
    assert sorted(r.doc_id for r in near_copies.one_of_each_group(docs).collect()) == [1, 2, 4]  # by similarity alone


def test_unused_memory_goes_back_behind_each_batch(monkeypatch):
    """Round 3, pipeline: the slices hold all rows in order, and the pool is asked behind each batch and at the end."""
    asked, pool = [], pa.default_memory_pool()
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: asked.append(1) or pool)
    batches = [pa.RecordBatch.from_pydict({"x": list(range(n))}) for n in (10, 0, 3)]
    got = [part.column(0).to_pylist() for part in common.in_turn(iter(batches), 4)]
    assert got == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [0, 1, 2]]
    assert len(asked) == 4
    assert list(common.in_turn(iter([]), 4)) == []


def test_tasks_of_decontamination_hold_the_words_of_few_texts(spark, monkeypatch):
    """F1 of round 3, pipeline: what a task holds doesn't grow with a batch's texts, nor with its distinct words."""
    monkeypatch.setattr(decontaminate, "TaskContext", MagicMock(**{"get.return_value.partitionId.return_value": 0}))
    table = np.zeros(1 << 10, np.uint8)
    table[::64] = 1
    texts = pa.array([" ".join(f"w{i}x{k}" for k in range(100)) for i in range(4000)])
    ids = pa.array(range(4000), pa.int64())

    def run(step, columns, *more):
        """Rows that the step's tasks return, and MB held at most."""
        docs = MagicMock()
        docs.sparkSession.sparkContext.broadcast.return_value.value = table
        step(docs, table, *more)
        batches = docs.select.return_value.mapInArrow.call_args[0][0]
        tracemalloc.start()
        rows = [r for b in batches(iter([pa.RecordBatch.from_arrays(columns, [f"c{k}" for k in range(len(columns))])])) for r in b.to_pylist()]
        most = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return rows, most

    counted, most = run(decontaminate._word_counts, [texts])
    assert counted[-1] == {"word": None, "n": 400_000} and most < 16
    table[:] = 0
    table[::1024] = 1
    found, most = run(decontaminate._doc_seeds, [ids, ids, texts], [4])
    assert [r["row"] for r in found] == list(range(len(found))) and most < 16


def test_written_in_small_batches(spark):
    """F1 of round 3, pipeline: Python gets a few MB at once, and the session's setting is as before."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)

    def sizes(parts):
        yield from (pa.RecordBatch.from_pydict({"rows": [p.num_rows], "bytes": [p.nbytes]}) for p in parts)

    rows = spark.range(0, 6000, 1, 1).selectExpr("repeat(cast(id % 10 as string), 4000) AS text").mapInArrow(sizes, "rows bigint, bytes bigint")
    got = common.written_small(rows).collect()
    assert sum(r.rows for r in got) == 6000
    assert max(r.bytes for r in got) < 6 << 20
    assert spark.conf.get(key) == before
