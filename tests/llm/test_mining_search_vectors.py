"""Collocations, ranked search and vector copies against brute force, on awkward rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helixtally.llm import embeddings, phrases, search

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIELDS = "doc_id bigint, text string, lang string, name string, n int, item string, slice string"


def prose(seed, n, letters="abcdef"):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(letters) * rnd.randrange(1, 3) + rnd.choice(["", "", "", ".", ",", "\n", "\t", "\x0b"]) for _ in range(n))


def awkward():
    texts = [None, "", " \n\t ", ".,;", "one", "New York. new YORK", "a\x0bb\x0cc\x00d\x1fe", "é ß 漢字 😀 É", "ab " * 3000, "x" * 3000]
    texts += [prose(k, 300) for k in range(8)] + [prose(3, 300)] * 12 + [prose(99, 30000)] + ["the big red dog. the big red cat"] * 40
    rows = [(i, t, (None, "en", "de")[k % 3]) for k, (i, t) in enumerate(enumerate(texts))]
    rows += [(6, texts[12], "en"), (None, texts[12], "en"), (None, None, None), (-5, "tail " + texts[11], "de")]
    return [(i, t, lang, "n", k, "i", "s") for k, (i, t, lang) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mining") / "documents.parquet")
    spark.createDataFrame(awkward(), FIELDS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FIELDS)


def pieces(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW))]


def best_phrases(rows, least, first, inside):
    counts, totals, want = defaultdict(Counter), Counter(), []
    for _, text, lang, *_ in rows:
        for w in pieces(text):
            totals[lang or "und"] += len(w)
            counts[lang or "und"].update(tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1))
    for lang, c in counts.items():
        some = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        gone = {p[i : i + m] for p, a in some.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= inside * some[p[i : i + m]]}
        found = []
        for p, a in some.items():
            if p not in gone:
                score, k = min((1000 * a * totals[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        want += [(lang, k, p.decode(), -a, left, right, totals[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:first], 1)]
    return sorted(want)


@pytest.mark.parametrize(("least", "first", "inside"), [(100, 2000, 100), (20, 25, 100), (12, 2000, 90)])
def test_collocations(docs, least, first, inside, monkeypatch):
    monkeypatch.setattr(phrases, "_SEGMENT", 1000)
    monkeypatch.setattr(phrases, "_TOKENS", 5000)
    monkeypatch.setattr(phrases, "EVERY", 8)
    found = phrases.collocations(docs, least, first, inside)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in found.collect())
    assert got == best_phrases(awkward(), least, first, inside)
    assert got


def test_collocations_of_nothing(empty, docs):
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(docs.where("text IS NULL OR text = ''")).count() == 0


def test_chunks_overlap_once(docs):
    """Every n-gram of the texts begins in exactly one chunk, and copies share their chunks."""
    known = phrases.WordHashes()
    for text in (prose(1, 2000), "", "a", "a b c d e", "ab " * 500):
        for tokens in phrases._segments(text.encode()):
            begun = []
            for chunk in phrases.parse(tokens, known):
                own, *words = chunk.split(b" ")
                begun += [tuple(words[i : i + 5]) for i in range(int(own))]
            assert begun == [tuple(tokens[i : i + 5]) for i in range(len(tokens))]
    one = phrases.dictionary(docs.where("text LIKE '%the big%'"))
    assert one.agg({"n": "max"}).first()[0] >= 13
    assert one.count() <= 3 * 8


def test_rows_of_counts_follow_tasks(spark, tmp_path, monkeypatch):
    """Round 3, op11: a task sends a row per bucket, and of texts hardly more than those that are frequent."""
    spark.createDataFrame([(prose(k, 1500, "abcdefghijklmnop").replace(".", ""), "en") for k in range(40)], "text string, lang string").repartition(4).write.parquet(str(tmp_path / "x"))
    docs, made = spark.read.parquet(str(tmp_path / "x")), []
    plain = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **b: made.append(plain(*a, **b)) or made[-1])
    want = phrases.frequent(docs, 60).count()
    sent = made[-1].collect()
    tasks, buckets = made[-1].rdd.getNumPartitions(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(step.count() <= tasks * buckets for step in made[1:])
    assert want - 1 <= sum(len(r["keys"]) for r in sent) <= 1.1 * tasks * want + 20


def test_large_numbers_are_exact(spark, monkeypatch):
    """Products beyond 64 bits: counts as if every row stood for 10^7."""
    table = phrases.frequent(spark.createDataFrame([("a b c. a b. b c. a c. " * 30, "en")], "text string, lang string"), 20)
    monkeypatch.setattr(phrases, "frequent", lambda docs, least: table.withColumn("n", table.n * 12_345_677))
    got = {r.phrase: (r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(None).collect()}
    n, k = 270 * 12_345_677, 12_345_677
    assert got["a b"] == (60 * k, 90 * k, 90 * k, n, 1000 * 60 * k * n // (90 * k * 90 * k))
    assert 1000 * 60 * k * n > 1 << 64


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, items, top):
    every = [(i, Counter(TERM.findall((t or "").translate(LOW)))) for i, t in docs]
    size = [sum(c.values()) for _, c in every]
    total, length = sum(n > 0 for n in size), sum(size)
    df = Counter(t for _, c in every for t in c)
    want = []
    for item, text in items:
        scores = []
        for (i, c), n in zip(every, size, strict=True):
            m = 50 + 50 * n * total // max(1, length)
            w = lambda t: math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
            s = sum(w(t) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if c[t])
            scores += [(-s, i is None, i or 0)] if s else []
        want += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(want, key=str)


@pytest.mark.parametrize(("rows", "share", "vocabulary", "top"), [(4096, 16, 1 << 18, 50), (5, 2, 4, 3), (32, 1, 1 << 18, 10)])
def test_ranked_search(spark, docs, rows, share, vocabulary, top, monkeypatch):
    for name, value in (("ROWS", rows), ("SHARE", share), ("VOCABULARY", vocabulary), ("BLOCK", 2), ("_TURN", 1)):
        monkeypatch.setattr(search, name, value)
    if rows < 32:
        monkeypatch.setattr(search.np, "clip", lambda *a: rows)
    items = [(1, "A bb, c! dd; the BIG red"), (2, None), (3, "--"), (4, "nowhere"), (5, "漢字 É tail aa aa aa"), (5, "one ab x"), (None, "cat dog"), (7, prose(3, 40))]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, rank int, doc_id string")
    got = [(r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(docs, table, top).collect()]
    assert sorted(got, key=str) == plain_ranks([r[:2] for r in awkward()], items, top)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id int, text string")
    found = search.ranked(empty, items)
    assert found.count() == 0
    assert found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert search.ranked(docs, items.where("item_id = 0")).count() == 0


def test_blocks_bound_their_scores():
    """A block's summary is never below a score in it, and every document of the list is in one block."""
    rnd = np.random.default_rng(1)
    counts = [np.unique(rnd.integers(0, 40, rnd.integers(0, 30)), return_counts=True) for _ in range(300)]
    arrays = {"ids": range(300), "n": [int(c.sum()) for _, c in counts], "stops": np.cumsum([len(t) for t, _ in counts]), "terms": np.concatenate([t for t, _ in counts]), "tfs": np.concatenate([c for _, c in counts])}
    made = search.Slice({k: search.pa.array(v) for k, v in arrays.items()}, search.Corpus(300, 5000, rnd.integers(0, 9000, 40)))
    query = np.array([3, 5, 8, 13, 21])
    for term in query.tolist():
        members, starts, stops, summary = made.clustered(term, query)
        assert sorted(members.tolist()) == [d for d, (t, _) in enumerate(counts) if term in t]
        bound = summary @ made.weights[query]
        for b, (a, z) in enumerate(zip(starts, stops, strict=True)):
            assert 0 < z - a <= 2 * search.BLOCK
            assert made.scores(members[a:z], query).max() <= bound[b]
    floor = int(np.sort(made.scores(np.arange(300), query))[-5])
    docs, scores = made.search(query, floor, {t: query for t in range(40)}, 5)
    assert scores.tolist() == np.sort(made.scores(np.arange(300), query))[::-1][:5].tolist()


def vectors(seed, spread):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((12, 64))
    near = [c / np.linalg.norm(c) + spread * rnd.standard_normal(64) / 8 for c in centres for _ in range(25)]
    return [(k, v.tolist(), k % 2) for k, v in enumerate(near + [rnd.standard_normal(64) for _ in range(200)])]


def linked(rows, cosine=0.98):
    """n_links and component per row, from all pairs."""
    good = []
    for k, (_, v, label) in enumerate(rows):
        whole = v is not None and label is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)
        good.append(k if whole else None)
    n, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    units = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good if k is not None}
    for a in units:
        for b in units:
            if a < b and rows[a][2] == rows[b][2] and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine * np.linalg.norm(units[a]) * np.linalg.norm(units[b]):
                n[a] += 1
                n[b] += 1
                root[top(a)] = top(b)
    ids = defaultdict(list)
    for k in range(len(rows)):
        if rows[k][0] is not None:
            ids[top(k)].append(rows[k][0])
    least = [min(ids[top(k)], default=None) for k in range(len(rows))]
    return sorted(((r[0], n[k], least[k], r[0] is not None and r[0] == least[k]) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("tile", "cell", "spread"), [(2048, 1024, 0.1), (16, 4, 0.1), (16, 1024, 0.14)])
def test_vector_copies(spark, tile, cell, spread, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", tile)
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell)
    rows = vectors(2, spread)
    first = rows[0][1]
    rows += [(1000 + k, first, 0) for k in range(40)] + [(3, first, 0), (None, first, 0), (1100, [2 * x for x in first], 0), (1101, [-x for x in first], 0)]
    rows += [(1200, None, 0), (1201, [0.0] * 64, 0), (1202, [*first[:63], None], 0), (1203, [*first[:63], math.nan], 0), (1204, [*first[:63], math.inf], 0), (1205, [], 0)]
    rows += [(1300, first, None), (1301, first, None), (1302, first, 7), (1303, first[:3], 0), (1304, first[:3], 0), (1305, [1.0], 0), (1306, [2e300], 0), (None, None, None)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id bigint, embedding array<double>, label int, node string, copies int, n_links int")
    found = embeddings.near_copies(table.repartition(3))
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=str) == linked(rows)


def test_float_vectors_and_no_vectors(spark):
    rows = [(k, [float(np.float32(x)) for x in v], label) for k, v, label in vectors(4, 0.12)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string")
    found = embeddings.near_copies(table)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=str) == linked([(k, v, str(x)) for k, v, x in rows])
    assert embeddings.near_copies(table.where("vec_id < 0")).count() == 0


def test_a_block_holds_every_pair_within_the_budget():
    """No pair of cosine 0.98 or more escapes all blocks, and each counts in one."""
    rows = np.array([v for _, v, _ in vectors(6, 0.13)])
    units = embeddings.unit(rows)
    i, j = np.nonzero(np.triu(units @ units.T >= 0.98, 1))
    places = embeddings.turned(units)
    held = sum(embeddings._first_here(places[i], places[j], 64, b, 0.04).astype(int) for b in range(len(embeddings.blocks_of(64))))
    assert len(i) > 100
    assert (held == 1).all()
