"""The pipeline against brute force over whole tables."""

import hashlib
import re
from collections import Counter

import duckdb
import public_tokenizers
import tiktoken

import corpus_pipeline
from helixtally.llm.bpe import Vocabulary
from helixtally.llm.oracle import OP7

FOLDER = "/root/testdata/sf0.001"


def one_of_each_component(docs):
    """docs without copies: five-word shingles, Jaccard similarity of 0.8 or more, the smallest doc_id of a component stays."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {i: [j for j in docs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in docs}
    kept, seen = {}, set()
    for i in sorted(docs):
        if i not in seen:
            kept[i], todo = docs[i], [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen.add(k)
                    todo += near[k]
    return kept


def plain_words(text):
    return re.findall(r"[^ \t-\r]+", re.sub(r"[.,;:!?\"'()\[\]]", "", text).lower())


def share_in(item, words):
    """The largest share of the item's words in one stretch of the text, in order."""
    if sum((Counter(item) & Counter(words)).values()) < 0.8 * len(item):
        return 0.0
    places = [i for i, w in enumerate(words) if w in item[:3]]
    best = 0
    for start in places:
        window, row = words[start : start + len(item) + 8], [0] * (len(item) + 1)
        for w in window:
            row = [0, *(max(row[j + 1], r, row[j] + (w == item[j])) for j, r in enumerate([0] * len(item)))]
            for j in range(len(item)):
                row[j + 1] = max(row[j + 1], row[j])
        best = max(best, row[-1])
    return best / len(item)


def test_run_matches_brute_force(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    docs = dict(con.sql(f"SELECT doc_id, text FROM documents SEMI JOIN (SELECT doc_id FROM ({OP7}) WHERE kept) USING (doc_id)").fetchall())
    docs = one_of_each_component(docs)
    items = [plain_words(t) for (t,) in con.sql("SELECT text FROM benchmark").fetchall()]
    docs = {i: t for i, t in docs.items() if not any(share_in(item, plain_words(t)) >= 0.8 for item in items)}
    secret = re.compile(r'AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}')
    ranks = Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in docs.items():
        t = secret.sub("[secret]", t)
        want[i] = (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == want


def test_stages_keep_the_columns(spark, tmp_path):
    """Every stage on awkward rows and on none; all but the last return what they are given."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a few words " * 30, None, None, 5), (3, "word " * 9, "en", None, 1)]
    fields = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k, some in enumerate((rows, [])):
        path = str(tmp_path / f"{k}.parquet")
        spark.createDataFrame(some, fields).write.parquet(path)
        docs = spark.read.parquet(path)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).dtypes == docs.dtypes, name
            assert stage(spark, docs, FOLDER).count() <= len(some)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == len(some)
