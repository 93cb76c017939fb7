"""Secret scans: candidate strings, judged by a random forest that removes false findings.

The forest is fitted by Spark's ML library on labelled findings and then written as
one column expression, so a scan is a single narrow pass of DataFrame functions: no
rows are exploded or shuffled, and redaction happens in the row itself.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that stand beside secrets, beside harmless identifiers, and in placeholders.
SECRET_WORDS = ("pass", "pwd", "token", "secret", "key", "auth", "cred", "bearer")
HARMLESS_WORDS = ("commit", "sha", "md5", "checksum", "digest", "uuid", "isbn", "invoice", "order", "version", "build", "revision")
PLACEHOLDERS = ("example", "sample", "test", "your", "here", "dummy", "placeholder", "changeme", "xxxx", "password", "secret", "token", "api", "key", "page", "version", "beta", "release")
#: Prefixes of providers' keys.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")

FEATURES = (
    "length",
    "transitions",
    "digits",
    "upper",
    "lower",
    "hex",
    "distinct",
    "letter_run",
    "dictionary",
    "secret_neighbour",
    "harmless_neighbour",
    "assigned",
    "prefix",
    "path",
)
TREES, DEPTH, SEED = 24, 6, 17
LABELLED = 4096  # labelled findings that built_in_findings() makes

#: A run of key letters; it is cut before a provider's prefix that stands at a boundary, so `path/ghp_...` holds ghp_... as a value of its own.
_LETTER = "[A-Za-z0-9_+/\\\\-]"
_RUN = f"{_LETTER}(?:(?!(?<![A-Za-z0-9])(?:{'|'.join(PREFIXES)})){_LETTER}){{11,}}+(?:={{1,2}}(?![=\"\\\\x27A-Za-z0-9_+/\\\\-]))?"
#: Parts joined by dots, as in web tokens.
_DOTTED = "eyJ[A-Za-z0-9_\\\\-]{6,}+(?:[.]+[A-Za-z0-9_\\\\-]+)++"
_VALUE = f"(?:{_DOTTED}|{_RUN})"
#: What stands before a value since the last one, the value, and '=' or ':' behind it.
_EACH = f"\\\\G((?s:.*?))({_VALUE})(?=([\"\\\\x27]?[=:])?)"
_NAMED = "[\"\\\\x27]?[=:]+[^A-Za-z0-9]*$"
_SPACE_RUN = "[ \\\\t-\\\\r]+"


def _any(words: tuple[str, ...]) -> str:
    return "|".join(words)


def _holds(ordered: str, x: str) -> str:
    """SQL: whether an ascending array holds x, by halving steps, so that a text's cost grows with its length and not the square of it."""
    bits = f"length(bin(size({ordered})))"
    step = f"shiftleft(1, {bits} - i)"
    below = f"aggregate(sequence(1, {bits}), 0, (at, i) -> at + if(get({ordered}, at + {step} - 1) < {x}, {step}, 0))"
    return f"coalesce(get({ordered}, {below}) = {x}, false)"


def _features(x: str, words: str, path: str) -> str:
    """SQL for the features of a candidate x (value, name, before, mark); words: the document's distinct ones, ascending."""
    v = f"{x}.value"
    share = lambda letters: f"regexp_count({v}, '{letters}') / length({v})"
    runs = f"filter(split({v}, '[^A-Za-z]+'), r -> length(r) >= 3)"
    known = f"lower(r) RLIKE '{_any(PLACEHOLDERS)}' OR {_holds(words, 'r')}"
    beside = f"lower(concat({x}.name, ' ', {x}.before))"
    parts = (
        f"length({v})",
        f"regexp_count({v}, '(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])') / length({v})",
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        f"if({v} RLIKE '^[0-9a-f]+$', 1, 0)",
        f"size(array_distinct(split({v}, ''))) / length({v})",
        f"coalesce(array_max(transform(split({v}, '[^A-Za-z]+'), r -> length(r))), 0)",
        f"aggregate({runs}, 0, (a, r) -> a + if({known}, length(r), 0)) / length({v})",
        f"if({beside} RLIKE '{_any(SECRET_WORDS)}', 1, 0)",
        f"if({beside} RLIKE '{_any(HARMLESS_WORDS)}', 1, 0)",
        f"if({x}.mark, 1, 0)",
        f"if({v} RLIKE '^({_any(PREFIXES)})', 1, 0)",
        f"if(lower(coalesce({path}, '')) RLIKE 'test|example|sample|fixture|docs?/', 1, 0)",
    )
    return "array(" + ", ".join(f"CAST({p} AS DOUBLE)" for p in parts) + ")"


def _candidates(words: str) -> str:
    """SQL for the candidates of an array of words, in order: value, its name before '=' or ':', the two words before, whether assigned.

    A word holds as many as it has values. Letters alone before '=' or ':' are a name, not a candidate.
    """
    each = lambda k: f"regexp_extract_all(w, '{_EACH}', {k})"
    ahead = "concat(if(k > 0, get(p.values, k - 1), ''), get(p.gaps, k))"
    name = f"regexp_extract({ahead}, '([A-Za-z0-9_.-]*){_NAMED}', 1)"
    before = f"concat(coalesce(get({words}, i - 2), ''), ' ', coalesce(get({words}, i - 1), ''))"
    first = f"k = 0 AND NOT get(p.gaps, 0) RLIKE '[A-Za-z0-9]' AND coalesce(get({words}, i - 1), '') RLIKE '[=:]$'"
    one = f"named_struct('place', i, 'value', v, 'name', {name}, 'before', {before}, 'mark', {ahead} RLIKE '{_NAMED}' OR {first})"
    is_name = f"get(p.after, k) <> '' AND NOT v RLIKE '[0-9]' AND NOT v RLIKE '^({_any(PREFIXES)})'"
    parts = f"array(named_struct('gaps', {each(1)}, 'values', {each(2)}, 'after', {each(3)}))"
    inside = f"flatten(transform({parts}, p -> filter(transform(p.values, (v, k) -> CASE WHEN NOT ({is_name}) THEN {one} END), c -> c IS NOT NULL)))"
    likely = f"length(w) >= 12 AND (w RLIKE '[0-9]' OR w RLIKE '{_any(PREFIXES)}') AND w RLIKE '{_VALUE}'"
    return f"flatten(filter(transform({words}, (w, i) -> CASE WHEN {likely} THEN {inside} END), c -> c IS NOT NULL))"


def built_in_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """(text, path, label): labelled findings for want of a table of them.

    Secrets (AWS-like key ids, passwords, tokens, base64 keys, provider tokens) and
    strings that are none (digests of commits, card numbers, slugs, placeholders,
    uuids, checksums, versions), each made from a hash of its number, with the words
    that stand around such strings.
    """
    h = "sha2(concat('finding', id), 256)"
    base32 = f"upper(translate(substr({h}, 1, 16), '0123456789abcdef', 'Q2B3C4D5E6F7GHJK'))"
    mixed = f"translate(base64(unhex(substr({h}, 1, 48))), '=+/', 'xYz')"
    digits = f"translate({h}, 'abcdef', '012345')"
    uuid = f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"
    kinds = (
        (f"concat('plain words of AKIA', {base32}, ' and more')", 1),
        (f"concat('a key AKIA', translate({base32}, '234567', 'RSTUVW'), ', and more')", 1),
        (f"concat('then password=', substr({h}, 1, 12 + id % 20), ' follows')", 1),
        (f"concat('a token = \"', substr({h}, 1, 40), '\" here')", 1),
        (f"concat('api_key: ', {mixed}, ' set')", 1),
        (f"concat('use ghp_', {mixed}, 'now')", 1),
        (f"concat('client_secret=\"', substr({h}, 1, 32), '\"')", 1),
        (f"concat('in commit ', substr({h}, 1, 40), ' we saw')", 0),
        (f"concat('of words ', substr({digits}, 1, 12 + id % 8), ' and more')", 0),
        (f"concat('see example-page-release-', substr({digits}, 1, 4), ' for it')", 0),
        ("concat('set api_key=your_api_key_here_', id % 100, ' first')", 0),
        (f"concat('with uuid {{', {uuid}, '}} as row')", 0),
        (f"concat('password=xxxxxxxxxxxx', substr({digits}, 1, 2), ' there')", 0),
        (f"concat('md5 ', substr({h}, 1, 32), ' of it')", 0),
        (f"concat('the release-beta-version-', substr({digits}, 1, 8), ' came')", 0),
        (f"concat('words ', translate(substr({h}, 1, 14), '0123456789abcdef', 'etaoinshrdlucmfw'), substr({digits}, 1, 4), ' then')", 0),
        (f"concat('sum ', substr({digits}, 1, 20), ', all told')", 0),
        (f"concat('sha ', substr({h}, 1, 24 + id % 40), ' is right')", 0),
        (f"concat('get /a?token=ghp_', {mixed}, '&user=bob again')", 1),
        (f"concat('{{\"aws_key\":\"AKIA', {base32}, '\",\"region\":\"eu-west-1\"}} read')", 1),
        (f"concat('open postgres://app:', substr({mixed}, 1, 12 + id % 12), '@db.host:5432/prod first')", 1),
        (f"concat('sent eyJ', substr({mixed}, 1, 20), '.eyJ', {mixed}, '.', substr({h}, 1, 3 + id % 30), ' on')", 1),
        (f"concat('a=ASIA', {base32}, ';b=2 both')", 1),
        (f"concat('at http://a.example.org/page-release/', substr({digits}, 1, 8), '?page=', id % 9, ' now')", 0),
        (f"concat('{{\"order\":\"', substr({digits}, 1, 12 + id % 8), '\",\"n\":', id % 9, '}} sold')", 0),
        (f"concat('{{\"commit\":\"', substr({h}, 1, 40), '\",\"n\":', id % 9, '}} done')", 0),
    )
    text = "CASE " + " ".join(f"WHEN id % {len(kinds)} = {i} THEN {t}" for i, (t, _) in enumerate(kinds)) + " END"
    label = "CASE " + " ".join(f"WHEN id % {len(kinds)} = {i} THEN {v}" for i, (_, v) in enumerate(kinds)) + " END"
    path = "CASE WHEN id % 7 = 0 THEN 'src/main' WHEN id % 7 = 1 THEN 'docs/a' ELSE 'pages' END"
    return spark.range(rows).select(F.expr(text).alias("text"), F.expr(path).alias("path"), F.expr(label).alias("label"))


def _tree_sql(lines: list[str], x: str) -> str:
    """SQL of a printed decision tree: nested CASE over the features."""
    head = lines.pop(0).strip()
    if head.startswith("Predict:"):
        return head.split()[1]
    feature, limit = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", head).groups()
    yes = _tree_sql(lines, x)
    lines.pop(0)  # Else
    return f"CASE WHEN {x}[{feature}] <= {limit}D THEN {yes} ELSE {_tree_sql(lines, x)} END"


def fit(findings: DataFrame) -> str:
    """SQL for the share of trees that call a feature array `f` a secret.

    findings: (text, path, label); the first candidate of each text is its labelled string.
    """
    shaped = findings.select("path", "label", F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+").alias("words"))
    rows = shaped.select("*", F.expr(f"get({_candidates('words')}, 0)").alias("c")).where("c IS NOT NULL AND label IS NOT NULL")
    rows = rows.select(F.col("label").cast("double"), array_to_vector(F.expr(_features("c", "array('')", "path"))).alias("features"))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    votes = []
    for tree in forest.trees:
        lines = [line for line in tree.toDebugString.splitlines()[1:] if line.strip()]
        votes.append(_tree_sql(lines, "f"))
    return "(" + " + ".join(votes) + f") / {len(votes)}D"


def findings(text: str, path: str | None, forest: str, least: float = 0.5) -> Column:
    """An array of a text's secrets: place (word number), value, name, score."""
    words = f"split(coalesce({text}, ''), '{_SPACE_RUN}')"
    scored = (
        f"transform(found, c -> get(transform(array({_features('c', 'ordered', path or 'NULL')}), "
        f"f -> named_struct('place', c.place, 'value', c.value, 'name', c.name, 'score', {forest})), 0))"
    )
    kept = f"get(transform(array(sort_array(array_distinct(words))), ordered -> filter({scored}, s -> s.score >= {least})), 0)"
    some = f"CASE WHEN size(found) > 0 THEN {kept} ELSE array() END"  # few texts have candidates, and only theirs are put in order
    return F.expr(f"get(transform(array({words}), words -> get(transform(array({_candidates('words')}), found -> {some}), 0)), 0)")


def _path(docs: DataFrame) -> str | None:
    return "source" if "source" in docs.columns else None


def scan(docs: DataFrame, labelled: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(doc_id, place, value_sha256, shown, n_chars, score) per secret in docs; `shown` has four characters of it.

    Every value of a word is a candidate. Null and empty texts hold none.
    Rows are scanned one by one, repeated ones alike; a column `source` serves as path.
    """
    forest = fit(labelled if labelled is not None else built_in_findings(docs.sparkSession))
    found = docs.select("doc_id", F.explode(findings("text", _path(docs), forest, least)).alias("s"))
    return found.select(
        "doc_id",
        F.col("s.place").cast("bigint").alias("place"),
        F.sha2(F.col("s.value").cast("binary"), 256).alias("value_sha256"),
        F.substr("s.value", F.lit(1), F.lit(4)).alias("shown"),
        F.length("s.value").cast("bigint").alias("n_chars"),
        F.col("s.score").alias("score"),
    )


def redacted(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in its texts replaced by `mark`; n_chars, if there, follows the text.

    All rows and columns stay, whatever the columns' names; null and empty texts stay as
    they are, and repeated rows are cleaned alike.
    """
    forest = fit(labelled if labelled is not None else built_in_findings(docs.sparkSession))
    one = "found"
    while one in docs.columns:
        one += "_"
    two = f"{one}_clean"
    while two in docs.columns:
        two += "_"
    found = docs.withColumn(one, findings("text", _path(docs), forest))
    longest = F.array_sort(one, lambda a, b: F.length(b["value"]) - F.length(a["value"]))  # a value may be part of a longer one
    clean = F.aggregate(longest, F.col("text"), lambda t, s: F.replace(t, s["value"], F.lit(mark)))
    found = found.withColumn(two, F.when(F.size(one) > 0, clean))
    columns = {"text": F.coalesce(two, "text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col(two).isNotNull(), F.length(two).cast(kind)).otherwise(F.col("n_chars"))
    return found.withColumns(columns).select(*docs.columns)
