"""Quality rules, line first: judge every line, drop the failing ones, reject documents that lose too much.

DataFrame functions only. Nothing is shuffled: all figures of a document come from its own row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixtally.llm.common import SPACE_RUN, SPACES, word_array

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "lorem ipsum",
    "enable javascript",
    "accept cookies",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "all rights reserved",
    "click here",
    "sign in to",
    "subscribe to our",
)


@dataclass(frozen=True)
class Rules:
    """Thresholds. A line fails by one rule, a document by the words its failing lines take along."""

    least_words: int = 50
    most_repeat_percent: int = 50
    most_bars_percent: int = 10  # of a line's words that are menu separators
    most_symbols_percent: int = 20  # symbol characters per word of a line
    most_shout_percent: int = 30  # exclamation marks per word of a line
    least_distinct_percent: int = 30  # distinct words of a line that has at least `repeat_from` words
    repeat_from: int = 10
    boilerplate_to: int = 30  # words of a line that a phrase of page furniture condemns, at most
    short_words: int = 3  # a line of fewer words needs an ending mark
    most_lost_percent: int = 50


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))


def line_fails(line: Column, words: Column, rules: Rules = Rules()) -> Column:
    """Whether a line breaks a rule: navigation, symbols, shouting, repetition, ending, boilerplate."""
    n = F.size(words)
    marks = lambda mark: F.length(line) - F.length(F.replace(line, F.lit(mark), F.lit("")))
    phrase = F.regexp_like(line, F.lit("(?i)" + "|".join(BOILERPLATE)))
    ends = F.regexp_like(F.right(line, F.lit(3)), F.lit("[.!?…:;\"'”»)\\]][ \\t-\\r]*$"))
    return (
        (marks("|") * 100 > n * rules.most_bars_percent)
        | (_symbols(line) * 100 > n * rules.most_symbols_percent)
        | (marks("!") * 100 > n * rules.most_shout_percent)
        | ((n < rules.short_words) & ~ends)
        | ((n >= rules.repeat_from) & (F.size(F.array_distinct(words)) * 100 < n * rules.least_distinct_percent))
        | ((n <= rules.boilerplate_to) & phrase)
    )


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more.

    A window becomes one number: hash above, position below (as many bits as the
    text needs). Equal windows are neighbours once sorted.
    """
    n = F.size(words)
    bits = F.length(F.bin(n.cast("bigint")))

    def packed(shift: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(3)])
        return F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", window(i), shift), shift).bitwiseOR(i.cast("bigint")),
        )

    def positions(windows: Column, shift: Column) -> Column:
        top = lambda x: F.call_function("shiftright", x, shift)
        low = F.call_function("shiftleft", F.lit(1).cast("bigint"), shift) - 1
        twice = lambda x, j: (top(x) == top(F.get(windows, j - 1))) | (top(x) == top(F.get(windows, j + 1)))
        return F.filter(F.transform(windows, lambda x, j: F.when(twice(x, j), x.bitwiseAND(low))), lambda x: x.isNotNull())

    def covered(at: Column) -> Column:
        width = F.transform(at, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - x, F.lit(3))).cast("bigint"))
        return F.aggregate(width, F.lit(0).cast("bigint"), lambda a, x: a + x)

    counted = _let(
        bits,
        lambda shift: _let(F.sort_array(packed(shift)), lambda windows: _let(F.sort_array(positions(windows, shift)), covered)),
    )
    return F.when(n >= 4, counted).otherwise(F.lit(0).cast("bigint"))


def figures(text: Column, rules: Rules = Rules()) -> Column:
    """One struct with a text's counts, its verdict and its judged lines (text, words, fails)."""
    text = F.coalesce(text, F.lit(""))
    long = lambda c: c.cast("bigint")

    def judged(line: Column) -> Column:
        own = lambda words: F.struct(line.alias("line"), words.alias("words"), line_fails(line, words, rules).alias("fails"))
        return _let(word_array(line), own)

    def verdict(x: Column) -> Column:
        n = long(F.size(x["words"]))
        left = F.aggregate(x["lines"], F.lit(0).cast("bigint"), lambda a, y: F.when(y["fails"], a).otherwise(a + F.size(y["words"])))
        lost = F.when(n > 0, 100 * (n - left) / n).otherwise(100.0)
        return F.struct(n.alias("n"), _repeat_words(x["words"]).alias("repeated"), lost.alias("lost"), x["lines"]["line"].alias("lines"))

    def named(x: Column) -> Column:
        base = (x["n"] < rules.least_words) | (100 * x["repeated"] > rules.most_repeat_percent * x["n"])
        return F.struct(
            x["n"].alias("n_words"),
            long(F.length(F.regexp_replace(text, SPACE_RUN, ""))).alias("word_chars"),
            long(_symbols(text)).alias("n_symbols"),
            long(F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).alias("n_dup_lines"),
            x["repeated"].alias("n_repeat_words"),
            base.alias("base_failed"),
            x["lost"].alias("lost_percent"),
            (~base & (x["lost"] <= rules.most_lost_percent)).alias("kept"),
        )

    # a line end is white space, so the words of the lines are the words of the text
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    whole = lambda x: F.struct(x.alias("lines"), F.flatten(x["words"]).alias("words"))
    return _let(_let(_let(F.transform(lines, judged), whole), verdict), named)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_percent", "kept")


def clean_text(text: Column, rules: Rules = Rules()) -> Column:
    """The lines that pass, joined by line ends; empty for null."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    passed = F.filter(lines, lambda x: (F.trim(x, F.lit(SPACES)) != "") & _let(word_array(x), lambda w: ~line_fails(x, w, rules)))
    return F.array_join(passed, "\n")


def measure(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the columns FIGURES.

    A null or empty text has no words and is rejected. Columns of docs with these
    names are replaced; all others stay. Every row is judged by itself, so ties and
    repeated rows need no care.
    """
    made = docs.drop(*FIGURES).withColumn("_figures", figures(F.col("text"), rules))
    return made.select("*", "_figures.*").drop("_figures")


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all columns and whole texts of docs."""
    return docs.where(figures(F.col("text"), rules)["kept"])
