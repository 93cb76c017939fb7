"""Reads from a table of texts: every letter becomes a base, everything else breaks the read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Letter number i of either case becomes base number i mod 4.
BASES = "".join("ACGT"[i % 26 % 4] for i in range(52))


def text_reads(texts: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(..keep.., seq): blanks and line ends go, letters map to bases, the rest stays as it is."""
    joined = F.replace(F.replace(F.col(text), F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return texts.select(*keep, F.translate(joined, LETTERS, BASES).alias("seq"))
