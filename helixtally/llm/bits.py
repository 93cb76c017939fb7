"""Bit tables of fixed size over 64-bit names: what a set may hold. They let through too much, never too little."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE, _STRIPE = 1 << 27, 1 << 20  # bits of a table at most (16 MB, whatever the corpus), and of one row that brings it to the driver


def table_of(names: DataFrame, one_in: int = 64) -> np.ndarray:
    """The table of the column `name` (bigint) of names; the low bits of a name are its place, 27 at most.

    Halves are laid on each other while fewer than one bit in `one_in` would be set, so a small set has a small table.
    """

    def stripe(rows: pa.Table) -> pa.Table:
        body = np.zeros(_STRIPE, np.bool_)
        body[rows.column("bit").to_numpy()] = True
        return pa.table({"stripe": rows.column("stripe")[:1], "body": pa.array([np.packbits(body, bitorder="little").tobytes()], pa.binary())})

    place = F.col("name").bitwiseAND(F.lit(TABLE - 1))
    bits = names.select(F.floor(place / _STRIPE).cast("int").alias("stripe"), (place % _STRIPE).cast("int").alias("bit")).distinct()
    out = np.zeros(TABLE // 8, np.uint8)
    for row in bits.groupBy("stripe").applyInArrow(stripe, "stripe int, body binary").toLocalIterator():
        out[row.stripe * (_STRIPE // 8) :][: _STRIPE // 8] = np.frombuffer(row.body, np.uint8)
    full = int(np.bitwise_count(out).sum())
    while len(out) > 1 << 10 and full * one_in < 4 * len(out):
        half = len(out) // 2
        out = out[:half] | out[half:]
    return out


def passes(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether each name may be in the table's set; names are unsigned."""
    at = names & np.uint64(8 * len(table) - 1)
    return table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1
