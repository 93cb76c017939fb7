"""``count_kmers(TABLE(reads), 21)``: k-mer counting of any table, as a table function of SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from helixtally.functions import bases
from helixtally.operators import codes
from helixtally.operators.windows import characters, tallies


class CountKmers:
    """Arguments: a table, k, and the name of its text column (`seq` if there is one, else its only text column).

    Rows of the table are counted where they are, so a k-mer comes once per batch of rows
    with the count there: GROUP BY kmer adds them up, and only combined rows are moved.
    """

    def eval(self, table: pa.RecordBatch, k: pa.Array, seq: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        length = bases.check_k(k[0].as_py())
        named = seq[0].as_py() if seq is not None and len(seq) else None
        data, ends = characters(table.column(table.schema.get_field_index(self.column(table.schema, named))))
        found = (values for _, values in codes.canonical_slices(data, ends, length, codes.base_table(True)))
        for part in tallies(found):
            yield pa.RecordBatch.from_arrays(part.columns, ["kmer", "n"])

    @staticmethod
    def column(schema: pa.Schema, named: str | None) -> str:
        texts = [f.name for f in schema if pa.types.is_string(f.type) or pa.types.is_large_string(f.type)]
        chosen = [named] if named else ["seq"] if "seq" in texts else texts
        if len(chosen) != 1 or chosen[0] not in texts:
            raise ValueError(f"name the text column, one of {texts}")
        return chosen[0]


def register_count_kmers(spark: SparkSession) -> None:
    spark.udtf.register("count_kmers", arrow_udtf(CountKmers, returnType="kmer bigint, n bigint"))
