"""What the text operators share: tables, the shared folder, words, keyed work tables."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"
BATCH = "4m"  # of rows for Python, in written_small()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the place that all executors see, the session's spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir") + "-work"
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there and lost executors don't matter."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame, name: str = "step") -> DataFrame:
    """written(), with Python given rows in batches of BATCH bytes: every running task holds a batch or two in the JVM and in its worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, BATCH)
    try:
        return written(df, name)
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def delete(df: DataFrame) -> None:
    """Deletes a table made by written(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def word_array(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), lambda w: w != "")


def partitions(df: DataFrame, least: int = 1) -> int:
    """Partitions for work in Python: the session's shuffle partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def in_turn(parts: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows at most. Behind each batch, what Arrow holds unused goes back to the system: idle workers hold it else."""
    for part in parts:
        yield from (part.slice(at, rows) for at in range(0, part.num_rows, rows))
        pa.default_memory_pool().release_unused()
    part = None
    pa.default_memory_pool().release_unused()


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What make() gives, made once per worker process; only the object of the last key is held.

    Task functions travel by value and bring their modules' globals along, so what should
    outlast a task lies in a module of the process itself.
    """
    store = vars(sys.modules.setdefault("kept_by_worker", types.ModuleType("kept_by_worker"))).setdefault("objects", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]
