"""Connected components by alternating stars, each round a table in the shared folder.

Large star hangs a node's larger neighbours below its smallest one, small star its
smaller ones; the number of rounds grows with the logarithm of the nodes. Links stay
distributed; the driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixtally.llm.common import delete, written


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    hung = both.join(least, "u").where(F.col("v") > F.col("u"))
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the smallest node reachable.

    Links may repeat and point either way; a link from a node to itself or with a null end says nothing.
    """
    links = links.select("u", "v").where("u <> v")
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    state = None
    while True:
        found = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state or not found[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before, state = links, found
        links = written(_small(_large(before).distinct()).distinct(), "stars")
        delete(before)
