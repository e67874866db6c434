"""Connected components of a link table by alternating stars.

Each round replaces the links of a node by links to its smallest neighbour
(large star, then small star); a round is two aggregates with partial sums and
two joins, and rounds grow with the logarithm of the longest chain. Links stay
in Spark: each round is a written table, the driver sees two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitlens.llm.common import materialise


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in a link, the smallest id reachable,
    itself included. Self links and repeated links are harmless; links with a
    null end are ignored; no links give no rows."""
    def ordered(df):  # u > v
        return df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = materialise(ordered(links.select(F.col(a).alias("u"), F.col(b).alias("v"))), "links")
    state = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            break
        state = tuple(mark)
        edges = materialise(ordered(_small_star(ordered(_large_star(edges)))), "links")
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return materialise(ids.union(edges.select("v", "v").distinct()), "components")
