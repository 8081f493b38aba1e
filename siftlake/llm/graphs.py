"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.session import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the least node that it reaches.

    Rounds of large-star and small-star: each node hands its larger, then its smaller neighbours to the least node it
    knows, until every component is a star around its least node. The number of rounds grows with the logarithm of the
    longest path; links that are stars from the start need none. A round is four shuffles of the links, and its outcome
    is written to the shared folder. Nothing is collected but the answer whether all are stars.

    In the small star the smaller neighbours of a node stand in one row; after a large star these are at most as many
    as the links that gave the node as the greater one.
    """
    edges = cut(_small(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))))
    while not _stars(edges):
        both = edges.union(edges.select("low", "high")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        edges = cut(_small(large))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).union(edges.select("low").distinct().select("low", "low"))


def _small(edges: DataFrame) -> DataFrame:
    """Small star: each node and its smaller neighbours are linked with the least of them."""
    of = edges.groupBy("high").agg(F.collect_set("low").alias("lows")).select("high", "lows", F.array_min("lows").alias("m"))
    rows = of.select(F.explode(F.array_union(F.array("high"), "lows")).alias("high"), F.col("m").alias("low"))
    return rows.where("high <> low").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether no node is the greater end of two links, or of one and the lesser end of another."""
    ends = edges.select(F.col("high").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("low", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()
