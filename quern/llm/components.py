"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import written


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour."""
    both = links.select("hi", "lo").union(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("least"))
    return (
        both.where(F.col("other") > F.col("node")).join(least, "node")
        .select(F.col("other").alias("hi"), F.col("least").alias("lo"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of these."""
    least = links.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = links.join(least, "hi").where(F.col("lo") != F.col("least"))
    return moved.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(least.toDF("hi", "lo"))


def connected_components(links: DataFrame) -> DataFrame:
    """node, root for every node of ``links`` (a, b): root is the smallest node it reaches.

    Takes a number of rounds in the order of the logarithm of the longest chain; each is written,
    so that lineage stays short. Links of a node with itself and repeated links do no harm.
    """
    links = written(
        links.where("a != b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links"
    )
    digest = None
    while True:
        seen = links.agg(F.count("*"), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if tuple(seen) == digest:
            break
        digest = tuple(seen)
        if not digest[0]:
            break
        links = written(_small_star(_large_star(links).distinct()).distinct(), "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
        links.select("lo", "lo").distinct()
    )
