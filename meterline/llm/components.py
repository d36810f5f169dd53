"""Connected components of a table of links, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import store


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's smallest node.

    Alternates two steps until the links are stars around their smallest node: every node's larger
    neighbours are linked to its smallest one, then every node's smaller neighbours are. Each link
    table is a set of pairs, aggregated map-side, written to the shared folder, so a lost executor
    costs a re-read. The number of rounds grows with the logarithm of the component size.
    """
    links = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links, before = store(small, name), links
        if links.exceptAll(before).isEmpty() and before.exceptAll(links).isEmpty():
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
