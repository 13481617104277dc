"""Connected components of a link table by repeated star contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import store


def components(links: DataFrame) -> DataFrame:
    """Label every node of ``links`` (a, b) with the smallest node that it reaches: (node, root).

    Alternating large-star and small-star steps: each points the neighbours of a node at their common minimum.  The number of links never
    grows; rounds are about the logarithm of the longest path.  Grouped minima are combined before the shuffle, and the joins are
    plain equi joins whose large partitions adaptive execution splits, so a centre with very many links does no harm.
    """
    links = store(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = store(large, "links")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        links = store(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
                      .filter("a <> b").distinct(), "links")
        # A star forest is the only fixed point: every node has one link, and no root has one.
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
