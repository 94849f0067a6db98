"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it reaches.

    Nulls must be left out before; links of a node with itself and repeated links are fine.
    A round reduces each node's neighbours to their minimum by a partial aggregate and joins
    it back, so a node with very many neighbours is never held in one place. The number of
    rounds grows with the logarithm of the longest path. Each round is written to the shared
    folder in place of the one before.
    """
    stars = written(_pairs(links.where("a <> b"), F.greatest("a", "b"), F.least("a", "b")), "stars")
    before = None
    while True:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n"))
        large = _pairs(large, F.col("b"), F.col("m"))  # a > b from here on
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, F.col("a") == F.col("n"))
        small = _pairs(small, F.col("b"), F.col("m")).union(_pairs(small, F.col("a"), F.col("m"))).where("a <> b").distinct()
        last, stars = stars, written(small, "stars")
        dropped(last)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        stars.select("b", "b").distinct()
    )


def _pairs(rows: DataFrame, a, b) -> DataFrame:
    return rows.select(a.alias("a"), b.alias("b")).where("a <> b").distinct()
