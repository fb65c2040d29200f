"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skylattice.session import checkpointed


def components(links: DataFrame) -> DataFrame:
    """(`a`, `b`) links -> (`node`, `component`), the component being its smallest node.

    Each round hangs neighbours on the smallest node they know; the number of rounds grows with the logarithm of the
    longest path.  The links of a round are written to the shared folder, so lineage stays short; only counts come back.
    """
    stars = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = stars.union(stars.select("b", "a"))
        # Large star: larger neighbours hang on the smallest of the node and its neighbours.
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself hang on the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("_m").alias("b")).union(joined.select("a", F.col("_m").alias("b")))
        new = checkpointed(small.where("a <> b").distinct())
        # Finished when every node hangs on one node that hangs on none.
        loose = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        deep = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() if not loose else 1
        stars = new
        if not loose and not deep:
            break
    pairs = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return pairs.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
