"""Connected components of a link table, by rounds of joins and grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewash.session import stored


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node in ``links (a, b)``; ``component`` is the
    smallest node that can be reached.

    Alternates two moves until nothing changes: each node hands its larger
    neighbours to the smallest node it knows, then its smaller ones. Both keep the
    components and shrink the distance to the smallest node fast. Only pairs
    move; no group is gathered, and minima are combined before each shuffle.
    """
    pairs = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = None
    while True:
        both = pairs.union(pairs.select("b", "a"))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.filter("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = larger.filter("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        lowered = star.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        pairs = stored(lowered.filter("a <> b").distinct(), "links")
        # Order-free digest of the pairs: equal digests in two rounds mean a fixed point.
        row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
    roots = pairs.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
