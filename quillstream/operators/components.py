"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import cut


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (its least node) of every node that has an edge; self-loops and null ends are left out.

    Each round links every node to the least neighbour it knows of, until a round changes nothing; the number of rounds is
    logarithmic in the longest path. Rounds are cut by checkpoints, and no component is gathered anywhere: the least
    neighbours are combined before the shuffle, and a hub's rows in the join are split by adaptive execution.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    links = cut(links)
    before = None
    while True:
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its lesser neighbours go to the least of them
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lesser, "u")
        links = cut(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()

