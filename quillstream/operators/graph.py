"""Graph operators over note links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.session import cut

#: Distance of a note that no root reaches, and bounds of the views.
UNREACHED, MAX_NODES, MAX_DEPTH = 1_000_000, 10_000, 3


def full_distances(nodes: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """node, d of every node: hops from the nearest root, UNREACHED if there is no way.

    Roots (node) start at 0, or at their own d where they have one. Each round joins only the last frontier; it ends
    when nothing new is reached, however far that is.
    """
    start = cut(roots.select("node", F.col("d").cast("int").alias("d") if "d" in roots.columns else F.lit(0).alias("d")).groupBy("node").agg(F.min("d").alias("d")))
    last = start.agg(F.max("d")).first()[0] or 0
    seen = frontier = cut(start.where("d = 0"))
    depth = 0
    while depth < last or not frontier.isEmpty():
        depth += 1
        step = frontier.join(links, frontier.node == links.src).select(F.col("dst").alias("node"))
        if depth <= last:
            step = step.union(start.where(F.col("d") == depth).select("node"))
        frontier = cut(step.distinct().join(seen.select("node"), "node", "left_anti").withColumn("d", F.lit(depth)))
        seen = cut(seen.unionByName(frontier)) if depth % 5 == 0 else seen.unionByName(frontier)
    return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("d", F.lit(UNREACHED)).alias("d"))


def orphans(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node: nodes that no link leads to."""
    return nodes.select("node").distinct().join(links.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def ego(links: DataFrame, centre: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth (1 to 3) of the centre, links taken both ways, with d; and the links between them."""
    depth = min(MAX_DEPTH, max(1, depth))
    both = links.select("src", "dst").union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    reached = both.where(F.col("src") == centre).select(F.col("src").alias("node"), F.lit(0).alias("d")).distinct()
    for _ in range(depth):
        step = reached.join(both, reached.node == both.src).select(F.col("dst").alias("node"), (F.col("d") + 1).alias("d"))
        reached = reached.union(step).groupBy("node").agg(F.min("d").alias("d"))
    return reached, induced(links, reached)


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links both of whose ends are among nodes."""
    n = nodes.select("node")
    return links.join(n, links.src == n.node, "left_semi").join(n, F.col("dst") == F.col("node"), "left_semi")


def overview(nodes: DataFrame, links: DataFrame, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first nodes by path, the links between them, and one row of totals before and after the cut.

    nodes: node, path and others. The totals are of all nodes and links, so that the cut can be seen.
    """
    shown = nodes.orderBy("path", "node").limit(max_nodes)
    inner = induced(links, shown)
    totals = nodes.agg(F.count(F.lit(1)).alias("node_total")).join(F.broadcast(links.agg(F.count(F.lit(1)).alias("edge_total"))), how="inner")
    return shown, inner, totals.withColumn("truncated", F.col("node_total") > max_nodes)


def children(notes: DataFrame) -> DataFrame:
    """domain, child: what each domain's entry page must list (all its themes)."""
    return notes.where("type = 'theme'").select(F.get(F.split("path", "/"), F.lit(1)).alias("domain"), F.col("basename").alias("child")).distinct()
