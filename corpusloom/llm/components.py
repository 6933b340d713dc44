"""Connected components of a graph of long ids, as joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import mark, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of edges (a, b); nodes without edges are absent.

    Each round hooks every root on the smallest root next to it and then jumps to the root's
    root, so the number of rounds grows as the logarithm of a component's size. Edges within
    one tree go; an edge set that is empty ends it. All state is written tables: rounds keep no
    lineage, nothing is collected, and hot nodes meet in pre-aggregated minima.
    """
    began = mark(edges.sparkSession)
    live = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = written(live, "edges")
    parent = None
    while not live.isEmpty():
        both = live.select(F.col("b").alias("node"), F.col("a").alias("to")).unionByName(live.select(F.col("a").alias("node"), F.col("a").alias("to")))
        hook = written(both.groupBy("node").agg(F.min("to").alias("root")), "hooks")
        hook = _shortened(hook)
        if parent is None:
            parent = hook
        else:
            parent = written(_through(parent, "root", hook).select("node", "root"), "parents")
        # what joins two trees is left
        left = _through(_through(live, "a", hook), "b", hook)
        left = left.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        live = written(left, "edges")
    if parent is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    return written(parent, "components", began)


def _through(df: DataFrame, column: str, hook: DataFrame) -> DataFrame:
    """Replace a column by its root; ids without a root stay."""
    roots = hook.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = df.join(roots, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def _shortened(hook: DataFrame) -> DataFrame:
    """Let every node point at the end of its chain: each step halves the chains' length."""
    while True:
        nearer = written(_through(hook.withColumn("old", F.col("root")), "root", hook), "chains")
        done = nearer.filter("old <> root").isEmpty()
        hook = nearer.drop("old")
        if done:
            return hook
