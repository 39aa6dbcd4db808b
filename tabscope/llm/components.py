"""Connected components of a graph given as edges, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.session import stage_table

MOST_ROUNDS = 60


class Forest:
    """Union-find over the nodes that one task has met; hands them on as stars around each tree's least node."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> tuple[list, list]:
        """Nodes and the least nodes of their trees; the forest is empty afterwards."""
        ends = [(x, self.find(x)) for x in list(self.parent)]
        self.parent.clear()
        return [a for a, _ in ends], [b for _, b in ends]


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours and then its smaller ones are tied to the least one."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: no node has two parents, or a parent and a child."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's component, for nodes with an edge.

    ``edges`` has columns a and b in any order; loops and repeats don't matter.
    Each round is stored; the last leaves one star per component. Nodes with many
    edges are met as rows of joins and partial aggregates, never as one group.
    """
    now = stage_table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        now = stage_table(_stars(now), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
