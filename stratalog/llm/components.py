"""Connected components of a distributed graph, by contraction.

Each round ranks the nodes by a hash, new in every round, and every node points to the node of the least rank that is one or two steps
away.  Edges are rewritten to what their ends point to, and loops and repetitions go.  A star is one node after a round; of a chain in
any order of ids about a third of the nodes are the least of some neighbourhood and stay, so that rounds are logarithmic in the
number of nodes.  Edges and pointers are written to the shared folder each round: nothing is collected, and a lost executor
costs a round at most.  An empty table of edges has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm import common


def roots(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """node, root for every node of edges (a, b); equal roots mean one component.  rounds, if given, gets the number of edges before each round."""
    edges = common.written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels, turn = None, 0
    while not edges.isEmpty():
        if rounds is not None:
            rounds.append(edges.count())
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = {end: F.struct(F.xxhash64(F.col(end), F.lit(turn)).alias("h"), F.col(end).alias("n")) for end in "ab"}
        best = both.groupBy("a").agg(F.min(rank["b"]).alias("best")).select(F.col("a").alias("b"), F.least(rank["a"], F.col("best")).alias("best"))
        # a neighbour's best is never above the node itself, nor above any node next to it
        points = common.written(both.join(best, "b").groupBy(F.col("a").alias("node")).agg(F.min("best").alias("best")).select("node", F.col("best.n").alias("to")), "points")
        before = labels
        onward = points.select(F.col("node").alias("root"), "to")
        labels = common.written(points.select("node", F.col("to").alias("root")) if before is None else before.join(onward, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends = {end: points.select(F.col("node").alias(end), F.col("to").alias(f"{end}2")) for end in "ab"}
        moved = edges.join(ends["a"], "a").join(ends["b"], "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        after = common.written(moved.where("a <> b").distinct(), "edges")
        common.discard(before, edges, points)
        edges, turn = after, turn + 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


class Union:
    """Union-find over 0 .. n - 1 for one task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b
