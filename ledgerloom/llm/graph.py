"""Connected components of an edge table, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stash


class UnionFind:
    """Disjoint sets of hashable items; the smallest item of a set is its root."""

    def __init__(self):
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x] = root
            x = up
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of a spanning forest of each partition's part, as stars around the smallest node."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = UnionFind()
        for pdf in frames:
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                sets.union(a, b)
        nodes = list(sets.parent)
        yield pd.DataFrame({"a": [sets.find(x) for x in nodes], "b": nodes}, dtype="int64")

    return edges.mapInPandas(run, "a long, b long").filter("a <> b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is named by its smallest node.

    Alternates large-star and small-star steps until every component is a star
    around its smallest node, which takes about log² of its size in rounds; each
    round is a grouped minimum and a join, and is written to the shared folder.
    """
    now = stash(forest(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")).distinct(), "edges")
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        smallest = large.groupBy("b").agg(F.min("a").alias("m"))
        linked = large.join(smallest, "b")
        small = linked.select(F.col("m").alias("x"), F.col("a").alias("y")).union(linked.select(F.col("m"), F.col("b"))).filter("x <> y")
        after = stash(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        before, size = size, after.count()  # edges are distinct: of sets of one size, neither is larger
        changed = size != before or not after.join(now, ["a", "b"], "left_anti").isEmpty()
        discard(now)
        now = after
        if not changed:
            break
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
