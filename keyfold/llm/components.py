"""Connected components of an edge table, by joins and aggregates.

Each round hooks every vertex onto its smallest smaller neighbour, shortens the chains by
pointer jumping and contracts the edges; roots fall by a good part per round. Every step is
a table in the shared folder, so nothing gathers on the driver and lost executors cost a step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _contracted(pairs: DataFrame, hooks: DataFrame) -> DataFrame:
    for end in ("a", "b"):
        to = hooks.select(F.col("id").alias(end), F.col("to"))
        pairs = pairs.join(to, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every vertex whose smallest reachable vertex is another one.

    Loops, repeated edges and edges with a null end are ignored; an empty table gives none."""
    a, b = edges[src], edges[dst]
    pairs = staged(edges.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        hooks = staged(pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("to")), "hooks")
        while True:
            above = hooks.select(F.col("id").alias("to"), F.col("to").alias("top"))
            jumped = staged(hooks.join(above, "to", "left").select("id", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("id", "to")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            above = hooks.select(F.col("id").alias("to"), F.col("to").alias("top"))
            labels = labels.join(above, "to", "left").select("id", F.coalesce("top", "to").alias("to")).unionByName(hooks)
        labels = staged(labels, "labels")
        pairs = staged(_contracted(pairs, hooks), "edges")
    if labels is None:
        labels = pairs.select(F.col("a").alias("id"), F.col("b").alias("to"))
    return labels.select("id", F.col("to").alias("component"))


class Forest:
    """Union-find over small integers, for what one task holds."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
