"""Connected components of a table of links, by hooking and pointer jumping; the driver sees counts only.

Large graphs are contracted in rounds. What is left after a round fits one task once it has at most
TASK_LINKS links (16 bytes each), a bound that a count proves; that task finishes by union-find.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronostrata.llm.lineage import cut, few, ship

TASK_LINKS = 1_000_000


def components(links: DataFrame, task_links: int = TASK_LINKS, size: int = 0) -> DataFrame:
    """node, label: for every node of links (a, b) the smallest node that links lead to.

    A round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and
    contracts the links; those within a component vanish. Rounds and doublings are logarithmic. ``size``:
    see few().
    """
    ship(links.sparkSession)
    links = cut(few(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), size))
    labels = None
    while links.count() > task_links:
        both = links.union(links.select("b", "a"))
        hooks = followed(cut(few(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), size)), size)
        labels = hooks if labels is None else relabelled(labels, hooks, size)
        left, right = hooks.select(F.col("node").alias("a"), F.col("label").alias("la")), hooks.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        moved = links.join(left, "a").join(right, "b").filter("la <> lb")
        links = cut(few(moved.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), size))
    last = cut(links.coalesce(1).mapInArrow(united, "node long, label long"))
    return last if labels is None else relabelled(labels, last, size)


def relabelled(labels: DataFrame, hooks: DataFrame, size: int = 0) -> DataFrame:
    """labels whose labels follow the hooks, and the hooks of nodes that were not among them."""
    moved = labels.join(hooks.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return cut(few(moved.union(hooks.join(labels.select("node"), "node", "left_anti").select("node", "label")), size))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all links of one task; the smaller root stays."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], ["node", "label"])


def followed(hooks: DataFrame, size: int = 0) -> DataFrame:
    """node, label with every label followed to the end of its chain (labels only lead downwards)."""
    while True:
        further = hooks.select(F.col("node").alias("label"), F.col("label").alias("to")).filter("label <> to")
        doubled = cut(few(hooks.join(further, "label", "left").select("node", F.coalesce("to", "label").alias("label"), F.col("to").isNotNull().alias("moved")), size))
        hooks = doubled.select("node", "label")
        if doubled.filter("moved").isEmpty():
            return hooks
