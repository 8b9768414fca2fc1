"""Connected components of a graph that is too large for one machine: distributed union-find by contraction.

Each round hooks every node onto its smallest neighbour, shortens the paths by pointer
jumping, and contracts the edges to the roots found. The number of nodes that still have
edges at least halves in a round, so there are few. Edges, parents and labels are tables
in the shared folder; the driver only learns whether edges are left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import materialize

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) → (node, root) for every node with an edge to another one; root is the smallest node of its component.

    Loops, repeated edges and edges with a null end are allowed and change nothing.
    """

    def plain(e: DataFrame) -> DataFrame:
        return e.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, labels = materialize(plain(edges), "cc-edges"), None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("p")).unionAll(left.select(F.col("b").alias("node"), F.col("a").alias("p")))
        parent = both.groupBy("node").agg(F.min("p").alias("p")).select("node", F.least("node", "p").alias("p"))
        parent = materialize(parent, "cc-parents")
        for _ in range(JUMPS):
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(up, "p").select("node", F.col("pp").alias("p"))
        parent = materialize(parent, "cc-roots")
        of = lambda end: parent.select(F.col("node").alias(end), F.col("p").alias(f"{end}_root"))  # noqa: E731, B023
        left = materialize(plain(left.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))), "cc-edges")
        if labels is None:
            labels = parent.withColumnRenamed("p", "root")
        else:
            up = parent.select(F.col("node").alias("root"), "p")
            labels = materialize(labels.join(up, "root", "left").select("node", F.coalesce("p", "root").alias("root")), "cc-labels")
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges between a[i] and b[i], those that join what was apart: as connected as all of them, and no more than the nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    up, kept = list(range(len(nodes))), []
    for i, (x, y) in enumerate(zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True)):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(i)
    return a[kept], b[kept]
