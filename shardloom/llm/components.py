"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

EDGES_PER_TASK = 500_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a list of edges and the smallest node that each reaches in it."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        for x in (a, b, before[a], before[b]):
            np.minimum.at(root, x, least)
        root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """The same components with each of ``parts`` tasks' edges replaced by stars to the smallest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows:
            node, root = local_roots(np.asarray(rows["u"]), np.asarray(rows["v"]))
            far = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["u", "v"])

    return edges.select("u", "v").repartition(parts).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, root): root is the smallest node reachable; only nodes with an edge.

    Tasks contract up to ``edges_per_task`` edges each; what more than one task had is joined up
    by alternating large-star and small-star steps until nothing changes.
    """
    shared_dir(edges.sparkSession)
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Each neighbour of u (large: each larger one) is linked to the smallest of u and its neighbours."""
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        moved = both.join(low, "u")
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")) if large else moved.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    parts = -(-edges.count() // edges_per_task)
    edges = contracted(edges, max(1, parts)).checkpoint()
    now, before = state(edges) if parts > 1 else None, None
    while now != before:
        edges = star(star(edges, True), False).checkpoint()
        before, now = now, state(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def between_parts(members: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two sides of a join that looks for links between the parts of a bucket: members (``keys``, part, ...) with ``largest``.

    Buckets of one part are left out.  The members of a bucket's largest part stand in the second
    side only, so that one stranger in a bucket isn't the reason to pair a large part with itself.
    """
    several = members.groupBy(*keys).agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(*keys)
    members = written(members.join(several, keys), "parts")
    sizes = members.groupBy(*keys, "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy(*keys).agg(F.max(F.struct("n", "part")).alias("most")).select(*keys, F.col("most.part").alias("largest"))
    members = written(members.join(largest, keys), "parts")
    return members.where("part != largest"), members
