"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _stars(a: np.ndarray, b: np.ndarray):
    """One edge (child, root) for each node that isn't a root."""
    nodes, root = roots(a, b)
    keep = nodes != root
    return nodes[keep], root[keep]


def _contract(batches, most: int = 1_000_000):
    """Edges of one task become stars; of more than ``most`` edges the stars so far are contracted, and sent on if still as many."""
    a, b, held = [], [], 0

    def out(child, parent):
        for s in range(0, len(child), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(child[s : s + 100_000]), pa.array(parent[s : s + 100_000])], names=["child", "parent"])

    for batch in batches:
        a.append(np.asarray(batch.column(0)))
        b.append(np.asarray(batch.column(1)))
        held += batch.num_rows
        if held > most:
            child, parent = _stars(np.concatenate(a), np.concatenate(b))
            if len(child) > most // 2:
                yield from out(child, parent)
                child, parent = child[:0], parent[:0]
            a, b, held = [child], [parent], len(child)
    if held:
        yield from out(*_stars(np.concatenate(a), np.concatenate(b)))


def connected(edges: DataFrame, rounds: int = 40, task_rows: int = 250_000) -> DataFrame:
    """(node, component) for all nodes of edges (a, b) of longs; component is the smallest node reachable.

    Edges are dealt by their larger node, and each task contracts its own to stars, so a node has at most one
    parent per task and no task ever gathers the larger neighbours of a hub. Rounds of regrouping by child and
    pointer jumping follow until the forest is flat, in as many tasks as the contracted edges need. Only
    counts reach the driver.
    """
    schema = "child long, parent long"
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    oriented = edges.select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).where("child != parent")
    forest = cut(oriented.repartition("child").mapInArrow(_contract, schema))
    tasks = max(8, -(-forest.count() // task_rows))
    for _ in range(rounds):
        up = forest.select(F.col("child").alias("parent"), F.col("parent").alias("above"))
        jumped = forest.join(up, "parent", "left").select("child", "parent", "above").coalesce(tasks)
        several = forest.groupBy("child").agg(F.count(F.lit(1)).alias("n")).coalesce(tasks).where("n > 1")
        if jumped.where("above is not null").isEmpty() and several.isEmpty():
            tops = forest.select(F.col("parent").alias("node"), F.col("parent").alias("component")).distinct()
            return forest.select(F.col("child").alias("node"), F.col("parent").alias("component")).unionByName(tops)
        # a jump keeps what it jumped from: the edge from parent to above is a row of its own
        shorter = jumped.select("child", F.coalesce("above", "parent").alias("parent"))
        forest = cut(shorter.unionByName(forest).repartition("child").coalesce(tasks).mapInArrow(_contract, schema))
    raise RuntimeError("components did not settle")
