"""Near-duplicate embeddings within labels (operator 4).

Spherical k-means is fitted on a bounded sample and assigns every vector to the cell of its nearest
centroid; vectors are compared by blocked cosine products within cells. A vector y of cell b is also a guest in
each cell a < b that can hold a partner: <x,a> >= <x,b> and |x - y| <= delta give
<y,b> - <y,a> <= delta * |a - b|, where delta = sqrt(2 - 2 * threshold). So no pair is lost at cell borders.

Equal vectors are one class with a number of its own and a count. Tasks give sums of counts and a spanning star per component
rather than pairs; hot cells are dealt out as pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, load, slices
from .components import connected, roots
from .vectors import matrix, sample, usable


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centroids; empty cells take the vectors that fit worst."""
    x, rnd = unit(x), np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rnd.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        s = x @ c.T
        cell = s.argmax(1)
        new = np.zeros_like(c)
        np.add.at(new, cell, x)
        empty = np.flatnonzero(np.linalg.norm(new, axis=1) < 1e-12)
        new[empty] = x[np.argsort(s.max(1))[: len(empty)]]
        c = unit(new)
    return c


def _placed(classes: DataFrame, centroids: np.ndarray, threshold: float) -> DataFrame:
    """c, label, n, v, cell, home: once for the own cell and once for each cell where it is a guest."""
    delta = (2 - 2 * threshold) ** 0.5 + 1e-9
    apart = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0)) + 1e-7  # centroids are unit vectors
    d = centroids.shape[1]

    def run(batches):
        for batch in slices(batches, 1024):
            x = unit(matrix(batch.column(3)))
            s = x @ centroids.T
            own = s.argmax(1)
            slack = s[np.arange(len(x)), own][:, None] - s
            there = (slack <= delta * apart[own] + 1e-9) & (np.arange(len(centroids)) <= own[:, None])
            there[np.arange(len(x)), own] = True
            row, cell = np.nonzero(there)
            taken = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.astype(np.int32)), pa.array(own[row] == cell)], names=["c", "label", "n", "v", "cell", "home"])

    return classes.where(F.col("d") == d).select("c", "label", "n", "v").mapInArrow(run, "c long, label string, n long, v binary, cell int, home boolean")


def _compared(placed: DataFrame, threshold: float, block: int) -> DataFrame:
    """(a, b, links): a star edge where b isn't null, else links that a has in one pair of blocks."""
    both = ["label", "cell"]
    t = F.pmod(F.xxhash64(*both), F.lit(97)).alias("t")  # a second key that follows from the first: both sides are dealt anew, and can be split
    sizes = placed.groupBy(*both).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).select("*", t)
    own = placed.select("*", t).join(sizes, [*both, "t"]).withColumn("k", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*both, F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "c", "n", "v", "home")

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        k, c, n, home = (table.column(x).to_numpy() for x in ("k", "c", "n", "home"))
        x = matrix(table.column("v"))
        x = x / np.abs(x).max(1, keepdims=True)  # no overflow in squares
        norm = np.sqrt((x * x).sum(1))
        left, right = np.flatnonzero(k == i), np.flatnonzero(k == j)
        links, a, b = np.zeros(len(c), np.int64), [], []
        for s in range(0, len(left), 512):
            rows = left[s : s + 512]
            near = (x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right][None]) >= threshold
            near &= home[rows][:, None] | home[right][None]
            if i == j:
                near &= rows[:, None] < right[None]
            p, q = np.nonzero(near)
            np.add.at(links, rows[p], n[right[q]])
            np.add.at(links, right[q], n[rows[p]])
            if len(p):
                nodes, root = roots(c[rows[p]], c[right[q]])
                a.append(nodes[nodes != root])
                b.append(root[nodes != root])
        some = np.flatnonzero(links)
        a, b = [np.concatenate([*z, np.zeros(0, np.int64)]) for z in (a, b)]
        return pa.table({"a": np.concatenate([c[some], a]), "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]), "links": np.concatenate([links[some], np.zeros(len(a), np.int64)])})

    return dealt.groupBy(*both, "i", "j").applyInArrow(run, "a long, b long, links long")


def _linked(classes: DataFrame, d: int, n: int, most: int, threshold: float, cell_rows: int, most_cells: int, fit_rows: int, block: int) -> DataFrame:
    """What ``_compared`` finds among the classes of vectors of length d: n in all, at most ``most`` with one label."""
    same = classes.where(F.col("d") == d)
    k = min(most_cells, most // cell_rows)
    x = sample(same, max(fit_rows, 8 * k), n).reshape(-1, d) if k > 1 else np.zeros((0, d))
    centroids = spherical_kmeans(x, k) if len(x) else np.eye(1, d)
    return _compared(_placed(same, centroids, threshold), threshold, min(block, max(512, (1 << 25) // (8 * d))))


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, cell_rows: int = 8192, most_cells: int = 16_384, fit_rows: int = 16_384, block: int = 8192) -> DataFrame:
    """id, n_links, component_id, kept of every row.

    Rows link if their labels are equal and not null and their cosine in double precision reaches the threshold (a pair exactly
    at it links); vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with
    nothing (component_id is the own id). Vectors of different lengths never link. Every row is a node of its own,
    repeated rows and rows that share an id too; component_id is the smallest id among the rows that links reach, and kept marks
    the rows whose own id that is. Vectors may be of any length: a block holds fewer of longer ones. Other columns are ignored,
    whatever their names; an empty table gives an empty table.

    Cells are sized by the largest label, as vectors meet within labels only. ``fit_rows`` (or eight for each cell) bounds the sample
    that k-means sees, not what is compared; beyond ``most_cells`` cells grow and are dealt in more pairs of blocks.
    """
    own = cut(usable(df, id_col, vec_col, label_col))
    valid = own.where("v is not null and id is not null")
    classes = cut(valid.groupBy("key").agg(F.min("rid").alias("c"), F.min("id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("d").alias("d"), F.first("v").alias("v")))
    found = None
    for r in classes.groupBy("d", "label").count().groupBy("d").agg(F.sum("count").alias("n"), F.max("count").alias("most")).collect():  # usually a single length
        part = _linked(classes, r.d, r.n, r.most, threshold, cell_rows, most_cells, fit_rows, block)
        found = part if found is None else cut(found.unionByName(part))
    if found is None:
        found = df.sparkSession.createDataFrame([], "a long, b long, links long")
    found = cut(found)
    links = found.where("b is null").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("links"))
    linked = connected(found.where("b is not null")).withColumnRenamed("node", "c")
    members = classes.select("key", "c", "low", "n").join(linked, "c", "left")
    lowest = members.where("component is not null").groupBy("component").agg(F.min("low").alias("top"))
    t = F.pmod(F.crc32("key"), F.lit(97)).alias("t")
    known = members.join(lowest, "component", "left").join(links, "c", "left")
    # equal vectors link with each other, so without other links their smallest id is that of the class
    known = known.select("key", t, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("top", "low").alias("component_id"))
    joined = valid.select("id", "key", t).join(known, ["key", "t"]).select("id", "n_links", "component_id")
    lone = own.where("v is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionByName(lone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(load(spark, sf_dir, "embeddings"))
