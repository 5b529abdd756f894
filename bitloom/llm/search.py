"""Nearest neighbours by additive quantisation (operator 9).

A vector is stored as the sum of one full-dimensional codeword from each of several codebooks, found by a
beam search, and the squared norm of that sum. Codebooks start from residual k-means and are refitted by least
squares to the codes of the beam search. A query scores rows by look-up tables of its scalar products with all
codewords and the stored norms. The best of each block are ranked by exact distances; then every other row is ranked
too, unless a bound from its score and its quantisation error, or its scalar product, proves that it is farther.
Equal vectors are one indexed row that carries its smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, load
from .vectors import matrix, sample, usable


def _smallest(ids: list, k: int) -> list:
    """The 2 k smallest ids, none more than k times: without any one of them k are left, if there are so many."""
    ids = sorted(ids)
    return [x for n, x in enumerate(ids) if n < k or ids[n - k] != x][: 2 * k]


def classes(rows: DataFrame, k: int) -> DataFrame:
    """key, d, v, ids of every distinct vector, with its smallest ids.

    Equal vectors meet within batches first, so the task of one that is very common gets short lists.
    """

    def run(batches):
        for batch in batches:
            ids, first = {}, {}
            for n, (key, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist())):
                ids.setdefault(key, []).append(i)
                first.setdefault(key, n)
            one = batch.take(pa.array(list(first.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([_smallest(x, k) for x in ids.values()], pa.list_(pa.int64()))], names=["key", "d", "v", "ids"])

    parts = rows.select("key", "d", "v", "id").mapInArrow(run, "key binary, d int, v binary, ids array<long>")
    met = parts.groupBy("key").agg(F.first("d").alias("d"), F.first("v").alias("v"), F.array_sort(F.flatten(F.collect_list("ids"))).alias("ids"))
    return met.withColumn("ids", F.slice(F.filter("ids", lambda x, n: (n < k) | (F.get(F.col("ids"), n - k) != x)), 1, 2 * k))


def _kmeans(x: np.ndarray, k: int, rnd, rounds: int = 8) -> np.ndarray:
    c = x[rnd.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


class AdditiveQuantizer:
    """books (m, k, d); vectors are scaled by one factor so that large components don't overflow."""

    def __init__(self, x: np.ndarray, m: int = 4, k: int = 256, beam: int = 4, rounds: int = 2, seed: int = 9):
        rnd = np.random.default_rng(seed)
        self.scale = float(np.abs(x).max()) or 1.0
        x = x / self.scale
        k = min(k, max(1, len(x)))
        self.beam, rest, books = beam, x.copy(), []
        for _ in range(m):
            c = _kmeans(rest, k, rnd)
            books.append(c)
            rest = rest - c[((c * c).sum(1) - 2 * (rest @ c.T)).argmin(1)]
        self._set(np.stack(books))
        for _ in range(rounds):
            codes = self.encode(x * self.scale)[0]
            hot = np.zeros((len(x), m * k))
            hot[np.arange(len(x))[:, None], codes + np.arange(m) * k] = 1
            fitted = np.linalg.solve(hot.T @ hot + 1e-3 * np.eye(m * k), hot.T @ x + 1e-3 * self.books.reshape(m * k, -1))
            self._set(fitted.reshape(m, k, -1))

    def _set(self, books: np.ndarray) -> None:
        self.books = books
        flat = books.reshape(-1, books.shape[2])
        self.gram, self.norms = flat @ flat.T, (books**2).sum(2)
        self.reach = float(np.sqrt(self.norms.max(1)).sum())

    def errors(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of the scaled vectors to their sums of codewords, rounded up."""
        rest = x / self.scale
        for j in range(len(self.books)):
            rest = rest - self.books[j][codes[:, j]]
        return np.sqrt((rest * rest).sum(1)) * (1 + 1e-9) + 1e-12 * self.reach

    def least(self, q: np.ndarray, scores: np.ndarray, errors: np.ndarray) -> np.ndarray:
        """(queries, rows): what distances are at least, by the triangle inequality and with a margin for rounding."""
        norm = ((q / self.scale) ** 2).sum(1)[:, None]
        margin = 1e-12 * (np.sqrt(norm) + self.reach) ** 2
        return (np.sqrt(np.maximum(norm + scores - margin, 0)) - errors[None]) * (self.scale * (1 - 1e-9))

    def encode(self, x: np.ndarray, rows: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, m) and squared norms of the sums, by beam search over the codebooks in their order."""
        m, k, _ = self.books.shape
        codes, norms = np.zeros((len(x), m), np.int64), np.zeros(len(x))
        for s in range(0, len(x), rows):
            y = x[s : s + rows] / self.scale
            dot = (y @ self.books.reshape(m * k, -1).T).reshape(len(y), m, k)
            beams, cost = np.zeros((len(y), 1, 0), np.int64), np.zeros((len(y), 1))
            at = np.arange(len(y))[:, None]
            for j in range(m):
                # cost of adding a word: its norm, minus twice its product with y, plus twice with the words so far
                more = np.repeat((self.norms[j][None] - 2 * dot[:, j])[:, None], beams.shape[1], 1) + cost[:, :, None]
                for i in range(j):
                    more += 2 * self.gram[i * k : (i + 1) * k, j * k : (j + 1) * k][beams[:, :, i]]
                flat = more.reshape(len(y), -1)
                b = min(self.beam, flat.shape[1])
                best = np.argpartition(flat, b - 1, 1)[:, :b]
                cost = flat[at, best]
                beams = np.concatenate([beams[at, best // k], (best % k)[:, :, None]], 2)
            win = cost.argmin(1)
            one = np.arange(len(y))
            codes[s : s + rows] = beams[one, win]
            # cost = |sum|^2 - 2 y sum, so the norm follows
            norms[s : s + rows] = cost[one, win] + 2 * sum(dot[one, j, beams[one, win, j]] for j in range(m))
        return codes, norms

    def scores(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """(queries, rows): squared distances to the quantised rows, short of the query's own norm."""
        tables = np.einsum("qd,mkd->mqk", q / self.scale, self.books)
        out = np.repeat(norms[None], len(q), 0)
        for j in range(len(self.books)):
            out -= 2 * tables[j][:, codes[:, j]]
        return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of q (n, d) and x (n, r, d), summed in the order of the components."""
    total = np.zeros(x.shape[:2])
    for j in range(q.shape[1]):
        diff = x[:, :, j] - q[:, None, j]
        total += diff * diff
    return np.sqrt(total)


def index(rows: DataFrame, quantizer: AdditiveQuantizer, blocks: int) -> DataFrame:
    """v, ids, codes, norm, error, block of every distinct vector."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                codes, norms = quantizer.encode(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), pa.array(norms), pa.array(quantizer.errors(x, codes))], names=["v", "ids", "codes", "norm", "error"])

    return rows.select("v", "ids").mapInArrow(run, "v binary, ids array<long>, codes binary, norm double, error double").withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))


def search(df: DataFrame, every: int = 100, k: int = 10, shortlist: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 4096, block_queries: int = 1024, fit_rows: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by ``every``.

    Distances are Euclidean, in double precision, on the original vectors; ties go to the smaller id. A query's
    own id is no candidate. Null ids and vectors that are null, empty, zero or hold null or non-finite components take
    no part, and only vectors of one length meet. Queries go in blocks against blocks of all rows; in each, the
    ``shortlist`` best by look-up give a distance within which the k nearest lie, and all rows not proven to be farther
    are ranked, so the result is exact; the shortlist only sets the work. Rows that share an id are candidates each for
    itself. Equal vectors are one row of a block and are told apart by their ids at the end. The quantiser sees a
    bounded sample; every vector is indexed.
    """
    valid = lambda x: usable(x, id_col, vec_col).where("v is not null and id is not null")
    own = cut(classes(valid(df), k))
    asked = cut(valid(df.where(F.col(id_col).cast("long") % every == 0)).select("id", "d", "v"))
    spark, out = df.sparkSession, None
    for r in own.groupBy("d").agg(F.count(F.lit(1)).alias("n")).join(asked.groupBy("d").agg(F.count(F.lit(1)).alias("q")), "d").collect():
        same = own.where(F.col("d") == r.d)
        quantizer = AdditiveQuantizer(sample(same, fit_rows, r.n).reshape(-1, r.d) if r.n > 64 else matrix_of(same, r.d))
        blocks, groups = -(-r.n // block_rows), -(-r.q // block_queries)
        rows = index(same, quantizer, blocks).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        queries = asked.where(F.col("d") == r.d).select("id", "v", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("g")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        part = queries.groupBy("g", "block").cogroup(rows.groupBy("g", "block")).applyInArrow(_meeting(quantizer, k, shortlist), "query_id long, vec_id long, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")


def matrix_of(rows: DataFrame, d: int) -> np.ndarray:
    """All vectors of a table of at most 64 rows."""
    return np.frombuffer(b"".join(sorted(bytes(r.v) for r in rows.select("v").limit(64).collect())), np.float64).reshape(-1, d)


def _within(q: np.ndarray, x: np.ndarray, most: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and distance of all pairs in ``maybe`` (queries, rows) that are at most ``most`` (queries) apart."""
    some = np.flatnonzero(maybe.any(0))
    top = max(np.abs(q).max(), np.abs(x).max())
    u, w = q / top, x[some] / top
    norms = (u * u).sum(1)[:, None] + (w * w).sum(1)[None]
    far = norms - 2 * (u @ w.T) > ((most / top) ** 2 * (1 + 1e-9))[:, None] + 1e-12 * norms + 1e-300
    a, b = np.nonzero(maybe[:, some] & ~far)
    b = some[b]
    d = np.concatenate([np.zeros(0), *(distances(q[a[s : s + 32_768]], x[b[s : s + 32_768], None])[:, 0] for s in range(0, len(a), 32_768))])
    ok = d <= most[a]
    return a[ok], b[ok], d[ok]


def _meeting(quantizer: AdditiveQuantizer, k: int, shortlist: int):
    """The best rows of a block for each query of a group."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not rows.num_rows:
            return empty
        q, x = matrix(queries.column("v")), matrix(rows.column("v"))
        qid, lists = queries.column("id").to_numpy(), rows.column("ids").combine_chunks()
        ids, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        sizes = np.diff(ends, prepend=0)
        holder, by_id = np.repeat(np.arange(len(x)), sizes), np.argsort(ids, kind="stable")
        codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
        norms, errors, parts = rows.column("norm").to_numpy(), rows.column("error").to_numpy(), []
        for s in range(0, len(q), 128):
            part = slice(s, s + 128)
            left = np.repeat(sizes[None], len(q[part]), 0)  # ids of each row without the query's own
            first, last = (np.searchsorted(ids, qid[part], side, by_id) for side in ("left", "right"))
            for i in np.flatnonzero(first < last):
                np.subtract.at(left[i], holder[by_id[first[i] : last[i]]], 1)
            score = quantizer.scores(q[part], codes, norms)
            n = min(max(k, shortlist), len(x))
            short = np.argpartition(np.where(left > 0, score, np.inf), n - 1, 1)[:, :n]
            weight, exact = np.take_along_axis(left, short, 1), distances(q[part], x[short])
            nearest = np.argsort(np.where(weight > 0, exact, np.inf), 1)
            enough = np.cumsum(np.take_along_axis(weight, nearest, 1), 1) >= k
            most = np.take_along_axis(np.take_along_axis(exact, nearest, 1), enough.argmax(1)[:, None], 1)[:, 0]
            most = np.where(enough[:, -1], most, np.inf)
            maybe = (left > 0) & ~(quantizer.least(q[part], score, errors) > most[:, None])
            a, b, d = _within(q[part], x, most, maybe)
            each = sizes[b]
            at = np.arange(each.sum()) + np.repeat(ends[b] - np.cumsum(each), each)
            a, d, v = np.repeat(a, each), np.repeat(d, each), ids[at]
            order = np.lexsort((v, d, a))
            order = order[v[order] != qid[part][a[order]]]
            a, d, v = a[order], d[order], v[order]
            ok = np.arange(len(a)) - np.searchsorted(a, a) < k
            parts.append((qid[part][a[ok]], v[ok], d[ok]))
        w, v, d = (np.concatenate(z) for z in zip(*parts))
        return pa.table({"query_id": w, "vec_id": v, "score": d})

    return run


def query(spark, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"))
