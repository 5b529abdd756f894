"""How many distinct values the first j bits of an order take, for every j at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import LIMB, gathered


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first differing bit of each pair of rows of words, from the most significant of LIMB bits; -1 if none."""
    out = np.full(len(a), -1, np.int64)
    for w in range(a.shape[1] - 1, -1, -1):
        x = (a[:, w] ^ b[:, w]).astype(np.uint64)
        some = x > 0
        high, length = x.copy(), np.zeros(len(x), np.int64)
        for s in (32, 16, 8, 4, 2, 1):
            big = high >> np.uint64(s) > 0
            length += np.where(big, s, 0)
            high = np.where(big, high >> np.uint64(s), high)
        out = np.where(some, w * LIMB + LIMB - 1 - length, out)
    return out


def k_profile(bits: DataFrame, order: list[int]) -> list[int]:
    """[K(0), ..., K(len(order))]: distinct values of each prefix of the order; [0, ...] of no rows.

    One distinct (partial on the map side, so that a hot row costs nothing), one range partitioning, and a
    comparison of neighbours within each partition. A pair whose first difference is bit i makes all prefixes longer
    than i one value richer. Counts and the first and last row of each partition reach the driver.
    """
    words = [w.alias(f"k{i}") for i, w in enumerate(gathered(order))]
    names = [f"k{i}" for i in range(len(words))]
    keys = bits.select(*words).distinct().repartitionByRange(*names).sortWithinPartitions(*names)

    def run(batches):
        counts, first, last = np.zeros(len(order) + 1, np.int64), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.stack([np.asarray(c) for c in batch.columns], 1)
            rows = a if last is None else np.concatenate([last[None], a])
            d = _first_difference(rows[:-1], rows[1:])
            counts += np.bincount(d[d >= 0], minlength=len(order) + 1)[: len(order) + 1]
            first, last = a[0] if first is None else first, a[-1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist()], pa.list_(pa.int64())) for x in (counts, first, last)], names=["counts", "first", "last"])

    parts = keys.mapInArrow(run, "counts array<long>, first array<long>, last array<long>").collect()
    if not parts:
        return [0] * (len(order) + 1)
    parts.sort(key=lambda r: list(r.first))
    counts = np.sum([r.counts for r in parts], axis=0)
    for a, b in zip(parts, parts[1:]):
        d = _first_difference(np.array([a.last]), np.array([b.first]))[0]
        counts[d] += d >= 0
    return (1 + np.concatenate([[0], np.cumsum(counts[:-1])])).tolist()


def k_profile_frame(bits: DataFrame, order: list[int]) -> DataFrame:
    """k_profile as (j, k)."""
    return bits.sparkSession.createDataFrame(list(enumerate(k_profile(bits, order))), "j int, k long")


def k_profile_approx(bits: DataFrame, order: list[int], rsd: float = 0.05) -> list[int]:
    """The same by HyperLogLog sketches, all prefixes in one aggregation without a shuffle of rows."""
    words = gathered(order)
    keys = bits.select(*[w.alias(f"k{i}") for i, w in enumerate(words)])
    aggs = [F.count(F.lit(1)).alias("n")]
    for j in range(1, len(order) + 1):
        full, part = divmod(j, LIMB)
        cols = [F.col(f"k{i}") for i in range(full)]
        if part:
            cols.append(F.col(f"k{full}").bitwiseAND(F.lit(((1 << part) - 1) << (LIMB - part))))
        aggs.append(F.approx_count_distinct(cols[0] if len(cols) == 1 else F.struct(*cols), rsd).alias(f"j{j}"))
    row = keys.agg(*aggs).first()
    return [min(1, row.n), *[max(min(1, row.n), min(row.n, row[f"j{j}"])) for j in range(1, len(order) + 1)]]


def precision(exact: list[int], approx: list[int]) -> list[dict]:
    """Absolute and relative error of each step."""
    return [{"j": j, "exact": k, "approx": a, "abs_error": abs(a - k), "rel_error": (a - k) / k if k else 0.0} for j, (k, a) in enumerate(zip(exact, approx))]


def precision_summary(steps: list[dict]) -> dict:
    """Mean absolute percentage error, root mean square error and bias over the steps whose exact count isn't 1."""
    own = [s for s in steps if s["exact"] > 1]
    if not own:
        return {"steps": 0, "mape": 0.0, "rmse": 0.0, "bias": 0.0}
    n = len(own)
    return {
        "steps": n,
        "mape": 100 * sum(abs(s["rel_error"]) for s in own) / n,
        "rmse": (sum((s["approx"] - s["exact"]) ** 2 for s in own) / n) ** 0.5,
        "bias": sum(s["approx"] - s["exact"] for s in own) / n,
    }
