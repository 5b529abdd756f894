"""Statistics of single bits: counts, entropy, constants and orders of positions."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..layout import LIMB, BitLayout, bit


def ones(bits: DataFrame, layout: BitLayout, by: list[str] | None = None) -> DataFrame:
    """(by..., pos, ones, n): set bits of each position, from one aggregation that is partial on the map side."""
    by = by or []
    wide = bits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(bit(p)) for p in range(layout.bits)]).alias("c"))
    return wide.select(*by, "n", F.posexplode("c").alias("pos", "ones")).select(*by, "pos", F.coalesce("ones", F.lit(0)).cast("long").alias("ones"), F.col("n").cast("long").alias("n"))


def binary_entropy(ones_: Column, n: Column) -> Column:
    """Shannon entropy of a bit, 0 where it is constant."""
    p = ones_ / n
    return F.when((n > 0) & (ones_ > 0) & (ones_ < n), -p * F.log2(p) - (1 - p) * F.log2(1 - p)).otherwise(F.lit(0.0))


def entropy(bits: DataFrame, layout: BitLayout, by: list[str] | None = None) -> DataFrame:
    """ones() with the entropy of each position."""
    return ones(bits, layout, by).withColumn("entropy", binary_entropy(F.col("ones"), F.col("n")))


def polarity(bits: DataFrame, layout: BitLayout) -> DataFrame:
    """(pos, state): zero, one or varying, by bitwise and / or of all rows; of no rows all are zero."""
    row = bits.agg(*[f(F.col(b)).alias(f"{n}_{b}") for b in layout.limbs for n, f in (("all", F.bit_and), ("any", F.bit_or))])
    at = lambda kind, p: F.shiftright(F.coalesce(F.col(f"{kind}_b{p // LIMB}"), F.lit(0)), p % LIMB).bitwiseAND(F.lit(1).cast("long"))
    state = [F.when(at("all", p) == 1, "one").when(at("any", p) == 0, "zero").otherwise("varying") for p in range(layout.bits)]
    return row.select(F.posexplode(F.array(*state)).alias("pos", "state"))


def order(counts: DataFrame) -> list[tuple[int, int, int]]:
    """(position, ones, n) by ascending entropy, ties by position; at most one row per bit reaches the driver.

    The order is that of the integers min(ones, n - ones), which are monotone in the entropy and have exact ties.
    """
    rows = [(r.pos, r.ones, r.n) for r in counts.select("pos", "ones", "n").collect()]
    return sorted(rows, key=lambda r: (min(r[1], r[2] - r[1]), r[0]))


def value_of_entropy(ones_: int, n: int) -> float:
    if not 0 < ones_ < n:
        return 0.0
    p = ones_ / n
    return -p * math.log2(p) - (1 - p) * math.log2(1 - p)


def interleaved(counts: list[tuple[int, int, int]], layout: BitLayout) -> list[int]:
    """Constant positions first; then ever again the position of the highest entropy among the features' heads.

    Features are worked through from their most significant bit; of equals the larger position comes first.
    """
    weight = {p: min(k, n - k) for p, k, n in counts}
    out = sorted(p for p, w in weight.items() if w == 0)
    queues = [[p for p in range(f.offset + f.width - 1, f.offset - 1, -1) if weight[p]] for f in layout.features]
    heads = [(-weight[q[0]], -q[0], i, 0) for i, q in enumerate(queues) if q]
    heapq.heapify(heads)
    while heads:
        _, negative, i, k = heapq.heappop(heads)
        out.append(-negative)
        if k + 1 < len(queues[i]):
            p = queues[i][k + 1]
            heapq.heappush(heads, (-weight[p], -p, i, k + 1))
    return out


def frequencies(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, count) of each value; order by count descending and value for a report."""
    return df.groupBy(*(by or []), value).agg(F.count(F.lit(1)).cast("long").alias("count"))


def distribution_entropy(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, distinct, entropy) of a column's values, from one grouped count."""
    by = by or []
    counts = frequencies(df, value, by)
    # H = log2 n - sum(c log2 c) / n needs no second pass for n
    out = counts.groupBy(*by).agg(F.sum("count").cast("long").alias("n"), F.count(F.lit(1)).cast("long").alias("distinct"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    return out.select(*by, "n", "distinct", (F.log2("n") - F.col("s") / F.col("n")).alias("entropy"))
