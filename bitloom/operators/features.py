"""Features of sorted dictionaries: ranks, deltas, cumulative maps, audits and pooled deltas, group by group."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, OutOfRange

LIMIT_U8, LIMIT_U16, LIMIT_U32 = 255, 65535, (1 << 32) - 1


def rank_delta(bases: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, rank, delta): ranks from 0 in ascending order, differences to the one before, 0 for the first.

    Values repeated within a group are an error; call it on distinct values.
    """
    w = Window.partitionBy(group).orderBy(value)
    delta = F.col(value) - F.lag(value).over(w)
    checked = F.when(delta == 0, F.raise_error(F.lit("a base occurs twice")).cast("long")).otherwise(F.coalesce(delta, F.lit(0)))
    return bases.select(group, value, (F.row_number().over(w) - 1).cast("long").alias("rank"), checked.cast("long").alias("delta"))


def normalized(ranked: DataFrame, group: str) -> DataFrame:
    """ranked with k, rank_norm = rank / (k - 1) and delta_norm = log2(1 + delta) / log2(1 + largest); 0 where undefined."""
    w = Window.partitionBy(group)
    k, top = F.count(F.lit(1)).over(w), F.max("delta").over(w)
    rank = F.when(k > 1, F.col("rank") / (k - 1)).otherwise(0.0)
    delta = F.when(top > 0, F.log2(1 + F.col("delta").cast("double")) / F.log2(1 + top.cast("double"))).otherwise(0.0)
    return ranked.select("*", k.cast("long").alias("k"), rank.alias("rank_norm"), delta.alias("delta_norm"))


def quantize_unit(x: Column) -> Column:
    """0..1 as 0..255, rounded half away from zero; other values are an error."""
    bad = x.isNull() | F.isnan(x) | (x < 0) | (x > 1)
    return F.when(bad, F.raise_error(F.lit("a value outside 0..1")).cast("int")).otherwise(F.round(255 * x).cast("int"))


def cumulative(norm: DataFrame, group: str, scale: int, floor: bool = False, limit: int | None = LIMIT_U16) -> DataFrame:
    """norm with z = rank + running sum of scale * delta_norm, each rounded (or floored); over ``limit`` is an error, if there is one."""
    w = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("delta_norm") * F.lit(float(scale))
    z = F.col("rank") + F.sum((F.floor(x) if floor else F.round(x)).cast("long")).over(w)
    return norm.withColumn("z", z if limit is None else F.when(z > limit, F.raise_error(F.lit(f"z over {limit}")).cast("long")).otherwise(z))


def largest_scale(a: np.ndarray, limit: int = LIMIT_U16, most: int = LIMIT_U16) -> int:
    """The largest whole S up to ``most`` with k - 1 + sum(floor(S * a)) <= limit; 0 of one base. The sum grows with S."""
    if len(a) - 1 > limit:
        raise OutOfRange(f"{len(a)} bases for a limit of {limit}")
    if len(a) <= 1:
        return 0
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        if len(a) - 1 + int(np.floor(mid * a).sum()) <= limit:
            low = mid
        else:
            high = mid - 1
    return low


def adaptive_scales(norm: DataFrame, group: str, limits: tuple[int, ...] = (LIMIT_U16,)) -> DataFrame:
    """(group, k, scale) by bisection for all groups at once: each round is an aggregation that is partial map-side.

    A group's limit is the first of ``limits``, ascending, that holds its ranks; more bases than the last one holds are an error.
    With A the sum of delta_norm, every scale up to (limit - k + 1) / A fits and none from (limit + 1) / A on, so few
    rounds remain. No group is ever gathered in one task; the table of groups carries its bounds from round to round.
    """
    from ..plans.tables import cut

    norm = cut(norm.select(group, "delta_norm"))
    k, a = F.col("k"), F.col("a")
    limit = F.raise_error(F.lit("too many bases")).cast("long")
    for most in reversed(limits):
        limit = F.when(k - 1 <= most, F.lit(most).cast("long")).otherwise(limit)
    bounds = norm.groupBy(group).agg(F.count(F.lit(1)).cast("long").alias("k"), F.sum("delta_norm").alias("a")).withColumn("limit", limit)
    top = F.greatest("limit", F.lit(LIMIT_U16).cast("long"))
    # a millionth more on either side than sums of doubles can be off
    low = F.when(a > 0, F.least(top, F.greatest(F.lit(0).cast("long"), F.floor((F.col("limit") - k + 1) / a * (1 - 1e-6)) - 1))).otherwise(top)
    high = F.when(a > 0, F.least(top, F.ceil((F.col("limit") + 1) / a * (1 + 1e-6)) + 1)).otherwise(top)
    bounds = cut(bounds.select(group, "k", "limit", *[F.when(k > 1, x).otherwise(0).cast("long").alias(n) for x, n in ((low, "low"), (high, "high"))]))
    for _ in range((bounds.agg(F.max(F.col("high") - F.col("low"))).first()[0] or 0).bit_length()):
        mid = F.floor((F.col("low") + F.col("high") + 1) / 2)
        tried = bounds.withColumn("mid", mid)
        sums = norm.join(tried.select(group, "mid"), group).groupBy(group).agg(F.sum(F.floor(F.col("mid") * F.col("delta_norm"))).alias("s"))
        ok = k - 1 + F.col("s") <= F.col("limit")
        bounds = cut(tried.join(sums, group).select(group, "k", "limit", F.when(ok, F.col("mid")).otherwise(F.col("low")).alias("low"), F.when(ok, F.col("high")).otherwise(F.greatest(F.col("low"), F.col("mid") - 1)).alias("high")))
    return bounds.select(group, "k", F.col("low").alias("scale"))


def adaptive(norm: DataFrame, group: str, limits: tuple[int, ...] = (LIMIT_U16,)) -> DataFrame:
    """norm with each group's largest scale and z = rank + running sum of floor(scale * delta_norm), up to its limit."""
    w = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    scaled = norm.join(adaptive_scales(norm, group, limits).drop("k"), group)
    return scaled.withColumn("z", F.col("rank") + F.sum(F.floor(F.col("scale") * F.col("delta_norm")).cast("long")).over(w))


def interleaved_key(value: Column, bits: int = 24) -> Column:
    """A base of three channels of eight bits with its bits dealt from the most significant of each channel on.

    Positions p, ascending, are the string's characters, first one most significant; they are reordered by (7 - p % 8, p / 8).
    """
    order = sorted(range(bits), key=lambda p: (7 - p % 8, p // 8))
    out = F.lit(0).cast("long")
    for k, p in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(value, p).bitwiseAND(F.lit(1).cast("long")), bits - 1 - k))
    return out


def audit(norm: DataFrame, group: str, scales: int = 17) -> DataFrame:
    """A row per group: k, delta_min, delta_max, mean delta_norm, whether all gaps are equal, zmax[S] for S < scales, and the
    largest S that fits 8 and 16 bits (null if not even 0 does; unbounded if every delta is 0)."""
    gaps = F.col("rank") > 0
    zmax = F.array(*[F.count(F.lit(1)) - 1 + F.sum(F.round(F.lit(float(s)) * F.col("delta_norm")).cast("long")) for s in range(scales)])
    out = norm.groupBy(group).agg(
        F.count(F.lit(1)).cast("long").alias("k"),
        F.min(F.when(gaps, F.col("delta"))).alias("delta_min"),
        F.max(F.when(gaps, F.col("delta"))).alias("delta_max"),
        F.avg(F.when(gaps, F.col("delta_norm"))).alias("delta_norm_mean"),
        zmax.alias("zmax"),
    )
    return out.withColumn("all_gaps_equal", F.coalesce(F.col("delta_min") == F.col("delta_max"), F.lit(False))).withColumn("unbounded", F.col("k") == 1)


def zmax(gaps: np.ndarray, scale: int) -> int:
    """The last z of a dictionary with these normalised gaps: their number plus the sum of scale * gap, rounded half up."""
    return len(gaps) + int(np.floor(scale * np.asarray(gaps, float) + 0.5).sum())


def largest_fitting(gaps: np.ndarray, limit: int, most: int = 1 << 20) -> int | None:
    """The largest S with zmax(gaps, S) <= limit, or None if there is none; ``most`` if every S fits."""
    if zmax(gaps, 0) > limit:
        return None
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if zmax(gaps, mid) <= limit else (low, mid - 1)
    return low


def pool(deltas: np.ndarray, bins: int = 256) -> np.ndarray:
    """Area averages of log2(1 + delta) / 24 in so many bins of equal width, with fractional edges; zeros of nothing."""
    x = np.log2(1 + np.asarray(deltas, float)) / 24
    if not len(x):
        return np.zeros(bins)
    total = np.concatenate([[0], np.cumsum(x)])
    edges = np.linspace(0, len(x), bins + 1)
    at = np.interp(edges, np.arange(len(x) + 1), total)
    return np.diff(at) / (len(x) / bins)


def pooled(ranked: DataFrame, group: str, bins: int = 256) -> DataFrame:
    """(group, bin, pooled): pool() of every group's gaps, by joining each gap to the bins it overlaps.

    Gap i covers [i, i + 1); bin b covers [b * n / bins, (b + 1) * n / bins). Groups of one base have zeros only.
    """
    if bins < 1:
        raise InvalidConfig("one bin at least")
    w = Window.partitionBy(group)
    gaps = ranked.select(group, "rank", "delta", (F.count(F.lit(1)).over(w) - 1).alias("n")).where("rank > 0")
    i, n = (F.col("rank") - 1).cast("double"), F.col("n")
    low = F.floor(i * bins / n).cast("int")
    high = F.least(F.ceil((i + 1) * bins / n).cast("int") - 1, F.lit(bins - 1))
    parts = gaps.select(group, "n", (F.log2(1 + F.col("delta").cast("double")) / 24).alias("x"), i.alias("i"), F.explode(F.sequence(F.greatest(low - 1, F.lit(0)), F.least(high + 1, F.lit(bins - 1)))).alias("bin"))
    left, right = F.greatest(F.col("i"), F.col("bin") * F.col("n") / bins), F.least(F.col("i") + 1, (F.col("bin") + 1) * F.col("n") / bins)
    sums = parts.withColumn("area", F.greatest(F.lit(0.0), right - left)).groupBy(group, "bin").agg((F.sum(F.col("x") * F.col("area")) * bins / F.first("n")).alias("pooled"))
    every = ranked.select(group).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(sums, [group, "bin"], "left").select(group, "bin", F.coalesce("pooled", F.lit(0.0)).alias("pooled"))


def spatial(rows: DataFrame, z: DataFrame, group: str, base: str, index: str, width: int) -> DataFrame:
    """(group, y, x, value): each pixel's z by its base, row-major."""
    joined = rows.select(group, index, base).join(z.select(group, base, "z"), [group, base])
    return joined.select(group, F.floor(F.col(index) / width).cast("int").alias("y"), F.pmod(F.col(index), F.lit(width)).cast("int").alias("x"), F.col("z").alias("value"))
