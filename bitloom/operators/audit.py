"""Audits of sets of compressed objects: size statistics, total joins, set comparisons, selection plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DuplicateKey, MissingKey
from ..plans.tables import running_sum


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., count, mean, std, min, p05, median, p95, p99, max): population deviation, linear percentiles; nulls are left out.

    Percentiles come from counts per distinct value and their running sums over range partitions, so no task holds the
    values of a group; only four pairs of values a group are aggregated.
    """
    by, names = by or [], {"p05": 0.05, "median": 0.5, "p95": 0.95, "p99": 0.99}
    totals = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(value).cast("long").alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    at = {n: (F.col("n") - 1) * F.lit(p) for n, p in names.items()}
    held = lambda r: F.max(F.when((r >= F.col("to") - F.col("c")) & (r < F.col("to")), F.col(value).cast("double")))
    ends = [held(f(x)).alias(f"_{k}_{n}") for n, x in at.items() for k, f in (("low", F.floor), ("high", F.ceil))]
    found = _places(df, value, by).groupBy(*by).agg(F.max("n").alias("n"), *ends)
    between = lambda n: F.when(F.floor(at[n]) == F.ceil(at[n]), F.col(f"_low_{n}")).otherwise((F.ceil(at[n]) - at[n]) * F.col(f"_low_{n}") + (at[n] - F.floor(at[n])) * F.col(f"_high_{n}"))
    found = found.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *[between(n).alias(n) for n in names])
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    found, same = (found, same) if by else (F.broadcast(found), F.lit(True))  # without groups it is one row
    return totals.join(found, same, "left").select(*by, "count", "mean", "std", "min", *names, "max")


def _places(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, c, to, n): each distinct value with its count, the number of its group's values up to it, and of all of them.

    One running sum over all groups in a global order, so a group of any size is spread over range partitions.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    ranked = running_sum(counts, [F.col(c) for c in [*by, value]], F.col("c"), "to")
    groups = ranked.groupBy(*by).agg(F.min(F.col("to") - F.col("c")).alias("_start"), F.sum("c").alias("n"))
    groups = groups.withColumnsRenamed({b: f"_by{i}" for i, b in enumerate(by)})
    same = [F.col(b).eqNullSafe(F.col(f"_by{i}")) for i, b in enumerate(by)]
    groups, same = (groups, same) if by else (F.broadcast(groups), F.lit(True))  # without groups it is one row
    return ranked.join(groups, same).select(*by, value, "c", (F.col("to") - F.col("_start")).alias("to"), "n")


def totals_of(raw: str, size: str, paired: str) -> list[Column]:
    """Aggregates: byte totals, saving of the totals, expansions, and the same over rows with a paired size that isn't 0."""
    has = F.coalesce(F.col(paired) != 0, F.lit(False))
    total = lambda c, cond=None: F.coalesce(F.sum(F.when(cond, F.col(c)) if cond is not None else F.col(c)), F.lit(0))
    return [
        F.count(F.lit(1)).cast("long").alias("images"),
        total(raw).cast("long").alias("raw_bytes"),
        total(size).cast("long").alias("compressed_bytes"),
        F.when(total(raw) > 0, 100 * (1 - total(size) / total(raw))).alias("saving_raw_pct"),
        F.count_if(F.col(size) > F.col(raw)).cast("long").alias("expansions"),
        F.count_if(has).cast("long").alias("paired"),
        total(paired, has).cast("long").alias("paired_bytes"),
        F.when(total(paired, has) > 0, 100 * (1 - total(size, has) / total(paired, has))).alias("saving_paired_pct"),
    ]


def summarize(df: DataFrame, raw: str = "raw_bytes", size: str = "igd_bytes", paired: str = "png_bytes", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*totals_of(raw, size, paired))


def families(df: DataFrame, split: str, partition: str, low: Column, aggregates: list[Column]) -> DataFrame:
    """The aggregates for all rows, each split, each partition, and each side of a threshold overall and by partition.

    One pass over the input by grouping sets; ``family`` names the set, null columns aren't part of it.
    """
    own = df.withColumns({"_low": F.when(low, "K<k").otherwise("K>=k")}).withColumnsRenamed({split: "_split", partition: "_partition"})
    cols = [F.col("_split"), F.col("_partition"), F.col("_low")]
    s, p, k = cols
    out = own.groupingSets([[], [s], [p], [k], [p, k]], *cols).agg(F.grouping_id().alias("_g"), *aggregates)
    family = F.when(F.col("_g") == 7, "all").when(F.col("_g") == 3, "split").when(F.col("_g") == 5, "partition").when(F.col("_g") == 6, "threshold").otherwise("partition/threshold")
    rest = [c for c in out.columns if c not in ("_split", "_partition", "_low", "_g")]
    return out.select(family.alias("family"), s.alias(split), p.alias(partition), k.alias("side"), *rest)


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table, if no key occurs twice; an error (when the plan runs) otherwise."""
    spoiled = df.groupBy(*keys).count().where("count > 1").limit(1)
    if row := spoiled.first():
        raise DuplicateKey(f"{[row[k] for k in keys]} occurs {row['count']} times")
    return df


def total_join(left: DataFrame, right: DataFrame, keys: list[str], equal: dict[str, str] | None = None) -> DataFrame:
    """An inner join in which every left row must find exactly one partner; ``equal`` pairs columns that must agree."""
    unique(right, keys)
    if row := left.join(right, keys, "left_anti").select(*keys).first():
        raise MissingKey(f"no partner for {list(row)}")
    joined = left.join(right, keys)
    for a, b in (equal or {}).items():
        joined = joined.withColumn(a, F.when(F.col(a).eqNullSafe(F.col(b)), F.col(a)).otherwise(F.raise_error(F.lit(f"{a} differs from {b}")).cast(dict(joined.dtypes)[a])))
    return joined


def with_optional(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join; rows without a partner keep nulls."""
    return left.join(right, keys, "left")


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right, keys, "left_anti")


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): distinct keys of one side only."""
    a, b = left.select(key), right.select(key)
    return a.subtract(b).select(F.lit("left only").alias("side"), key).unionByName(b.subtract(a).select(F.lit("right only").alias("side"), key))


def same_set(left: DataFrame, right: DataFrame, key: str) -> bool:
    return differences(left, right, key).isEmpty()


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as bags of rows."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def argmax_per_scale(df: DataFrame, scales: str, path: str, limit: int = 255) -> DataFrame:
    """(s, zmax, path, overflows): of each scale the largest z, where it is (the first path of equals) and how many exceed a limit.

    ``scales`` is an array column indexed by the scale.
    """
    each = df.select(path, F.posexplode(scales).alias("s", "z"))
    w = each.groupBy("s").agg(F.max("z").alias("zmax"), F.count_if(F.col("z") > limit).cast("long").alias("overflows"), F.min_by(path, F.struct(-F.col("z"), F.col(path))).alias(path))
    return w.select("s", "zmax", path, "overflows")


def common_scale(df: DataFrame, scale: str, path: str) -> DataFrame:
    """(scale, path, unfit): the largest scale that fits all, the object that limits it, and how many fit none (null)."""
    return df.agg(F.min(scale).alias("scale"), F.min_by(path, F.when(F.col(scale).isNotNull(), F.struct(scale, path))).alias(path), F.count_if(F.col(scale).isNull()).cast("long").alias("unfit"))


def nearest_rank(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., p, value): the element at position round((n - 1) * p) of the ascending order, halves to even.

    The order is by value; where values tie, any of them is the same. Counting per distinct value keeps a hot value small.
    """
    by = by or []
    each = _places(df, value, by).withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in shares])))
    at = F.rint((F.col("n") - 1) * F.col("p"))
    return each.where((at >= F.col("to") - F.col("c")) & (at < F.col("to"))).select(*by, "p", value)


def plan(images: DataFrame, known: DataFrame, key: str, least: int, skip: DataFrame | None = None) -> DataFrame:
    """images with ``action``: skip what is done, copy what has enough bases, recompress what has too few, compress the rest."""
    own = images.join(known.select(key, F.col("k").alias("original_k")), key, "left")
    if skip is not None:
        own = own.join(skip.select(key).distinct().withColumn("_done", F.lit(True)), key, "left")
    else:
        own = own.withColumn("_done", F.lit(None).cast("boolean"))
    action = F.when(F.col("_done"), "skip").when(F.col("original_k").isNull(), "compress").when(F.col("original_k") >= least, "copy").otherwise("recompress")
    return own.withColumn("action", action).drop("_done")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("count"))


def label_index(df: DataFrame, batch: str, index: str, name: str = "global_index") -> DataFrame:
    """Rows numbered across batches: the sizes of the batches before, plus the place in the own one.

    Sizes come from one aggregation over the few batches, so no window runs over all rows.
    """
    w = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).select(batch, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    return df.join(sizes, batch).withColumn(name, (F.col("_start") + F.col(index)).cast("long")).drop("_start")


def checked_artifacts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Rows that break a rule, with the names of the rules."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)
