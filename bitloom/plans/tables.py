"""Materialising intermediates, and ids in a global order without a single-task sort."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder of ``spark.checkpoint.dir``; only a single-machine session may go without one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise InvalidConfig("spark.checkpoint.dir: a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="bitloom-"))
    return df.checkpoint(eager=True)


def _ranged(df: DataFrame, order: list) -> DataFrame:
    """Range partitions, sorted each; ``_at`` has the partition above bit 33 and the place in it below."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))


def _starts(totals: dict[int, int]):
    """A column with the sum of all partitions before the row's own."""
    total, offsets = 0, {}
    for p in sorted(totals):
        offsets[p], total = total, total + totals[p]
    return F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv])[F.shiftright("_at", 33)]


def numbered(df: DataFrame, order: list, name: str = "id") -> DataFrame:
    """Consecutive numbers from 0 in a global order: range partitions, sorted each, with offsets from their counts.

    One row per partition reaches the driver.
    """
    ranged = _ranged(df, order)
    counts = {r.p: r["count"] for r in ranged.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()}
    if not counts:
        return ranged.withColumn(name, F.col("_at")).drop("_at")
    return ranged.withColumn(name, _starts(counts) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def running_sum(df: DataFrame, order: list, value, name: str) -> DataFrame:
    """The sum of a whole-numbered column up to and with each row, in a global order; nulls count as 0.

    Sums run within range partitions; the totals of the partitions before (one row each on the driver) are added.
    """
    ranged = _ranged(df.withColumn("_v", F.coalesce(value, F.lit(0)).cast("long")), order)
    totals = {r.p: r.s for r in ranged.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.sum("_v").alias("s")).collect()}
    if not totals:
        return ranged.withColumn(name, F.col("_v")).drop("_at", "_v")
    w = Window.partitionBy(F.shiftright("_at", 33)).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn(name, _starts(totals) + F.sum("_v").over(w)).drop("_at", "_v")


def _carried(ranged: DataFrame, last: list, names: list[str], schema: str) -> DataFrame:
    """For each range partition the latest value that ``last`` found in those before it: one row per partition on the driver."""
    ends = ranged.groupBy(F.shiftright("_at", 33).alias("p")).agg(*last).orderBy("p").collect()
    rows, now = [], [None] * len(names)
    for r in ends:
        rows.append((r["p"], *now))
        now = [old if r[n] is None else r[n][0] for n, old in zip(names, now)]
    return ranged.sparkSession.createDataFrame(rows, schema)


def with_previous(df: DataFrame, order: list, column: str, name: str) -> DataFrame:
    """Each row with a column of the row before it in a global order (null for the first): range partitions, the last row of each carried on."""
    ranged = _ranged(df, order)
    kind = ranged.schema[column].dataType.simpleString()
    before = _carried(ranged, [F.max_by(F.struct(column), "_at").alias("_b")], ["_b"], f"_p long, _b {kind}")
    w = Window.partitionBy(F.shiftright("_at", 33)).orderBy("_at")
    near = ranged.withColumn("_p", F.shiftright("_at", 33)).withColumn("_lag", F.lag(F.struct(column)).over(w))
    out = near.join(F.broadcast(before), "_p", "left")  # a row per partition
    return out.withColumn(name, F.when(F.col("_lag").isNotNull(), F.col("_lag").getField(column)).otherwise(F.col("_b"))).drop("_p", "_at", "_lag", "_b")


def filled_forward(df: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """Nulls replaced by the last value before them in a global order: within range partitions, and carried on between them."""
    ranged = _ranged(df, order)
    names = [f"_b{i}" for i in range(len(columns))]
    latest = [F.max_by(F.struct(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(n) for c, n in zip(columns, names)]
    kinds = "".join(f", {n} {ranged.schema[c].dataType.simpleString()}" for c, n in zip(columns, names))
    before = _carried(ranged, latest, names, "_p long" + kinds)
    w = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(before), "_p", "left")  # a row per partition
    return out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), n) for c, n in zip(columns, names)}).drop("_p", "_at", *names)
