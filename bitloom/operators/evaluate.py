"""Evaluation of predictions: confusion, precision and recall, confidence intervals, sweeps, splits, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..plans.tables import numbered

Z = 1.959963984540054


def confusion(df: DataFrame, classes: list, target: str = "target", prediction: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """(by..., target, prediction, count) with zeros for pairs that don't occur (among groups that do)."""
    by = by or []
    labels = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], [target, prediction]).select(F.col(target).cast(dict(df.dtypes)[target]), F.col(prediction).cast(dict(df.dtypes)[prediction]))
    counts = df.groupBy(*by, target, prediction).agg(F.count(F.lit(1)).cast("long").alias("count"))
    grid = df.select(*by).distinct().crossJoin(F.broadcast(labels)) if by else labels  # a constant number of classes
    return grid.join(counts, [*by, target, prediction], "left").select(*by, target, prediction, F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def class_metrics(counts: DataFrame, target: str = "target", prediction: str = "prediction", by: list[str] | None = None, undefined: float | None = None, percent: bool = False) -> DataFrame:
    """(by..., class, support, predicted, tp, precision, recall, f1) of confusion counts; ``undefined`` where a divisor is 0."""
    by = by or []
    each = counts.select(*by, F.explode(F.array(F.struct(F.col(target).alias("class"), F.lit(True).alias("true")), F.struct(F.col(prediction).alias("class"), F.lit(False).alias("true")))).alias("s"), target, prediction, "count").select(*by, "s.class", "s.true", target, prediction, "count")
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).cast("long")
    out = each.groupBy(*by, "class").agg(total(F.col("true")).alias("support"), total(~F.col("true")).alias("predicted"), total(F.col("true") & (F.col(target) == F.col(prediction))).alias("tp"))
    scale, none = (100.0 if percent else 1.0), F.lit(undefined).cast("double")
    share = lambda a, b: F.when(b > 0, scale * a / b).otherwise(none)
    return out.select(*by, "class", "support", "predicted", "tp", share(F.col("tp"), F.col("predicted")).alias("precision"), share(F.col("tp"), F.col("support")).alias("recall"), share(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def averages(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., macro_f1, weighted_f1, macro_precision, macro_recall): undefined values count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return metrics.groupBy(*(by or [])).agg(F.avg(zero("f1")).alias("macro_f1"), (F.sum(zero("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg(zero("precision")).alias("macro_precision"), F.avg(zero("recall")).alias("macro_recall"))


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a share."""
    p, z2 = successes / n, Z * Z
    den = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / den
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / den
    return centre - half, centre + half


def describe(df: DataFrame, by: list[str], target: str = "target", prediction: str = "prediction", loss: str = "loss") -> DataFrame:
    """(by..., n, population_pct, accuracy_pct, ci_low, ci_high, loss, errors, classes, balanced_accuracy).

    Two levels of aggregation: per class, then per group; balanced accuracy is the mean recall of the classes present.
    """
    ok = F.col(target) == F.col(prediction)
    per = df.groupBy(*by, target).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("ok"), F.sum(loss).alias("loss"))
    out = per.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.sum("ok").cast("long").alias("ok"), F.sum("loss").alias("loss"), F.count(F.lit(1)).cast("long").alias("classes"), F.avg(F.col("ok") / F.col("n")).alias("balanced"))
    low, high = wilson(F.col("ok"), F.col("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return out.select(*by, "n", (100 * F.col("n") / whole).alias("population_pct"), (100 * F.col("ok") / F.col("n")).alias("accuracy_pct"), (100 * low).alias("ci_low"), (100 * high).alias("ci_high"), (F.col("loss") / F.col("n")).alias("loss"), (F.col("n") - F.col("ok")).alias("errors"), "classes", (100 * F.col("balanced")).alias("balanced_accuracy"))


def range_edges(counts: dict[int, int], least: int = 100) -> list[int]:
    """Edges of half-open ranges from powers of two, merged until each has ``least`` values; a poor last one joins the one before."""
    if not counts:
        return []
    top = max(counts)
    raw = sorted({0, top + 1, *[1 << i for i in range(1, top.bit_length() + 1)]})
    edges, pending = [raw[0]], 0
    for low, high in zip(raw, raw[1:]):
        pending += sum(n for k, n in counts.items() if low <= k < high)
        if pending >= least:
            edges.append(high)
            pending = 0
    if edges[-1] != raw[-1]:
        if pending and len(edges) > 1:
            edges[-1] = raw[-1]
        else:
            edges.append(raw[-1])
    return edges


def bucketed(df: DataFrame, value: str, edges: list[int], name: str = "range") -> DataFrame:
    """df with the half-open range "[low,high)" of a value, null outside all."""
    col = F.lit(None).cast("string")
    for low, high in zip(edges, edges[1:]):
        col = F.when((F.col(value) >= low) & (F.col(value) < high), f"[{low},{high})").otherwise(col)
    return df.withColumn(name, col)


def sweep(df: DataFrame, value: str, error: Column, thresholds: list[int]) -> DataFrame:
    """(threshold, below, coverage, error_coverage, enrichment, s1) of value < threshold, in one pass over the rows.

    coverage and error_coverage are shares of all rows and all errors; s1 is their difference, enrichment their ratio.
    """
    if not thresholds:
        raise InvalidConfig("one threshold at least")
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(error).alias("e")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if(F.col(value) < t).alias(f"n{i}"), F.count_if((F.col(value) < t) & error).alias(f"e{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).cast("long").alias("threshold"), F.col(f"n{i}").alias("below"), F.col(f"e{i}").alias("errors")) for i, t in enumerate(thresholds)])
    out = one.select("n", "e", F.explode(rows).alias("r")).select("n", "e", "r.*")
    share, errors = F.when(F.col("n") > 0, F.col("below") / F.col("n")), F.when(F.col("e") > 0, F.col("errors") / F.col("e"))
    return out.select("threshold", F.col("below").cast("long").alias("below"), F.col("errors").cast("long").alias("errors"), share.alias("coverage"), errors.alias("error_coverage"), F.when(share > 0, errors / share).alias("enrichment"), (errors - share).alias("s1"))


def best_threshold(sweeps: DataFrame) -> DataFrame:
    return sweeps.orderBy(F.desc("s1"), "threshold").limit(1)


def top_fraction(df: DataFrame, value: str, tie: str, share: float = 0.05) -> DataFrame:
    """The ceil(n * share) rows of the largest values, ties by ``tie`` ascending, with ``rank`` from 1.

    Ranks come from a range-partitioned order, so no window sees all rows.
    """
    n = df.count()
    ranked = numbered(df, [F.col(value).desc(), F.col(tie).asc()], "rank").withColumn("rank", F.col("rank") + 1)
    return ranked.where(F.col("rank") <= -(-n * round(share * 1_000_000) // 1_000_000))


def pivoted(df: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    return df.groupBy(row).pivot(column, columns).agg(F.first(value))


def diverse(df: DataFrame, target: str, order: list[str], n: int) -> DataFrame:
    """n rows: the first of each target in the order, then others in the order; ``pick`` numbers them."""
    w = Window.partitionBy(target).orderBy(*order)
    first = df.withColumn("_later", F.row_number().over(w) > 1)
    return first.orderBy("_later", *order).limit(n).withColumn("pick", F.row_number().over(Window.orderBy("_later", *order))).drop("_later")


def compare_runs(history: DataFrame, run: str, epoch: str, accuracy: str, loss: str, reference: str) -> DataFrame:
    """(run, epoch, accuracy, loss, delta): of each run the best epoch by accuracy (by loss if it has none), and its lead on a reference."""
    best = F.max_by(F.struct(epoch, accuracy, loss), F.struct(F.coalesce(F.col(accuracy), F.lit(float("-inf"))), -F.col(loss), -F.col(epoch)))
    rows = history.groupBy(run).agg(best.alias("b")).select(run, f"b.{epoch}", f"b.{accuracy}", f"b.{loss}")
    ref = rows.where(F.col(run) == reference).select(F.col(accuracy).alias("_ref"))
    return rows.join(F.broadcast(ref), how="left").withColumn("delta", F.col(accuracy) - F.col("_ref")).drop("_ref").orderBy(F.desc_nulls_last(accuracy), run)


def stratified_split(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """df with ``split``: of each label int(n * share + 0.5) rows are val, those of the smallest hash of seed and key."""
    w = Window.partitionBy(label)
    n = F.count(F.lit(1)).over(w)
    at = F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return df.withColumn("split", F.when(at <= F.floor(n * share + 0.5), "val").otherwise("train"))


def per_class_sample(df: DataFrame, label: str, key: str, n: int, holdout: int, seed: int = 42) -> DataFrame:
    """n rows of each label without replacement, ``holdout`` of which are marked val."""
    w = Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    ranked = df.withColumn("_at", F.row_number().over(w)).where(F.col("_at") <= n)
    return ranked.withColumn("split", F.when(F.col("_at") <= holdout, "val").otherwise("train")).drop("_at")


def moments(df: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., n, mean and population deviation of each value): moments that merge partition by partition."""
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).cast("long").alias("n"), *[f(v).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_pop))])


def standardized(value: Column, mean: Column | float, std: Column | float, clip: float = 10.0) -> Column:
    z = (value - mean) / std
    return F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))


def best_so_far(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """history with ``best`` (the smallest loss so far) and ``improved`` (strictly smaller than all before)."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return history.withColumn("improved", before.isNull() | (F.col(loss) < before)).withColumn("best", F.least(F.coalesce(before, F.col(loss)), F.col(loss)))


def hysteresis(history: DataFrame, run: str, epoch: str, accuracy: str, margin: float) -> DataFrame:
    """(run, best_epoch, best): the accuracy that last beat the best before it by more than ``margin``.

    A fold over a run's epochs in order; a run has few.
    """
    steps = F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(accuracy).cast("double").alias("a"))))
    zero = F.struct(F.lit(None).cast("long").alias("e"), F.lit(None).cast("double").alias("a"))
    fold = F.aggregate("_s", zero, lambda acc, x: F.when(acc["a"].isNull() | (x["a"] > acc["a"] + margin), x).otherwise(acc))
    return history.groupBy(run).agg(steps.alias("_s")).select(run, fold.alias("_b")).select(run, F.col("_b.e").alias("best_epoch"), F.col("_b.a").alias("best"))


def weighted_totals(batches: DataFrame, n: str, loss: str, correct: str, seconds: str, by: list[str] | None = None) -> DataFrame:
    """(by..., n, loss, accuracy, seconds): batch means weighted by batch sizes."""
    return batches.groupBy(*(by or [])).agg(F.sum(n).cast("long").alias("n"), (F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("loss"), (F.sum(correct) / F.sum(n)).alias("accuracy"), F.sum(seconds).alias("seconds"))


def predictions(df: DataFrame, probabilities: str, target: str) -> DataFrame:
    """df with prediction (the first largest), confidence, p_true and correct."""
    p = F.col(probabilities)
    guess = (F.array_position(p, F.array_max(p)) - 1).cast("int")
    return df.withColumns({"prediction": guess, "confidence": F.array_max(p), "p_true": F.element_at(p, F.col(target).cast("int") + 1)}).withColumn("correct", F.col("prediction") == F.col(target))
