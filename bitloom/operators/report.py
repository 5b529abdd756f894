"""Reports and the small classifier on pooled deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import size_text


def markdown(families: DataFrame, title: str = "Audit") -> str:
    """A readable report of audit.families: one line for each group (there are few)."""
    lines = [f"# {title}", "", "| group | images | raw | compressed | saving % | expansions |", "|-|-|-|-|-|-|"]
    names = [c for c in families.columns if c not in ("family",) and dict(families.dtypes)[c] == "string"]
    for r in families.orderBy("family", *names).collect():
        group = " / ".join([r.family, *[str(r[c]) for c in names if r[c] is not None]])
        saving = "" if r.saving_raw_pct is None else f"{r.saving_raw_pct:.2f}"
        lines.append(f"| {group} | {r.images} | {size_text(r.raw_bytes)} | {size_text(r.compressed_bytes)} | {saving} | {r.expansions} |")
    return "\n".join(lines) + "\n"


def vectors(pooled: DataFrame, group: str, name: str = "features") -> DataFrame:
    """(group, features): the bins of features.pooled as one vector for pyspark.ml; a group has a fixed number of bins."""
    from pyspark.ml.functions import array_to_vector

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bin", "pooled"))), lambda x: x["pooled"])
    return pooled.groupBy(group).agg(ordered.alias("_a")).select(group, array_to_vector("_a").alias(name))


def classifier(rows: DataFrame, classes: int, bins: int = 256, hidden: tuple[int, ...] = (64,), steps: int = 100, seed: int = 42):
    """A multilayer perceptron on (features, label), trained by Spark."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(layers=[bins, *hidden, classes], maxIter=steps, seed=seed, featuresCol="features", labelCol="label").fit(rows)
