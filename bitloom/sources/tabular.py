"""Tables in and out: CSV, JSON lines, manifests, and whole small tables as containers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidConfig, NullValues
from ..functions.text import with_extension
from ..operators import preprocess
from ..plans.tables import filled_forward
from . import objects


def read_csv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """A CSV file; types are inferred (one more pass) unless a schema is given."""
    reader = spark.read.option("header", str(header).lower())
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)


def fill_nulls(df: DataFrame, strategy: str, value: float | None = None, order: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Nulls of numeric columns filled by zero, one, a value, min, max, mean, or forward / backward along an order."""
    numeric = [c for c, t in df.dtypes if t in preprocess.INTS or t in preprocess.FLOATS]
    types = dict(df.dtypes)
    if strategy in ("zero", "one", "value"):
        fill = {"zero": 0, "one": 1, "value": value}[strategy]
        if fill is None:
            raise InvalidConfig("a value to fill with")
        return df.fillna(fill, subset=numeric)
    if strategy in ("min", "max", "mean"):
        row = df.agg(*[{"min": F.min, "max": F.max, "mean": F.avg}[strategy](c).alias(c) for c in numeric]).first()
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c]).cast(types[c])) for c in numeric if row[c] is not None})
    if strategy in ("forward", "backward") and order:
        if not by:
            key = F.col(order).asc_nulls_first() if strategy == "forward" else F.col(order).desc_nulls_last()
            return filled_forward(df, [key], [c for c in numeric if c != order]).select(*df.columns)
        w = Window.partitionBy(*by).orderBy(order)
        w = w.rowsBetween(Window.unboundedPreceding, 0) if strategy == "forward" else w.rowsBetween(0, Window.unboundedFollowing)
        pick = F.last if strategy == "forward" else F.first
        return df.withColumns({c: pick(c, ignorenulls=True).over(w) for c in numeric if c != order})
    raise InvalidConfig(f"strategy: {strategy}")


def write_csv(df: DataFrame, path: str) -> str:
    path = with_extension(path, ".csv")
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def weighted_csv(samples: DataFrame, path: str) -> str:
    """Condensed samples with their weight as the first column."""
    return write_csv(samples.select("weight", *[c for c in samples.columns if c != "weight"]), path)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_manifest(spark: SparkSession, path: str, samples: str = "samples") -> DataFrame:
    """A JSON document with an array of samples, one row for each; its other fields stay."""
    df = spark.read.option("multiLine", "true").json(path)
    rest = [c for c in df.columns if c != samples]
    return df.select(*rest, F.explode(samples).alias("_s")).select(*rest, "_s.*")


def write_manifest(df: DataFrame, path: str, split: str, key: str, splits: tuple[str, ...] = ("train", "test")) -> None:
    """JSON lines by split; every split must have rows and no key may occur twice, before anything is written."""
    seen = {r[0] for r in df.select(split).distinct().collect()}
    if set(splits) - seen:
        raise InvalidConfig(f"no rows for {sorted(set(splits) - seen)}")
    if df.where(F.col(key).isNull()).limit(1).count():
        raise NullValues(key)
    from ..operators.audit import unique

    unique(df, [key]).write.mode("errorifexists").partitionBy(split).json(path)


def pack_groups(df: DataFrame, group: str, columns: list[str], scale: int = 2, **options) -> DataFrame:
    """(group, k, content): each group's rows, in the order of the columns, as a table container of its own."""
    types, kind = dict(df.dtypes), dict(df.dtypes)[group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(columns)
        parts, cols = [], []
        for c in columns:
            x = pdf[c].to_numpy()
            floats = types[c] in preprocess.FLOATS
            v = [int(np.floor(abs(float(t)) * 10**scale + 0.5)) * (1 if t >= 0 else -1) for t in x] if floats else [int(t) for t in x]
            low = min(v)
            width = next(w for w in (8, 16, 32, 64) if max(v) - low < 1 << w)
            cols.append(objects.Column(objects.WORDS[width], width, 4 if floats else 2, scale if floats else 0, low, c, types[c]))
            parts.append(objects._to_bits(np.array([t - low for t in v], np.uint64), width))
        got = objects.compress(np.concatenate(parts, 1), cols, **options)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "k": [len(got.bases)], "content": [objects.write_table(got)]})

    return df.select(group, *columns).groupBy(group).applyInPandas(run, f"`{group}` {kind}, k long, content binary")


def unpack_groups(files: DataFrame, group: str, schema: str, rows: list[int] | None = None) -> DataFrame:
    """The rows of table containers again, all or some by number; names and types come from the containers."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf[group], pdf["content"]):
                c, at, out = objects.read_table(bytes(content)), 0, {}
                bits = c.matrix(None if rows is None else np.array([r for r in rows if r < c.n], np.int64))
                for col in c.columns:
                    v = objects._from_bits(bits[:, at : at + col.width])
                    at += col.width
                    whole = [int(t) + col.minimum for t in v]
                    out[col.name] = np.array(whole, float) / 10**col.scale if col.transform == 4 else np.array(whole, np.int64)
                yield pd.DataFrame({group: name, **out})

    return files.select(group, "content").mapInPandas(run, schema)

