"""Index samples for access benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import OutOfRange
from ..plans.tables import numbered


def random_rows(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """Exactly max(1, int(n * share)) keys (distinct ones), those of the smallest md5 of "key:seed".

    Counts by the first 16 bits find the hash at the border; all below it is taken by a filter, and only the keys that
    share its bits (a 65,536th) are put in order and numbered.
    """
    if not 0 < share <= 1:
        raise OutOfRange("a share in (0, 1]")
    keys = df.select(key, F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))).alias("_h")).withColumn("_s", F.substring("_h", 1, 4))
    counts = {r["_s"]: r["count"] for r in keys.groupBy("_s").count().collect()}
    left, border = max(1, int(sum(counts.values()) * share)), ""
    for border in sorted(counts):
        if counts[border] >= left:
            break
        left -= counts[border]
    rest = numbered(keys.where(F.col("_s") == border), [F.col("_h"), F.col(key)], "_n").where(F.col("_n") < left)
    return keys.where(F.col("_s") < border).select(key).unionByName(rest.select(key))


def sequential_rows(df: DataFrame, key: str, share: float, start: int = 0) -> DataFrame:
    """The first max(1, int(n * share)) keys from a start, for keys that count up by one from 0."""
    if not 0 < share <= 1:
        raise OutOfRange("a share in (0, 1]")
    n = max(1, int(df.count() * share))
    return df.select(key).where(F.col(key).between(start, start + n - 1))
