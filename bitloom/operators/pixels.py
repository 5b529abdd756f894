"""Pixel grids as rows (image, y, x, channels): grouping, group codes, crops, flips, conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..functions.pixels import unzigzag, zigzag
from ..layout import position_bits


def grouped(pixels: DataFrame, image: str, channels: list[str], width: int, height: int, columns: int, rows: int) -> DataFrame:
    """(image, gy, gx, channel...): arrays of each group's values, row by row, with zeros beyond the edges.

    columns and rows are the grid's size. One aggregation keyed by group; a missing pixel counts as zero too.
    """
    if min(width, height, columns, rows) < 1:
        raise InvalidConfig("sizes of one at least")
    at = F.pmod("y", F.lit(height)) * width + F.pmod("x", F.lit(width))
    own = pixels.where(F.col("x").between(0, columns - 1) & F.col("y").between(0, rows - 1)).select(image, F.floor(F.col("y") / height).cast("int").alias("gy"), F.floor(F.col("x") / width).cast("int").alias("gx"), at.cast("int").alias("at"), *channels)
    # of each group: a map from place to value, at most width * height entries
    maps = own.groupBy(image, "gy", "gx").agg(*[F.map_from_entries(F.collect_list(F.struct("at", F.col(c).cast("int")))).alias(c) for c in channels])
    return maps.select(image, "gy", "gx", *[_filled(c, width * height) for c in channels])


def _filled(c: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.element_at(F.col(c), i), F.lit(0))).alias(c)


def ungrouped(groups: DataFrame, image: str, channels: list[str], width: int, height: int, columns: int, rows: int) -> DataFrame:
    """The pixels of groups again, without those beyond the edges."""
    zipped = F.arrays_zip(*[F.col(c) for c in channels])
    out = groups.select(image, "gy", "gx", F.posexplode(zipped).alias("at", "v"))
    out = out.select(image, (F.col("gy") * height + F.floor(F.col("at") / width)).cast("int").alias("y"), (F.col("gx") * width + F.col("at") % width).cast("int").alias("x"), *[F.col(f"v.{c}").alias(c) for c in channels])
    return out.where(F.col("x").between(0, columns - 1) & F.col("y").between(0, rows - 1))


def first_pixel(values: Column) -> Column:
    """The first value, then the zig-zag differences of the others to it (9 bits each)."""
    return F.transform(values, lambda v, i: F.when(i == 0, v).otherwise(zigzag(v - F.element_at(values, 1))))


def from_first_pixel(codes: Column) -> Column:
    return F.transform(codes, lambda v, i: F.when(i == 0, v).otherwise(F.element_at(codes, 1) + unzigzag(v)))


def minimum(values: Column) -> Column:
    """(low, at, rest): the smallest value, the place where it is first, and what the others have above it."""
    low = F.array_min(values)
    at = F.array_position(values, low).cast("int") - 1
    rest = F.filter(F.transform(values, lambda v: v - low), lambda v, i: i != at)
    return F.struct(low.alias("low"), at.alias("at"), rest.alias("rest"))


def from_minimum(code: Column) -> Column:
    rest = F.transform(code["rest"], lambda v: v + code["low"])
    return F.concat(F.slice(rest, F.lit(1), code["at"]), F.array(code["low"]), F.slice(rest, code["at"] + 1, F.size(rest) - code["at"]))


def group_bits(pixels: int, transform: str) -> int:
    """Bits of one channel of a group."""
    if transform == "raw":
        return 8 * pixels
    if transform == "first_pixel":
        return 8 + 9 * (pixels - 1)
    if transform == "minimum":
        return 8 + position_bits(pixels) + 8 * (pixels - 1)
    raise InvalidConfig(f"transform: {transform}")


def crop(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """Pixels of an inclusive rectangle: a predicate that reaches the scan."""
    return pixels.where(F.col("x").between(x1, x2) & F.col("y").between(y1, y2))


def crop_groups(groups: DataFrame, x1: int, y1: int, x2: int, y2: int, width: int, height: int) -> DataFrame:
    """Only the groups that a crop touches."""
    return groups.where(F.col("gx").between(x1 // width, x2 // width) & F.col("gy").between(y1 // height, y2 // height))


def flipped(pixels: DataFrame, image: str, columns: int, share: float = 0.5, seed: int = 42) -> DataFrame:
    """Images mirrored left to right, or not, by a hash of their id: the same in every run."""
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(image).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))
    return pixels.withColumn("x", F.when(chance, columns - 1 - F.col("x")).otherwise(F.col("x")).cast("int"))


def converted(pixels: DataFrame, channels: list[str], function) -> DataFrame:
    """Three channels through one of functions.pixels' conversions, under their names."""
    new = function(*[F.col(c) for c in channels])
    return pixels.withColumns(dict(zip(channels, new)))


def resized(pixels: DataFrame, image: str, channels: list[str], columns: int, rows: int, to_columns: int, to_rows: int) -> DataFrame:
    """Bilinear enlargement: each new pixel joins the at most four old ones around its centre."""
    spark = pixels.sparkSession

    def places(n: int, m: int, name: str) -> DataFrame:
        i = F.col("id").cast("double")
        s = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (i + 0.5) * n / m - 0.5))
        low = F.floor(s).cast("int")
        both = F.array(F.struct(low.alias("old"), (1 - (s - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("old"), (s - low).alias("w")))
        return spark.range(m).select(F.col("id").cast("int").alias(name), F.explode(both).alias("p")).select(name, F.col("p.old").alias(f"old_{name}"), F.col("p.w").alias(f"w_{name}")).groupBy(name, f"old_{name}").agg(F.sum(f"w_{name}").alias(f"w_{name}"))

    own = pixels.select(image, F.col("x").alias("old_x"), F.col("y").alias("old_y"), *channels)
    # both tables of places have at most two rows per new column or row
    joined = own.join(F.broadcast(places(columns, to_columns, "x")), "old_x").join(F.broadcast(places(rows, to_rows, "y")), "old_y")
    weight = F.col("w_x") * F.col("w_y")
    return joined.groupBy(image, "y", "x").agg(*[F.floor(F.sum(F.col(c) * weight) + 0.5).cast("int").alias(c) for c in channels])
