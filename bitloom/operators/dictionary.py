"""The dictionary of bases: grouping rows by their base bits, ids, layout states, deviations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..layout import LIMB, BitLayout, any_of, bit, bits_needed, gathered
from ..plans.tables import numbered
from . import bitstats


def layout_states(states: DataFrame, selected: list[int]) -> DataFrame:
    """(pos, state): zero, one (constant and selected), variable (selected) or deviation."""
    chosen = F.col("pos").isin(selected) if selected else F.lit(False)
    return states.select("pos", F.when(chosen & (F.col("state") != "varying"), F.col("state")).when(chosen, "variable").otherwise("deviation").alias("state"))


@dataclass
class Dictionary:
    """bases (base_id, base words b0.., count), rows (keys, base_id, deviation words d0..), and the positions.

    Base words hold the selected bits in place, deviation words the others; their sum is the row.
    """

    layout: BitLayout
    selected: list[int]
    bases: DataFrame
    rows: DataFrame
    order: list[int] | None = None

    @property
    def deviation_bits(self) -> int:
        return self.layout.bits - len(self.selected)


def base_words(layout: BitLayout, selected: list[int]) -> list:
    return [F.col(b).bitwiseAND(F.lit(m)).alias(b) for b, m in zip(layout.limbs, layout.masks(selected))]


def grouped(bits: DataFrame, layout: BitLayout, selected: list[int]) -> DataFrame:
    """Distinct base words and how many rows have each."""
    return bits.select(*base_words(layout, selected)).groupBy(*layout.limbs).agg(F.count(F.lit(1)).cast("long").alias("count"))


def column_order(bases: DataFrame, layout: BitLayout) -> list[int]:
    """Positions by the entropy of each bit over the distinct bases (each counts once), ties by position."""
    return [p for p, _, _ in bitstats.order(bitstats.ones(bases, layout))]


def build(bits: DataFrame, layout: BitLayout, selected: list[int], keys: list[str], sort: bool = True) -> Dictionary:
    """Bases and rows of a selection of positions.

    Sorted dictionaries number bases by their bits in ``column_order``, ones first; others by ascending words. A
    hot base costs nothing in the counts, and the join that gives rows their ids is left to Spark, which
    broadcasts the bases if they are small and splits skewed partitions if not.
    """
    selected = sorted(selected)
    counts = grouped(bits, layout, selected)
    if sort:
        order = column_order(counts, layout)
        words = gathered(order)
        ranked = counts.select("*", *[w.alias(f"k{i}") for i, w in enumerate(words)])
        bases = numbered(ranked, [F.col(f"k{i}").desc() for i in range(len(words))], "base_id").drop(*[f"k{i}" for i in range(len(words))])
    else:
        order, bases = None, numbered(counts, [F.col(b) for b in reversed(layout.limbs)], "base_id")
    bases = bases.select("base_id", *layout.limbs, "count")
    rest = layout.masks(set(range(layout.bits)) - set(selected))
    named = bits.select(*keys, *base_words(layout, selected), *[F.col(b).bitwiseAND(F.lit(m)).alias(f"d{i}") for i, (b, m) in enumerate(zip(layout.limbs, rest))])
    rows = named.join(bases.drop("count"), layout.limbs).select(*keys, "base_id", *[f"d{i}" for i in range(len(layout.limbs))])
    return Dictionary(layout, selected, bases, rows, order)


def projected(dictionary: Dictionary, positions: list[int] | None = None) -> DataFrame:
    """(base_id, v0.., count): the given (selected) positions of each base, packed next to each other in ascending order."""
    positions = sorted(positions if positions is not None else dictionary.selected)
    words = []
    for i in range(0, max(1, len(positions)), LIMB):
        words.append(any_of([F.shiftleft(bit(p), k) for k, p in enumerate(positions[i : i + LIMB])]).alias(f"v{i // LIMB}"))
    return dictionary.bases.select("base_id", *words, "count")


def id_bits(k: int) -> int:
    return bits_needed(k) if k else 0


def decode(dictionary: Dictionary, keys: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Packed rows again: each row's base or'ed with its deviation. Ids without a base are an error."""
    rows = dictionary.rows if rows is None else rows
    limbs = dictionary.layout.limbs
    joined = rows.join(dictionary.bases.drop("count"), "base_id", "left")
    checked = F.when(F.col("b0").isNull(), F.raise_error(F.concat(F.lit("no base "), F.col("base_id").cast("string"))).cast("long"))
    return joined.select(*keys, *[F.coalesce(F.col(b), checked).bitwiseOR(F.col(f"d{i}")).alias(b) for i, b in enumerate(limbs)])


def random_access(dictionary: Dictionary, key: str, wanted: list[int], distinct: bool = False) -> DataFrame:
    """Packed rows of the given row numbers, ascending; repeated requests are kept unless ``distinct``.

    Up to 1000 numbers become a predicate that Parquet's statistics prune by; the repetition of a number comes from
    a map. Longer lists join.
    """
    rows, spark = dictionary.rows, dictionary.rows.sparkSession
    wanted = sorted(set(wanted)) if distinct else sorted(wanted)
    if len(wanted) > 1000 or len(set(wanted)) < len(wanted):
        rows = rows.join(spark.createDataFrame([(w,) for w in wanted], f"`{key}` long"), key)
    else:
        rows = rows.where(F.col(key).isin(wanted))
    return decode(dictionary, [key], rows).orderBy(key)


def row_ranges(dictionary: Dictionary, key: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Packed rows whose numbers lie in any of the inclusive ranges."""
    cond = F.lit(False)
    for low, high in ranges:
        cond = cond | F.col(key).between(low, high)
    return decode(dictionary, [key], dictionary.rows.where(cond))
