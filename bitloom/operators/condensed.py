"""Condensed samples: few weighted rows that stand for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..layout import LIMB, BitLayout, any_of
from . import bitstats
from .dictionary import base_words
from .preprocess import unpacked
from .profile import k_profile


def prefix_for(profile: list[int], constants: int, most: int) -> int:
    """Bits of an order, constants first, to take while there are fewer than ``most`` groups."""
    j = constants
    while j < len(profile) - 1 and profile[j] < most:
        j += 1
    return j


def condense(bits: DataFrame, layout: BitLayout, selected: list[int]) -> DataFrame:
    """(sample words b0.., weight): a row for each group of equal selected bits.

    Each feature's value is its selected bits plus the floor of the mean of its other bits, cut to its width;
    the weight is the number of rows. Means are taken in decimals, so sums don't overflow.
    """
    masks = layout.masks(selected)
    values = []
    for f in layout.features:
        inside = [p for p in selected if f.offset <= p < f.offset + f.width]
        own = sum(1 << (p - f.offset) for p in inside)
        signed = own - (1 << 64) if own >= 1 << 63 else own
        value = unpacked(f)
        width = (1 << f.width) - 1 if f.width < 63 else -1 if f.width == 64 else (1 << 63) - 1
        mean = F.floor(F.sum(value.bitwiseAND(F.lit(~signed & width if f.width < 64 else ~signed)).cast("decimal(38,0)")) / F.count(F.lit(1))).cast("long")
        values.append((f, (F.first(value.bitwiseAND(F.lit(signed))) + mean).bitwiseAND(F.lit(width))))
    if any(f.width == 64 for f in layout.features):
        raise InvalidConfig("condensed samples of features of up to 32 bits")
    names = [f"g{i}" for i in range(len(masks))]
    own = bits.select(*layout.limbs, *[w.alias(g) for w, g in zip(base_words(layout, selected), names)])
    groups = own.groupBy(*names).agg(F.count(F.lit(1)).cast("long").alias("weight"), *[v.alias(f"_f{i}") for i, (_, v) in enumerate(values)])
    words = []
    for limb, name in enumerate(layout.limbs):
        parts = []
        for i, f in enumerate(layout.features):
            low, high = max(f.offset, limb * LIMB), min(f.offset + f.width, (limb + 1) * LIMB)
            if low < high:
                parts.append(F.shiftleft(F.shiftright(F.col(f"_f{i}"), low - f.offset).bitwiseAND(F.lit((1 << (high - low)) - 1)), low - limb * LIMB))
        words.append(any_of(parts).alias(name))
    return groups.select(*words, "weight")


def condensed_samples(bits: DataFrame, layout: BitLayout, most: int = 30) -> DataFrame:
    """condense() on the shortest prefix of the interleaved order that gives ``most`` groups, if there is one."""
    if most < 1:
        raise InvalidConfig("one sample at least")
    counts = bitstats.order(bitstats.ones(bits, layout))
    order = bitstats.interleaved(counts, layout)
    constants = sum(min(k, n - k) == 0 for _, k, n in counts)
    return condense(bits, layout, order[: prefix_for(k_profile(bits, order), constants, most)])


def appended(bits: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Rows and samples together: ``is_condensed`` tells them apart; samples have null keys, rows null weights."""
    limbs = [c for c in samples.columns if c != "weight"]
    types = dict(bits.dtypes)
    rows = bits.select(*keys, *limbs, F.lit(None).cast("long").alias("weight"), F.lit(False).alias("is_condensed"))
    return rows.unionByName(samples.select(*[F.lit(None).cast(types[k]).alias(k) for k in keys], *limbs, "weight", F.lit(True).alias("is_condensed")))


def appended_polarity(previous: DataFrame, samples: DataFrame, layout: BitLayout) -> DataFrame:
    """Constant positions that stay constant when the samples are appended: (pos, state)."""
    new = bitstats.polarity(samples.drop("weight"), layout).withColumnRenamed("state", "now")
    return previous.join(F.broadcast(new), "pos").select("pos", F.when(F.col("state") == F.col("now"), F.col("state")).otherwise("varying").alias("state"))
