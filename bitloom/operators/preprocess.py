"""From columns to bit rows and back: type dispatch, normalisation, width inference, packing, reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig, NonFinite, NullValues, OutOfRange, UnsupportedType
from ..layout import LIMB, BitLayout, Feature, any_of, smallest_width

INTS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
FLOATS = {"float": 32, "double": 64}
SCALE = 9


def scaled(column: Column, scale: int) -> Column:
    """Rounded half away from zero after scaling by a power of ten, as a long."""
    return F.round(column.cast("double") * F.lit(float(10**scale))).cast("long")


def raw_bits(column: Column, dtype: str) -> Column:
    """IEEE-754 bits as a long."""
    if dtype == "float":
        return F.call_function("java_method", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), column).cast("int").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), column).cast("long")


def from_raw_bits(column: Column, dtype: str) -> Column:
    if dtype == "float":
        return F.call_function("java_method", F.lit("java.lang.Float"), F.lit("intBitsToFloat"), F.when(column >= 1 << 31, column - (1 << 32)).otherwise(column).cast("int")).cast("float")
    return F.call_function("java_method", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), column).cast("double")


def infer(df: DataFrame, columns: list[str] | None = None, floats: str = "scaled_offset", scale: int | dict[str, int] = SCALE, normalize: bool = True) -> BitLayout:
    """The layout of a table, from one aggregation of minima, maxima, nulls and non-finite values.

    floats: scaled_offset, scaled (always 64 bits) or raw. Nulls, non-finite numbers (unless raw), values that
    overflow when scaled and types other than integers and floats are errors.
    """
    columns = columns or df.columns
    if floats not in ("scaled_offset", "scaled", "raw"):
        raise InvalidConfig(f"floats: {floats}")
    types = dict(df.dtypes)
    for c in columns:
        if types[c] not in INTS and types[c] not in FLOATS:
            raise UnsupportedType(f"{c}: {types[c]}")
    of = (lambda c: scale.get(c, SCALE)) if isinstance(scale, dict) else (lambda c: scale)
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        aggs.append(F.count_if(x.isNull()).alias(f"null{i}"))
        if types[c] in INTS:
            aggs += [F.min(x).cast("long").alias(f"min{i}"), F.max(x).cast("long").alias(f"max{i}")]
        elif floats != "raw":
            odd = F.isnan(x) | (F.abs(x) == float("inf"))
            safe = F.when(~odd, x.cast("double") * F.lit(float(10 ** of(c))))
            fits = F.when(F.abs(safe) < 9.2e18, F.round(safe).cast("long"))
            aggs += [F.count_if(odd).alias(f"odd{i}"), F.max(F.abs(safe)).alias(f"abs{i}"), F.min(fits).alias(f"min{i}"), F.max(fits).alias(f"max{i}")]
    row = df.agg(*aggs).first()
    features, offset = [], 0
    for i, c in enumerate(columns):
        if row[f"null{i}"]:
            raise NullValues(f"{c}: {row[f'null{i}']} nulls")
        if types[c] in FLOATS and floats != "raw":
            if row[f"odd{i}"]:
                raise NonFinite(f"{c}: {row[f'odd{i}']} values")
            if (row[f"abs{i}"] or 0) >= 9.2e18:
                raise OutOfRange(f"{c}: values overflow at scale {of(c)}")
        low, high = (row[f"min{i}"] or 0, row[f"max{i}"] or 0) if types[c] in INTS or floats != "raw" else (0, 0)
        if types[c] in FLOATS:
            kind = floats if floats != "raw" else "none"
            width = {"raw": FLOATS[types[c]], "scaled": 64}.get(floats) or smallest_width(high - low)
            low = low if floats == "scaled_offset" else 0
        elif normalize:
            kind, width = "offset", smallest_width(high - low)
        else:
            kind, width, low = "offset", INTS[types[c]], -(1 << (INTS[types[c]] - 1))
        features.append(Feature(c, types[c], width, offset, kind, low, of(c) if types[c] in FLOATS and floats != "raw" else 0))
        offset += width
    return BitLayout(tuple(features))


def code(f: Feature) -> Column:
    """The unsigned value of a feature; of 64 bits the long with the same bits."""
    x = F.col(f"`{f.name}`")
    if f.transform == "none":
        return raw_bits(x, f.dtype)
    value = scaled(x, f.scale) if f.dtype in FLOATS else x.cast("long")
    if f.transform == "scaled" or f.minimum == -(1 << 63):
        return value.bitwiseXOR(F.lit(-(1 << 63)))
    if f.width == 64:  # the difference may wrap; it is right modulo 2**64
        wide = value.cast("decimal(20,0)") - F.lit(f.minimum).cast("decimal(20,0)")
        return F.when(wide >= F.lit(1 << 63), wide - F.lit(1 << 64).cast("decimal(21,0)")).otherwise(wide).cast("long")
    return value - F.lit(f.minimum)


def codes(df: DataFrame, layout: BitLayout, keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` and each feature's unsigned value under its name."""
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keep or [])], *[code(f).alias(f.name) for f in layout.features]).withColumnsRenamed({f"_k{i}": k for i, k in enumerate(keep or []) if k not in {f.name for f in layout.features}})


def _part(value: Column, f: Feature, limb: int) -> Column | None:
    low, high = max(f.offset, limb * LIMB), min(f.offset + f.width, (limb + 1) * LIMB)
    if low >= high:
        return None
    x = F.shiftrightunsigned(value, low - f.offset).bitwiseAND(F.lit((1 << (high - low)) - 1))
    return F.shiftleft(x, low - limb * LIMB)


def pack(df: DataFrame, layout: BitLayout, keep: list[str] | None = None) -> DataFrame:
    """Bit rows: the columns of ``keep``, then one long for each LIMB bits."""
    words = []
    for i, name in enumerate(layout.limbs):
        words.append(any_of([p for f in layout.features if (p := _part(code(f), f, i)) is not None]).alias(name))
    return df.select(*[F.col(k) for k in keep or []], *words)


def unpacked(f: Feature, prefix: str = "b") -> Column:
    """The unsigned value of a feature in a packed row."""
    parts = []
    for limb in range(f.offset // LIMB, (f.offset + f.width - 1) // LIMB + 1):
        low, high = max(f.offset, limb * LIMB), min(f.offset + f.width, (limb + 1) * LIMB)
        x = F.shiftright(F.col(f"{prefix}{limb}"), low - limb * LIMB).bitwiseAND(F.lit((1 << (high - low)) - 1))
        parts.append(F.shiftleft(x, low - f.offset))
    return any_of(parts)


def decoded(f: Feature, value: Column) -> Column:
    """The column's value, in its own type, from the unsigned one. Integers are exact up to 64 bits."""
    if f.transform == "none":
        return from_raw_bits(value, f.dtype)
    if f.transform == "scaled" or f.minimum == -(1 << 63):
        value = value.bitwiseXOR(F.lit(-(1 << 63)))
    elif f.width == 64:
        wide = F.when(value < 0, value.cast("decimal(20,0)") + F.lit(1 << 64).cast("decimal(20,0)")).otherwise(value.cast("decimal(20,0)"))
        value = (wide + F.lit(f.minimum).cast("decimal(20,0)")).cast("long")
    else:
        value = value + F.lit(f.minimum)
    if f.dtype in FLOATS:
        value = value.cast("double") / F.lit(float(10**f.scale))
    return value.cast(f.dtype)


def reconstruct(bits: DataFrame, layout: BitLayout, keep: list[str] | None = None) -> DataFrame:
    """The table of packed rows: inverse transforms, original names and types."""
    return bits.select(*[F.col(k) for k in keep or []], *[decoded(f, unpacked(f)).alias(f.name) for f in layout.features])


def dumped(bits: DataFrame, layout: BitLayout, name: str = "bits") -> DataFrame:
    """Rows as strings of 0 and 1, the most significant bit first."""
    text = F.concat(*[F.lpad(F.bin(F.col(b)), min(LIMB, layout.bits - i * LIMB), "0") for i, b in reversed(list(enumerate(layout.limbs)))])
    return bits.withColumn(name, text)


def renamed(df: DataFrame, names: list[str], types: list[str]) -> DataFrame:
    """The table under other names and types; one of each for every column."""
    if not len(names) == len(types) == len(df.columns) or len(set(names)) != len(names):
        raise InvalidConfig("one distinct name and one type for each column")
    return df.toDF(*names).select(*[F.col(f"`{n}`").cast(t).alias(n) for n, t in zip(names, types)])
