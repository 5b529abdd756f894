"""Column expressions on bytes of pixels: zig-zag codes and colour models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(v: Column) -> Column:
    """16-bit signed to unsigned: 0, -1, 1, -2, ... as 0, 1, 2, 3, ..."""
    v = v.cast("int")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 15)).bitwiseAND(F.lit(0xFFFF))


def unzigzag(u: Column) -> Column:
    u = u.cast("int")
    return F.shiftright(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1)))


def signed(v: Column) -> Column:
    """A byte as a signed number."""
    return F.when(v < 128, v).otherwise(v - 256).cast("int")


def signed_half(v: Column) -> Column:
    """A byte, taken as signed, shifted right by one (towards minus infinity)."""
    return F.shiftright(signed(v), 1)


def ycocg(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lossy luma and two chroma bytes biased by 128."""
    r, g, b = (x.cast("int") for x in (r, g, b))
    y = F.shiftright(r + 2 * g + b, 2)
    co = F.shiftright(r - b, 1) + 128
    cg = F.shiftright(2 * g - r - b, 2) + 128
    return y, co, cg


def from_ycocg(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    """Back to bytes, clamped."""
    y, co, cg = y.cast("int"), co.cast("int") - 128, cg.cast("int") - 128
    clamp = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(255))
    t = y - cg
    return clamp(t + co), clamp(y + cg), clamp(t - co)


def ycocg_r(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The reversible model in bytes: differences modulo 256, chroma biased by 128."""
    r, g, b = (x.cast("int") for x in (r, g, b))
    co = F.pmod(r - b, F.lit(256))
    t = F.pmod(b + signed_half(co), F.lit(256))
    cg = F.pmod(g - t, F.lit(256))
    y = F.pmod(t + signed_half(cg), F.lit(256))
    return y, F.pmod(co + 128, F.lit(256)), F.pmod(cg + 128, F.lit(256))


def from_ycocg_r(y: Column, co: Column, cg: Column) -> tuple[Column, Column, Column]:
    y, co, cg = y.cast("int"), F.pmod(co.cast("int") - 128, F.lit(256)), F.pmod(cg.cast("int") - 128, F.lit(256))
    t = F.pmod(y - signed_half(cg), F.lit(256))
    g = F.pmod(cg + t, F.lit(256))
    b = F.pmod(t - signed_half(co), F.lit(256))
    return F.pmod(b + co, F.lit(256)), g, b


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The JPEG conversion, rounded and clamped to bytes."""
    clamp = lambda v: F.least(F.greatest(F.floor(v + 0.5).cast("int"), F.lit(0)), F.lit(255))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return clamp(y), clamp(-0.168736 * r - 0.331264 * g + 0.5 * b + 128), clamp(0.5 * r - 0.418688 * g - 0.081312 * b + 128)
