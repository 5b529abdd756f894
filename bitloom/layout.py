"""Bit layouts: which bits of a row belong to which column, and how values become bits.

Rows are packed, least significant bit first, feature after feature, into words of LIMB bits; a table of up to
LIMB bits a row is one long column, wider ones have several (``b0``, ``b1``, ...).
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import InvalidFormat, OutOfRange

LIMB = 62
WIDTHS = (8, 16, 32, 64)


def smallest_width(largest: int) -> int:
    """The smallest of 8, 16, 32, 64 and 128 bits that holds a value."""
    for w in (*WIDTHS, 128):
        if largest < 1 << w:
            return w
    raise OutOfRange(f"{largest} needs over 128 bits")


def bits_needed(count: int) -> int:
    """Bits of an id among ``count``, one at least."""
    return max(1, (count - 1).bit_length()) if count > 0 else 1


def position_bits(count: int) -> int:
    """Bits of a position among ``count``, none for a single one."""
    return (count - 1).bit_length() if count > 1 else 0


@dataclass(frozen=True)
class Feature:
    """A packed column. transform: none, offset, scaled (biased by 2**63) or scaled_offset."""

    name: str
    dtype: str
    width: int
    offset: int
    transform: str = "none"
    minimum: int = 0
    scale: int = 0


@dataclass(frozen=True)
class BitLayout:
    features: tuple[Feature, ...]

    @property
    def bits(self) -> int:
        return self.features[-1].offset + self.features[-1].width if self.features else 0

    @property
    def limbs(self) -> list[str]:
        return [f"b{i}" for i in range(max(1, -(-self.bits // LIMB)))]

    def feature_at(self, position: int) -> Feature:
        """The feature that holds a bit position."""
        if not 0 <= position < self.bits:
            raise OutOfRange(f"position {position} of {self.bits}")
        return self.features[bisect.bisect_right([f.offset for f in self.features], position) - 1]

    def masks(self, positions) -> list[int]:
        """The positions as one mask for each limb."""
        out = [0] * len(self.limbs)
        for p in positions:
            if not 0 <= p < self.bits:
                raise OutOfRange(f"position {p} of {self.bits}")
            out[p // LIMB] |= 1 << (p % LIMB)
        return out


def bit(position: int, prefix: str = "b") -> Column:
    """The bit at a position, 0 or 1, as a long."""
    return F.shiftright(F.col(f"{prefix}{position // LIMB}"), position % LIMB).bitwiseAND(F.lit(1).cast("long"))


def any_of(columns: list[Column]) -> Column:
    """Bitwise or as a balanced tree, so that hundreds of columns don't nest deeply."""
    columns = list(columns) or [F.lit(0).cast("long")]
    while len(columns) > 1:
        columns = [reduce(lambda a, b: a.bitwiseOR(b), columns[i : i + 2]) for i in range(0, len(columns), 2)]
    return columns[0]


def gathered(positions: list[int], prefix: str = "b") -> list[Column]:
    """Words that hold the given positions in their order, the first as the most significant bit.

    Words of LIMB bits compare, one after another, as the strings of these bits do.
    """
    words = []
    for i in range(0, max(1, len(positions)), LIMB):
        part = positions[i : i + LIMB]
        words.append(any_of([F.shiftleft(bit(p, prefix), LIMB - 1 - k) for k, p in enumerate(part)]))
    return words


def parse_rows(text: str) -> list[int]:
    """Row numbers of "0,5,10-20": sorted, each once."""
    out: set[int] = set()
    for part in text.split(","):
        m = re.fullmatch(r"\s*([0-9]+)\s*(?:-\s*([0-9]+)\s*)?", part)
        if not m:
            raise InvalidFormat(f"not a row or a range of rows: {part!r}")
        low, high = int(m[1]), int(m[2] or m[1])
        if high < low:
            raise InvalidFormat(f"a range that runs backwards: {part!r}")
        out.update(range(low, high + 1))
    return sorted(out)


def parse_crop(text: str) -> tuple[int, int, int, int]:
    """x1, y1, x2, y2, all inclusive."""
    m = re.fullmatch(r"\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*", text)
    if not m:
        raise InvalidFormat(f"not x1,y1,x2,y2: {text!r}")
    x1, y1, x2, y2 = map(int, m.groups())
    if x2 < x1 or y2 < y1:
        raise InvalidFormat(f"a crop that runs backwards: {text!r}")
    return x1, y1, x2, y2
