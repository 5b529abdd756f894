"""One compressed object (an image or a small table) in numpy, and its binary containers.

Sets of objects are compressed, read and audited by running this once per object in Spark tasks (sources/containers).
A bit matrix is an array (rows, bits) of 0 and 1. Numbers in containers are little-endian; bit streams fill bytes from
the least significant bit.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from ..errors import InvalidConfig, InvalidFormat, OutOfRange
from ..layout import bits_needed, position_bits
from ..operators import encode, select
from ..operators.bitstats import value_of_entropy

# Tags of the containers.
MODELS = ("rgb", "ycocg", "ycocg_r")
TRANSFORMS = ("raw", "first_pixel", "minimum")
ENCODINGS = {"normal": 0, "rle": 2, "huffman": 3}
TABLES = {"raw": 0, "unary": 1, "fixed": 2}
NUMBERS = {"tinyint": 3, "smallint": 4, "int": 5, "bigint": 6, "float": 1, "double": 2}
WORDS = {8: 4, 16: 5, 32: 6, 64: 7}
ANY_WIDTH, BLOCK = 12, 1024
DEVIATION, VARIABLE, ZERO, ONE = range(4)


@dataclass(frozen=True)
class Grid:
    """What an image's rows of groups stand for."""

    width: int
    height: int
    channels: int
    model: str = "ycocg_r"
    transform: str = "first_pixel"
    group_width: int = 1
    group_height: int = 1
    colorspace: int = 0

    @property
    def columns(self) -> int:
        return -(-self.width // self.group_width)

    @property
    def rows(self) -> int:
        return -(-self.height // self.group_height)

    @property
    def channel_bits(self) -> int:
        pixels = self.group_width * self.group_height
        return {"raw": 8 * pixels, "first_pixel": 8 + 9 * (pixels - 1), "minimum": 8 + position_bits(pixels) + 8 * (pixels - 1)}[self.transform]


@dataclass
class Column:
    """A feature: its number's tag, transform (tag, scale, minimum) and width."""

    tag: int
    width: int
    transform: int = 0
    scale: int = 0
    minimum: int = 0
    name: str = ""
    dtype: str = "double"


@dataclass
class Compressed:
    columns: list[Column]
    n: int
    states: np.ndarray
    bases: np.ndarray  # (K, variable positions)
    ids: np.ndarray
    deviations: np.ndarray  # (n + condensed, deviation positions)
    order: list[int] = field(default_factory=list)  # of variable positions, as the sorted dictionary compares them
    weights: list[int] = field(default_factory=list)
    encoding: str = "huffman"
    table: str = "raw"
    grid: Grid | None = None

    @property
    def row_width(self) -> int:
        return self.grid.columns if self.grid else BLOCK

    @property
    def base_bits(self) -> int:
        return int((self.states != DEVIATION).sum())

    def matrix(self, rows: np.ndarray | None = None) -> np.ndarray:
        """The bit matrix again, of all rows or some."""
        ids, dev = (self.ids, self.deviations) if rows is None else (self.ids[rows], self.deviations[rows])
        if len(ids) and ids.max() >= len(self.bases):
            raise OutOfRange(f"base {ids.max()} of {len(self.bases)}")
        out = np.zeros((len(ids), len(self.states)), np.uint8)
        out[:, self.states == ONE] = 1
        out[:, self.states == VARIABLE] = self.bases[ids]
        out[:, self.states == DEVIATION] = dev
        return out


# --- images and tables as bit matrices ----------------------------------------------------------------------------


def _signed_half(v: np.ndarray) -> np.ndarray:
    return ((v ^ 128) - 128) >> 1


def to_model(rgb: np.ndarray, model: str) -> np.ndarray:
    """(..., 3 or 4) bytes in a colour model; alpha stays."""
    if model == "rgb":
        return rgb
    r, g, b = (rgb[..., i].astype(np.int32) for i in range(3))
    out = rgb.copy()
    if model == "ycocg":
        parts = (r + 2 * g + b) >> 2, ((r - b) >> 1) + 128, ((2 * g - r - b) >> 2) + 128
    elif model == "ycocg_r":
        co = (r - b) & 255
        t = (b + _signed_half(co)) & 255
        cg = (g - t) & 255
        parts = (t + _signed_half(cg)) & 255, (co + 128) & 255, (cg + 128) & 255
    else:
        raise InvalidConfig(f"model: {model}")
    for i, p in enumerate(parts):
        out[..., i] = p
    return out


def from_model(values: np.ndarray, model: str) -> np.ndarray:
    if model == "rgb":
        return values
    y, co, cg = (values[..., i].astype(np.int32) for i in range(3))
    out = values.copy()
    if model == "ycocg":
        co, cg = co - 128, cg - 128
        parts = y - cg + co, y + cg, y - cg - co
        parts = [np.clip(p, 0, 255) for p in parts]
    else:
        co, cg = (co - 128) & 255, (cg - 128) & 255
        t = (y - _signed_half(cg)) & 255
        b = (t - _signed_half(co)) & 255
        parts = (b + co) & 255, (cg + t) & 255, b
    for i, p in enumerate(parts):
        out[..., i] = p
    return out


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """(...,) numbers as (..., width) bits, least significant first."""
    return ((values[..., None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def _from_bits(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(bits.shape[-1], dtype=np.uint64)).sum(-1, dtype=np.uint64)


def image_matrix(pixels: np.ndarray, grid: Grid) -> np.ndarray:
    """Rows of groups, row by row, of an image (height, width, channels) of bytes."""
    values = to_model(pixels, grid.model)
    gh, gw = grid.group_height, grid.group_width
    padded = np.zeros((grid.rows * gh, grid.columns * gw, grid.channels), np.uint8)
    padded[: grid.height, : grid.width] = values
    groups = padded.reshape(grid.rows, gh, grid.columns, gw, grid.channels).transpose(0, 2, 4, 1, 3).reshape(-1, grid.channels, gh * gw).astype(np.int32)
    first = groups[..., :1]
    if grid.transform == "raw":
        parts = [_to_bits(groups, 8).reshape(*groups.shape[:2], -1)]
    elif grid.transform == "first_pixel":
        d = groups[..., 1:] - first
        parts = [_to_bits(first[..., 0], 8), _to_bits(np.where(d >= 0, 2 * d, -2 * d - 1), 9).reshape(*groups.shape[:2], -1)]
    elif grid.transform == "minimum":
        at = groups.argmin(-1)
        low = groups.min(-1)
        rest = (groups - low[..., None])[np.arange(groups.shape[-1]) != at[..., None]].reshape(*groups.shape[:2], -1)
        parts = [_to_bits(low, 8), _to_bits(at, position_bits(groups.shape[-1])), _to_bits(rest, 8).reshape(*groups.shape[:2], -1)]
    else:
        raise InvalidConfig(f"transform: {grid.transform}")
    return np.concatenate(parts, -1).reshape(len(groups), -1)


def matrix_image(bits: np.ndarray, grid: Grid) -> np.ndarray:
    """The image of all rows of groups."""
    gh, gw, n = grid.group_height, grid.group_width, grid.group_height * grid.group_width
    part = bits.reshape(len(bits), grid.channels, -1)
    if grid.transform == "raw":
        groups = _from_bits(part.reshape(*part.shape[:2], n, 8)).astype(np.int64)
    elif grid.transform == "first_pixel":
        first = _from_bits(part[..., :8]).astype(np.int64)[..., None]
        code = _from_bits(part[..., 8:].reshape(*part.shape[:2], n - 1, 9)).astype(np.int64)
        groups = np.concatenate([first, first + np.where(code & 1, -(code + 1) // 2, code // 2)], -1)
    else:
        p = position_bits(n)
        low, at = _from_bits(part[..., :8]).astype(np.int64), _from_bits(part[..., 8 : 8 + p]).astype(np.int64)
        rest = _from_bits(part[..., 8 + p :].reshape(*part.shape[:2], n - 1, 8)).astype(np.int64)
        if (at >= n).any():
            raise InvalidFormat("a place outside the group")
        groups = np.zeros((*part.shape[:2], n), np.int64)
        groups[np.arange(n) != at[..., None]] = rest.reshape(-1)
        groups += low[..., None]
    if (groups < 0).any() or (groups > 255).any():
        raise InvalidFormat("a value that is no byte")
    image = groups.reshape(grid.rows, grid.columns, grid.channels, gh, gw).transpose(0, 3, 1, 4, 2).reshape(grid.rows * gh, grid.columns * gw, grid.channels)
    return from_model(image[: grid.height, : grid.width].astype(np.uint8), grid.model)


def crop_rows(grid: Grid, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """Row numbers of the groups that an inclusive rectangle touches."""
    if not (0 <= x1 <= x2 < grid.width and 0 <= y1 <= y2 < grid.height):
        raise OutOfRange("a crop outside the image")
    gx = np.arange(x1 // grid.group_width, x2 // grid.group_width + 1)
    gy = np.arange(y1 // grid.group_height, y2 // grid.group_height + 1)
    return (gy[:, None] * grid.columns + gx).reshape(-1)


def crop(c: Compressed, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """Part of an image, from the groups it touches alone."""
    g, rows = c.grid, crop_rows(c.grid, x1, y1, x2, y2)
    left, top = x1 // g.group_width * g.group_width, y1 // g.group_height * g.group_height
    columns = x2 // g.group_width - x1 // g.group_width + 1
    part = Grid(columns * g.group_width, len(rows) // columns * g.group_height, g.channels, g.model, g.transform, g.group_width, g.group_height)
    return matrix_image(c.matrix(rows), part)[y1 - top : y2 - top + 1, x1 - left : x2 - left + 1]


# --- compression --------------------------------------------------------------------------------------------------


def profile(bits: np.ndarray, order: list[int]) -> list[int]:
    """Distinct prefixes of the order, all lengths."""
    if not len(bits):
        return [0] * (len(order) + 1)
    rows = np.unique(bits[:, order], axis=0)
    differ = rows[1:] != rows[:-1]
    first = differ.argmax(1) if len(order) else np.zeros(0, int)
    return [1, *(1 + np.cumsum(np.bincount(first, minlength=len(order)))).tolist()]


def entropy_order(bits: np.ndarray) -> tuple[list[int], list[float], int]:
    """Positions by entropy, their entropies, and how many are constant."""
    n, ones = len(bits), bits.sum(0, dtype=np.int64)
    weight = np.minimum(ones, n - ones)
    order = np.argsort(weight, kind="stable")
    return order.tolist(), [value_of_entropy(int(ones[p]), n) for p in order], int((weight == 0).sum())


def compress(bits: np.ndarray, columns: list[Column], decay: float = 0.45, patience: int = 5, least: int | None = None, encoding: str = "huffman", table: str = "raw", grid: Grid | None = None) -> Compressed:
    """Adaptive selection, at least ``least`` bases, a sorted dictionary, one of the encodings."""
    order, entropies, constants = entropy_order(bits)
    prof = profile(bits, order)
    model = select.SizeModel(len(bits), bits.shape[1], len(columns))
    best = select.adaptive(model, prof, entropies, constants, decay, patience).best
    return dictionary(bits, columns, order[: select.enforce_minimum(prof, best, least)], encoding, table, grid)


def dictionary(bits: np.ndarray, columns: list[Column], selected: list[int], encoding: str = "huffman", table: str = "raw", grid: Grid | None = None) -> Compressed:
    """The compressed form for a selection of positions."""
    states = np.zeros(bits.shape[1], np.uint8)
    ones = bits.sum(0, dtype=np.int64)
    states[selected] = VARIABLE
    states[(states == VARIABLE) & (ones == 0)] = ZERO
    states[(states == VARIABLE) & (ones == len(bits)) & (ones > 0)] = ONE
    var = bits[:, states == VARIABLE]
    bases = np.unique(var, axis=0) if len(bits) else var
    order = np.argsort(np.minimum(b := bases.sum(0, dtype=np.int64), len(bases) - b), kind="stable")
    at = np.lexsort(bases[:, order[::-1]].T)[::-1] if bases.shape[1] else np.arange(len(bases))
    bases = bases[at]
    if bases.shape[1]:
        packed = {r.tobytes(): i for i, r in enumerate(np.ascontiguousarray(bases))}
        ids = np.array([packed[r.tobytes()] for r in np.ascontiguousarray(var)], np.int64)
    else:
        ids = np.zeros(len(bits), np.int64)
    return Compressed(columns, len(bits), states, bases, ids, bits[:, states == DEVIATION], order.tolist(), [], encoding, table, grid)


def compress_image(pixels: np.ndarray, model: str = "ycocg_r", transform: str = "first_pixel", group: tuple[int, int] = (1, 1), **kw) -> Compressed:
    height, width, channels = pixels.shape
    if channels not in (3, 4):
        raise InvalidConfig(f"{channels} channels")
    grid = Grid(width, height, channels, model, transform, *group)
    return compress(image_matrix(pixels, grid), [Column(ANY_WIDTH, grid.channel_bits) for _ in range(channels)], grid=grid, **kw)


# --- bit streams --------------------------------------------------------------------------------------------------


def _bytes_of(bits: np.ndarray) -> bytes:
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise InvalidFormat("the data end too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def bits(self, n: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.take(-(-n // 8)), np.uint8), bitorder="little")[:n]


def _symbols(c: Compressed) -> np.ndarray:
    """(rows, deviation and id bits)."""
    return np.concatenate([c.deviations, _to_bits(c.ids, bits_needed(len(c.bases)))], 1)


def _blocks(c: Compressed) -> list[tuple[int, int]]:
    """Spans of rows that are encoded by themselves; condensed rows come last."""
    out = [(s, min(s + c.row_width, c.n)) for s in range(0, c.n, c.row_width)]
    return out + ([(c.n, len(c.ids))] if len(c.ids) > c.n else [])


def _write_stream(c: Compressed) -> bytes:
    sym, rows = _symbols(c), -(-c.n // c.row_width) if c.n else 0
    if c.encoding == "normal":
        return bytes([0]) + _bytes_of(sym.reshape(-1))
    if c.encoding == "rle":
        codes = np.unique(np.packbits(sym, axis=1), axis=0, return_inverse=True)[1].reshape(-1) if len(sym) else np.zeros(0, int)
        packets, picked, offsets = [], [], []
        for s, e in _blocks(c):
            if s < c.n:
                offsets.append((len(packets), len(picked) * sym.shape[1]))
            i = s
            for r, m in encode.packets_of(codes[s:e]):
                if r:
                    picked.append(i)
                    i += r + 1
                picked += range(i, i + m)
                i += m
                packets.append((r, m))
        head = struct.pack("<BII", 2, rows, c.row_width) + b"".join(struct.pack("<II", *o) for o in offsets)
        return head + struct.pack("<I", len(packets)) + bytes(v for p in packets for v in p) + _bytes_of(sym[picked].reshape(-1))
    counts = dict(enumerate(np.bincount(c.ids, minlength=len(c.bases)).tolist()))
    table = encode.canonical(encode.huffman_lengths(counts))
    id_bits, dev = bits_needed(len(c.bases)), c.deviations.shape[1]
    if dev > 255:
        raise OutOfRange("over 255 deviation bits in a Huffman stream")
    lengths = np.array([table[i][0] for i in range(len(c.bases))], np.int64) if table else np.zeros(1, np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths[c.ids])]) if len(c.ids) else np.zeros(1, np.int64)
    code_bits = np.zeros(int(starts[-1]), np.uint8)
    for i, (n, code) in table.items():
        at = starts[:-1][c.ids == i]
        for k in range(n):  # most significant bit first
            code_bits[at + k] = code >> (n - 1 - k) & 1
    offsets = starts[:-1][: c.n : c.row_width] if c.n else []
    out = struct.pack("<BIBBII", 3, len(table), id_bits, dev, rows, c.row_width)
    out += b"".join(s.to_bytes(-(-id_bits // 8), "little") + bytes([n]) for s, (n, _) in sorted(table.items(), key=lambda x: (x[1][0], x[0])))
    return out + struct.pack(f"<{rows}I", *[int(o) for o in offsets]) + _bytes_of(c.deviations.reshape(-1)) + _bytes_of(code_bits)


def _read_stream(r: _Reader, samples: int, dev: int, k: int, n: int) -> tuple[str, np.ndarray, np.ndarray]:
    ids_width, tag = bits_needed(k), r.number(1)
    width = dev + ids_width
    if tag == 0:
        sym = r.bits(samples * width).reshape(samples, width)
        return "normal", _from_bits(sym[:, dev:]).astype(np.int64), sym[:, :dev]
    if tag == 2:
        rows = r.number(4)
        r.number(4)
        r.take(8 * rows)
        packets = np.frombuffer(r.take(2 * r.number(4)), np.uint8).reshape(-1, 2).astype(np.int64)
        repeat = np.concatenate([np.concatenate([[a + 1] if a else [], np.ones(b)]) for a, b in packets] or [np.zeros(0)]).astype(np.int64)
        sym = r.bits(len(repeat) * width).reshape(-1, width)
        sym = np.repeat(sym, repeat, axis=0)
        if len(sym) != samples:
            raise InvalidFormat("runs that don't add up to the rows")
        return "rle", _from_bits(sym[:, dev:]).astype(np.int64), sym[:, :dev]
    if tag != 3:
        raise InvalidFormat(f"encoding {tag}")
    count, id_bits, dev_bits, rows = r.number(4), r.number(1), r.number(1), r.number(4)
    if id_bits != ids_width or dev_bits != dev:
        raise InvalidFormat("widths that contradict the layout")
    r.number(4)
    lengths = {}
    for _ in range(count):
        s = r.number(-(-id_bits // 8))
        lengths[s] = r.number(1)
    r.take(4 * rows)
    deviations = r.bits(samples * dev).reshape(samples, dev)
    codes = {(n_, c_): s for s, (n_, c_) in encode.canonical(lengths).items()}
    stream, ids, i = r.bits(8 * (len(r.data) - r.at)).tolist(), np.zeros(samples, np.int64), 0
    for row in range(samples):
        code = size = 0
        while True:
            if i >= len(stream) or size > encode.MOST_CODE:
                raise InvalidFormat("a code that isn't in the table")
            code, size, i = code << 1 | stream[i], size + 1, i + 1
            if (size, code) in codes:
                ids[row] = codes[size, code]
                break
    return "huffman", ids, deviations


def _write_table(c: Compressed) -> bytes:
    v, k = c.bases.shape[1], len(c.bases)
    if c.table == "raw" or not k:
        return struct.pack("<BQ", 0, k) + (np.packbits(c.bases, axis=1, bitorder="little").tobytes() if v else b"")
    tiers = encode.UNARY_TIERS if c.table == "unary" else encode.FIXED_TIERS
    keys = [int("".join(map(str, row)) or "0", 2) for row in c.bases[:, c.order].tolist()]
    bits: list[int] = []
    for a, b in zip(keys, keys[1:]):
        d = a - b - 1
        if d < 0:
            raise InvalidFormat("a dictionary that isn't sorted")
        tier = next((i for i, w in enumerate(tiers) if d.bit_length() <= w), len(tiers))
        if c.table == "unary":
            bits += [1] * tier + ([0] if tier < len(tiers) else [])
        else:
            bits += [tier >> i & 1 for i in range(6)]
        bits += [d >> i & 1 for i in range(tiers[tier] if tier < len(tiers) else v)]
    size = -(-bits_needed(max(1, v)) // 8)
    out = struct.pack("<BQQ", TABLES[c.table], k, len(c.order)) + b"".join(o.to_bytes(size, "little") for o in c.order)
    out += keys[0].to_bytes(-(-v // 8), "little")
    return out + struct.pack("<QQ", k - 1, len(bits)) + _bytes_of(np.array(bits, np.uint8))


def _read_table(r: _Reader, v: int) -> tuple[str, np.ndarray, list[int]]:
    tag, k = r.number(1), r.number(8)
    if tag == 0:
        size = -(-v // 8)
        raw = np.frombuffer(r.take(k * size), np.uint8).reshape(k, size)
        return "raw", np.unpackbits(raw, axis=1, bitorder="little")[:, :v] if v else np.zeros((k, 0), np.uint8), []
    if tag not in (1, 2):
        raise InvalidFormat(f"table {tag}")
    tiers, size = (encode.UNARY_TIERS if tag == 1 else encode.FIXED_TIERS), -(-bits_needed(max(1, v)) // 8)
    order = [r.number(size) for _ in range(r.number(8))]
    if sorted(order) != list(range(v)):
        raise InvalidFormat("an order that isn't one")
    key = r.number(-(-v // 8))
    deltas, length = r.number(8), r.number(8)
    bits, i, keys = r.bits(length).tolist(), 0, [key]
    if deltas != k - 1:
        raise InvalidFormat("as many deltas as bases, but for one")
    for _ in range(deltas):
        if tag == 1:
            tier = 0
            while tier < len(tiers) and bits[i]:
                tier, i = tier + 1, i + 1
            i += tier < len(tiers)
        else:
            tier = sum(b << j for j, b in enumerate(bits[i : i + 6]))
            i += 6
        width = tiers[tier] if tier < len(tiers) else v
        key -= sum(b << j for j, b in enumerate(bits[i : i + width])) + 1
        i += width
        keys.append(key)
    if i != length or min(keys) < 0:
        raise InvalidFormat("a delta stream that doesn't end where it says")
    bases = np.zeros((k, v), np.uint8)
    for row, x in enumerate(keys):
        for rank, column in enumerate(order):
            bases[row, column] = x >> (v - 1 - rank) & 1
    return ("unary" if tag == 1 else "fixed"), bases, order


def write(c: Compressed) -> bytes:
    """The container without names: counts, features with the state of each bit, weights, dictionary, stream."""
    if not c.columns:
        raise InvalidConfig("one column at least")
    out, at = [b"EGD\x01" + struct.pack("<QQQ", c.n, len(c.weights), len(c.columns))], 0
    for col in c.columns:
        extra = struct.pack("<B", col.scale) if col.transform in (1, 4) else b""
        if col.transform in (2, 4):
            extra += struct.pack("<q", col.minimum)
        elif col.transform == 3:
            extra += struct.pack("<Q", col.minimum)
        states = c.states[at : at + col.width]
        at += col.width
        pairs = np.stack([states & 1, states >> 1], 1).reshape(-1)
        out.append(bytes([1, col.tag, col.transform]) + extra + struct.pack("<H", col.width) + _bytes_of(pairs))
    size = -(-bits_needed(c.n) // 8)
    return b"".join([*out, *(w.to_bytes(size, "little") for w in c.weights), _write_table(c), _write_stream(c)])


def read(data: bytes, grid: Grid | None = None) -> Compressed:
    """Parses what write() gives; anything that contradicts itself is an error."""
    r = _Reader(data)
    if r.take(4) != b"EGD\x01":
        raise InvalidFormat("not a container of version 1")
    n, m, d = r.number(8), r.number(8), r.number(8)
    if not d:
        raise InvalidFormat("no columns")
    columns, states = [], []
    for _ in range(d):
        if r.number(1) != 1:
            raise InvalidFormat("an unknown kind of column")
        col = Column(r.number(1), 0, r.number(1))
        if col.transform == 1:
            col.scale = r.number(1)
        elif col.transform in (2, 4):
            col.scale = r.number(1) if col.transform == 4 else 0
            col.minimum = struct.unpack("<q", r.take(8))[0]
        elif col.transform == 3:
            col.minimum = r.number(8)
        elif col.transform:
            raise InvalidFormat(f"transform {col.transform}")
        col.width = r.number(2)
        pairs = r.bits(2 * col.width).reshape(-1, 2)
        states.append(pairs[:, 0] | pairs[:, 1] << 1)
        columns.append(col)
    state = np.concatenate(states)
    size = -(-bits_needed(n) // 8)
    weights = [r.number(size) for _ in range(m)]
    table, bases, order = _read_table(r, int((state == VARIABLE).sum()))
    encoding, ids, deviations = _read_stream(r, n + m, int((state == DEVIATION).sum()), len(bases), n)
    if len(ids) and ids.max() >= len(bases):
        raise InvalidFormat("an id without a base")
    if encoding != "huffman" and any(r.take(len(data) - r.at)):
        raise InvalidFormat("data behind the end")
    return Compressed(columns, n, state, bases, ids, deviations, order, weights, encoding, table, grid)


def write_image(c: Compressed) -> bytes:
    g, payload = c.grid, write(c)
    return b"IGD\x01" + struct.pack("<IIBBBBIIQ", g.width, g.height, g.channels, g.colorspace, MODELS.index(g.model), TRANSFORMS.index(g.transform), g.group_width, g.group_height, len(payload)) + payload


def image_header(data: bytes) -> tuple[Grid, int]:
    """The grid and the payload's length from the first 32 bytes."""
    if len(data) < 32 or data[:4] != b"IGD\x01":
        raise InvalidFormat("not an image container of version 1")
    w, h, ch, space, model, transform, gw, gh, n = struct.unpack("<IIBBBBIIQ", data[4:32])
    if not (w and h and gw and gh) or ch not in (3, 4) or model > 2 or transform > 2 or space > 1:
        raise InvalidFormat("a header that makes no sense")
    return Grid(w, h, ch, MODELS[model], TRANSFORMS[transform], gw, gh, space), n


def read_image(data: bytes) -> Compressed:
    grid, n = image_header(data)
    if 32 + n != len(data):
        raise InvalidFormat("a payload of another length")
    c = read(data[32:], grid)
    if c.n != grid.rows * grid.columns or sum(x.width for x in c.columns) != grid.channels * grid.channel_bits:
        raise InvalidFormat("a grid of another size")
    return c


def write_table(c: Compressed) -> bytes:
    names = b"".join(struct.pack("<H", len(b := col.name.encode())) + b for col in c.columns)
    types, payload = bytes(NUMBERS.get(col.dtype, 255) for col in c.columns), write(c)
    return b"TGD\x01" + struct.pack("<II", len(c.columns), len(names)) + names + struct.pack("<I", len(types)) + types + struct.pack("<Q", len(payload)) + payload


def read_table(data: bytes) -> Compressed:
    r = _Reader(data)
    if r.take(4) != b"TGD\x01":
        raise InvalidFormat("not a table container of version 1")
    d, size = r.number(4), r.number(4)
    end, names = r.at + size, []
    while r.at < end:
        names.append(r.take(r.number(2)).decode())
    types = r.take(r.number(4))
    payload = r.take(r.number(8))
    if r.at != len(data) or len(names) != d or len(types) != d:
        raise InvalidFormat("sections that don't fit")
    c, of = read(payload), {v: k for k, v in NUMBERS.items()}
    if len(c.columns) != d:
        raise InvalidFormat("another number of columns")
    for col, name, t in zip(c.columns, names, types):
        col.name, col.dtype = name, of.get(t, "double")
    return c


def sizes(c: Compressed) -> dict[str, int]:
    """Bytes of the container and its parts."""
    total, table, stream = len(write(c)), len(_write_table(c)), len(_write_stream(c))
    return {"total": total, "base_table": table, "stream": stream, "params": total - table - stream}


# --- extraction ---------------------------------------------------------------------------------------------------


def dictionary_values(c: Compressed, interleaved: bool = False) -> list[int]:
    """Each base as a number: its selected positions, ascending (or interleaved), the first as the most significant bit."""
    if c.weights:
        raise InvalidConfig("dictionaries of files with condensed samples aren't extracted")
    positions = np.flatnonzero(c.states != DEVIATION)
    if interleaved:
        if not c.grid or c.grid.channels != 3 or len(c.states) != 24 or (c.grid.group_width, c.grid.group_height) != (1, 1):
            raise InvalidConfig("interleaving needs three channels of single pixels")
        positions = np.array(sorted(positions.tolist(), key=lambda p: (7 - p % 8, p // 8)), np.int64)
    full = np.zeros((len(c.bases), len(c.states)), np.uint8)
    full[:, c.states == ONE] = 1
    full[:, c.states == VARIABLE] = c.bases
    return [int("".join(map(str, row)) or "0", 2) for row in full[:, positions].tolist()]


def extract(c: Compressed) -> dict:
    """A document of the dictionary, its frequencies, the layout and the base of each row."""
    names = ("deviation", "variable", "zero", "one")
    positions = np.flatnonzero(c.states != DEVIATION)
    counts = np.bincount(c.ids, minlength=len(c.bases)).tolist()
    width = len(positions)
    return {
        "image": None if c.grid is None else {"width": c.grid.width, "height": c.grid.height, "channels": c.grid.channels, "pixel_group_width": c.grid.group_width, "pixel_group_height": c.grid.group_height},
        "base_bits": width,
        "bit_states": [names[s] for s in c.states],
        "bases": [{"id": i, "bits": format(v, f"0{width}b") if width else "", "count": counts[i]} for i, v in enumerate(dictionary_values(c))],
        "base_ids": c.ids.tolist(),
    }
