"""Images in and out: PNG and BMP files as pixels, conversions of whole folders, CIFAR archives."""

from __future__ import annotations

import io
import pickle
import struct
import tarfile
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidFormat
from . import objects

_PNG = b"\x89PNG\r\n\x1a\n"
CHANNELS = ("r", "g", "b")
# Classes of the archive, in the order of their labels.
CIFAR_CLASSES = ("airplane", "automobile", "bird", "cat", "deer", "dog", "frog", "horse", "ship", "truck")


def write_png(pixels: np.ndarray) -> bytes:
    """An 8-bit RGB or RGBA image, with the Sub filter where it makes a line's bytes smaller."""
    h, w, ch = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows, left = pixels.reshape(h, -1), np.zeros((h, w * ch), np.uint8)
    left[:, ch:] = rows[:, :-ch]
    sub = rows - left
    cost = lambda x: np.minimum(x, 256 - x.astype(np.int32)).sum(1)
    pick = cost(sub) < cost(rows)
    raw = np.concatenate([pick[:, None].astype(np.uint8), np.where(pick[:, None], sub, rows)], 1).tobytes()
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if ch == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """(height, width, 3 or 4) of an 8-bit grey, RGB, palette or RGBA image that isn't interlaced."""
    if data[:8] != _PNG:
        raise InvalidFormat("not a PNG file")
    at, idat, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if len(body) < n:
            raise InvalidFormat("a PNG file that ends too early")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 3, 4, 6) or head[6]:
        raise InvalidFormat("only 8-bit PNG files that aren't interlaced")
    w, h, kind = head[0], head[1], head[3]
    ch = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8)
        lines = raw.reshape(h, w * ch + 1)
    except (zlib.error, ValueError) as e:
        raise InvalidFormat(f"damaged PNG data: {e}") from e
    out, above = np.zeros((h, w * ch), np.uint8), np.zeros(w * ch, np.int32)
    for y in range(h):
        kind_, line = int(lines[y, 0]), lines[y, 1:].astype(np.int32)
        if kind_ == 1:  # running sums per channel
            line = line.reshape(w, ch).cumsum(0).reshape(-1)
        elif kind_ == 2:
            line = line + above
        elif kind_ in (3, 4):
            for x in range(w * ch):
                a = line[x - ch] if x >= ch else 0
                if kind_ == 3:
                    p = (a + above[x]) // 2
                else:
                    b, c = above[x], above[x - ch] if x >= ch else 0
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if da <= db and da <= dc else b if db <= dc else c
                line[x] = (line[x] + p) & 255
        elif kind_:
            raise InvalidFormat(f"PNG filter {kind_}")
        above = line & 255
        out[y] = above
    image = out.reshape(h, w, ch)
    if kind == 3:
        return palette[image[..., 0]]
    if kind == 0:
        return np.repeat(image, 3, 2)
    return np.concatenate([np.repeat(image[..., :1], 3, 2), image[..., 1:]], 2) if kind == 4 else image


def read_bmp(data: bytes) -> np.ndarray:
    """(height, width, 3) of an uncompressed BMP file of 24 or 32 bits."""
    if data[:2] != b"BM" or len(data) < 54:
        raise InvalidFormat("not a BMP file")
    start, w, h, depth, packed = *struct.unpack("<I", data[10:14]), *struct.unpack("<ii", data[18:26]), *struct.unpack("<HI", data[28:34])
    if depth not in (24, 32) or packed not in (0, 3):
        raise InvalidFormat("only uncompressed BMP files of 24 or 32 bits")
    stride = (w * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * depth // 8].reshape(abs(h), w, -1)
    return np.ascontiguousarray((rows[::-1] if h > 0 else rows)[..., 2::-1])


def decode(data: bytes) -> np.ndarray:
    """By the first bytes; formats without a decoder here are an error."""
    if data[:8] == _PNG:
        return read_png(data)
    if data[:2] == b"BM":
        return read_bmp(data)
    raise InvalidFormat("an image format without a decoder")


def pixels(files: DataFrame, name: str = "path") -> DataFrame:
    """(name, y, x, r, g, b, a, error) of image files (name, content): a damaged file is one row that says why; a is null without alpha."""

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf[name], pdf["content"]):
                try:
                    image = decode(bytes(content))
                except InvalidFormat as e:
                    yield pd.DataFrame({name: [path], **dict.fromkeys(("y", "x", "r", "g", "b", "a")), "error": [str(e)]})
                    continue
                y, x = np.indices(image.shape[:2])
                alpha = image[..., 3].ravel().astype("float") if image.shape[2] == 4 else None
                yield pd.DataFrame({name: path, "y": y.ravel(), "x": x.ravel(), **{c: image[..., i].ravel().astype(int) for i, c in enumerate(CHANNELS)}, "a": alpha, "error": None})

    return files.select(name, "content").mapInPandas(run, f"`{name}` string, y int, x int, r int, g int, b int, a int, error string")


def converted(files: DataFrame, model: str, name: str = "path") -> DataFrame:
    """(name, content): PNG files whose channels hold a colour model (ycocg, ycocg_r or ycbcr)."""

    def run(batches):
        for pdf in batches:
            out = []
            for content in pdf["content"]:
                image = decode(bytes(content))
                out.append(write_png(_ycbcr(image) if model == "ycbcr" else objects.to_model(image, model)))
            yield pd.DataFrame({name: pdf[name], "content": out})

    return files.select(name, "content").mapInPandas(run, f"`{name}` string, content binary")


def _ycbcr(image: np.ndarray) -> np.ndarray:
    rgb, out = image[..., :3].astype(float), image.copy()
    m = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
    out[..., :3] = np.clip(np.floor(rgb @ m.T + [0, 128, 128] + 0.5), 0, 255).astype(np.uint8)
    return out


def compressed(files: DataFrame, name: str = "path", **options) -> DataFrame:
    """(name, k, content, error): image files as containers, straight from their bytes."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf[name], pdf["content"]):
                try:
                    c = objects.compress_image(decode(bytes(content)), **options)
                    rows.append((path, len(c.bases), objects.write_image(c), None))
                except InvalidFormat as e:
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[name, "k", "content", "error"]).convert_dtypes()

    return files.select(name, "content").mapInPandas(run, f"`{name}` string, k long, content binary, error string")


class _Plain(pickle.Unpickler):
    """Only what arrays of bytes need; archives are data from elsewhere."""

    allowed = {("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"), ("numpy", "ndarray"), ("numpy", "dtype"), ("_codecs", "encode")}

    def find_class(self, module, name):
        if (module, name) not in self.allowed:
            raise InvalidFormat(f"a pickle that asks for {module}.{name}")
        return super().find_class(module, name)


def cifar(files: DataFrame) -> DataFrame:
    """(batch, batch_index, label, class, file, pixels) of CIFAR-10 tar archives (path, content); pixels are 32 x 32 x 3 bytes, row by row."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(bytes(content))) as tar:
                    for member in tar:
                        name = member.name.rsplit("/", 1)[-1]
                        if not (name.startswith("data_batch") or name == "test_batch"):
                            continue
                        d = _Plain(tar.extractfile(member), encoding="bytes").load()
                        data = np.asarray(d[b"data"], np.uint8).reshape(-1, 3, 32, 32).transpose(0, 2, 3, 1)
                        labels = d[b"labels"]
                        names = [n.decode() for n in d.get(b"filenames", [b""] * len(labels))]
                        yield pd.DataFrame({"batch": name, "batch_index": np.arange(len(labels)), "label": labels, "class": [CIFAR_CLASSES[i] for i in labels], "file": names, "pixels": [x.tobytes() for x in data]})

    return files.select("content").mapInPandas(run, "batch string, batch_index long, label int, class string, file string, pixels binary")


def bytes_to_pixels(df: DataFrame, column: str, width: int, channels: int = 3) -> DataFrame:
    """Rows of packed pixels exploded to (y, x, r, g, b), by built-in functions."""
    text = F.hex(column)
    count = F.octet_length(column) / channels
    at = df.withColumn("_t", text).withColumn("_i", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    value = lambda c: F.conv(F.substr(F.col("_t"), (F.col("_i") * (2 * channels) + 2 * c + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    return at.select(*[c for c in df.columns if c != column], F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).cast("int").alias("x"), *[value(i).alias(n) for i, n in enumerate(CHANNELS)])
