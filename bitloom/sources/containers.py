"""Containers in Spark: sets of images compressed, read, audited and mapped, one object at a time in parallel tasks."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from . import objects


def _image_of(pdf: pd.DataFrame, channels: list[str]) -> np.ndarray:
    out = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, len(channels)), np.uint8)
    for i, c in enumerate(channels):
        out[pdf["y"], pdf["x"], i] = pdf[c]
    return out


def compress_images(pixels: DataFrame, image: str, channels: list[str], **options) -> DataFrame:
    """(image, k, base_bits, content) of pixels (image, y, x, channels...); an image is gathered in one task, a set never."""
    kind = dict(pixels.dtypes)[image]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = objects.compress_image(_image_of(pdf, channels), **options)
        return pd.DataFrame({image: [pdf[image].iloc[0]], "k": [len(c.bases)], "base_bits": [c.base_bits], "content": [objects.write_image(c)]})

    return pixels.select(image, "y", "x", *channels).groupBy(image).applyInPandas(run, f"`{image}` {kind}, k long, base_bits int, content binary")


def decompress_images(files: DataFrame, image: str, channels: list[str], crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The pixels of containers (image, content), or of an inclusive rectangle of each."""
    kind = dict(files.dtypes)[image]

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf[image], pdf["content"]):
                c = objects.read_image(bytes(content))
                x0, y0 = (crop[0], crop[1]) if crop else (0, 0)
                part = objects.crop(c, *crop) if crop else objects.matrix_image(c.matrix(), c.grid)
                y, x = np.indices(part.shape[:2])
                yield pd.DataFrame({image: name, "y": y.ravel() + y0, "x": x.ravel() + x0, **{ch: part[..., i].ravel().astype(np.int32) for i, ch in enumerate(channels)}})

    return files.select(image, "content").mapInPandas(run, f"`{image}` {kind}, y int, x int, " + ", ".join(f"`{c}` int" for c in channels))


def scan(spark: SparkSession, folder: str, glob: str = "*.igd", recursive: bool = True) -> DataFrame:
    """Files of a folder as (path, length, content); columns that aren't used aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(folder)


def headers(files: DataFrame, content: str = "content", length: str | None = None) -> DataFrame:
    """files with the fields of the image header and the sizes, by built-in functions on the first 32 bytes.

    ``error`` says what is wrong with a header; its other fields are then null.
    """
    head = F.substring(F.col(content), 1, 32)
    text = F.hex(head)

    def number(at: int, size: int):
        swapped = F.concat(*[F.substring(text, 2 * (at + i) + 1, 2) for i in range(size - 1, -1, -1)])
        return F.conv(swapped, 16, 10).cast("long")

    ok = F.octet_length(head) == 32
    magic = F.substring(text, 1, 8) == "49474401"
    size = F.col(length) if length else F.octet_length(content).cast("long")
    fields = {"width": number(4, 4), "height": number(8, 4), "channels": number(12, 1), "colorspace": number(13, 1), "color_model": number(14, 1), "grouping_transform": number(15, 1), "group_width": number(16, 4), "group_height": number(20, 4)}
    error = F.when(~ok, "truncated").when(~magic, "not an image container").when(number(24, 8) + 32 != size, "a payload of another length")
    out = files.withColumn("error", error).withColumns({k: F.when(F.col("error").isNull(), v) for k, v in fields.items()})
    raw = F.col("width") * F.col("height") * F.col("channels")
    return out.withColumns({"raw_bytes": raw, "igd_bytes": size}).withColumns({"saving_raw_pct": 100 * (1 - F.col("igd_bytes") / F.col("raw_bytes")), "raw_to_igd_ratio": F.col("raw_bytes") / F.col("igd_bytes"), "bits_per_pixel": 8 * F.col("igd_bytes") / (F.col("width") * F.col("height"))})


def base_counts(files: DataFrame, image: str) -> DataFrame:
    """(image, k, width, height, group_width, group_height, error): damaged files keep their row and say why."""
    kind = dict(files.dtypes)[image]

    def run(batches):
        for pdf in batches:
            rows = []
            for name, content in zip(pdf[image], pdf["content"]):
                try:
                    c = objects.read_image(bytes(content))
                    rows.append((name, len(c.bases), c.grid.width, c.grid.height, c.grid.group_width, c.grid.group_height, None))
                except objects.InvalidFormat as e:
                    rows.append((name, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[image, "k", "width", "height", "group_width", "group_height", "error"]).convert_dtypes()

    return files.select(image, "content").mapInPandas(run, f"`{image}` {kind}, k long, width int, height int, group_width int, group_height int, error string")


def dictionaries(files: DataFrame, image: str, interleaved: bool = False) -> DataFrame:
    """(image, value, base_id, count) of every base: the input of operators.features."""
    kind = dict(files.dtypes)[image]

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf[image], pdf["content"]):
                c = objects.read_image(bytes(content))
                yield pd.DataFrame({image: name, "value": objects.dictionary_values(c, interleaved), "base_id": np.arange(len(c.bases)), "count": np.bincount(c.ids, minlength=len(c.bases))})

    return files.select(image, "content").mapInPandas(run, f"`{image}` {kind}, value long, base_id long, count long")


def maps(files: DataFrame, image: str, interleaved: bool = True) -> DataFrame:
    """(image, y, x, scale, z): each image's adaptive cumulative map, row by row."""
    kind = dict(files.dtypes)[image]

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf[image], pdf["content"]):
                c = objects.read_image(bytes(content))
                z, scale = adaptive_map(objects.dictionary_values(c, interleaved))
                grid = z[c.ids].reshape(c.grid.rows, c.grid.columns)
                y, x = np.indices(grid.shape)
                yield pd.DataFrame({image: name, "y": y.ravel(), "x": x.ravel(), "scale": scale, "z": grid.ravel()})

    return files.select(image, "content").mapInPandas(run, f"`{image}` {kind}, y int, x int, scale int, z int")


def adaptive_map(values: list[int]) -> tuple[np.ndarray, int]:
    """z of each base by its id, and the scale."""
    order = np.argsort(np.array(values, np.int64), kind="stable")
    d = np.diff(np.array(values, np.float64)[order], prepend=np.array(values, np.float64)[order][:1])
    a = np.log2(1 + d) / np.log2(1 + d.max()) if len(d) and d.max() > 0 else np.zeros(len(d))
    scale = features.largest_scale(a)
    z = np.empty(len(values), np.int64)
    z[order] = np.arange(len(values)) + np.floor(scale * a).cumsum().astype(np.int64)
    return z, scale


def archives(arrays: DataFrame, image: str, names: list[str], width: int, dtype: str = "uint16") -> DataFrame:
    """(image, content): an uncompressed NPZ archive of named arrays from rows (image, y, x, names...)."""
    kind = dict(arrays.dtypes)[image]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values(["y", "x"]), io.BytesIO()
        np.savez(out, **{n: pdf[n].to_numpy().astype(dtype).reshape(-1, width) for n in names})
        return pd.DataFrame({image: [pdf[image].iloc[0]], "content": [out.getvalue()]})

    return arrays.groupBy(image).applyInPandas(run, f"`{image}` {kind}, content binary")


def ablation(pixels: DataFrame, image: str, channels: list[str], grid: list[dict]) -> DataFrame:
    """(image, variant, k, total, base_table, stream, params): container sizes for each combination of options."""
    kind = dict(pixels.dtypes)[image]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        array, rows = _image_of(pdf, channels), []
        for options in grid:
            c = objects.compress_image(array, **options)
            rows.append((pdf[image].iloc[0], ", ".join(f"{k}={v}" for k, v in options.items()), len(c.bases), *objects.sizes(c).values()))
        return pd.DataFrame(rows, columns=[image, "variant", "k", "total", "base_table", "stream", "params"])

    return pixels.select(image, "y", "x", *channels).groupBy(image).applyInPandas(run, f"`{image}` {kind}, variant string, k long, total long, base_table long, stream long, params long")


def extracted(files: DataFrame, image: str) -> DataFrame:
    """(image, document): the extracted document as JSON."""
    import json

    kind = dict(files.dtypes)[image]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({image: pdf[image], "document": [json.dumps(objects.extract(objects.read_image(bytes(c)))) for c in pdf["content"]]})

    return files.select(image, "content").mapInPandas(run, f"`{image}` {kind}, document string")
