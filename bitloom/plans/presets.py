"""Named pipelines over a table, and statistics that are kept by what they were computed from."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfig
from ..layout import BitLayout, bits_needed
from ..operators import bitstats, dictionary, encode, preprocess, profile, select


@dataclass(frozen=True)
class Preset:
    """How to choose base bits and encode rows."""

    selector: str = "adaptive"
    decay: float = 0.5
    patience: int = 10
    entropy: float = 0.5
    approximate: bool = False
    least: int | None = None
    sort: bool = True
    encoding: str = "huffman"


PRESETS = {
    "best": Preset(),
    "best_rle": Preset(encoding="rle"),
    "fast": Preset(selector="threshold", entropy=0.9, patience=1, approximate=True, sort=False, encoding="normal"),
    "image": Preset(decay=0.45, patience=5, least=1),
}


def choose(bits: DataFrame, layout: BitLayout, preset: Preset) -> tuple[list[int], select.Walk]:
    """The positions that a preset selects, and the steps of its walk."""
    counts = bitstats.order(bitstats.ones(bits, layout))
    order = [c[0] for c in counts]
    prof = (profile.k_profile_approx if preset.approximate else profile.k_profile)(bits, order)
    model = select.SizeModel(counts[0][2] if counts else 0, layout.bits, len(layout.features))
    entropies, constants = [bitstats.value_of_entropy(k, n) for _, k, n in counts], sum(min(k, n - k) == 0 for _, k, n in counts)
    if preset.selector == "adaptive":
        walk = select.adaptive(model, prof, entropies, constants, preset.decay, preset.patience)
    elif preset.selector == "threshold":
        walk = select.threshold(model, prof, entropies, preset.entropy, preset.patience)
    elif preset.selector == "naive":
        walk = select.naive(model, prof, constants, preset.patience)
    elif preset.selector == "all":
        walk = select.all_bits(model, prof)
    else:
        raise InvalidConfig(f"selector: {preset.selector}")
    return order[: select.enforce_minimum(prof, walk.best, preset.least)], walk


def compress(df: DataFrame, columns: list[str], keys: list[str], preset: Preset | str = "best", **infer) -> tuple[dictionary.Dictionary, select.Walk]:
    """The dictionary form of a table: layout, selection, bases and rows."""
    preset = PRESETS[preset] if isinstance(preset, str) else preset
    layout = preprocess.infer(df, columns, **infer)
    bits = preprocess.pack(df, layout, keys)
    selected, walk = choose(bits, layout, preset)
    return dictionary.build(bits, layout, selected, keys, preset.sort), walk


def encoded_bits(d: dictionary.Dictionary, keys: list[str], encoding: str, block: int = 1024) -> int:
    """Bits of the rows in an encoding; rows are in the order of one key that counts up from 0."""
    n, k = d.rows.count(), d.bases.count()
    if encoding == "normal":
        return encode.normal_size(n, d.deviation_bits, k)
    if encoding == "huffman":
        return encode.huffman_size(encode.huffman_codes(d.rows), -(-n // block), d.deviation_bits).first().bits
    if encoding == "rle":
        symbol = ["base_id", *[f"d{i}" for i in range(len(d.layout.limbs))]]
        packets = encode.packets(d.rows, symbol, keys[0], F.floor(F.col(keys[0]) / block))
        return encode.rle_size(packets, d.deviation_bits + bits_needed(k)).first().bits
    raise InvalidConfig(f"encoding: {encoding}")


def action(source: str, target: str | None = None, rows: str | None = None, crop: str | None = None, analytics: bool = False) -> str:
    """What to do with a file, by its extension and the options given; contradictions are errors."""
    ext = source.lower().rsplit(".", 1)[-1] if "." in source else ""
    images = ("png", "jpg", "jpeg", "bmp", "gif", "tiff", "webp")
    if rows and crop or analytics and (rows or crop):
        raise InvalidConfig("one of rows, crop and analytics")
    if ext == "csv" or ext in images:
        if rows or crop or analytics:
            raise InvalidConfig("rows, crop and analytics are for compressed files")
        return "compress_table" if ext == "csv" else "compress_image"
    if ext == "tgd":
        if crop:
            raise InvalidConfig("tables can't be cropped")
        return "analytics" if analytics else "decompress_rows" if rows else "decompress_table"
    if ext == "igd":
        if rows:
            raise InvalidConfig("images have no row ranges")
        return "analytics" if analytics else "decompress_crop" if crop else "decompress_image"
    raise InvalidConfig(f"an unknown kind of file: {source}")


def cached(df: DataFrame, path: str, context: dict, compute) -> DataFrame:
    """compute(df), kept as a table at ``path`` under a hash of ``context``; a known context reads the table alone."""
    from pyspark.errors import AnalysisException

    spark, key = df.sparkSession, json.dumps(context, sort_keys=True)
    digest = spark.range(1).select(F.sha2(F.lit(key), 256)).first()[0]
    target = f"{path}/context={digest}"
    try:
        return spark.read.parquet(target)
    except AnalysisException:
        compute(df).write.mode("errorifexists").parquet(target)
        return spark.read.parquet(target)
