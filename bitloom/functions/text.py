"""Names of files and numbers for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_id(path: Column) -> Column:
    """The file name without folders (of either slash) and without a known ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(\.network)?\.(npz|igd|png|parquet)$", "")


def with_extension(path: str, extension: str) -> str:
    """The path with the extension, unless it has it already (in either case)."""
    return path if path.lower().endswith(extension) else path + extension


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    raise AssertionError


def duration_text(seconds: float) -> str:
    if seconds < 1:
        return f"{seconds * 1000:.1f} ms"
    return f"{seconds:.2f} s" if seconds < 60 else f"{int(seconds // 60)} min {seconds % 60:.0f} s"


def saving_pct(size: Column, reference: Column) -> Column:
    """100 * (1 - size / reference); null if the reference is 0 or null."""
    return F.when(reference != 0, 100.0 * (1 - size / reference))
