"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; only a single-machine session may go without it."""
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="bitloom-"))


def col(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The user's whole row (or some columns) as one column, with places for names, so that none clashes."""
    places = [col(c).alias(f"c{i}") for i, c in enumerate(df.columns if columns is None else columns)]
    return F.struct(*(places or [F.lit(True).alias("none")]))


def unboxed(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The rows that ``boxed`` packed as ``box``, under their names; ``changed`` gives new values of some."""
    changed = changed or {}
    return df.select(*[changed.get(c, F.col(f"box.c{i}")).alias(c) for i, c in enumerate(columns)])


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small intermediate in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write an intermediate of the input's order of size as a compressed table in the shared checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordCache(dict):
    """A bounded dict of two generations: what was used in neither of the last two fills is forgotten.

    ``compute`` maps a list of distinct missing keys to their values, none of which is None.
    """

    def __init__(self, compute, cap: int = 500_000):
        super().__init__()
        self.compute, self.cap, self.old, self.missed = compute, cap, {}, []

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            self.missed.append(key)
        else:
            self[key] = value
        return value

    def forget(self, keep: int = 100_000) -> None:
        """Keep the keys that came first, which are the frequent ones; the rest of the memory is free again."""
        first = dict(islice((self.old or self).items(), keep))
        self.old = {}
        self.clear()
        self.update(first)

    def all(self, keys: list) -> list:
        out = list(map(self.__getitem__, keys))
        if self.missed:
            missing, self.missed = list(set(self.missed)), []
            self.update(zip(missing, self.compute(missing)))
            out = list(map(self.__getitem__, keys))
        if len(self) > self.cap:
            self.old = dict(self)
            self.clear()
        return out


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages, and each keeps what it ever needed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batches, rows: int = 512):
    """Arrow batches in parts of at most so many rows, so that what is made of them in Python stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def utf8_bytes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the offsets (len + 1) of each; a null counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=ends[1:])
    return np.frombuffer(b"".join(raw), np.uint8), ends


def groups_of_bytes(sizes: np.ndarray, most: int):
    """Slices of consecutive items whose sizes add up to about ``most`` (one item at least)."""
    start = total = 0
    for i, s in enumerate(sizes):
        if i > start and total + s > most:
            yield start, i
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        yield start, len(sizes)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Spark hand rows to Python in batches of at most so many (its own 10,000 whole texts take much memory)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
