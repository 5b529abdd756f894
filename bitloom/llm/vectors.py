"""What the operators on embeddings share."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, slices


def matrix(column) -> np.ndarray:
    """(n, d) doubles of equally long binary values."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1) if values else np.zeros((0, 1))


def usable(df: DataFrame, id_col: str, vec_col: str, label_col: str | None = None) -> DataFrame:
    """rid, id, label, d, v (the doubles as bytes; null unless a finite vector that isn't zero), key (digest of v and label)."""
    schema = "rid long, id long, label string, d int, v binary, key binary"
    label = col(label_col).cast("string") if label_col else F.lit("")

    def run(batches):
        for batch in slices(batches, 2048):
            vs, keys, dims = [], [], []
            labels = batch.column(2).to_pylist()
            for lab, x in zip(labels, batch.column(3).to_pylist()):
                v = None
                if x and lab is not None and None not in x:
                    a = np.array(x, np.float64)
                    v = a + 0.0 if np.isfinite(a).all() and a.any() else None  # + 0.0: no negative zeros
                vs.append(v.tobytes() if v is not None else None)
                dims.append(len(v) if v is not None else None)
                keys.append(hashlib.blake2b(vs[-1] + lab.encode("utf-8", "surrogatepass"), digest_size=16).digest() if v is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dims, pa.int32()), pa.array(vs, pa.binary()), pa.array(keys, pa.binary())], names=["rid", "id", "label", "d", "v", "key"])

    return df.select(F.monotonically_increasing_id().alias("rid"), col(id_col).cast("long").alias("id"), label.alias("label"), col(vec_col).cast("array<double>").alias("x")).mapInArrow(run, schema)


def sample(rows: DataFrame, most: int, total: int) -> np.ndarray:
    """About ``most`` vectors (at most twice as many) for fitting, chosen by a hash; in the order of their bytes."""
    share = min(1.0, most / max(1, total))
    got = rows.where(F.pmod(F.xxhash64("v", F.lit("fit")), F.lit(1_000_003)) < F.lit(share * 1_000_003)).select("v").limit(2 * most).collect()
    return np.frombuffer(b"".join(sorted(bytes(r.v) for r in got)), np.float64)
