"""Vector columns as bytes, shared by near-duplicate and nearest-neighbour search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(vec: str) -> str:
    """SQL condition: not null, no null or non-finite component, not all zero."""
    return (f"{vec} is not null and size({vec}) > 0 and forall({vec}, x -> x is not null and not isnan(x) and "
            f"abs(x) < double('infinity')) and exists({vec}, x -> x <> 0)")


def packed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, dim, vec)``: usable vectors as little-endian floats where the column holds floats,
    else as doubles; exactly as given, so that a shuffle carries no more than the input."""
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = col.offsets.to_numpy()[1:] - col.offsets[0].as_py()
            raw, starts = flat.tobytes(), np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array((ends - starts).astype(np.int32)),
                pa.array([raw[width * i:width * j] for i, j in zip(starts, ends)], pa.binary())], ["id", "dim", "vec"])

    rows = df.where(usable(f"`{vec_col}`")).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, dim int, vec binary")


def matrix(col: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors of one length as doubles, whichever width they were packed in."""
    raw = b"".join(col.to_pylist())
    single = len(raw) < 8 * dim * len(col)
    return np.frombuffer(raw, dtype="<f4" if single else "<f8").reshape(-1, dim).astype(np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    # scaled by the largest component first, so that squares neither overflow nor vanish
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))
