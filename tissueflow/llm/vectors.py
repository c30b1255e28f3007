"""What the vector operators share: which rows count, and their entries as whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of this magnitude and more count as not finite, so that sums of products stay within 64 bits.
LIMIT = float(1 << 18)


def common_length(rows: DataFrame, vec_col: str) -> int:
    """The commonest length of the vectors, the longer one of two as common; 0 without vectors."""
    n = rows.filter(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = n.agg(F.max(F.struct("n", "d")).alias("m")).first()["m"]
    return best["d"] if best else 0


def whole(vectors: pa.Array, d: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors count, and those as ``floor(scale * entry)``: they aren't null, have ``d`` entries, and none
    of these is null, not finite, or of magnitude LIMIT and more."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    at = np.flatnonzero((vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == d) & vectors.is_valid().to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(at)).flatten().cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, d)  # a null is NaN here
    ok = (np.abs(x) < LIMIT).all(axis=1)
    return at[ok], np.floor(x[ok] * scale).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)
