"""Vectors out of Arrow list columns, as exact integers, and packed for a row a block."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .exchange import expand, squeeze

#: Vectors of a block, at most, and bytes of their components, about.
BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
#: Sums of products must stay below this to be exact in 64-bit integers.
LARGEST = 1 << 62


def is_usable(vector: str, dim: int | None = None) -> Column:
    """Whether a vector is there, without null or non-finite components and, if asked, of `dim` components."""
    plain = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return F.coalesce(plain & (F.size(vector) == dim if dim else F.lit(True)), F.lit(False))


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component. Components of 2^31 or more after scaling are an error: their products pass 64 bits."""
    out = np.floor(values.astype(np.float64) * scale)
    if out.size and np.abs(out).max() >= 1 << 31:
        raise ValueError("vector components are too large for exact 64-bit arithmetic")
    return out.astype(np.int64)


def grouped(batch: pa.RecordBatch, vector: str, scale: int, dim: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, integer matrix) of the batch's usable vectors, one for each length and block."""
    column = batch.column(vector)
    if not len(column):
        return []
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    flat = pc.cast(column.flatten(), pa.float64())
    bad = pc.is_null(flat).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(flat, math.nan).to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(flat)
    starts = np.concatenate(([0], np.cumsum(np.maximum(sizes, 0))))
    wrong = np.concatenate(([0], np.cumsum(bad)))
    usable = (sizes >= 0) & (wrong[starts[1:]] == wrong[starts[:-1]])
    out = []
    for size in np.unique(sizes[usable]):
        if dim is not None and size != dim:
            continue
        at = np.flatnonzero(usable & (sizes == size))
        step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, int(size)))))
        for i in range(0, len(at), step):
            rows = at[i : i + step]
            out.append((rows, scaled(flat[starts[rows][:, None] + np.arange(size)[None, :]], scale).reshape(len(rows), size)))
    return out


def packed(matrix: np.ndarray) -> bytes:
    """A matrix of integers below 2^31, in as few bytes as they need, compressed."""
    kind = next(t for t in (np.int8, np.int16, np.int32) if not matrix.size or np.iinfo(t).min <= matrix.min() and matrix.max() <= np.iinfo(t).max)
    return np.dtype(kind).itemsize.to_bytes(1, "little") + squeeze(np.ascontiguousarray(matrix.astype(kind)).reshape(-1))


def unpacked(body: bytes, rows: int) -> np.ndarray:
    flat = expand(body[1:], {1: np.int8, 2: np.int16, 4: np.int32}[body[0]])
    return flat.reshape(rows, -1).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def largest(matrix: np.ndarray) -> int:
    return int(np.abs(matrix).max()) if matrix.size else 0


def exact_type(most: int, width: int) -> type:
    """The type in which squared distances of rows of `width` integers up to `most` are exact: float64, whose matrix products are
    fast, or int64. Beyond both it is an error."""
    bound = 4 * most * most * width
    if bound >= LARGEST:
        raise ValueError("vector components are too large for exact 64-bit arithmetic")
    return np.float64 if bound < 1 << 53 else np.int64
