"""Vectors as whole numbers in blocks: shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers saturate here, so that sums and squares of two of them keep to 38 digits.
LIMIT = 1 << 58


def whole(embedding: Column) -> Column:
    """The vector is there, and so is every component, as a finite number."""
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column without nulls as rows of doubles, filled up with zeros to ``dim`` (the longest length)."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    dim = max(int(lengths.max(initial=0)), dim or 0)
    if len(values) == len(lengths) * dim:
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = values
    return out


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, saturating at ``LIMIT``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)


def narrow(y: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes and content of whole numbers in the narrowest form that holds them."""
    low, high = (int(y.min()), int(y.max())) if y.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return width, y.astype(f"<i{width}").tobytes()


def wide(content: bytes, width: int, n: int, dim: int) -> np.ndarray:
    """What :func:`narrow` wrote, as ``n`` rows of 64-bit whole numbers."""
    return np.frombuffer(content, f"<i{width}").reshape(n, dim).astype(np.int64)


def exact(*parts: np.ndarray, dim: int) -> list[np.ndarray]:
    """The matrices in the fastest type in which squared distances between their rows are exact."""
    most = max([0, *(int(np.abs(p).max()) for p in parts if p.size)])
    kind = np.float64 if 4 * dim * most * most < 1 << 53 else np.int64 if 4 * dim * most * most < 1 << 63 else object
    return [p.astype(kind) for p in parts]
