"""Vector columns as packed numbers: one binary value per usable vector."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A list<double> column as (flat values, length of each row, whether the
    row is usable: not null, no null or non-finite component)."""
    flat = pc.list_flatten(column)
    length = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    null = np.asarray(pc.is_null(flat).to_numpy(zero_copy_only=False), bool)
    values = np.asarray(pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), np.float64)
    row = np.repeat(np.arange(len(column)), length)
    bad = np.bincount(row[null | ~np.isfinite(values)], minlength=len(column)) > 0
    return values, length, ~bad & np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)


def stack(parts: list[bytes], kind: str) -> np.ndarray:
    """Rows of equal length, one per binary value."""
    n = len(parts)
    return np.frombuffer(b"".join(parts), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)
