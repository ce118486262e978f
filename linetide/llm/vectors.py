"""Vectors as bytes: one reader for the operators over embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector of an array column in double precision; None if it is null or holds a null or non-finite component."""
    values = column.values
    whole = values.to_numpy(zero_copy_only=False).astype(np.float64)
    finite = np.isfinite(whole)
    if values.null_count:
        finite &= np.asarray(values.is_valid())
    offsets = np.asarray(column.offsets)
    bad = np.concatenate([[0], np.cumsum(~finite)])
    valid = np.asarray(column.is_valid())
    return [whole[a:b] if ok and bad[a] == bad[b] else None for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
