"""Vector expressions over ``array<float>`` or ``array<double>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Neighbouring columns whose greatest score is taken together.
GROUP = 32


def norm(vector: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
        )
    )


def l2_normalise(vector: Column) -> Column:
    """Unit vector in double precision; the zero vector stays as it is.

    The length is repeated as a second array, because an expression inside the
    lambda would be evaluated once per element.
    """
    length = norm(vector)
    scale = F.when(length == 0, F.lit(1.0)).otherwise(length)
    scales = F.array_repeat(scale, F.size(vector))
    return F.zip_with(vector, scales, lambda x, n: x.cast("double") / n)


def matrix_of(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> np.ndarray:
    """The vectors of a list column as rows; all must have one length, ``size`` if given."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    size = int(lengths[0]) if size is None else size
    if column.null_count or (lengths != size).any():
        raise ValueError(f"a vector is NULL or has not {size} entries, as others have")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision; zero rows stay as they are."""
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length == 0, 1.0, length)


def best_columns(
    scores: np.ndarray, k: int, digits: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``(row, column)`` of the k greatest scores of each row; of equal ones the first columns.

    With ``digits`` scores count as rounded, and only those are rounded that may be among the k.
    """
    if scores.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(scores.shape))
    groups = scores.shape[1] // GROUP
    if groups >= 2 * k:
        # The k-th best of the groups' maxima is a floor; mostly few scores reach it.
        width = groups * GROUP
        tops = scores[:, :width].reshape(len(scores), groups, GROUP).max(axis=2)
        floor = np.partition(tops, groups - k, axis=1)[:, groups - k, None]
        if digits is not None:
            floor = floor - 2 * 10.0**-digits
        row, group = np.nonzero(tops >= floor)
        rest, last = np.nonzero(scores[:, width:] >= floor)
        if GROUP * len(row) + len(rest) <= max(scores.size // 4, GROUP * k * len(scores)):
            column = (GROUP * group[:, None] + np.arange(GROUP)).ravel()
            row = np.r_[np.repeat(row, GROUP), rest]
            column = np.r_[column, width + last]
            found = scores[row, column]
            reach = found >= floor[row, 0]
            row, column, found = row[reach], column[reach], found[reach]
            if digits is not None:
                found = np.round(found, digits)
            order = np.lexsort((column, -found, row))
            row, column = row[order], column[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column = row[kept], column[kept]
            order = np.lexsort((column, row))
            return row[order], column[order]
    if digits is not None:
        scores = np.round(scores, digits)
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above, equal = scores > kth, scores == kth
    missing = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= missing)))
