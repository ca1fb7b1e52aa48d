"""Balls of near vectors, and bounds on inner products with what lies in them.

Angles obey the triangle inequality: if a query vector is at angle ``a`` from a centre and all
members lie between ``low`` and ``high`` from it, no member is nearer to the query than
``a - high`` or ``low - a``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoor.functions.vectors import matrix_of, unit_rows
from spoor.session import ship_package

#: Centres at most, and vectors that they are fitted to. The fit decides speed, not results.
MAX_BALLS = 128
SAMPLE = 4096
ROUNDS = 8
#: The ball of zero vectors, whose products are all zero.
ZERO = -1
#: What rounding may add to an angle.
SLACK = 1e-6


def fit_centres(vectors: DataFrame, count: int) -> np.ndarray:
    """Unit centres of a bounded sample of ``vectors (vid, embedding)``; at least one."""
    sample = vectors.orderBy(F.xxhash64("vid")).limit(SAMPLE).select("embedding").toArrow()
    units = unit_rows(matrix_of(sample["embedding"]))
    units = units[np.abs(units).any(axis=1)]
    if not len(units):
        return np.zeros((1, units.shape[1]))
    wanted = int(min(MAX_BALLS, max(1, np.sqrt(count)), len(units)))
    # Each centre starts at the vector that is farthest from those before it.
    chosen, nearest = [0], units @ units[0]
    for _ in range(wanted - 1):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    centres = units[chosen]
    for _ in range(ROUNDS):
        ball = np.argmax(units @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, ball, units)
        filled = np.linalg.norm(sums, axis=1) > 1e-9
        centres = np.where(filled[:, None], unit_rows(sums), centres)
    return centres


def angles(units: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centres.T, -1, 1))


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``vid, ball, angle``: the nearest centre of each of ``vectors (vid, embedding)``."""
    ship_package(vectors.sparkSession)

    def work(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            units = unit_rows(matrix_of(batch.column(1)))
            away = angles(units, centres)
            ball = np.argmin(away, axis=1)
            angle = away[np.arange(len(ball)), ball]
            ball[~units.any(axis=1)] = ZERO
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ball, pa.int32()), pa.array(angle)],
                names=["vid", "ball", "angle"],
            )

    return vectors.select("vid", "embedding").mapInArrow(work, "vid long, ball int, angle double")


def upper_bounds(away: np.ndarray, zero: np.ndarray, ball, low, high) -> np.ndarray:
    """Per query row and ball part, what no inner product with a member exceeds.

    ``away`` are the angles of the query rows to all centres, ``zero`` marks zero rows.
    """
    a = away[:, ball]
    gap = np.maximum(np.maximum(a - high, low - a) - SLACK, 0.0)
    bounds = np.cos(gap)
    bounds[:, ball == ZERO] = 0.0
    bounds[zero] = 0.0
    return bounds


def along_a_tour(centres: np.ndarray) -> list[int]:
    """The balls in an order in which neighbours are near, the ball of zeros first."""
    order, left = [0], set(range(1, len(centres)))
    while left:
        rest = sorted(left)
        nearest = rest[int(np.argmax(centres[rest] @ centres[order[-1]]))]
        order.append(nearest)
        left.remove(nearest)
    return [ZERO, *order]


def group_balls(rows: dict[int, int], tour: list[int], size: int) -> tuple[dict, int]:
    """Ball -> (first group, number of groups), of about ``size`` rows each, and their number.

    Neighbours in the tour share a group until it is full; a large ball has several.
    """
    groups, filled, at = {}, 0, 0
    for ball in tour:
        n = rows.get(ball, 0)
        if filled and filled + n > size:
            at, filled = at + 1, 0
        parts = max(1, -(-n // size))
        groups[ball] = (at, parts)
        if parts > 1:
            at, filled = at + parts, 0
        else:
            filled += n
    return groups, at + (1 if filled else 0)
