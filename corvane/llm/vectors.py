"""Vector columns: which rows take part, and matrices of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CELLS = 1 << 22  # distances held at once


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))


def matrix(column: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows of a list column in double precision, shorter ones filled up with zeros."""
    lists = column.to_numpy()
    lengths = {len(x) for x in lists}
    width = max([width or 0, *lengths])
    if lengths == {width}:
        return np.stack(lists).astype(np.float64)
    out = np.zeros((len(lists), width))
    for row, x in zip(out, lists):
        row[: len(x)] = x
    return out


def k_means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres of points, the same for the same points; k or fewer."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a and b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, CELLS // max(1, len(centres)))
    parts = [squares(points[at : at + step], centres).argmin(1) for at in range(0, len(points), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
