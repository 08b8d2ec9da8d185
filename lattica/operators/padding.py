"""Which target positions a cell is copied to when an axis is padded."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("edge", "reflect", "symmetric")


def sources(n: int, left: int, right: int, mode: str) -> np.ndarray:
    """For each target position, the source position along an axis of size n."""
    if mode not in MODES:
        raise ValueError(f"no pad mode {mode}; there are {MODES}")
    p = np.arange(-left, n + right)
    if mode == "edge" or n == 1:
        return np.clip(p, 0, n - 1)
    if mode == "symmetric":
        m = p % (2 * n)
        return np.where(m < n, m, 2 * n - 1 - m)
    m = p % (2 * n - 2)
    return np.where(m < n, m, 2 * n - 2 - m)


def targets(position: Column, n: int, left: int, right: int, mode: str) -> Column:
    """The array of target positions of a source position: arithmetic sequences, as few at any width of the padding."""
    if mode not in MODES:
        raise ValueError(f"no pad mode {mode}; there are {MODES}")
    end = left + n + right - 1

    def images(first: Column, period: int) -> Column:
        """The targets whose place before padding is `first` modulo `period`."""
        start = F.pmod(first + left, F.lit(period)).cast("int")
        return F.when(start <= end, F.sequence(start, F.lit(end), F.lit(period))).otherwise(F.array().cast("array<int>"))

    if mode == "edge" or n == 1:
        low = F.when(position == 0, F.lit(0)).otherwise(position + left)
        high = F.when(position == n - 1, F.lit(end)).otherwise(position + left)
        return F.sequence(low.cast("int"), high.cast("int"))
    if mode == "symmetric":
        return F.concat(images(position, 2 * n), images(-1 - position, 2 * n))
    return F.array_distinct(F.concat(images(position, 2 * n - 2), images(-position, 2 * n - 2)))
