"""What the two document classifiers share: folds, a bounded sample of labelled rows, Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on, at most; chosen by a hash of the id.
SAMPLE = 4000


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32(doc_id as text) mod `of`; a null id counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def sample(labels: DataFrame, target: str, keep: Column, doc_id: str = "doc_id", limit: int = SAMPLE) -> DataFrame:
    """_id, _label of at most `limit` labelled ids for which `keep` holds: those with the least hashes.

    Null ids and labels are left out; where an id has several labels, the
    least one counts. The rows are bounded and come back as a local table.
    """
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(target).cast("int").alias("_label"), keep.alias("_keep"))
    usable = usable.where("_keep and _id is not null and _label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    hashed = usable.withColumn("_hash", F.pmod(F.xxhash64("_id"), F.lit(1 << 30)))
    # Only about as many rows as are wanted get sorted, however many labels there are.
    n = usable.count()
    if n > 2 * limit:
        hashed = hashed.where(F.col("_hash") < int((1 << 30) * 1.5 * limit / n))
    rows = hashed.orderBy("_hash", "_id").limit(limit).select("_id", "_label").collect()
    return labels.sparkSession.createDataFrame(rows, usable.select("_id", "_label").schema)


def spaced(rows: np.ndarray, most: int) -> np.ndarray:
    """All rows, or `most` evenly spaced ones."""
    return rows if len(rows) <= most else rows[np.arange(most) * len(rows) // most]


def adam(loss: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int, rate: float, project: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Minimises a loss, given as its gradient; `project` maps the parameters back after each step."""
    x, first, second = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        gradient = loss(x)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        x -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        if project:
            x = project(x)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
