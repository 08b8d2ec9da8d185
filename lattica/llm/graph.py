"""Connected components over edge tables of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: A node with over 1/HUBS of the edges is a hub; an edge has two ends, so there are at most 2 * HUBS of them.
HUBS = 256


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """u, v, m of every edge (u, v), m being the least v of u; `edges` has at most 2 * total rows.

    A hub's least v is broadcast (at most 2 * HUBS rows at any size), so its
    edges stay where they are and never meet in one task.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    hubs = least.where(F.col("n") > total / HUBS).select("u", F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    hot = marked.where("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    rest = marked.where("hub_m is null").select("u", "v")
    return hot.union(rest.join(least.where(F.col("n") <= total / HUBS).select("u", "m"), "u").select("u", "v", "m"))


def keyed_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left joined to right by `key`, unique in right, whose `weight` is the number of left's rows that have it, of `total`; weight goes.

    Keys of over total / HUBS rows, at most HUBS of them, are broadcast: their rows never meet in one task.
    """
    hot = F.col(weight) > total / HUBS
    hubs = right.where(hot).drop(weight)
    rest = left.join(F.broadcast(hubs.select(key)), key, "left_anti").join(right.where(~hot).drop(weight), key)
    return left.join(F.broadcast(hubs), key).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label (the least node of its component) of every node of an edge; loops and repeated edges do no harm.

    Alternates large-star and small-star steps until the edges are stars; each
    round is written in the shared folder. Nothing but two numbers per round
    and the bounded hubs reaches the driver.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    now, mark = (t := cut(pairs)), _mark(t)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # An edge to the least node stays; any other goes from its lower end to that node.
        small = _with_least(large, mark[0]).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        now = cut(small.distinct())
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the pairs (a, b) connect, and no more than one per node."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]
