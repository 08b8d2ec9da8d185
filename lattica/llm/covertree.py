"""Exact top-k inner products by dual-tree search over cover trees.

The top of the tree is shared: centers from a bounded sample (its upper nodes)
deal all rows into regions, each with its covering radius over all of its rows,
and a region into slabs of a fixed size. A query is first searched in its own
slab, which gives its kth score so far; it is then sent only to slabs of
regions in which a row could reach that score. A task holds the cover tree of
one slab and that of one group of queries, and prunes pairs of nodes whose
largest possible inner product is below the worst kth score in the query node.
The best k of every slab are then ranked per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .worker import task

SLAB = 4096
#: Rows that the regions' centers are taken from, and regions, at most (both for each vector length).
SAMPLE, REGIONS = 4096, 512
#: Vector lengths, the commonest ones, that have regions; vectors of any other length are one region.
LENGTHS = 16
LEAF, QUERY_LEAF = 64, 8


@dataclass
class Node:
    """Points within `radius` of `center`; a leaf has no children."""

    center: np.ndarray
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


class CoverTree:
    """Nodes of one level are nets: every child covers its points within half its parent's covering scale."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors, self.leaf = vectors, leaf
        squares = np.einsum("ij,ij->i", vectors, vectors)
        # A slab has a bounded number of rows, and so has this table of their distances.
        self._distance = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2.0 * (vectors @ vectors.T), 0)).astype(np.float32)
        points = np.arange(len(vectors))
        self.root = self._node(0, points, float(self._distance[0].max()))
        del self._distance

    def _node(self, center: int, points: np.ndarray, scale: float) -> Node:
        reach = self._distance[center, points]
        node = Node(self.vectors[center], float(reach.max()) * (1 + 1e-5) + 1e-3, points)
        while len(points) > self.leaf and scale > 1e-3 and reach.max() > 1e-3:
            scale = min(scale, float(reach.max())) / 2
            near = reach <= scale
            if near.all():
                continue
            nodes, left, at = [], points, center
            while len(left):
                inside = self._distance[at, left] <= scale
                nodes.append((at, left[inside]))
                left = left[~inside]
                at = int(left[0]) if len(left) else at
            node.children = [self._node(c, p, scale) for c, p in nodes]
            break
        return node


class Search:
    """The k best rows of one slab for every query of one group, ties to smaller ids."""

    def __init__(self, queries: np.ndarray, query_rows: np.ndarray, data: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        """floor: for each query a score that k other rows reach, or -inf."""
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.queries, self.query_rows, self.data, self.rows, self.ids, self.k = queries, query_rows, data, rows, ids, k
        self.score = np.full((len(queries), k), -np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.pairs = 0

    def run(self) -> None:
        self.visit(CoverTree(self.queries, QUERY_LEAF).root, CoverTree(self.data).root)

    def worst(self, query: Node) -> float:
        return float(self.kth(query.points).min())

    def kth(self, queries: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[queries, -1], self.floor[queries])

    def bounds(self, query: Node, nodes: list[Node]) -> np.ndarray:
        """The largest inner product that points of the query node and of each node can have."""
        centers = np.stack([n.center for n in nodes])
        radius = np.array([n.radius for n in nodes])
        own = math.sqrt(float(query.center @ query.center))
        return (centers @ query.center + own * radius + np.sqrt(np.einsum("ij,ij->i", centers, centers)) * query.radius + query.radius * radius) + 1.0

    def visit(self, query: Node, node: Node) -> None:
        if self.bounds(query, [node])[0] < self.worst(query):
            return
        if query.children and (not node.children or query.radius >= node.radius):
            for child in query.children if len(query.children) <= 64 else self.bundles(query):
                self.visit(child, node)
        elif not node.children:
            self.compare(query, node.points)
        else:
            bound = self.bounds(query, node.children)
            order = np.argsort(-bound, kind="stable")
            for at in range(0, len(order), 128):
                live = [i for i in order[at : at + 128] if bound[i] >= self.worst(query)]
                if not live:
                    break  # the rest have smaller bounds
                leaves = [node.children[i].points for i in live if not node.children[i].children]
                if leaves:
                    self.compare(query, np.concatenate(leaves))
                for i in live:
                    if node.children[i].children:
                        self.visit(query, node.children[i])

    def bundles(self, query: Node) -> Iterator[Node]:
        """Many small children as leaves of up to 64 neighbours in the list, which keeps comparisons in blocks."""
        small = [c for c in query.children if not c.children]
        yield from (c for c in query.children if c.children)
        for at in range(0, len(small), 64):
            points = np.concatenate([c.points for c in small[at : at + 64]])
            center = small[at].center
            radius = float(np.sqrt(((self.queries[points] - center) ** 2).sum(1)).max()) + 1e-3
            yield Node(center, radius, points)

    def compare(self, query: Node, points: np.ndarray) -> None:
        q = query.points
        self.pairs += len(q) * len(points)
        score = self.queries[q] @ self.data[points].T
        score = np.where(self.query_rows[q][:, None] == self.rows[points][None, :], -np.inf, score)
        use = (score >= self.kth(q)[:, None]).any(0)
        if not use.any():
            return
        points, score = points[use], score[:, use]
        both = np.concatenate([self.score[q], score], 1)
        index = np.concatenate([self.found[q], np.broadcast_to(points, score.shape)], 1)
        ids = np.where(index >= 0, self.ids[index], np.iinfo(np.int64).max)
        order = np.lexsort((ids, -both), axis=1)[:, : self.k]
        self.score[q] = np.take_along_axis(both, order, 1)
        self.found[q] = np.where(np.isinf(self.score[q]), -1, np.take_along_axis(index, order, 1))


def quantised(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """_row, vec_id, _dim, _v (64-bit integers): floor(scale * x) of every usable vector."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out, dims = [], [], []
            for i, (key, value) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if key is None or not value.is_valid or value.values.null_count:
                    continue
                x = np.floor(scale * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    keep.append(i)
                    out.append(x.astype("<f8").tobytes())
                    dims.append(len(x))
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["_row", "vec_id", "_dim", "_v"])

    columns = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    return columns.mapInArrow(task(turn), "_row long, vec_id long, _dim int, _v binary")


def region_centers(rows: DataFrame, slab: int) -> dict[int, np.ndarray]:
    """For each vector length, the centers of its regions: upper nodes of the cover tree of at most SAMPLE rows."""
    counts = [(r["_dim"], r["count"]) for r in rows.groupBy("_dim").count().orderBy(F.desc("count"), "_dim").limit(LENGTHS).collect()]
    out = {}
    for dim, n in counts:
        own = rows.where(F.col("_dim") == dim).withColumn("_hash", F.pmod(F.xxhash64("_v"), F.lit(1 << 30)))
        if n > 2 * SAMPLE:
            own = own.where(F.col("_hash") < int((1 << 30) * 1.5 * SAMPLE / n))
        found = own.groupBy("_v").agg(F.min("_hash").alias("_hash")).orderBy("_hash", "_v").limit(SAMPLE).collect()
        wanted = min(REGIONS, -(-n // slab))
        if not dim or wanted < 2 or not found:
            out[dim] = np.zeros((1, dim))
            continue
        nodes = [CoverTree(np.stack([np.frombuffer(r["_v"], "<f8") for r in found])).root]
        while len(nodes) < wanted:
            # The widest node makes way for its children, as long as they fit.
            inner = [i for i, x in enumerate(nodes) if x.children and len(nodes) - 1 + len(x.children) <= REGIONS]
            if not inner:
                break
            nodes += nodes.pop(max(inner, key=lambda i: nodes[i].radius)).children
        out[dim] = np.stack([x.center for x in nodes])
    return out


def dealt(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """rows with _region, that of the nearest center, and _reach, the distance to it."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            region, reach = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim in np.unique(dims):
                for at in np.array_split(own := np.flatnonzero(dims == dim), -(-len(own) // 2048)):
                    x = np.frombuffer(b"".join(batch.column(3).take(pa.array(at)).to_pylist()), "<f8").reshape(len(at), dim)
                    c = centers.get(int(dim), np.zeros((1, dim)))
                    region[at] = ((c * c).sum(1) - 2.0 * (x @ c.T)).argmin(1)
                    reach[at] = np.sqrt(((x - c[region[at]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region), pa.array(reach)], ["_row", "vec_id", "_dim", "_v", "_region", "_reach"])

    return rows.mapInArrow(task(turn), "_row long, vec_id long, _dim int, _v binary, _region int, _reach double")


def matrix(table: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(table["_v"]), "<f8").reshape(len(table), -1)


_FOUND = "_query long, query_id long, vec_id long, score long, _pairs long"


def results(job: Search, queries: pd.DataFrame) -> pd.DataFrame:
    """What a search has found; its first row has the number of pairs that were compared (a row of nulls, if it has found none)."""
    q, at = np.nonzero(job.found >= 0)
    out = pd.DataFrame({"_query": queries["_row"].to_numpy()[q], "query_id": queries["vec_id"].to_numpy()[q], "vec_id": job.ids[job.found[q, at]], "score": job.score[q, at].astype(np.int64), "_pairs": 0}, dtype="Int64")
    if out.empty:
        out = pd.DataFrame([[None] * 4 + [0]], columns=list(out.columns), dtype="Int64")
    out.loc[0, "_pairs"] = job.pairs
    return out


def searched(vectors: DataFrame, k: int, every: int, scale: int, vec_id: str, embedding: str, slab: int) -> DataFrame:
    """_query, query_id, vec_id, score, _pairs: the best rows of every slab that a query was sent to."""
    rows = cut(quantised(vectors, vec_id, embedding, scale))
    centers = region_centers(rows, slab)
    placed = cut(dealt(rows, centers))
    # Regions are bounded, for each vector length; so are these rows.
    stats = placed.groupBy("_dim", "_region").agg(F.count("*").alias("n"), F.max("_reach").alias("r")).collect()
    parts = {(s["_dim"], s["_region"]): (-(-s["n"] // slab), s["r"] * (1 + 1e-9) + 1e-6) for s in stats}
    table = vectors.sparkSession.createDataFrame([(*key, n) for key, (n, _) in sorted(parts.items())], "_dim int, _region int, _parts int")
    keys = ["_dim", "_region", "_part"]
    data = placed.join(table, ["_dim", "_region"]).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int")).select("_row", "vec_id", "_v", *keys)

    def first(own: pd.DataFrame) -> pd.DataFrame:
        queries = own[own["vec_id"] % every == 0].reset_index(drop=True)
        if queries.empty:
            return pd.DataFrame()
        x = matrix(own)
        job = Search(matrix(queries), queries["_row"].to_numpy(), x, own["_row"].to_numpy(), own["vec_id"].to_numpy(), k)
        job.run()
        best = [at[at >= 0] for at in job.found]
        scores = [score[at >= 0].astype(np.int64) for at, score in zip(job.found, job.score, strict=True)]
        out = queries.assign(_kth=job.score[:, -1], _ids=[job.ids[at] for at in best], _scores=scores, _pairs=0)
        out.loc[0, "_pairs"] = job.pairs
        return out

    seeds = cut(
        data.groupBy(*keys).applyInPandas(first, "_row long, vec_id long, _v binary, _dim int, _region int, _part int, _kth double, _ids array<long>, _scores array<long>, _pairs long")
    )

    def sent(vector: bool):
        """The queries again, once for each other slab in which a row could reach their kth score."""

        def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            center = {dim: np.zeros((1, dim)) for dim, _ in parts} | centers
            radius = {dim: np.array([parts.get((dim, i), (0, 0.0))[1] for i in range(len(c))]) for dim, c in center.items()}
            count = {dim: np.array([parts.get((dim, i), (0, 0.0))[0] for i in range(len(c))]) for dim, c in center.items()}
            for batch in batches:
                for i in range(len(batch)):
                    dim, region, part, kth = (batch.column(c)[i].as_py() for c in (3, 4, 5, 6))
                    q = np.frombuffer(batch.column(2)[i].as_py(), "<f8")
                    bound = center[dim] @ q + math.sqrt(float(q @ q)) * radius[dim] + 1.0
                    live = np.flatnonzero((bound >= kth) & (count[dim] > 0))
                    to = np.repeat(live, count[dim][live])
                    of = np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in count[dim][live])])
                    other = (to != region) | (of != part)
                    n = int(other.sum())
                    if n:
                        same = batch.slice(i, 1).take(pa.array([0] * n))
                        own = [same.column(0), same.column(1), same.column(2), same.column(6)] if vector else [same.column(0)]
                        names = ["_row", "vec_id", "_v", "_kth"] if vector else ["_row"]
                        yield pa.RecordBatch.from_arrays([*own, same.column(3), pa.array(to[other].astype(np.int32)), pa.array(of[other].astype(np.int32))], [*names, *keys])

        columns = "_row long, vec_id long, _v binary, _kth double" if vector else "_row long"
        return seeds.select("_row", "vec_id", "_v", *keys, "_kth").mapInArrow(task(turn), f"{columns}, _dim int, _region int, _part int")

    groups = cut(sent(False).groupBy(*keys).agg(F.ceil(F.count("*") / slab).cast("int").alias("_groups")))
    visits = sent(True).join(groups, keys).withColumn("_group", F.pmod(F.xxhash64("_row"), F.col("_groups")).cast("int")).drop("_groups")
    copies = data.join(groups, keys).withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1))).drop("_groups")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["_query", "query_id", "vec_id", "score", "_pairs"], dtype="Int64")
        job = Search(matrix(right), right["_row"].to_numpy(), matrix(left), left["_row"].to_numpy(), left["vec_id"].to_numpy(), k, right["_kth"].to_numpy())
        job.run()
        return results(job, right)

    rest = copies.groupBy(*keys, "_group").cogroup(visits.groupBy(*keys, "_group")).applyInPandas(search, _FOUND)
    own = seeds.select(F.col("_row").alias("_query"), F.col("vec_id").alias("query_id"), F.explode(F.arrays_zip("_ids", "_scores")).alias("_b"))
    tally = seeds.select(*(F.lit(None).cast("long").alias(c) for c in ("_query", "query_id", "vec_id", "score")), "_pairs")
    return own.select("_query", "query_id", "_b._ids", "_b._scores", F.lit(0).cast("long")).union(tally).union(rest).toDF("_query", "query_id", "vec_id", "score", "_pairs")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", slab: int = SLAB) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k greatest integer inner products with all other rows.

    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part. Vectors are compared with those of equal
    length only. Ties go to the smaller id; among repeated ids, only the
    query's own row is left out. Scores up to 2 ** 53 are exact. Other columns
    are not read; an empty table gives an empty result.
    """
    best = searched(vectors, k, every, scale, vec_id, embedding, slab).where("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("_query").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pairs_compared(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", slab: int = SLAB) -> int:
    """How many of the (query, row) pairs top_k computes inner products of."""
    return searched(vectors, k, every, scale, vec_id, embedding, slab).agg(F.sum("_pairs")).first()[0] or 0
