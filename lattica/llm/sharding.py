"""Consistent hashing with virtual nodes and bounded loads.

Every shard has `points` virtual nodes on a ring of CELLS cells; a key's home
is the first virtual node at or after its cell. No shard may hold more than
(1 + slack) times the mean: every shard first takes what is at home there, and
keys that find it full then continue clockwise, so an overflowing key displaces
no other and little moves when a shard is added. The walk runs over (cell, size
class) totals, of which there are at most CELLS * 64 at any data size. Overflow
is placed largest class first, so the small ones level the loads; a total that
fits nowhere whole is cut by running bytes.
"""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut

CELLS = 4096
POINTS = 128
SLACK = 1 / 4096


def ring(shards: int, points: int = POINTS, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise. A shard's own nodes don't depend on the number of shards."""
    nodes = []
    for shard in range(shards):
        for point in range(points):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{point}".encode(), digest_size=8).digest(), "big")
            nodes.append((h, shard))
    return [(h * cells >> 64, shard) for h, shard in sorted(nodes)]


def walk(totals: list[tuple[int, int, int, int]], shards: int, points: int = POINTS, slack: float = SLACK) -> list[tuple[int, int, int, int, int]]:
    """Segments (cell, size class, first byte, end byte, shard) for totals (cell, size class, rows, bytes).

    A row belongs to the segment in which its bytes start, its total's rows
    laid end to end. Class k holds sizes below 2 ** k, so a segment cut that
    much short never takes its shard over the bound. Where no shard has room
    for a row, what is left of its total goes to the least loaded one.
    """
    nodes = ring(shards, points)
    cells = [c for c, _ in nodes]
    most = sum(t[3] for t in totals) / shards * (1 + slack)
    load, out, over = [0] * shards, [], []
    for cell, kind, _, size in sorted(totals):
        home = nodes[bisect.bisect_left(cells, cell) % len(nodes)][1]
        if load[home] + size <= most:
            load[home] += size
            out.append((cell, kind, 0, size, home))
        else:
            over.append((kind, cell, size))
    for kind, cell, size in sorted(over, reverse=True):
        at, lo = bisect.bisect_left(cells, cell), 0
        way = list(dict.fromkeys(nodes[(at + step) % len(nodes)][1] for step in range(len(nodes))))
        whole = next((s for s in way if load[s] + size <= most), None)
        for shard in way if whole is None else [whole]:
            end = size if load[shard] + size - lo <= most else min(size, lo + int(most - load[shard]) - (1 << kind))
            if end > lo:
                out.append((cell, kind, lo, end, shard))
                load[shard] += end - lo
                lo = end
        if lo < size:
            shard = min(way, key=lambda s: (load[s], s))
            out.append((cell, kind, lo, size, shard))
            load[shard] += size - lo
    return out


def shard(docs: DataFrame, shards: int = 24, points: int = POINTS, slack: float = SLACK, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null) for every row of docs.

    size is the text's UTF-8 bytes plus 8 (a null text: 8, with the CRC of
    nothing). Sizes per shard are near equal; slots run from 0 without gaps in
    each shard. Repeated rows are placed each for itself, a null doc_id is a
    key like any other, other columns are not read, and an empty table gives
    an empty result. Reruns agree: only doc_id, size and CRC decide. Equal
    texts may part: a group can be larger than a shard, and loads come first.
    """
    raw = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    keyed = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    keyed = keyed.withColumn("_key", F.xxhash64("doc_id", "size", "text_crc32"))
    keyed = cut(keyed.withColumn("_cell", F.shiftrightunsigned("_key", 52).cast("int")).withColumn("_kind", F.length(F.bin("size"))))
    # At most CELLS * 64 totals, whatever the input.
    totals = [tuple(r) for r in keyed.groupBy("_cell", "_kind").agg(F.count("*"), F.sum("size")).collect()]
    segments = pd.DataFrame(walk(totals, shards, points, slack), columns=["_cell", "_kind", "_lo", "_hi", "shard"])
    plan = keyed.sparkSession.createDataFrame(segments, "_cell int, _kind int, _lo long, _hi long, shard int")
    # Rows are dealt by (cell, class) once: for their running bytes, for the plan and for their places in a segment.
    order = ["_key", "doc_id", "size", "text_crc32"]
    laid = Window.partitionBy("_cell", "_kind").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("_at", F.sum("size").over(laid) - F.col("size")).join(plan, ["_cell", "_kind"]).where("_at >= _lo and _at < _hi")
    segment = ["_cell", "_kind", "_lo"]
    placed = cut(placed.withColumn("_rank", F.row_number().over(Window.partitionBy(*segment).orderBy(*order)) - 1))
    before = Window.partitionBy("shard").orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", *segment).agg(F.count("*").alias("_n"))
    starts = counts.select(*segment, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(starts, segment).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_first") + F.col("_rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
