"""Halo tiling: geometry on the driver (tiles per tensor are few), cells by broadcast joins, stitching by one aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from itertools import product
from math import ceil, floor
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import V, TensorFrame
from .padding import sources

Pair = tuple[int, int]


def pair(width: int | Sequence[int]) -> Pair:
    return (width, width) if isinstance(width, int) else (int(width[0]), int(width[1]))


@dataclass(frozen=True)
class LinearAxisTransform:
    """size -> floor or ceil of size * scale, plus offset."""

    axis: str
    scale: float
    offset: int

    def compute(self, size: int, round_up: bool = False) -> int:
        return (ceil if round_up else floor)(size * self.scale) + self.offset


@dataclass(frozen=True)
class Tile:
    """An inner region of a tensor with its halo."""

    sample_shape: Mapping[str, int]
    inner_slice: Mapping[str, Pair]
    halo: Mapping[str, Pair] = field(default_factory=dict)
    block_index: int = 0
    blocks_in_sample: int = 1

    def _halo(self, axis: str) -> Pair:
        return self.halo.get(axis, (0, 0))

    @property
    def inner_shape(self) -> dict[str, int]:
        return {a: hi - lo for a, (lo, hi) in self.inner_slice.items()}

    @property
    def shape(self) -> dict[str, int]:
        return {a: n + sum(self._halo(a)) for a, n in self.inner_shape.items()}

    @property
    def outer_slice(self) -> dict[str, Pair]:
        """What the tile reads of the tensor: the halo stops at its edges."""
        out = {}
        for a, (lo, hi) in self.inner_slice.items():
            size, (left, right) = self.sample_shape[a], self._halo(a)
            out[a] = (max(0, min(lo - left, size - (hi - lo) - left)), min(size, hi + right))
        return out

    @property
    def padding(self) -> dict[str, Pair]:
        out = {}
        for a, (lo, hi) in self.inner_slice.items():
            (first, last), (left, right) = self.outer_slice[a], self._halo(a)
            out[a] = (max(0, left - (lo - first)), max(0, right - (last - hi)))
        return out

    @property
    def local_slice(self) -> dict[str, Pair]:
        """The inner region in the tile's own coordinates."""
        return {a: (self._halo(a)[0], self._halo(a)[0] + n) for a, n in self.inner_shape.items()}

    def get_transformed(self, new_axes: Mapping[str, LinearAxisTransform | int]) -> Tile:
        """The tile of an output whose axes follow from this one's: by a transform, or of a fixed size."""

        def moved(make) -> dict:
            return {a: make(t) for a, t in new_axes.items()}

        lo_hi = lambda t: (0, t) if isinstance(t, int) else tuple(t.compute(x) for x in self.inner_slice[t.axis])
        halo = {}
        for a, t in new_axes.items():
            if not isinstance(t, int):
                own = self._halo(t.axis)
                low, high = (tuple(f(x * t.scale) for x in own) for f in (floor, ceil))
                if low != high:
                    raise ValueError(f"the halo {own} of {t.axis} doesn't scale to whole cells")
                halo[a] = low
        return Tile(moved(lambda t: t if isinstance(t, int) else t.compute(self.sample_shape[t.axis])), moved(lo_hi), halo, self.block_index, self.blocks_in_sample)


def split_shape(shape: Mapping[str, int], block_shape: Mapping[str, int], halo: Mapping[str, int | Pair] | None = None, stride: Mapping[str, int] | None = None) -> list[Tile]:
    """All tiles of a tensor: inner regions of block minus halo, the last one of an axis moved back inside."""
    halo = {a: pair(w) for a, w in (halo or {}).items()}
    stride = stride or {}
    if unknown := [a for a in block_shape if a not in shape]:
        raise ValueError(f"no axes {unknown}")
    if large := [a for a, n in block_shape.items() if n > shape[a]]:
        raise ValueError(f"blocks exceed the tensor along {large}")
    per_axis = []
    for a, size in shape.items():
        inner = block_shape.get(a, size) - (sum(halo.get(a, (0, 0))) if a in block_shape else 0)
        if inner <= 0:
            raise ValueError(f"the halo leaves nothing of the blocks along {a}")
        starts = range(0, size, stride.get(a) or inner)
        per_axis.append([(min(s, size - inner), min(s, size - inner) + inner) for s in starts])
    regions = list(product(*per_axis))
    own = {a: halo.get(a, (0, 0)) if a in block_shape else (0, 0) for a in shape}
    return [Tile(dict(shape), dict(zip(shape, r, strict=True)), own, i, len(regions)) for i, r in enumerate(regions)]


def split_shapes(shapes: Mapping[str, Mapping[str, int]], block_shapes: Mapping[str, Mapping[str, int]], *, halo: Mapping[str, Mapping[str, Any]] | None = None, strides: Mapping[str, Mapping[str, int]] | None = None, broadcast: bool = False) -> list[dict[str, Tile]]:
    """Aligned tiles of several members; members of one tile repeat where that is allowed."""
    tiles = {m: split_shape(shapes[m], block_shapes[m], (halo or {}).get(m), (strides or {}).get(m)) for m in block_shapes}
    n = max((len(t) for t in tiles.values()), default=0)
    for m, own in tiles.items():
        if len(own) not in (n, 1) or (len(own) != n and not broadcast):
            raise ValueError(f"{m} has {len(own)} tiles, others have {n}")
        if len(own) != n:
            tiles[m] = [replace(own[0], block_index=i, blocks_in_sample=n) for i in range(n)]
    return [{m: tiles[m][i] for m in tiles} for i in range(n)]


def tile_table(spark: SparkSession, tiles: Sequence[Tile], member: str = "") -> DataFrame:
    """The geometry as a DataFrame: member, block_index, blocks_in_sample and eight numbers per axis."""
    axes = list(tiles[0].inner_slice)
    rows = []
    for t in tiles:
        outer, pads = t.outer_slice, t.padding
        rows.append((member, t.block_index, t.blocks_in_sample, *[x for a in axes for x in (*t.inner_slice[a], *outer[a], *pads[a], *t._halo(a))]))
    names = [f"{a}_{part} int" for a in axes for part in ("in_start", "in_stop", "out_start", "out_stop", "pad_l", "pad_r", "halo_l", "halo_r")]
    return spark.createDataFrame(rows, ", ".join(["member string", "block_index int", "blocks_in_sample int", *names]))


def split(tensor: TensorFrame, tiles: Sequence[Tile], pad_mode: str = "symmetric") -> TensorFrame:
    """The cells of all tiles, in tile coordinates, with block_index as a further key.

    Per axis, a table maps cell positions to (tile start, position in the
    tile); the tables are as small as the axes, so cells are never shuffled.
    """
    spark = tensor.df.sparkSession
    axes = list(tensor.dims)
    df = tensor.df
    for a in axes:
        rows = sorted({(int(source), lo, target) for t in tiles for lo, target, source in _axis_cells(t, a, pad_mode)})
        table = spark.createDataFrame(rows, f"{a} int, _start_{a} int, _at_{a} int")
        df = df.join(F.broadcast(table), a).drop(a).withColumnRenamed(f"_at_{a}", a)
    index = spark.createDataFrame([(t.block_index, *[t.inner_slice[a][0] for a in axes]) for t in tiles], ", ".join(["block_index int", *[f"_start_{a} int" for a in axes]]))
    df = df.join(F.broadcast(index), [f"_start_{a}" for a in axes]) if axes else df.crossJoin(F.broadcast(index))
    keys = (*tensor.keys, "block_index")
    return TensorFrame(df.select(*keys, *axes, V), tensor.dims, keys, tensor.dtype, tuple(tiles[0].shape[a] for a in axes))


def _axis_cells(tile: Tile, axis: str, mode: str) -> Iterator[tuple[int, int, int]]:
    (first, last), (left, right) = tile.outer_slice[axis], tile.padding[axis]
    start = tile.inner_slice[axis][0]
    for target, source in enumerate(sources(last - first, left, right, mode)):
        yield start, target, first + int(source)


def inner(blocks: TensorFrame, tiles: Sequence[Tile]) -> TensorFrame:
    """The cells of the inner regions, in the coordinates of the whole tensor."""
    axes = blocks.dims
    names = ["block_index int", *[f"{p}{a} int" for a in axes for p in ("_lo_", "_n_", "_to_")]]
    rows = [(t.block_index, *[x for a in axes for x in (t.local_slice[a][0], t.inner_shape[a], t.inner_slice[a][0])]) for t in tiles]
    df = blocks.df.join(F.broadcast(blocks.df.sparkSession.createDataFrame(rows, ", ".join(names))), "block_index")
    for a in axes:
        at = F.col(a) - F.col(f"_lo_{a}")
        df = df.where((at >= 0) & (at < F.col(f"_n_{a}"))).withColumn(a, (at + F.col(f"_to_{a}")).cast("int"))
    return replace(blocks, df=df.select(*blocks.keys, *axes, V), known=tuple(tiles[0].sample_shape[a] for a in axes))


def stitch(blocks: TensorFrame, tiles: Sequence[Tile], fill: float | None = None) -> TensorFrame:
    """Inner regions put together; where they overlap the later tile wins. fill: for cells that no tile covers."""
    cells = inner(blocks, tiles)
    keys = tuple(k for k in cells.keys if k != "block_index")
    df = cells.df.groupBy(*keys, *cells.dims).agg(F.max_by(V, "block_index").alias(V))
    if fill is not None:
        grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
        for a, n in zip(cells.dims, cells.known, strict=True):
            grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        df = grid.join(df.withColumn("_hit", F.lit(True)), [*keys, *cells.dims], "left")
        df = df.select(*keys, *cells.dims, F.when(F.col("_hit"), F.col(V)).otherwise(F.lit(fill)).alias(V))
    return replace(cells, df=df, keys=keys)


def as_single_block(tensor: TensorFrame, halo: Mapping[str, int | Pair] | None = None) -> tuple[TensorFrame, list[Tile]]:
    sizes = tensor.sizes
    own = {a: pair(w) for a, w in (halo or {}).items()}
    tile = Tile(sizes, {a: (own.get(a, (0, 0))[0], n - own.get(a, (0, 0))[1]) for a, n in sizes.items()}, own)
    return replace(tensor, df=tensor.df.withColumn("block_index", F.lit(0)), keys=(*tensor.keys, "block_index")), [tile]


def input_halo(output_halo: Mapping[str, int | Pair], references: Mapping[str, tuple[str, float]]) -> dict[str, Pair]:
    """The halo of an input for one of an output; references: output axis -> (input axis, output cells per input cell)."""
    out = {}
    for axis, width in output_halo.items():
        source, scale = references[axis]
        halo = tuple(w / scale for w in pair(width))
        if any(h != int(h) for h in halo):
            raise ValueError(f"the halo of {axis} isn't a whole number of cells of {source}")
        out[source] = tuple(map(int, halo))
    return out
