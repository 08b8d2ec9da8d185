"""TensorFrame: labelled tensors as a DataFrame of cells.

One row per element: the key columns (the sample), one INT column per axis and
`value`. All tensors of a frame have the same dims; sizes are held where they
are known and found by one aggregation where they aren't. Every operator
returns a new frame with a lazy plan.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .axes import guess_dims
from .functions import numeric as N

V = "value"


@dataclass(frozen=True, eq=False)
class TensorFrame:
    df: DataFrame
    dims: tuple[str, ...]
    keys: tuple[str, ...] = ()
    dtype: str = "float64"
    known: tuple[int, ...] | None = None

    # construction

    @classmethod
    def from_packed(cls, df: DataFrame, data: str, dims: Sequence[str], shape: Sequence[int], keys: Sequence[str], dtype: str = "float64") -> TensorFrame:
        """Cells of a column of flat row-major arrays, all of one shape; null arrays have no cells, arrays of another length fail the query."""
        position = F.col("_p")
        columns = []
        for i, (dim, n) in enumerate(zip(dims, shape, strict=True)):
            stride = math.prod(shape[i + 1 :])
            columns.append(F.pmod(F.floor(position / stride), F.lit(n)).cast("int").alias(dim))
        n = math.prod(shape)
        wrong = F.raise_error(F.concat(F.lit(f"{data} should have {n} values, not "), F.size(data).cast("string")))
        whole = F.when(F.col(data).isNull() | (F.size(data) == n), F.col(data)).otherwise(wrong)
        cells = df.select(*keys, F.posexplode(whole).alias("_p", "_v"))
        return cls(cells.select(*keys, *columns, F.col("_v").cast(N.SPARK_TYPES[dtype]).alias(V)), tuple(dims), tuple(keys), dtype, tuple(shape))

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray, dims: Sequence[str] | None = None, key: Any = None) -> TensorFrame:
        """One tensor from the driver; dims are guessed from the shape where they aren't given."""
        dims = tuple(dims) if dims is not None else guess_dims(array.shape)
        if len(dims) != array.ndim:
            raise ValueError(f"{array.ndim} axes, {len(dims)} dims")
        dtype = "bool" if array.dtype == bool else array.dtype.name
        if dtype not in N.SPARK_TYPES:
            raise ValueError(f"no tensor of dtype {array.dtype}")
        keys = () if key is None else ("sample_id",)
        plain = Decimal if dtype == "uint64" else (lambda v: v)
        rows = [(*(() if key is None else (key,)), *map(int, at), plain(array[at].item())) for at in np.ndindex(array.shape)]
        named = f"{'' if key is None else 'sample_id ' + ('string' if isinstance(key, str) else 'bigint') + ', '}{''.join(f'{d} int, ' for d in dims)}{V} {N.SPARK_TYPES[dtype]}"
        return cls(spark.createDataFrame(rows, named), dims, keys, dtype, tuple(array.shape))

    @classmethod
    def from_xarray(cls, spark: SparkSession, array: Any, key: Any = None) -> TensorFrame:
        """From anything with `values` and `dims`, such as an xarray.DataArray; coordinates and name are dropped."""
        return cls.from_numpy(spark, np.asarray(array.values), tuple(map(str, array.dims)), key)

    # metadata

    @property
    def ndim(self) -> int:
        return len(self.dims)

    @property
    def shape(self) -> tuple[int, ...]:
        if self.known is not None:
            return self.known
        row = self.df.agg(*[F.max(d).alias(d) for d in self.dims]).first() if self.dims else ()
        return tuple(0 if n is None else n + 1 for n in row)

    @property
    def sizes(self) -> dict[str, int]:
        return dict(zip(self.dims, self.shape, strict=True))

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    def flat_index(self) -> Column:
        """The row-major position of a cell."""
        out = F.lit(0).cast("bigint")
        for dim, n in self.sizes.items():
            out = out * n + F.col(dim)
        return out

    def _make(self, value: Column, dtype: str | None = None) -> TensorFrame:
        return replace(self, df=self.df.select(*self.keys, *self.dims, value.alias(V)), dtype=dtype or self.dtype)

    # elementwise

    def apply(self, function: Any, dtype: str | None = None) -> TensorFrame:
        """function: Column -> Column."""
        return self._make(function(F.col(V)), dtype)

    def binary(self, other: TensorFrame | float | int | bool, function: Any, dtype: str | None = None, reflected: bool = False) -> TensorFrame:
        """A scalar is a literal; another tensor is joined by its shared keys and axes, and broadcast over the others."""
        if not isinstance(other, TensorFrame):
            a, b = F.col(V), F.lit(other)
            return self._make(function(b, a) if reflected else function(a, b), dtype)
        shared = [d for d in self.dims if d in other.dims]
        mine, theirs = self.sizes, other.sizes
        if clash := [d for d in shared if mine[d] != theirs[d]]:
            raise ValueError(f"sizes differ along {clash}")
        same = [k for k in self.keys if k in other.keys]
        right = other.df.withColumnRenamed(V, "_other")
        joined = N.matched(self.df, right, same, shared) if same or shared else self.df.crossJoin(right)
        dims = self.dims + tuple(d for d in other.dims if d not in self.dims)
        keys = self.keys + tuple(k for k in other.keys if k not in self.keys)
        known = tuple({**theirs, **mine}[d] for d in dims)
        return TensorFrame(joined.select(*keys, *dims, function(F.col(V), F.col("_other")).alias(V)), dims, keys, dtype or self.dtype, known)

    def _common(self, other: Any) -> str:
        """The dtype of integer arithmetic with a tensor or number; float64 where either is no integer."""
        if isinstance(other, TensorFrame):
            found = np.result_type(self.dtype, other.dtype).name
        else:  # a number takes the tensor's dtype; beside truth values it is an integer
            found = "float64" if isinstance(other, float | np.floating) else ("int64" if self.dtype == "bool" and not isinstance(other, bool | np.bool_) else self.dtype)
        return "float64" if found.startswith("float") else found

    def _arithmetic(self, other: Any, floats: Any, whole: Any, reflected: bool = False) -> TensorFrame:
        """floats(a, b) on floats; whole(a, b, dtype) on integers, which wrap as their dtype does."""
        dtype = self._common(other)
        if dtype == "float64":
            return self.binary(other, floats, dtype, reflected)
        if not isinstance(other, TensorFrame) and not N.holds(dtype, int(other)):
            raise OverflowError(f"{other} is out of bounds for {dtype}")
        return self.binary(other, lambda a, b: whole(a, b, dtype), dtype, reflected)

    def __add__(self, other: Any) -> TensorFrame:
        if self._common(other) == "bool":
            return self | other
        return self._arithmetic(other, lambda a, b: a + b, lambda a, b, t: N.wrapped(N.widened(a, t) + N.widened(b, t), t))

    def _minus(self, other: Any, reflected: bool) -> TensorFrame:
        if self._common(other) == "bool":
            raise TypeError("truth values can't be subtracted; use ^")
        return self._arithmetic(other, lambda a, b: a - b, lambda a, b, t: N.wrapped(N.widened(a, t) - N.widened(b, t), t), reflected)

    def __sub__(self, other: Any) -> TensorFrame:
        return self._minus(other, False)

    def __rsub__(self, other: Any) -> TensorFrame:
        return self._minus(other, True)

    def __mul__(self, other: Any) -> TensorFrame:
        if self._common(other) == "bool":
            return self & other
        return self._arithmetic(other, lambda a, b: a * b, N.product)

    __radd__, __rmul__ = __add__, __mul__

    def __truediv__(self, other: Any) -> TensorFrame:
        return self.binary(other, N.divide, "float64")

    def __rtruediv__(self, other: Any) -> TensorFrame:
        return self.binary(other, N.divide, "float64", True)

    def _numbers(self, other: Any) -> tuple[TensorFrame, Any]:
        """Both, truth values as int8 where both are truth values."""
        if self._common(other) != "bool":
            return self, other
        return self.astype("int8"), other.astype("int8") if isinstance(other, TensorFrame) else int(other)

    def _whole_division(self, other: Any, floats: Any, part: int, reflected: bool = False) -> TensorFrame:
        own, other = self._numbers(other)
        return own._arithmetic(other, floats, lambda a, b, t: N.floor_parts(a, b, t)[part], reflected)

    def __floordiv__(self, other: Any) -> TensorFrame:
        return self._whole_division(other, N.floor_divide, 0)

    def __rfloordiv__(self, other: Any) -> TensorFrame:
        return self._whole_division(other, N.floor_divide, 0, True)

    def __mod__(self, other: Any) -> TensorFrame:
        return self._whole_division(other, N.modulo, 1)

    def __rmod__(self, other: Any) -> TensorFrame:
        return self._whole_division(other, N.modulo, 1, True)

    def _power(self, other: Any, reflected: bool) -> TensorFrame:
        own, other = self._numbers(other)
        if not reflected and isinstance(other, int) and other < 0 and "float" not in own.dtype:
            raise ValueError("integers to negative integer powers")
        return own._arithmetic(other, N.power, N.whole_power, reflected)

    def __pow__(self, other: Any) -> TensorFrame:
        return self._power(other, False)

    def __rpow__(self, other: Any) -> TensorFrame:
        return self._power(other, True)

    def _bits(self, other: Any, logical: Any, bitwise: Any) -> TensorFrame:
        return self.binary(other, logical if self.dtype == "bool" else bitwise)

    def __and__(self, other: Any) -> TensorFrame:
        return self._bits(other, lambda a, b: a & b, lambda a, b: a.bitwiseAND(b))

    def __or__(self, other: Any) -> TensorFrame:
        return self._bits(other, lambda a, b: a | b, lambda a, b: a.bitwiseOR(b))

    def __xor__(self, other: Any) -> TensorFrame:
        return self._bits(other, lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b))

    __rand__, __ror__, __rxor__ = __and__, __or__, __xor__

    def __lshift__(self, n: int) -> TensorFrame:
        """Bits that leave the dtype are lost."""
        return self.apply(lambda a: N.product(a, F.lit(1 << n), self.dtype) if n < N.BITS[self.dtype] else a - a)

    def __rshift__(self, n: int) -> TensorFrame:
        """Signed integers keep their sign."""
        if self.dtype == "uint64":
            return self.apply(lambda a: F.floor(a / F.lit(str(1 << n)).cast("decimal(38,0)")).cast("decimal(20,0)"))
        return self.apply(lambda a: F.shiftright(a.cast("bigint"), min(n, 63)).cast(N.SPARK_TYPES[self.dtype]))

    def compare(self, op: str, other: Any) -> TensorFrame:
        return self.binary(other, lambda a, b: N.compare(op, a, b), "bool")

    def __lt__(self, other: Any) -> TensorFrame:
        return self.compare("<", other)

    def __le__(self, other: Any) -> TensorFrame:
        return self.compare("<=", other)

    def __gt__(self, other: Any) -> TensorFrame:
        return self.compare(">", other)

    def __ge__(self, other: Any) -> TensorFrame:
        return self.compare(">=", other)

    def __eq__(self, other: Any) -> TensorFrame:  # type: ignore[override]
        return self.compare("==", other)

    def __ne__(self, other: Any) -> TensorFrame:  # type: ignore[override]
        return self.compare("!=", other)

    __hash__ = object.__hash__

    def __neg__(self) -> TensorFrame:
        return self * -1.0 if "float" in self.dtype else self._minus(0, True)

    def __pos__(self) -> TensorFrame:
        return self

    def __abs__(self) -> TensorFrame:
        return self.apply(F.abs if "float" in self.dtype else lambda a: N.wrapped(F.abs(N.widened(a, self.dtype)), self.dtype))

    def __invert__(self) -> TensorFrame:
        if self.dtype.startswith("u"):
            return self.apply(lambda a: (F.lit(str((1 << N.BITS[self.dtype]) - 1)).cast("decimal(20,0)") - a).cast(N.SPARK_TYPES[self.dtype]))
        return self.apply((lambda a: ~a) if self.dtype == "bool" else F.bitwise_not)

    def round(self, digits: int = 0) -> TensorFrame:
        return self.apply(lambda a: N.round_half_even(a, digits))

    def conj(self) -> TensorFrame:
        """Itself: there are no complex tensors."""
        return self

    conjugate = conj

    def exp(self) -> TensorFrame:
        return self.apply(F.exp, "float64")

    def sqrt(self) -> TensorFrame:
        return self.apply(F.sqrt, "float64")

    def clip(self, low: float | None = None, high: float | None = None) -> TensorFrame:
        bound = lambda x: None if x is None else F.lit(x)
        return self.apply(lambda a: N.clip(a, bound(low), bound(high)))

    def astype(self, dtype: str) -> TensorFrame:
        return self if dtype == self.dtype else self.apply(lambda a: N.as_dtype(a, self.dtype, dtype), dtype)

    def argsort(self, dim: str) -> TensorFrame:
        """Along dim: the positions in the order of their values (stable, NaN last)."""
        rest = [*self.keys, *(d for d in self.dims if d != dim)]
        rank = F.row_number().over(Window.partitionBy(*rest).orderBy(F.col(V), F.col(dim))) - 1
        ranked = self.df.select(*rest, F.col(dim).cast("bigint").alias(V), rank.cast("int").alias(dim))
        return replace(self, df=ranked.select(*self.keys, *self.dims, V), dtype="int64")

    # selection and shape

    def __getitem__(self, key: Any) -> TensorFrame:
        """An int drops its axis, a slice keeps it and starts again at 0; mappings name axes; a boolean frame selects cells."""
        if isinstance(key, TensorFrame):
            mask = key.df.where(V).select(*key.keys, *key.dims)
            return replace(self, df=self.df.join(mask, [*(k for k in self.keys if k in key.keys), *key.dims], "left_semi"), known=None)
        if isinstance(key, Mapping):
            parts = dict(key)
        else:
            key = key if isinstance(key, tuple) else (key,)
            if Ellipsis in key:
                at = key.index(Ellipsis)
                key = key[:at] + (slice(None),) * (self.ndim - len(key) + 1) + key[at + 1 :]
            parts = dict(zip(self.dims, key, strict=False))
        out, dims, sizes = self.df, list(self.dims), dict(self.sizes)
        for dim, part in parts.items():
            n = sizes[dim]
            if isinstance(part, int):
                if not -n <= part < n:
                    raise IndexError(f"{part} is out of bounds for axis {dim} of size {n}")
                out = out.where(F.col(dim) == part % n).drop(dim)
                dims.remove(dim)
                del sizes[dim]
            else:
                if isinstance(part, tuple):
                    part = slice(*part)
                lo, hi, step = part.indices(n)
                count = len(range(lo, hi, step))
                first, last = (lo, hi - 1) if step > 0 else (lo + (count - 1) * step, lo)
                if (lo, hi, step) != (0, n, 1):
                    out = out.where(F.col(dim).between(first, last)).where(F.pmod(F.col(dim) - lo, F.lit(abs(step))) == 0)
                    out = out.withColumn(dim, ((F.col(dim) - lo) / step).cast("int"))
                sizes[dim] = count
        return TensorFrame(out.select(*self.keys, *dims, V), tuple(dims), self.keys, self.dtype, tuple(sizes[d] for d in dims))

    def assign(self, patch: TensorFrame, at: Mapping[str, tuple[int, int]] | None = None) -> TensorFrame:
        """The patch's cells (moved to `at`: axis -> (start, stop)) take the place of this frame's."""
        moved = patch.df.withColumnRenamed(V, "_patch").withColumn("_hit", F.lit(True))
        for dim, (start, _) in (at or {}).items():
            if dim in patch.dims:
                moved = moved.withColumn(dim, F.col(dim) + start)
        on = [*(k for k in self.keys if k in patch.keys), *patch.dims]
        inside = F.lit(True)
        for dim, (start, stop) in (at or {}).items():
            inside &= F.col(dim).between(start, stop - 1)
        joined = self.df.join(moved, on, "left")
        return replace(self, df=joined.select(*self.keys, *self.dims, F.when(F.col("_hit") & inside, F.col("_patch")).otherwise(F.col(V)).alias(V)))

    def where(self, mask: TensorFrame, value: float) -> TensorFrame:
        """Cells where the mask holds become value."""
        return self.binary(mask, lambda a, m: F.when(m, F.lit(value)).otherwise(a))

    def item(self) -> Any:
        rows = self.df.select(V).take(2)
        if len(rows) != 1:
            raise ValueError("item() needs a single element")
        return rows[0][0]

    def __len__(self) -> int:
        if not self.dims:
            raise TypeError("a tensor without axes has no length")
        return self.shape[0]

    def __iter__(self):
        return (self[i] for i in range(len(self)))

    def __bool__(self) -> bool:
        raise TypeError("the truth of a tensor is not defined; use item() on a reduction")

    def transpose(self, dims: Sequence[str]) -> TensorFrame:
        """Other order of the axes; new ones are added with size 1. No data moves."""
        if missing := [d for d in self.dims if d not in dims]:
            raise ValueError(f"transpose lacks {missing}")
        out = self.expand_dims([d for d in dims if d not in self.dims])
        sizes = dict(zip(out.dims, out.known, strict=True)) if out.known else None
        return replace(out, df=out.df.select(*self.keys, *dims, V), dims=tuple(dims), known=sizes and tuple(sizes[d] for d in dims))

    def expand_dims(self, dims: Sequence[str] | Mapping[str, int]) -> TensorFrame:
        """New leading axes, of size 1 or as given (the data repeat)."""
        sizes = dict(dims) if isinstance(dims, Mapping) else dict.fromkeys(dims, 1)
        out = self.df
        for dim, n in sizes.items():
            out = out.withColumn(dim, F.lit(0) if n == 1 else F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        names = (*sizes, *self.dims)
        return replace(self, df=out.select(*self.keys, *names, V), dims=names, known=None if self.known is None else (*sizes.values(), *self.known))

    def crop_to(self, sizes: Mapping[str, int], crop_where: str | Mapping[str, str] = "both") -> TensorFrame:
        """left: the tail stays; right: the head stays; both: the middle."""
        parts = {}
        for dim, n in sizes.items():
            have = self.sizes[dim]
            place = crop_where if isinstance(crop_where, str) else crop_where[dim]
            if place not in ("left", "right", "both"):
                raise ValueError(f"no place to crop: {place}")
            if have > n:
                start = {"left": have - n, "right": 0, "both": (have - n) // 2}[place]
                parts[dim] = slice(start, start + n)
        return self[parts] if parts else self

    def pad(self, width: Mapping[str, int | tuple[int, int]], mode: str = "symmetric") -> TensorFrame:
        """mode: edge, reflect or symmetric. A cell is copied to the targets that map onto it: no shuffle."""
        from .operators.padding import targets

        out, sizes = self.df, dict(self.sizes)
        for dim, w in width.items():
            left, right = (w, w) if isinstance(w, int) else w
            if left or right:
                out = out.withColumn(dim, F.explode(targets(F.col(dim), sizes[dim], left, right, mode)))
                sizes[dim] += left + right
        return replace(self, df=out.select(*self.keys, *self.dims, V), known=tuple(sizes[d] for d in self.dims))

    def pad_to(self, sizes: Mapping[str, int], pad_where: str | Mapping[str, str] = "both", mode: str = "symmetric") -> TensorFrame:
        width = {}
        for dim, n in sizes.items():
            more = n - self.sizes[dim]
            place = pad_where if isinstance(pad_where, str) else pad_where[dim]
            if place not in ("left", "right", "both"):
                raise ValueError(f"no place to pad: {place}")
            if more > 0:
                width[dim] = {"left": (more, 0), "right": (0, more), "both": (more // 2, more - more // 2)}[place]
        return self.pad(width, mode) if width else self

    def resize_to(self, sizes: Mapping[str, int], *, pad_where: str | Mapping[str, str] = "both", crop_where: str | Mapping[str, str] = "both", pad_mode: str = "symmetric") -> TensorFrame:
        """Crops, pads, then adds the axes that it lacks."""
        own = {d: n for d, n in sizes.items() if d in self.dims}
        out = self.crop_to(own, crop_where).pad_to(own, pad_where, pad_mode)
        new = {d: n for d, n in sizes.items() if d not in self.dims}
        return out.expand_dims(new) if new else out

    # reductions; NaN is skipped, variance is that of the population

    def _reduced(self, over: str | Sequence[str] | None) -> list[str]:
        names = self.dims if over is None else ((over,) if isinstance(over, str) else tuple(over))
        if unknown := [d for d in names if d not in self.dims and d != "batch"]:
            raise ValueError(f"no axes {unknown}")
        return [d for d in self.dims if d not in names]

    def reduce(self, aggregate: Column, over: str | Sequence[str] | None = None, per: Sequence[str] | None = None, dtype: str = "float64") -> TensorFrame:
        """aggregate is over `value`; per: key columns that stay (by default all)."""
        kept, per = self._reduced(over), tuple(self.keys if per is None else per)
        grouped = self.df.groupBy(*per, *kept).agg(aggregate.alias(V))
        return TensorFrame(grouped, tuple(kept), per, dtype, self.known and tuple(self.sizes[d] for d in kept))

    def mean(self, dim: Any = None) -> TensorFrame:
        return self.reduce(F.avg(N.present(F.col(V))), dim)

    def sum(self, dim: Any = None) -> TensorFrame:
        whole = "float" not in self.dtype
        return self.reduce(F.sum(F.col(V).cast("bigint")) if whole else F.coalesce(F.sum(N.present(F.col(V))), F.lit(0.0)), dim, dtype="int64" if whole else "float64")

    def var(self, dim: Any = None) -> TensorFrame:
        return self.reduce(F.var_pop(N.present(F.col(V))), dim)

    def std(self, dim: Any = None) -> TensorFrame:
        return self.reduce(F.stddev_pop(N.present(F.col(V))), dim)

    def quantile(self, q: float | Sequence[float], dim: Any = None, method: str = "linear") -> TensorFrame:
        """A list of q adds a leading axis `quantile`; method: linear or inverted_cdf."""
        if isinstance(q, float | int):
            return self.reduce(quantile_of(F.col(V), q, method), dim)
        kept = self._reduced(dim)
        table = self.df.groupBy(*self.keys, *kept).agg(*[quantile_of(F.col(V), x, method).alias(f"_{i}") for i, x in enumerate(q)])
        spread = table.select(*self.keys, *kept, F.posexplode(F.array(*[f"_{i}" for i in range(len(q))])).alias("quantile", V))
        return TensorFrame(spread.select(*self.keys, "quantile", *kept, V), ("quantile", *kept), self.keys, "float64", self.known and (len(q), *[self.sizes[d] for d in kept]))

    def argmax(self) -> DataFrame:
        """Per sample, the position of the greatest value (the first of equals; NaN counts as the greatest, as in arrays)."""
        where = F.max_by(F.struct(*self.dims), F.struct(F.col(V), -self.flat_index()))
        return self.df.groupBy(*self.keys).agg(where.alias("_at")).select(*self.keys, "_at.*")

    # packed form

    def packed(self) -> DataFrame:
        """One row per sample: keys, dims, shape, dtype, data (flat, row-major)."""
        cells = F.sort_array(F.collect_list(F.struct(self.flat_index().alias("p"), F.col(V).alias("v"))))
        data = F.transform(cells, lambda c: c["v"])
        grouped = self.df.groupBy(*self.keys).agg(data.alias("data"))
        return grouped.select(*self.keys, F.array(*map(F.lit, self.dims)).alias("dims"), F.array(*map(F.lit, self.shape)).alias("shape"), F.lit(self.dtype).alias("dtype"), "data")

    def to_numpy(self, limit: int = 50_000_000) -> dict[Any, np.ndarray] | np.ndarray:
        """Arrays by key (or the one array of a frame without keys) on the driver; refuses more than `limit` cells."""
        if self.df.limit(limit + 1).count() > limit:
            raise ValueError(f"more than {limit} cells; write them instead")
        shape, out = self.shape, {}
        for row in self.packed().collect():
            key = tuple(row[k] for k in self.keys)
            out[key[0] if len(key) == 1 else key] = np.array(row["data"]).reshape(shape)
        return out if self.keys else out[()]


def quantile_of(column: Column, q: float, method: str = "linear") -> Column:
    """An exact quantile aggregate of `value`, without NaN."""
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile of {q}")
    if method == "linear":
        return F.percentile(N.present(column), F.lit(float(q)))
    if method == "inverted_cdf":
        # the least value whose share of the values up to it is at least q
        return F.expr(f"percentile_disc({float(q)!r}D) WITHIN GROUP (ORDER BY nanvl(cast({V} as double), cast(null as double)))")
    raise ValueError(f"no quantile method {method}")
