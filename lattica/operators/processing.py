"""Pre- and postprocessing: each operator is one projection over cells, after a join with the statistics that it needs.

Statistics over a data set have one row per kept coordinate, which the shape
bounds, and are broadcast; those per sample are joined by sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..axes import axis_ids
from ..frame import V, TensorFrame
from ..functions import numeric as N
from ..plans.measures import Measure, Stat, StatsCalculator, StatTable

Members = dict[str, TensorFrame]
Value = Callable[[Measure], Column]


@dataclass(frozen=True)
class Operator:
    """Reads one member and writes one; does nothing where its member is absent."""

    input: str
    output: str

    @property
    def required_measures(self) -> frozenset[Measure]:
        return frozenset()

    def column(self, v: Column, of: Value, tensor: TensorFrame) -> Column:
        raise NotImplementedError

    def dtype(self, tensor: TensorFrame) -> str:
        return "float64"

    def describe(self) -> dict[str, Any]:
        raise NotImplementedError(f"{type(self).__name__} has no description")

    def __call__(self, members: Members, stat: Stat | None = None) -> Members:
        if self.input not in members:
            return members
        tensor = members[self.input]
        df, names = tensor.df, {}
        for i, table in enumerate(dict.fromkeys((stat or Stat()).find(m) for m in sorted(self.required_measures, key=str)) if self.required_measures else ()):
            renamed = {m: f"_s{i}{c}" for m, c in table.columns.items()}
            names.update({m: F.col(c) for m, c in renamed.items() if m in self.required_measures})
            side = table.df.select(*table.keys, *table.kept, *[F.col(c).alias(renamed[m]) for m, c in table.columns.items() if m in self.required_measures])
            on = [*table.keys, *table.kept]
            # Without keys there is one row per kept coordinate.
            side = side if table.keys else F.broadcast(side)
            df = N.matched(df, side, table.keys, table.kept) if on else df.crossJoin(side)
        value = self.column(F.col(V), names.__getitem__, tensor)
        out = replace(tensor, df=df.select(*tensor.keys, *tensor.dims, value.alias(V)), dtype=self.dtype(tensor))
        if self.output in members and self.output != self.input and members[self.output].known not in (None, out.known):
            raise ValueError(f"{self.output} has another shape than {self.input}")
        return {**members, self.output: out}


StatTable.__hash__ = object.__hash__  # type: ignore[method-assign]  # tables are looked up by identity


def along(values: float | Sequence[float], axis: str | None) -> Column:
    """A scalar, or the value at the cell's position along an axis."""
    if isinstance(values, int | float):
        return F.lit(float(values))
    if len(values) == 1:
        return F.lit(float(values[0]))
    if axis is None:
        raise ValueError("several values need an axis")
    return F.element_at(F.array(*[F.lit(float(x)) for x in values]), F.col(axis) + 1)


@dataclass(frozen=True)
class AddKnownDatasetStats:
    """Statistics that are known take the place of computed ones."""

    known: Stat

    def __call__(self, members: Members, stat: Stat | None = None) -> Stat:
        return (stat or Stat()).with_tables(self.known.tables)


@dataclass(frozen=True)
class UpdateStats:
    """Statistics of the members; initial dataset values stay unless they are to be updated, in which case the data behind them count too."""

    calculator: StatsCalculator
    keep_updating_initial_dataset_stats: bool = False

    def __call__(self, members: Members, stat: Stat | None = None) -> Stat:
        use = self.calculator.has_dataset_measures and not self.keep_updating_initial_dataset_stats
        found = self.calculator.skip_update_and_get_all(members) if use else self.calculator.update_and_get_all(members)
        return (stat or Stat()).with_tables(found.tables)


@dataclass(frozen=True)
class Binarize(Operator):
    """value > threshold, which may differ along an axis."""

    threshold: float | Sequence[float] = 0.0
    axis: str | None = None

    def column(self, v, of, tensor):
        return N.compare(">", v, along(self.threshold, self.axis))

    def dtype(self, tensor):
        return "bool"


@dataclass(frozen=True)
class Clip(Operator):
    """Bounds are numbers or quantile measures. Beyond a number NaN stays; beyond a quantile NaN becomes the bound."""

    min: float | Measure | None = None
    max: float | Measure | None = None

    def __post_init__(self):
        low, high = self.min, self.max
        if low is None and high is None:
            raise ValueError("clip needs a bound")
        if isinstance(low, int | float) and isinstance(high, int | float) and not low < high:
            raise ValueError("min must be below max")
        if isinstance(low, Measure) and isinstance(high, Measure):
            if low.axes != high.axes or not low.q < high.q:
                raise ValueError("two quantiles need equal axes and a lower q first")

    @property
    def required_measures(self):
        return frozenset(m for m in (self.min, self.max) if isinstance(m, Measure))

    def column(self, v, of, tensor):
        for bound, low in ((self.min, True), (self.max, False)):
            if isinstance(bound, Measure):
                v = N.replace_beyond(v, of(bound) if low else None, None if low else of(bound))
            elif bound is not None:
                v = N.clip(v, F.lit(bound) if low else None, None if low else F.lit(bound))
        return v

    def dtype(self, tensor):
        return tensor.dtype if not self.required_measures else "float64"


@dataclass(frozen=True)
class EnsureDtype(Operator):
    target: str = "float32"

    def column(self, v, of, tensor):
        return v if tensor.dtype == self.target else N.as_dtype(v, tensor.dtype, self.target)

    def dtype(self, tensor):
        return self.target

    def describe(self):
        return {"id": "ensure_dtype", "kwargs": {"dtype": self.target}}


@dataclass(frozen=True)
class ScaleLinear(Operator):
    gain: float | Sequence[float] = 1.0
    offset: float | Sequence[float] = 0.0
    axis: str | None = None

    def column(self, v, of, tensor):
        out = v * along(self.gain, self.axis) + along(self.offset, self.axis)
        return out.cast("float") if tensor.dtype == "float32" else out

    def dtype(self, tensor):
        return "float32" if tensor.dtype == "float32" else "float64"


@dataclass(frozen=True)
class ScaleMeanVariance(Operator):
    """Mean and deviation become those of a reference member (by default its own, which changes nothing but by eps)."""

    axes: tuple[str, ...] | None = None
    reference: str | None = None
    eps: float = 1e-6

    def _pair(self, member: str) -> tuple[Measure, Measure]:
        scope = "dataset" if self.axes is not None and "batch" in axis_ids(self.axes) else "sample"
        return Measure(scope, "mean", member, self.axes), Measure(scope, "std", member, self.axes)

    @property
    def required_measures(self):
        return frozenset([*self._pair(self.input), *self._pair(self.reference or self.input)])

    def column(self, v, of, tensor):
        (m, s), (rm, rs) = self._pair(self.input), self._pair(self.reference or self.input)
        return (v - of(m)) / (of(s) + self.eps) * (of(rs) + self.eps) + of(rm)


@dataclass(frozen=True)
class ScaleRange(Operator):
    """(value - lower) / (upper - lower + eps); by default over the data set, from its least to its greatest value."""

    lower: Measure | None = None
    upper: Measure | None = None
    eps: float = 1e-6

    def __post_init__(self):
        low, high = self._bounds()
        if low.axes != high.axes or not low.q < high.q:
            raise ValueError("two quantiles need equal axes and a lower q first")

    def _bounds(self) -> tuple[Measure, Measure]:
        return (self.lower or Measure("dataset", "quantile", self.input, None, 0.0), self.upper or Measure("dataset", "quantile", self.input, None, 1.0))

    @property
    def required_measures(self):
        return frozenset(self._bounds())

    def column(self, v, of, tensor):
        low, high = map(of, self._bounds())
        return (v - low) / (high - low + self.eps)

    def describe(self):
        low, high = self._bounds()
        return {"id": "scale_range", "kwargs": {"axes": low.axes, "min_percentile": low.q * 100, "max_percentile": high.q * 100, "eps": self.eps}}


@dataclass(frozen=True)
class Sigmoid(Operator):
    def column(self, v, of, tensor):
        return 1 / (1 + F.exp(-v.cast("double")))

    def describe(self):
        return {"id": "sigmoid", "kwargs": {}}


@dataclass(frozen=True)
class Softmax(Operator):
    axis: str = "channel"

    def __call__(self, members, stat=None):
        if self.input not in members:
            return members
        from pyspark.sql import Window

        tensor = members[self.input]
        # One exchange by sample serves both windows; their groups are slices of one tensor.
        along_axis = Window.partitionBy(*tensor.keys, *(d for d in tensor.dims if d != self.axis))
        e = tensor.df.withColumn("_e", F.exp(F.col(V).cast("double") - F.max(V).over(along_axis)))
        value = F.col("_e") / F.sum("_e").over(along_axis)
        return {**members, self.output: replace(tensor, df=e.select(*tensor.keys, *tensor.dims, value.alias(V)), dtype="float64")}

    def describe(self):
        return {"id": "softmax", "kwargs": {"axis": self.axis}}


@dataclass(frozen=True)
class ZeroMeanUnitVariance(Operator):
    """(value - mean) / (std + eps); mean and std have equal axes."""

    mean: Measure | None = None
    std: Measure | None = None
    eps: float = 1e-6

    def __post_init__(self):
        m, s = self._pair()
        if m.axes != s.axes or m.scope != s.scope:
            raise ValueError("mean and std need equal axes")

    def _pair(self) -> tuple[Measure, Measure]:
        return (self.mean or Measure("dataset", "mean", self.input), self.std or Measure("dataset", "std", self.input))

    @property
    def required_measures(self):
        return frozenset(self._pair())

    def column(self, v, of, tensor):
        m, s = map(of, self._pair())
        return (v - m) / (s + self.eps)

    def describe(self):
        return {"id": "zero_mean_unit_variance", "kwargs": {"axes": self._pair()[0].axes, "eps": self.eps}}


@dataclass(frozen=True)
class FixedZeroMeanUnitVariance(Operator):
    mean: float | Sequence[float] = 0.0
    std: float | Sequence[float] = 1.0
    axis: str | None = None
    eps: float = 1e-6

    def column(self, v, of, tensor):
        return (v - along(self.mean, self.axis)) / (along(self.std, self.axis) + self.eps)

    def describe(self):
        return {"id": "fixed_zero_mean_unit_variance", "kwargs": {"mean": self.mean, "std": self.std, "axis": self.axis}}


def _scope(kwargs: Mapping[str, Any]) -> tuple[str, tuple[str, ...] | None]:
    """(dataset or sample, axes): no axes mean the whole data set."""
    axes = kwargs.get("axes")
    mode = kwargs.get("mode")
    if axes is None and mode in (None, "per_dataset"):
        return "dataset", None
    names = axis_ids(axes or (), mode == "per_dataset") or None
    return ("dataset" if names and "batch" in names else "sample"), names


def get_proc(description: Mapping[str, Any], member: str, output: str | None = None) -> Operator:
    """The operator of a description {id, kwargs}; older descriptions have `name`, letters as axes and a mode."""
    name = description.get("id") or description["name"]
    k = dict(description.get("kwargs") or {})
    out = output or member
    scope, axes = _scope(k)
    eps = {"eps": k["eps"]} if "eps" in k else {}
    quantile = lambda p, method="linear": Measure(scope, "quantile", member, axes, p / 100, method if scope == "sample" else "linear")
    if name == "binarize":
        return Binarize(member, out, k.get("threshold", 0.0), k.get("axis"))
    if name == "clip":
        method = "inverted_cdf"
        low = quantile(k["min_percentile"], method) if k.get("min_percentile") is not None else k.get("min")
        high = quantile(k["max_percentile"], method) if k.get("max_percentile") is not None else k.get("max")
        return Clip(member, out, low, high)
    if name == "ensure_dtype":
        return EnsureDtype(member, out, k["dtype"])
    if name == "scale_linear":
        if k.get("axes"):
            raise NotImplementedError("scale_linear along the axes of an older description")
        return ScaleLinear(member, out, k.get("gain", 1.0), k.get("offset", 0.0), k.get("axis"))
    if name == "scale_mean_variance":
        return ScaleMeanVariance(member, out, axes, k.get("reference_tensor"), **eps)
    if name == "scale_range":
        source = k.get("reference_tensor") or member
        bounds = [Measure(scope, "quantile", source, axes, k.get(key, default) / 100) for key, default in (("min_percentile", 0.0), ("max_percentile", 100.0))]
        return ScaleRange(member, out, *bounds, **eps)
    if name == "sigmoid":
        return Sigmoid(member, out)
    if name == "softmax":
        return Softmax(member, out, k.get("axis", "channel"))
    if name == "fixed_zero_mean_unit_variance" or (name == "zero_mean_unit_variance" and k.get("mode") == "fixed"):
        return FixedZeroMeanUnitVariance(member, out, k["mean"], k["std"], k.get("axis"), **eps)
    if name == "zero_mean_unit_variance":
        return ZeroMeanUnitVariance(member, out, Measure(scope, "mean", member, axes), Measure(scope, "std", member, axes), **eps)
    raise ValueError(f"no operator {name}")


PROCESSING = ("binarize", "clip", "ensure_dtype", "fixed_zero_mean_unit_variance", "scale_linear", "scale_mean_variance", "scale_range", "sigmoid", "softmax", "zero_mean_unit_variance")


# Row-local forms: statistics within one packed tensor need no shuffle at all.


def packed_zero_mean_unit_variance(data: Column, shape: Sequence[int], kept: int = 1, eps: float = 1e-6) -> Column:
    """Of flat row-major arrays, per position of the first `kept` axes: every step stays within the row."""
    groups, n = math.prod(shape[:kept]), math.prod(shape[kept:])

    def normal(g: Column) -> Column:
        part = F.slice(data, g * n + 1, n)
        seen = F.filter(part, lambda x: ~F.isnan(x))
        total = lambda f: F.aggregate(seen, F.lit(0.0), lambda a, x: a + f(x)) / F.size(seen)
        mean = total(lambda x: x)
        return F.transform(F.array(F.struct(part.alias("part"), seen.alias("seen"), mean.alias("mean"))), lambda s: F.transform(
            F.array(F.struct(s["part"].alias("part"), s["mean"].alias("mean"), F.sqrt(F.aggregate(s["seen"], F.lit(0.0), lambda a, x: a + (x - s["mean"]) * (x - s["mean"])) / F.size(s["seen"])).alias("std"))),
            lambda t: F.transform(t["part"], lambda x: (x - t["mean"]) / (t["std"] + eps)),
        )[0])[0]

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), normal))
