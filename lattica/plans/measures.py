"""Statistics of tensors: what can be asked for, and how requests share aggregations.

A request is a Measure. The planner puts all measures with the same scope,
member and axes into one aggregation, so mean, variance, deviation and any
number of quantiles cost one pass and one shuffle of partial states.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axes import axis_ids
from ..frame import V, TensorFrame, quantile_of
from ..functions import numeric as N

SCOPES, NAMES, METHODS = ("sample", "dataset"), ("mean", "std", "var", "quantile"), ("linear", "inverted_cdf")
#: How a quantile over a data set is taken; "mean" is the count-weighted mean of the samples' quantiles.
DATASET_QUANTILES = ("exact", "approx", "kll", "mean")


@dataclass(frozen=True)
class Measure:
    scope: str
    name: str
    member: str
    axes: tuple[str, ...] | None = None
    q: float | None = None
    method: str = "linear"

    def __post_init__(self) -> None:
        if self.axes is not None:
            object.__setattr__(self, "axes", axis_ids(self.axes))
        if self.scope not in SCOPES or self.name not in NAMES:
            raise ValueError(f"no measure {self.scope} {self.name}")
        batch = self.axes is not None and "batch" in self.axes
        if self.scope == "sample" and batch:
            raise ValueError("the axes of a sample measure don't contain batch")
        if self.scope == "dataset" and self.axes is not None and not batch:
            raise ValueError("the axes of a dataset measure contain batch")
        if (self.name == "quantile") != (self.q is not None) or (self.q is not None and not 0 <= self.q <= 1):
            raise ValueError("a quantile has a q from 0 to 1, other measures have none")
        if self.method not in METHODS:
            raise ValueError(f"no quantile method {self.method}")

    def as_json(self) -> dict[str, Any]:
        out = {k: v for k, v in asdict(self).items() if v is not None}
        if self.name != "quantile" or self.scope == "dataset":
            out.pop("method")
        return out

    @classmethod
    def from_json(cls, data: Mapping[str, Any]) -> Measure:
        return cls(**{**data, "axes": None if data.get("axes") is None else tuple(data["axes"])})


def sample_mean(member: str, axes: Any = None) -> Measure:
    return Measure("sample", "mean", member, axes)


def sample_std(member: str, axes: Any = None) -> Measure:
    return Measure("sample", "std", member, axes)


def sample_var(member: str, axes: Any = None) -> Measure:
    return Measure("sample", "var", member, axes)


def sample_quantile(q: float, member: str, axes: Any = None, method: str = "linear") -> Measure:
    return Measure("sample", "quantile", member, axes, q, method)


def dataset_mean(member: str, axes: Any = None) -> Measure:
    return Measure("dataset", "mean", member, axes)


def dataset_std(member: str, axes: Any = None) -> Measure:
    return Measure("dataset", "std", member, axes)


def dataset_var(member: str, axes: Any = None) -> Measure:
    return Measure("dataset", "var", member, axes)


def dataset_quantile(q: float, member: str, axes: Any = None) -> Measure:
    return Measure("dataset", "quantile", member, axes, q)


@dataclass(frozen=True)
class StatTable:
    """Values of measures that share scope, member and axes: keys, kept axes and one column per measure."""

    df: DataFrame
    keys: tuple[str, ...]
    kept: tuple[str, ...]
    columns: Mapping[Measure, str]

    def value(self, measure: Measure) -> TensorFrame:
        return TensorFrame(self.df.select(*self.keys, *self.kept, F.col(self.columns[measure]).alias(V)), self.kept, self.keys)


@dataclass
class Stat:
    """Tables by the measures that they hold; later tables win."""

    tables: list[StatTable] = field(default_factory=list)

    def find(self, measure: Measure) -> StatTable:
        for table in reversed(self.tables):
            if measure in table.columns:
                return table
        raise KeyError(measure)

    def __contains__(self, measure: Measure) -> bool:
        return any(measure in t.columns for t in self.tables)

    def value(self, measure: Measure) -> TensorFrame:
        return self.find(measure).value(measure)

    def with_tables(self, tables: Iterable[StatTable]) -> Stat:
        return Stat([*self.tables, *tables])


def plan(measures: Iterable[Measure]) -> dict[tuple[str, str, tuple[str, ...] | None], list[Measure]]:
    """Requests by what one aggregation can answer; equal requests count once."""
    groups: dict = {}
    for m in sorted(set(measures), key=lambda m: (m.scope, m.member, m.axes or (), m.name, m.q or 0, m.method)):
        groups.setdefault((m.scope, m.member, m.axes), []).append(m)
    return groups


def compute(measures: Iterable[Measure], members: Mapping[str, TensorFrame], quantiles: str = "exact") -> Stat:
    """The statistics of all samples of the members; members that are absent are skipped."""
    tables = []
    for (scope, member, axes), wanted in plan(measures).items():
        if member in members:
            tables.append(_table(scope, axes, wanted, members[member], quantiles))
    return Stat(tables)


def _table(scope: str, axes: tuple[str, ...] | None, wanted: list[Measure], tensor: TensorFrame, quantiles: str) -> StatTable:
    kept = tuple(tensor._reduced(axes))
    keys = tensor.keys if scope == "sample" else ()
    columns = {m: f"_{'_'.join(map(str, (m.name, i)))}" for i, m in enumerate(wanted)}
    direct = [m for m in wanted if m.name != "quantile" or scope == "sample" or quantiles != "mean"]
    df = tensor.df.groupBy(*keys, *kept).agg(*[_aggregate(m, quantiles).alias(columns[m]) for m in direct]) if direct else None
    if rest := [m for m in wanted if m not in direct]:
        values = N.present(F.col(V))
        per = tensor.df.groupBy(*tensor.keys, *kept).agg(F.count(values).alias("_n"), *[F.percentile(values, F.lit(float(m.q))).alias(columns[m]) for m in rest])
        mean = per.groupBy(*kept).agg(*[(F.sum(F.col("_n") * F.col(columns[m])) / F.sum("_n")).alias(columns[m]) for m in rest])
        df = mean if df is None else (df.join(mean, list(kept)) if kept else df.crossJoin(mean))
    return StatTable(df, keys, kept, columns)


def _aggregate(m: Measure, quantiles: str) -> Column:
    values = N.present(F.col(V))
    if m.name != "quantile":
        return {"mean": F.avg, "var": F.var_pop, "std": F.stddev_pop}[m.name](values)
    if m.scope == "sample" or quantiles == "exact":
        return quantile_of(F.col(V), m.q, m.method)
    if quantiles == "approx":
        return F.percentile_approx(values, float(m.q), 10_000)
    if quantiles == "kll":
        return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(values), F.lit(float(m.q)))
    raise ValueError(f"no dataset quantile {quantiles}; there are {DATASET_QUANTILES}")


def compute_dataset_measures(measures: Iterable[Measure], members: Mapping[str, TensorFrame], quantiles: str = "exact") -> Stat:
    measures = list(measures)
    if any(m.scope != "dataset" for m in measures):
        raise ValueError("only dataset measures are computed here")
    return compute(measures, members, quantiles)


def compute_sample_measures(measures: Iterable[Measure], members: Mapping[str, TensorFrame]) -> Stat:
    measures = list(measures)
    if any(m.scope != "sample" for m in measures):
        raise ValueError("only sample measures are computed here")
    return compute(measures, members)


class StatsCalculator:
    """Measures over data that arrive in parts.

    Parts are united lazily and aggregated once. Initial dataset values are
    used instead where they cover every dataset measure that is asked for.
    """

    def __init__(self, measures: Iterable[Measure], initial: Stat | None = None, quantiles: str = "exact"):
        self.measures, self.quantiles = frozenset(measures), quantiles
        self.dataset = frozenset(m for m in self.measures if m.scope == "dataset")
        covered = initial is not None and all(m in initial for m in self.dataset)
        self.initial = initial if covered else None
        self.members: dict[str, TensorFrame] = {}
        self.last: dict[str, TensorFrame] = {}
        self._final: Stat | None = None

    @property
    def has_dataset_measures(self) -> bool:
        return self.initial is not None

    def update(self, members: Mapping[str, TensorFrame]) -> None:
        from dataclasses import replace

        self._final, self.initial = None, None
        self.last = dict(members)
        for name, tensor in members.items():
            before = self.members.get(name)
            self.members[name] = tensor if before is None else replace(before, df=before.df.unionByName(tensor.df), known=before.known if before.known == tensor.known else None)

    def finalize(self) -> Stat:
        if self.initial is not None:
            return self.initial
        if self._final is None:
            self._final = compute(self.dataset, self.members, self.quantiles)
        return self._final

    def update_and_get_all(self, members: Mapping[str, TensorFrame]) -> Stat:
        self.update(members)
        return self.finalize().with_tables(self._samples(members))

    def skip_update_and_get_all(self, members: Mapping[str, TensorFrame]) -> Stat:
        return self.finalize().with_tables(self._samples(members))

    def _samples(self, members: Mapping[str, TensorFrame]) -> list[StatTable]:
        return compute(self.measures - self.dataset, members).tables
