"""Comparison of tensors with what they should be."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frame import V, TensorFrame


@dataclass(frozen=True)
class Tolerance:
    """|actual - expected| may exceed atol + rtol * |expected| in `ppm` of a million cells."""

    rtol: float = 1e-3
    atol: float = 1e-3
    ppm: float = 0.0

    @classmethod
    def of_decimal(cls, decimal: int) -> Tolerance:
        return cls(0.0, 1.5 * 10.0**-decimal)


def choose_tolerance(specific: Iterable[tuple[str | None, str | None, Tolerance]], weight_format: str, output: str) -> Tolerance:
    """The first entry whose format and output (None: any) fit, else the default."""
    return next((t for f, o, t in specific if f in (None, weight_format) and o in (None, output)), Tolerance())


def mismatches(actual: TensorFrame, expected: TensorFrame, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """One row: cells, mismatched, ppm, largest differences and where (abs_at, rel_at: the first such cell's keys and axes); cells that only one side has, and NaN on one side, are mismatches."""
    on = [*expected.keys, *expected.dims]
    both = actual.df.select(*on, F.col(V).cast("double").alias("_a"), F.lit(True).alias("_in_a")).join(
        expected.df.select(*on, F.col(V).cast("double").alias("_e"), F.lit(True).alias("_in_e")), on, "full_outer"
    )
    one_sided = F.col("_in_a").isNull() | F.col("_in_e").isNull() | (F.isnan("_a") != F.isnan("_e"))
    off = F.abs(F.col("_a") - F.col("_e"))
    beyond = off > tolerance.atol + tolerance.rtol * F.abs("_e")
    wrong = one_sided | (F.coalesce(beyond, F.lit(False)) & ~F.isnan("_e"))
    relative = off / (F.abs("_e") + 1e-6)
    out = both.select(*on, wrong.alias("_wrong"), off.alias("_off"), relative.alias("_rel"))
    seen = F.when(~F.isnan("_off"), F.col("_off"))
    where = F.struct(*on)

    def first_largest(c: str) -> Column:
        return F.min_by(where, F.when(~F.isnan(c), F.struct((-F.col(c)).alias("_down"), *on)))

    return out.agg(
        F.count("*").alias("cells"), F.count_if("_wrong").alias("mismatched"), (F.count_if("_wrong") / F.count("*") * 1e6).alias("ppm"),
        F.max(seen).alias("max_abs"), F.max(F.when(~F.isnan("_rel"), F.col("_rel"))).alias("max_rel"),
        first_largest("_off").alias("abs_at"), first_largest("_rel").alias("rel_at"),
    )


def missing_members(actual: Mapping[str, object], expected: Mapping[str, object]) -> tuple[list[str], list[str]]:
    """(missing, unexpected) names."""
    return [m for m in expected if m not in actual], [m for m in actual if m not in expected]


@dataclass
class Report:
    """Entries (status, location, message); the worst status is the report's."""

    entries: list[tuple[str, str, str]] = field(default_factory=list)

    def add(self, status: str, where: str, what: str = "") -> None:
        self.entries.append((status, where, what))

    @property
    def status(self) -> str:
        states = {s for s, *_ in self.entries}
        return "failed" if "failed" in states else ("warning" if "warning" in states else "passed")


def check_outputs(actual: Mapping[str, TensorFrame], expected: Mapping[str, TensorFrame], tolerance: Tolerance = Tolerance(), report: Report | None = None) -> Report:
    report = report or Report()
    missing, unexpected = missing_members(actual, expected)
    for name in missing:
        report.add("failed", name, "missing")
    for name in unexpected:
        report.add("failed", name, "unexpected")
    for name in (m for m in expected if m in actual):
        a, e = actual[name], expected[name]
        if a.dims != e.dims or a.shape != e.shape:
            report.add("failed", name, f"{a.dims} {a.shape}, not {e.dims} {e.shape}")
            continue
        row = mismatches(a, e, tolerance).first()
        if row["mismatched"] and row["ppm"] > tolerance.ppm:
            at = f" at {row['abs_at'].asDict()}" if row["abs_at"] else ""
            report.add("failed", name, f"{row['mismatched']} of {row['cells']} cells differ, by up to {row['max_abs']}{at}")
        elif row["mismatched"]:
            report.add("warning", name, f"{row['ppm']:.3g} ppm differ, which is tolerated")
        else:
            report.add("passed", name)
    return report


def check_model(predict: Callable[[dict[str, TensorFrame]], dict[str, TensorFrame]], inputs: dict[str, TensorFrame], expected: Mapping[str, TensorFrame], tolerance: Tolerance = Tolerance(), sizes: Iterable[Mapping[str, int]] = (), shape_of: Callable[[Mapping[str, int]], dict[str, int]] | None = None, stop_early: bool = False) -> Report:
    """Golden outputs, then the shapes of the outputs for resized inputs."""
    report = check_outputs(predict(inputs), expected, tolerance)
    for case in sizes:
        if stop_early and report.status == "failed":
            break
        resized = {m: t.resize_to({d: n for d, n in case.items() if d in t.dims}) for m, t in inputs.items()}
        for m, t in predict(resized).items():
            wanted = (shape_of or (lambda s: dict(s)))(case)
            found = {d: max((r[0] for r in t.df.agg(F.max(d)).collect()), default=-1) + 1 for d in t.dims if d in wanted}
            bad = {d: n for d, n in found.items() if n != wanted[d]}
            report.add("failed" if bad else "passed", f"{m} at {dict(case)}", str(bad or ""))
    return report


def enable_determinism(seed: int = 0) -> None:
    random.seed(seed)
    np.random.seed(seed)
