"""Registered queries over the shared tables, each with the SQL that it is held against.

`embeddings` vectors are tensors of channel 4, y 4, x 4; `events` is an
ordered series of values; `part` is a one-dimensional tensor.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import checking
from .frame import V, TensorFrame
from .functions import numeric as N
from .operators import processing as P
from .operators import tiling as T
from .plans import measures as M
from .plans.pipeline import FunctionModel, Output, PredictionPipeline, union_members
from .streaming import running

DIMS, SHAPE, KEYS = ("channel", "y", "x"), (4, 4, 4), ("vec_id",)
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# The cells of `embeddings`, the common start of most oracles.
CELLS = """cells AS (SELECT vec_id, CAST(p // 16 AS INTEGER) AS channel, CAST((p // 4) % 4 AS INTEGER) AS y, CAST(p % 4 AS INTEGER) AS x, v AS value
 FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"""
AT = "vec_id, channel, y, x"
OUT = "round(value, 6) + 0.0 AS value"


def add(name: str, query: Query, sql: str | None = None, cells: bool = True) -> None:
    _QUERIES[name] = query
    if sql:
        _SQL[name] = (f"WITH {CELLS}{', ' if sql.startswith('WITH+') else ' '}" if cells else "") + sql.removeprefix("WITH+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> TensorFrame:
    data = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("data"))
    return TensorFrame.from_packed(data, "data", DIMS, SHAPE, KEYS)


def parts(spark: SparkSession, sf_dir: str) -> TensorFrame:
    """p_size, a 1-d integer tensor whose axis is the part's key, counted from 0."""
    df = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).cast("int").alias("x"), F.col("p_size").cast("int").alias(V))
    return TensorFrame(df, ("x",), (), "int32")


def rounded(tensor: TensorFrame | DataFrame) -> DataFrame:
    df = tensor.df if isinstance(tensor, TensorFrame) else tensor
    numbers = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[(F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) if c in numbers else F.col(c) for c in df.columns])


def tensor_query(name: str, make: Callable[[TensorFrame], TensorFrame | DataFrame], sql: str) -> None:
    add(name, lambda spark, sf_dir: rounded(make(embeddings(spark, sf_dir))), sql)


def cellwise(name: str, make: Callable[[TensorFrame], TensorFrame], value: str, kind: str | None = None) -> None:
    shown = f"{value} AS value" if kind else f"round({value}, 6) + 0.0 AS value"
    tensor_query(name, make, f"SELECT {AT}, {shown} FROM cells")


def processed(name: str, operator: Callable[[], P.Operator], sql: str, members: Callable[[TensorFrame], dict] | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tensor = embeddings(spark, sf_dir)
        own = members(tensor) if members else {"raw": tensor}
        step = operator()
        return rounded(step(own, M.compute(step.required_measures, own))[step.output])

    add(name, run, sql)


# M: elementwise

for _name, _make, _sql in (
    ("add", lambda t: t + 1.5, "value + 1.5"), ("sub", lambda t: 2 - t, "2 - value"), ("mul", lambda t: t * 3.0, "value * 3.0"),
    ("div", lambda t: t / 0.3, "value / 0.3"), ("div_by_zero", lambda t: (t / 0.0).clip(-9.0, 9.0), "CASE WHEN value > 0 THEN 9.0 WHEN value < 0 THEN -9.0 ELSE 'nan'::DOUBLE END"),
    ("floordiv", lambda t: t // 0.07, "floor(value / 0.07)"), ("mod", lambda t: t % 0.07, "value - 0.07 * floor(value / 0.07)"),
    ("mod_negative", lambda t: t % -0.07, "value - (-0.07) * floor(value / (-0.07))"),
    ("pow", lambda t: abs(t) ** 1.5, "pow(abs(value), 1.5)"), ("rpow", lambda t: 2.0 ** t, "pow(2.0, value)"), ("rdiv", lambda t: 1.0 / (t + 2), "1.0 / (value + 2)"),
    ("neg", lambda t: -t, "-value"), ("pos", lambda t: +t, "value"), ("abs", abs, "abs(value)"), ("conj", lambda t: t.conj(), "value"),
    ("round_half_even", lambda t: (t * 8).round(), "round_even(value * 8, 0)"), ("exp", lambda t: t.exp(), "exp(value)"), ("sqrt", lambda t: abs(t).sqrt(), "sqrt(abs(value))"),
    ("tensor", lambda t: t + t, "value + value"), ("clip", lambda t: t.clip(-0.1, 0.1), "least(greatest(value, -0.1), 0.1)"),
):
    cellwise(f"tensor_{_name}" if _name not in ("neg", "pos", "abs", "conj", "exp", "sqrt") else f"unary_{_name}" if _name != "tensor" else "tensor_tensor", _make, _sql)

for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="), ("eq", "=="), ("ne", "!=")):
    cellwise(f"cmp_{_name}", lambda t, op=_op: t.round(1).compare(op, 0.1), f"round_even(value, 1) {'=' if _op == '==' else _op} 0.1", "bool")
cellwise("logical_and_or_xor_not", lambda t: ((t > 0) & ~(t > 0.1)) | ((t < -0.2) ^ (t < -0.1)), "((value > 0) AND NOT (value > 0.1)) OR ((value < -0.2) <> (value < -0.1))", "bool")

for _name, _make, _sql in (
    ("bitwise_and", lambda t: t & 12, "p_size & 12"), ("bitwise_or", lambda t: t | 5, "p_size | 5"), ("bitwise_xor", lambda t: t ^ 9, "xor(p_size, 9)"),
    ("bitwise_not", lambda t: ~t, "~p_size"), ("shift_left", lambda t: t << 3, "p_size << 3"), ("shift_right", lambda t: t >> 2, "p_size >> 2"),
):
    add(_name, lambda s, d, make=_make: make(parts(s, d)).df, f"SELECT CAST(p_partkey - 1 AS INTEGER) AS x, CAST({_sql} AS INTEGER) AS value FROM part", cells=False)

# Integers wrap as their dtype does.


def bytes_of(t: TensorFrame) -> TensorFrame:
    return t.apply(lambda v: F.floor((v + 1) * 127).cast("bigint"), "int64").astype("uint8")


_BYTE = "CAST(floor((value + 1) * 127) AS BIGINT) % 256"
for _name, _make, _sql in (
    ("uint8_add", lambda t: t + 250, "(b + 250) % 256"), ("uint8_sub", lambda t: 3 - t, "((3 - b) % 256 + 256) % 256"), ("uint8_mul", lambda t: t * t, "(b * b) % 256"),
    ("uint8_shift", lambda t: t << 1, "(b * 2) % 256"), ("uint8_not", lambda t: ~t, "255 - b"), ("uint8_neg", lambda t: -t, "(256 - b) % 256"), ("uint8_pow", lambda t: t ** 3, "(b * b * b) % 256"),
):
    tensor_query(_name, lambda t, make=_make: make(bytes_of(t)), f"SELECT {AT}, CAST({_sql} AS SMALLINT) AS value FROM (SELECT {AT}, {_BYTE} AS b FROM cells)")
for _name, _make, _sql in (
    ("int32_floordiv", lambda t: (t - 25) // 7, "floor((p_size - 25) / 7.0)"), ("int32_mod", lambda t: (t - 25) % -7, "(p_size - 25) - (-7) * floor((p_size - 25) / -7.0)"),
    ("int32_pow_wraps", lambda t: t ** 7, "((p_size::HUGEINT ** 7)::HUGEINT + 2147483648) % 4294967296 - 2147483648"), ("int32_mul_wraps", lambda t: t * 2_000_000_000, "((p_size::HUGEINT * 2000000000) + 2147483648) % 4294967296 - 2147483648"),
):
    add(_name, lambda s, d, make=_make: make(parts(s, d)).df, f"SELECT CAST(p_partkey - 1 AS INTEGER) AS x, CAST({_sql} AS INTEGER) AS value FROM part", cells=False)
add("int64_mul_wraps", lambda s, d: (parts(s, d).astype("int64") * 4_000_000_000_000_000_003).df, "SELECT CAST(p_partkey - 1 AS INTEGER) AS x, CAST((p_size::HUGEINT * 4000000000000000003 + 9223372036854775808) % 18446744073709551616 - 9223372036854775808 AS BIGINT) AS value FROM part", cells=False)

tensor_query("argsort", lambda t: t.argsort("x"), f"SELECT vec_id, channel, y, CAST(row_number() OVER (PARTITION BY vec_id, channel, y ORDER BY value, x) - 1 AS INTEGER) AS x, CAST(x AS BIGINT) AS value FROM cells")

# T: selection and shape

tensor_query("slice", lambda t: t[{"y": slice(1, 3), "x": slice(-2, None)}], f"SELECT vec_id, channel, CAST(y - 1 AS INTEGER) AS y, CAST(x - 2 AS INTEGER) AS x, {OUT} FROM cells WHERE y BETWEEN 1 AND 2 AND x >= 2")
tensor_query("slice_step", lambda t: t[:, ::2, 3::-2], f"SELECT vec_id, channel, CAST(y // 2 AS INTEGER) AS y, CAST((3 - x) // 2 AS INTEGER) AS x, {OUT} FROM cells WHERE y % 2 = 0 AND x IN (1, 3)")
tensor_query("index", lambda t: t[{"channel": 2}], f"SELECT vec_id, y, x, {OUT} FROM cells WHERE channel = 2")
for _where, _start in (("left", 1), ("right", 0), ("both", 0)):
    tensor_query(f"crop_{_where}", lambda t, w=_where: t.crop_to({"y": 3, "x": 3}, w), f"SELECT vec_id, channel, CAST(y - {_start} AS INTEGER) AS y, CAST(x - {_start} AS INTEGER) AS x, {OUT} FROM cells WHERE y BETWEEN {_start} AND {_start + 2} AND x BETWEEN {_start} AND {_start + 2}")
tensor_query("mask_select", lambda t: t[t > 0.1], f"SELECT {AT}, {OUT} FROM cells WHERE value > 0.1")
tensor_query("mask_assign", lambda t: t.where(t < 0, 0.0), f"SELECT {AT}, round(CASE WHEN value < 0 THEN 0.0 ELSE value END, 6) + 0.0 AS value FROM cells")
tensor_query("slice_assign", lambda t: t.assign(t[{"y": slice(0, 2)}] * 10, {"y": (2, 4)}), f"SELECT {', '.join('a.' + c for c in AT.split(', '))}, round(coalesce(b.value * 10, a.value), 6) + 0.0 AS value FROM cells a LEFT JOIN cells b ON a.vec_id = b.vec_id AND a.channel = b.channel AND a.x = b.x AND b.y = a.y - 2 AND a.y >= 2")
tensor_query("transpose", lambda t: t.transpose(("x", "batch", "y", "channel")), f"SELECT vec_id, x, CAST(0 AS INTEGER) AS batch, y, channel, {OUT} FROM cells")
tensor_query("expand_dims", lambda t: t.expand_dims({"time": 2}), f"SELECT vec_id, CAST(time AS INTEGER) AS time, channel, y, x, {OUT} FROM cells, range(2) AS r(time)")
tensor_query("broadcast_binary", lambda t: t - t.mean(("y", "x")), f"SELECT {AT}, round(value - avg(value) OVER (PARTITION BY vec_id, channel), 6) + 0.0 AS value FROM cells")
tensor_query("item", lambda t: t[{"channel": 1, "y": 2, "x": 3}], f"SELECT vec_id, {OUT} FROM cells WHERE channel = 1 AND y = 2 AND x = 3")
tensor_query("packed", lambda t: t.packed().select("vec_id", "dims", "shape", "dtype", F.transform("data", lambda v: F.round(v, 6) + F.lit(0.0)).alias("data")), "SELECT vec_id, ['channel', 'y', 'x'] AS dims, [4, 4, 4]::INTEGER[] AS shape, 'float64' AS dtype, list(round(value, 6) + 0.0 ORDER BY channel, y, x) AS data FROM cells GROUP BY vec_id")
_PAD = {
    "edge": "least(greatest(p, 0), 3)",
    "symmetric": "CASE WHEN ((p % 8) + 8) % 8 < 4 THEN ((p % 8) + 8) % 8 ELSE 7 - ((p % 8) + 8) % 8 END",
    "reflect": "CASE WHEN ((p % 6) + 6) % 6 < 4 THEN ((p % 6) + 6) % 6 ELSE 6 - ((p % 6) + 6) % 6 END",
}
for _mode, _map in _PAD.items():
    tensor_query(f"pad_{_mode}", lambda t, m=_mode: t.pad({"x": (6, 7)}, m), f"SELECT vec_id, channel, y, CAST(p + 6 AS INTEGER) AS x, {OUT} FROM cells JOIN (SELECT p, {_map} AS s FROM (SELECT unnest(range(-6, 11)) AS p)) ON s = x")
tensor_query("resize_to", lambda t: t.resize_to({"y": 2, "x": 6, "time": 2}), f"SELECT vec_id, CAST(time AS INTEGER) AS time, channel, CAST(y - 1 AS INTEGER) AS y, CAST(p + 1 AS INTEGER) AS x, {OUT} FROM cells JOIN (SELECT p, {_PAD['symmetric']} AS s FROM (SELECT unnest(range(-1, 5)) AS p)) ON s = x, range(2) AS r(time) WHERE y IN (1, 2)")

# A: reductions and measures

_AGG = {"mean": "avg(value)", "sum": "sum(value)", "var": "var_pop(value)", "std": "stddev_pop(value)"}
for _name, _sql in _AGG.items():
    tensor_query(f"reduce_{_name}", lambda t, n=_name: getattr(t, n)("channel"), f"SELECT vec_id, y, x, round({_sql}, 6) + 0.0 AS value FROM cells GROUP BY vec_id, y, x")
for _name in ("mean", "var", "std"):
    tensor_query(f"sample_{_name}", lambda t, n=_name: M.compute([m := M.Measure("sample", n, "raw", ("y", "x"))], {"raw": t}).value(m), f"SELECT vec_id, channel, round({_AGG[_name]}, 6) + 0.0 AS value FROM cells GROUP BY vec_id, channel")
    tensor_query(f"dataset_{_name}", lambda t, n=_name: M.compute([m := M.Measure("dataset", n, "raw", ("batch", "y", "x"))], {"raw": t}).value(m), f"SELECT channel, round({_AGG[_name]}, 6) + 0.0 AS value FROM cells GROUP BY channel")
    tensor_query(f"dataset_{_name}_scalar", lambda t, n=_name: M.compute([m := M.Measure("dataset", n, "raw")], {"raw": t}).value(m), f"SELECT round({_AGG[_name]}, 6) + 0.0 AS value FROM cells")
tensor_query("quantile_list", lambda t: t.quantile([0.0, 0.25, 1.0], ("y", "x")), "SELECT vec_id, CAST(q - 1 AS INTEGER) AS quantile, channel, round(v, 6) + 0.0 AS value FROM (SELECT vec_id, channel, unnest(quantile_cont(value, [0.0, 0.25, 1.0])) AS v, unnest([1, 2, 3]) AS q FROM cells GROUP BY vec_id, channel)")
for _method, _sql in (("linear", "quantile_cont"), ("inverted_cdf", "quantile_disc")):
    tensor_query(f"sample_quantile_{_method}", lambda t, w=_method: M.compute([m := M.sample_quantile(0.3, "raw", ("y", "x"), w)], {"raw": t}).value(m), f"SELECT vec_id, channel, round({_sql}(value, 0.3), 6) + 0.0 AS value FROM cells GROUP BY vec_id, channel")
_Q = M.dataset_quantile(0.9, "raw", ("batch", "y", "x"))
tensor_query("dataset_quantile_exact", lambda t: M.compute([_Q], {"raw": t}).value(_Q), "SELECT channel, round(quantile_cont(value, 0.9), 6) + 0.0 AS value FROM cells GROUP BY channel")
tensor_query("dataset_quantile_mean_of_samples", lambda t: M.compute([_Q], {"raw": t}, "mean").value(_Q), "SELECT channel, round(sum(n * q) / sum(n), 6) + 0.0 AS value FROM (SELECT vec_id, channel, count(*) AS n, quantile_cont(value, 0.9) AS q FROM cells GROUP BY vec_id, channel) GROUP BY channel")
for _kind in ("approx", "kll"):
    add(f"dataset_quantile_{_kind}", lambda s, d, k=_kind: rounded(M.compute([_Q], {"raw": embeddings(s, d)}, k).value(_Q)))
tensor_query("argmax", lambda t: t.argmax(), "SELECT vec_id, channel, y, x FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, channel, y, x) AS r FROM cells) WHERE r = 1")


def _fused(t: TensorFrame) -> DataFrame:
    wanted = [M.Measure("dataset", n, "raw", ("batch", "y", "x")) for n in ("mean", "var", "std")] + [M.dataset_quantile(q, "raw", ("batch", "y", "x")) for q in (0.0, 0.5, 1.0)]
    (own,) = M.compute(wanted, {"raw": t}).tables
    names = {m: m.name if m.q is None else f"q{round(m.q * 100)}" for m in wanted}
    return own.df.select("channel", *[F.col(own.columns[m]).alias(n) for m, n in names.items()])


tensor_query("fused_measures", _fused, "SELECT channel, round(avg(value), 6) + 0.0 AS mean, round(var_pop(value), 6) + 0.0 AS var, round(stddev_pop(value), 6) + 0.0 AS std, round(min(value), 6) + 0.0 AS q0, round(quantile_cont(value, 0.5), 6) + 0.0 AS q50, round(max(value), 6) + 0.0 AS q100 FROM cells GROUP BY channel")
tensor_query("member_shape", lambda t: replace(t, known=None).df.agg(*[(F.max(d) + 1).cast("int").alias(d) for d in t.dims]), "SELECT CAST(max(channel) + 1 AS INTEGER) AS channel, CAST(max(y) + 1 AS INTEGER) AS y, CAST(max(x) + 1 AS INTEGER) AS x FROM cells")
tensor_query("last_sample_measures", lambda t: M.compute([m := M.sample_mean("raw")], {"raw": t}).value(m).df.orderBy(F.desc("vec_id")).limit(1), "SELECT vec_id, round(avg(value), 6) + 0.0 AS value FROM cells GROUP BY vec_id ORDER BY vec_id DESC LIMIT 1")

# O: processing

_MEAN, _STD = "avg(value) OVER (PARTITION BY vec_id, channel)", "stddev_pop(value) OVER (PARTITION BY vec_id, channel)"
_YX = ("y", "x")


def _zmuv_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of one sample are computed within its row: a scan and a projection, no exchange."""
    data = P.packed_zero_mean_unit_variance(F.col("embedding").cast("array<double>"), SHAPE, kept=1)
    packed = table(spark, sf_dir, "embeddings").select("vec_id", data.alias("data"))
    return rounded(TensorFrame.from_packed(packed, "data", DIMS, SHAPE, KEYS))


_ZMUV = f"SELECT {AT}, round((value - {_MEAN}) / ({_STD} + 1e-6), 6) + 0.0 AS value FROM cells"
add("zmuv_sample_channel", _zmuv_packed, _ZMUV)
processed("zmuv_sample_cells", lambda: P.ZeroMeanUnitVariance("raw", "raw", M.sample_mean("raw", _YX), M.sample_std("raw", _YX)), _ZMUV)
processed("zmuv_dataset", lambda: P.ZeroMeanUnitVariance("raw", "raw"), f"SELECT {AT}, round((value - avg(value) OVER ()) / (stddev_pop(value) OVER () + 1e-6), 6) + 0.0 AS value FROM cells")
processed("zmuv_dataset_channel", lambda: P.ZeroMeanUnitVariance("raw", "raw", M.dataset_mean("raw", ("batch", "y", "x")), M.dataset_std("raw", ("batch", "y", "x"))), f"SELECT {AT}, round((value - avg(value) OVER (PARTITION BY channel)) / (stddev_pop(value) OVER (PARTITION BY channel) + 1e-6), 6) + 0.0 AS value FROM cells")
processed("fixed_zmuv", lambda: P.FixedZeroMeanUnitVariance("raw", "raw", 0.01, 0.2), f"SELECT {AT}, round((value - 0.01) / (0.2 + 1e-6), 6) + 0.0 AS value FROM cells")
processed("fixed_zmuv_axis", lambda: P.FixedZeroMeanUnitVariance("raw", "raw", [0.01, 0.02, 0.03, 0.04], [0.1, 0.2, 0.3, 0.4], "channel"), f"SELECT {AT}, round((value - 0.01 * (channel + 1)) / (0.1 * (channel + 1) + 1e-6), 6) + 0.0 AS value FROM cells")
processed("binarize", lambda: P.Binarize("raw", "raw", 0.05), f"SELECT {AT}, value > 0.05 AS value FROM cells")
processed("binarize_axis", lambda: P.Binarize("raw", "raw", [-0.1, 0.0, 0.1, 0.2], "channel"), f"SELECT {AT}, value > (CASE channel WHEN 0 THEN -0.1 WHEN 1 THEN 0.0 WHEN 2 THEN 0.1 ELSE 0.2 END) AS value FROM cells")
processed("clip_values", lambda: P.Clip("raw", "raw", -0.05, 0.2), f"SELECT {AT}, round(least(greatest(value, -0.05), 0.2), 6) + 0.0 AS value FROM cells")
processed("clip_quantile_sample", lambda: P.get_proc({"id": "clip", "kwargs": {"min_percentile": 30, "max_percentile": 70, "axes": ("x",)}}, "raw"), f"SELECT {', '.join('c.' + k for k in AT.split(', '))}, round(least(greatest(value, lo), hi), 6) + 0.0 AS value FROM cells c JOIN (SELECT vec_id, channel, y, quantile_disc(value, 0.3) AS lo, quantile_disc(value, 0.7) AS hi FROM cells GROUP BY ALL) q ON c.vec_id = q.vec_id AND c.channel = q.channel AND c.y = q.y")
processed("clip_quantile_dataset", lambda: P.Clip("raw", "raw", M.dataset_quantile(0.1, "raw"), M.dataset_quantile(0.9, "raw")), f"SELECT {AT}, round(least(greatest(value, lo), hi), 6) + 0.0 AS value FROM cells, (SELECT quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM cells)")
processed("scale_linear", lambda: P.ScaleLinear("raw", "raw", 2.0, 1.0), f"SELECT {AT}, round(value * 2 + 1, 6) + 0.0 AS value FROM cells")
processed("scale_linear_axis", lambda: P.ScaleLinear("raw", "raw", [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 42.0, 0.0], "channel"), f"SELECT {AT}, round(value * (channel + 1) + (CASE channel WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 42 ELSE 0 END), 6) + 0.0 AS value FROM cells")
processed("scale_mean_variance", lambda: P.ScaleMeanVariance("raw", "raw", _YX, "ref"), f"SELECT {AT}, round((value - m) / (s + 1e-6) * (rs + 1e-6) + rm, 6) + 0.0 AS value FROM (SELECT *, {_MEAN} AS m, {_STD} AS s, avg(2 * value + 3) OVER (PARTITION BY vec_id, channel) AS rm, stddev_pop(2 * value + 3) OVER (PARTITION BY vec_id, channel) AS rs FROM cells)", lambda t: {"raw": t, "ref": t * 2.0 + 3.0})
processed("scale_range_dataset", lambda: P.ScaleRange("raw", "raw"), f"SELECT {AT}, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER () + 1e-6), 6) + 0.0 AS value FROM cells")
processed("scale_range_sample", lambda: P.ScaleRange("raw", "raw", M.sample_quantile(0.1, "raw", _YX), M.sample_quantile(0.9, "raw", _YX)), f"SELECT {', '.join('c.' + k for k in AT.split(', '))}, round((value - lo) / (hi - lo + 1e-6), 6) + 0.0 AS value FROM cells c JOIN (SELECT vec_id, channel, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM cells GROUP BY ALL) q ON c.vec_id = q.vec_id AND c.channel = q.channel")
processed("sigmoid", lambda: P.Sigmoid("raw", "raw"), f"SELECT {AT}, round(1 / (1 + exp(-value)), 6) + 0.0 AS value FROM cells")
processed("softmax", lambda: P.Softmax("raw", "raw", "channel"), f"SELECT {AT}, round(exp(value) / sum(exp(value)) OVER (PARTITION BY vec_id, y, x), 6) + 0.0 AS value FROM cells")
for _kind, _sql in (("uint8", "CAST(((trunc(value * 1000)::BIGINT % 256) + 256) % 256 AS SMALLINT)"), ("int8", "CAST(((trunc(value * 1000)::BIGINT + 128) % 256 + 256) % 256 - 128 AS TINYINT)"), ("int32", "CAST(trunc(value * 1000) AS INTEGER)"), ("bool", "trunc(value * 1000) <> 0")):
    processed(f"ensure_dtype_{_kind}", lambda k=_kind: P.EnsureDtype("raw", "raw", k), f"SELECT {AT}, {_sql} AS value FROM cells", lambda t: {"raw": t.apply(lambda v: F.when(v >= 0, F.floor(v * 1000)).otherwise(F.ceil(v * 1000)).cast("double"))})

# B: tiles


def _tiles(halo: int, stride: int | None = None, block: int = 3) -> list[T.Tile]:
    return T.split_shape(dict(zip(DIMS, SHAPE, strict=True)), {"y": block, "x": block}, {"y": halo, "x": halo}, {"y": stride, "x": stride} if stride else None)


def _tile_sql(block: int, halo: int) -> str:
    inner = block - 2 * halo
    n = -(-4 // inner)
    lo = f"least({inner} * {{0}}, {4 - inner})"
    return f"SELECT '' AS member, CAST(i * {n} + j AS INTEGER) AS block_index, CAST({n * n} AS INTEGER) AS blocks_in_sample, CAST({lo.format('i')} AS INTEGER) AS y_in_start, CAST({lo.format('j')} AS INTEGER) AS x_in_start, CAST(greatest(0, {lo.format('i')} - {halo}) AS INTEGER) AS y_out_start, CAST(least(4, {lo.format('j')} + {inner + halo}) AS INTEGER) AS x_out_stop FROM range({n}) AS a(i), range({n}) AS b(j)"


for _name, _block, _halo in (("tiles", 3, 0), ("tiles_halo", 4, 1)):
    add(_name, lambda s, d, b=_block, h=_halo: T.tile_table(s, _tiles(h, None, b)).select("member", "block_index", "blocks_in_sample", "y_in_start", "x_in_start", "y_out_start", "x_out_stop"), _tile_sql(_block, _halo), cells=False)
# Tile cells with a halo of 1 and reflect padding: tile t starts at 2 * t - 1, position p of 4 maps to |s| or 6 - s.
_TILE = """WITH+tiled AS (SELECT vec_id, CAST(2 * i + j AS INTEGER) AS block_index, channel, CAST(p AS INTEGER) AS y, CAST(q AS INTEGER) AS x, value, i, j
 FROM range(2) AS a(i), range(2) AS b(j), range(4) AS c(p), range(4) AS d(q), cells
 WHERE cells.y = (CASE WHEN 2 * i - 1 + p > 3 THEN 6 - (2 * i - 1 + p) ELSE abs(2 * i - 1 + p) END) AND cells.x = (CASE WHEN 2 * j - 1 + q > 3 THEN 6 - (2 * j - 1 + q) ELSE abs(2 * j - 1 + q) END))"""
tensor_query("tile_cells", lambda t: T.split(t, _tiles(1, None, 4), "reflect"), f"{_TILE} SELECT vec_id, block_index, channel, y, x, {OUT} FROM tiled")
tensor_query("stitch", lambda t: T.stitch(T.split(t, tiles := _tiles(1, None, 4), "reflect"), tiles), f"SELECT {AT}, {OUT} FROM cells")


def _marked(t: TensorFrame) -> TensorFrame:
    """Overlapping tiles (3 of 4 per axis), each with its index added, so that the winner shows."""
    tiles = _tiles(0, None, 3)
    blocks = T.split(t, tiles)
    return T.stitch(replace(blocks, df=blocks.df.withColumn(V, F.col(V) + F.col("block_index"))), tiles, fill=float("nan"))


tensor_query("stitch_overlap", _marked, f"SELECT {AT}, round(value + (CASE WHEN y >= 1 THEN 2 ELSE 0 END) + (CASE WHEN x >= 1 THEN 1 ELSE 0 END), 6) + 0.0 AS value FROM cells")


def _multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = embeddings(spark, sf_dir)
    small = t[{"channel": slice(0, 1)}]
    tiles = T.split_shapes({"raw": t.sizes, "one": small.sizes}, {"raw": {"y": 2}, "one": {}}, broadcast=True)
    a, b = (T.split(x, [own[m] for own in tiles]) for m, x in (("raw", t), ("one", small)))
    n = lambda x, m: x.df.groupBy("block_index").agg(F.count("*").alias(f"{m}_cells"), (F.round(F.sum(V), 6) + F.lit(0.0)).alias(f"{m}_sum"))
    return n(a, "raw").join(n(b, "one"), "block_index")


add("multi_member_tiles", _multi, "SELECT CAST(y // 2 AS INTEGER) AS block_index, count(*) AS raw_cells, round(sum(value), 6) + 0.0 AS raw_sum, (SELECT count(*) FROM cells WHERE channel = 0) AS one_cells, (SELECT round(sum(value), 6) + 0.0 FROM cells WHERE channel = 0) AS one_sum FROM cells GROUP BY y // 2")

# R: running, frozen, fixed and streamed statistics


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _stats(df: DataFrame, *columns: str) -> DataFrame:
    """Rounded a little off exact halves, which both sides can miss by an ulp."""
    return df.select(*columns, *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean", "var")])


add("running_stats", lambda s, d: _stats(running.running_statistics(_events(s, d).select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"]), "event_id", "n"), """SELECT event_id, n, round(mean + 1e-9, 4) AS mean, round(var + 1e-9, 4) AS var FROM (SELECT event_id,
 count(*) OVER w AS n, avg(value) OVER w AS mean, var_pop(value) OVER w AS var FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", cells=False)


def _frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the first half of the samples, applied to the second."""
    t = embeddings(spark, sf_dir)
    first = replace(t, df=t.df.where("vec_id % 2 = 0"))
    second = replace(t, df=t.df.where("vec_id % 2 = 1"))
    calculator = M.StatsCalculator([M.dataset_mean("raw"), M.dataset_std("raw")])
    calculator.update({"raw": first})
    frozen = M.StatsCalculator(calculator.measures, calculator.finalize())
    step = P.ZeroMeanUnitVariance("raw", "raw")
    return rounded(step({"raw": second}, P.UpdateStats(frozen)({"raw": second}))["raw"])


add("frozen_stats", _frozen, f"SELECT {AT}, round((value - m) / (s + 1e-6), 6) + 0.0 AS value FROM cells, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM cells WHERE vec_id % 2 = 0) WHERE vec_id % 2 = 1")


def _frozen_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all samples, applied to all samples of a second, scaled member."""
    t = embeddings(spark, sf_dir)
    calculator = M.StatsCalculator([M.dataset_mean("raw"), M.dataset_std("raw")])
    calculator.update({"raw": t})
    frozen = M.StatsCalculator(calculator.measures, calculator.finalize())
    scaled = {"raw": t * 2}
    return rounded(P.ZeroMeanUnitVariance("raw", "raw")(scaled, P.UpdateStats(frozen)(scaled))["raw"])


add("frozen_stats_scaled", _frozen_scaled, f"SELECT {AT}, round((2 * value - m) / (s + 1e-6), 6) + 0.0 AS value FROM cells, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM cells)")


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = M.Stat([M.StatTable(spark.createDataFrame([(0.25, 0.5)], "_m double, _s double"), (), (), {M.dataset_mean("raw"): "_m", M.dataset_std("raw"): "_s"})])
    pipeline = PredictionPipeline(FunctionModel(lambda x: x), {}, [P.ZeroMeanUnitVariance("raw", "raw")], fixed=given)
    return rounded(pipeline.apply_preprocessing({"raw": embeddings(spark, sf_dir)})["raw"])


add("fixed_stats", _fixed, f"SELECT {AT}, round((value - 0.25) / (0.5 + 1e-6), 6) + 0.0 AS value FROM cells")


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States per user and type, merged by type: the same as in one pass."""
    states = running.partials(_events(spark, sf_dir), ["event_type", "user_id"])
    return _stats(running.merged(states, ["event_type"]), "event_type", "n")


_EVENT_STATS = "SELECT event_type, count(*) AS n, round(avg(value) + 1e-9, 4) AS mean, round(var_pop(value) + 1e-9, 4) AS var FROM events GROUP BY event_type"
add("merged_partial_stats", _merged, "SELECT event_type, CAST(n AS BIGINT) AS n, mean, var FROM (" + _EVENT_STATS + ")", cells=False)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"stream_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp()}"
    schema = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")  # a file, or a folder of part files
    return _stats(running.stream_statistics(stream, ["event_type"], "value", name, f"{folder}/{name}"), "event_type", "n")


add("streaming_stats", _streamed, _EVENT_STATS, cells=False)

# V, L: comparison and prediction


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = embeddings(spark, sf_dir)
    off = replace(t, df=t.df.withColumn(V, F.col(V) + F.when(F.col("vec_id") % 7 == 0, 0.01).otherwise(1e-7)))
    return rounded(checking.mismatches(off, t, checking.Tolerance(1e-3, 1e-3))).select("cells", "mismatched", "ppm", "max_abs")


add("compare_outputs", _compare, "SELECT count(*) AS cells, count(*) FILTER (abs(a - value) > 1e-3 + 1e-3 * abs(value)) AS mismatched, round(count(*) FILTER (abs(a - value) > 1e-3 + 1e-3 * abs(value)) / count(*) * 1e6, 6) + 0.0 AS ppm, round(max(abs(a - value)), 6) + 0.0 AS max_abs FROM (SELECT value, value + (CASE WHEN vec_id % 7 = 0 THEN 0.01 ELSE 1e-7 END) AS a FROM cells)")


def mean_filter(x: np.ndarray) -> np.ndarray:
    """The mean of 3 x 3 neighbours over the last two axes, reflected at the edges."""
    wide = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(1, 1), (1, 1)], mode="reflect")
    h, w = x.shape[-2:]
    return sum(wide[..., i : i + h, j : j + w] for i in range(3) for j in range(3)) / 9


def _pipeline() -> PredictionPipeline:
    return PredictionPipeline(FunctionModel(mean_filter), {"output": Output(DIMS)}, [P.ScaleLinear("input", "input", 2.0, 1.0)], [P.Sigmoid("output", "output")])


_AROUND = """WITH+around AS (SELECT c.vec_id, c.channel, c.y, c.x, avg(2 * n.value + 1) AS value FROM cells c, range(-1, 2) AS a(i), range(-1, 2) AS b(j), cells n
 WHERE n.vec_id = c.vec_id AND n.channel = c.channel AND n.y = (CASE WHEN c.y + i > 3 THEN 6 - c.y - i ELSE abs(c.y + i) END) AND n.x = (CASE WHEN c.x + j > 3 THEN 6 - c.x - j ELSE abs(c.x + j) END) GROUP BY ALL)"""
_PREDICTED = f"{_AROUND} SELECT {AT}, round(1 / (1 + exp(-value)), 6) + 0.0 AS value FROM around"
tensor_query("predict_local_model", lambda t: _pipeline().predict({"input": t})["output"], _PREDICTED)
tensor_query("predict_blockwise", lambda t: _pipeline().predict_blockwise({"input": t}, {"y": 4, "x": 4}, {"y": 1, "x": 1})["output"], _PREDICTED)
tensor_query("preprocess_pipeline", lambda t: PredictionPipeline(FunctionModel(mean_filter), {}, [P.Clip("raw", "raw", -0.2, 0.2), P.EnsureDtype("raw", "raw", "float32"), P.ScaleLinear("raw", "raw", 2.0, 1.0)]).apply_preprocessing({"raw": t})["raw"], f"SELECT {AT}, round(CAST(CAST(least(greatest(value, -0.2), 0.2) AS FLOAT) * 2 + 1 AS FLOAT)::DOUBLE, 6) + 0.0 AS value FROM cells")
tensor_query("union_members", lambda t: union_members({"raw": t, "twice": t * 2}).groupBy("member").agg(F.count("*").alias("cells"), F.avg(V).alias("mean")), "SELECT member, count(*) AS cells, round(avg(value), 6) + 0.0 AS mean FROM (SELECT 'raw' AS member, value FROM cells UNION ALL SELECT 'twice', 2 * value FROM cells) GROUP BY member")
tensor_query("dtype_wrap_uint64", lambda t: t.apply(lambda v: F.floor(v * 1000).cast("bigint"), "int64").astype("uint64").df.select(*t.keys, *t.dims, F.col(V).cast("string").alias(V)), f"SELECT {AT}, CAST(CASE WHEN floor(value * 1000) < 0 THEN 18446744073709551616::HUGEINT + floor(value * 1000)::HUGEINT ELSE floor(value * 1000)::HUGEINT END AS VARCHAR) AS value FROM cells")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
