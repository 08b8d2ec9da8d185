"""Frames, operators, tiles and files against numpy and hand-made values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import axes, checking, cli
from lattica.frame import TensorFrame
from lattica.operators import processing as P
from lattica.operators import tiling as T
from lattica.operators.padding import sources
from lattica.plans import measures as M
from lattica.plans.pipeline import FunctionModel, Output, PredictionPipeline, create_model, predict_many
from lattica.sources import arrays, statistics


def tensor(spark, array, dims):
    return TensorFrame.from_numpy(spark, np.asarray(array), dims)


def run(step, member, stat=None):
    own = {"data": member}
    return step(own, stat or M.compute(step.required_measures, own))["data"].to_numpy()


def test_axes():
    assert axes.guess_dims((4, 5)) == ("y", "x") and axes.guess_dims((3, 9, 9)) == ("channel", "y", "x") and axes.guess_dims((64, 64, 64)) == ("z", "y", "x")
    assert axes.Axis.create("b") == axes.Axis("batch", "batch") and axes.axis_kind("t") == "time"
    assert axes.match_dims((5, 6), ("x", "y"))[0] == (0, 1)
    with pytest.raises(ValueError):
        axes.axis_kind("q")
    with pytest.raises(ValueError):
        axes.guess_dims((1,) * 6)


def test_numpy_round_trip_and_elementwise(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((2, 3, 4)), rng.standard_normal((3, 4))
    x, y = tensor(spark, a, ("channel", "y", "x")), tensor(spark, b, ("y", "x"))
    assert np.array_equal(x.to_numpy(), a)
    assert np.allclose((x * y - 2).to_numpy(), a * b - 2)
    assert np.allclose((x // 0.3).to_numpy(), a // 0.3) and np.allclose((x % -0.3).to_numpy(), a % -0.3)
    assert np.array_equal((x > y).to_numpy(), a > b)
    assert np.array_equal(x.argsort("x").to_numpy(), a.argsort(-1, kind="stable"))


def test_nan_follows_arrays(spark):
    a = np.array([math.nan, 1.0, -2.0])
    x = tensor(spark, a, ("x",))
    assert x.compare(">", 0).to_numpy().tolist() == [False, True, False] and x.compare("!=", x).to_numpy().tolist() == [True, False, False]
    assert (x / 0.0).to_numpy()[1:].tolist() == [math.inf, -math.inf] and x.mean().item() == -0.5
    assert math.isnan(x.clip(0, 1).to_numpy()[0])


@pytest.mark.parametrize("dtype", ["uint8", "int8", "uint16", "int32", "uint32", "int64", "uint64", "float32", "bool"])
def test_casts_wrap_as_arrays_do(spark, dtype):
    a = np.array([300.7, -1.2, 255.0, -256.0, 0.0])
    wanted = a.astype(np.int64).astype(dtype) if dtype not in ("float32", "bool") else a.astype(dtype)
    found = tensor(spark, a, ("x",)).astype(dtype).to_numpy()
    assert [type(w)(f) for f, w in zip(found.tolist(), wanted.tolist(), strict=True)] == wanted.tolist()


def test_shapes(spark):
    a = np.arange(24.0).reshape(2, 3, 4)
    x = tensor(spark, a, ("channel", "y", "x"))
    assert np.array_equal(x[0, 1:, ::-1].to_numpy(), a[0, 1:, ::-1]) and np.array_equal(x[..., 2].to_numpy(), a[..., 2])
    assert x.transpose(("x", "batch", "channel", "y")).shape == (4, 1, 2, 3)
    for mode, name in (("edge", "edge"), ("reflect", "reflect"), ("symmetric", "symmetric")):
        assert np.array_equal(x.pad({"x": (6, 7), "y": 1}, mode).to_numpy(), np.pad(a, ((0, 0), (1, 1), (6, 7)), mode=name))
    assert np.array_equal(x.pad({"x": 3}).crop_to({"x": 4}).to_numpy(), a)
    assert x.resize_to({"y": 5, "x": 2, "time": 2}).shape == (2, 2, 5, 2)
    assert sources(1, 2, 2, "reflect").tolist() == [0] * 5
    with pytest.raises(ValueError):
        x + tensor(spark, np.zeros(3), ("x",))
    with pytest.raises(IndexError):
        x[5]


def test_reductions_and_quantiles(spark):
    a = np.random.default_rng(1).standard_normal((3, 4, 5))
    x = tensor(spark, a, ("channel", "y", "x"))
    assert np.allclose(x.var(("y", "x")).to_numpy(), a.var((1, 2))) and np.allclose(x.std().item(), a.std()) and np.allclose(x.sum("y").to_numpy(), a.sum(1))
    for method in ("linear", "inverted_cdf"):
        assert np.allclose(x.quantile([0.0, 0.1, 0.5, 1.0], ("y", "x"), method).to_numpy(), np.quantile(a, [0.0, 0.1, 0.5, 1.0], (1, 2), method=method))
    assert tuple(x.argmax().first()) == np.unravel_index(a.argmax(), a.shape)


def test_golden_processing(spark):
    flat = tensor(spark, np.arange(9.0).reshape(3, 3), ("x", "y"))
    z = run(P.ZeroMeanUnitVariance("data", "data", M.sample_mean("data"), M.sample_std("data")), flat)
    assert np.allclose(z.ravel()[:4], [-1.54919274, -1.16189455, -0.77459637, -0.38729818], rtol=1e-5)
    assert run(P.Clip("data", "data", 3, 5), flat).tolist() == [[3, 3, 3], [3, 4, 5], [5, 5, 5]]
    rows = tensor(spark, np.arange(15.0).reshape(3, 5), ("channel", "x"))
    step = P.get_proc({"id": "clip", "kwargs": {"min_percentile": 30, "max_percentile": 70, "axes": ["x"]}}, "data")
    assert run(step, rows).tolist() == [[1, 1, 2, 3, 3], [6, 6, 7, 8, 8], [11, 11, 12, 13, 13]]
    linear = tensor(spark, np.arange(6.0).reshape(1, 2, 3), ("x", "y", "channel"))
    assert run(P.ScaleLinear("data", "data", [1, 2, 3], [1, 2, 42], "channel"), linear).tolist() == [[[1, 4, 48], [4, 10, 57]]]
    assert run(P.Binarize("data", "data", 4), flat).tolist() == [[False] * 3, [False, False, True], [True] * 3]
    assert P.Sigmoid("other", "other")({"data": flat})["data"] is flat
    for bad in ({}, {"min": 3, "max": 1}):
        with pytest.raises(ValueError):
            P.Clip("data", "data", **bad)


def test_a_reference_sets_mean_and_deviation(spark):
    a = np.random.default_rng(2).standard_normal((3, 4, 5))
    x = tensor(spark, a, ("channel", "y", "x"))
    own = {"data": x, "ref": x * 2 + 3}
    step = P.ScaleMeanVariance("data", "data", ("y", "x"), "ref")
    assert np.allclose(step(own, M.compute(step.required_measures, own))["data"].to_numpy(), 2 * a + 3, atol=1e-4)


def test_measures_check_their_axes_and_share_aggregations():
    with pytest.raises(ValueError):
        M.sample_mean("m", ("batch",))
    with pytest.raises(ValueError):
        M.dataset_mean("m", ("x",))
    groups = M.plan([M.sample_mean("m"), M.sample_std("m"), M.sample_mean("m"), M.dataset_mean("m")])
    assert sorted(map(len, groups.values())) == [1, 2]


def test_parts_give_the_statistics_of_the_whole(spark):
    a = np.random.default_rng(3).standard_normal((4, 10))
    parts = [TensorFrame.from_numpy(spark, row, ("x",), i) for i, row in enumerate(a)]
    calculator = M.StatsCalculator([M.dataset_var("m"), M.dataset_quantile(0.3, "m")])
    for part in parts:
        calculator.update({"m": part})
    stat = calculator.finalize()
    assert np.isclose(stat.value(M.dataset_var("m")).item(), a.var()) and np.isclose(stat.value(M.dataset_quantile(0.3, "m")).item(), np.quantile(a, 0.3))


def test_tiles():
    assert [t.inner_slice["x"] for t in T.split_shape({"x": 10}, {"x": 4})] == [(0, 4), (4, 8), (6, 10)]
    tile = T.split_shape({"x": 10}, {"x": 6}, {"x": 1})[0]
    assert (tile.outer_slice["x"], tile.padding["x"], tile.local_slice["x"]) == ((0, 5), (1, 0), (1, 5))
    moved = tile.get_transformed({"x": T.LinearAxisTransform("x", 2, 0), "channel": 3})
    assert moved.inner_slice == {"x": (0, 8), "channel": (0, 3)} and moved.halo["x"] == (2, 2)
    with pytest.raises(ValueError):
        T.split_shape({"x": 3}, {"x": 4})
    with pytest.raises(ValueError):
        T.split_shapes({"a": {"x": 4}, "b": {"x": 4}}, {"a": {"x": 2}, "b": {}})
    assert T.input_halo({"x": 4}, {"x": ("y", 2)}) == {"y": (2, 2)}


@pytest.mark.parametrize("halo", [0, 1])
def test_split_and_stitch(spark, halo):
    a = np.random.default_rng(4).standard_normal((2, 7, 5))
    x = tensor(spark, a, ("channel", "y", "x"))
    tiles = T.split_shape(x.sizes, {"y": 4, "x": 4}, {"y": halo, "x": halo})
    blocks = T.split(x, tiles, "reflect")
    assert np.array_equal(T.stitch(blocks, tiles).to_numpy(), a)
    wide = np.pad(a, ((0, 0), (halo, halo), (halo, halo)), mode="reflect")
    own = blocks.to_numpy()
    for t in tiles:
        y, x0 = t.inner_slice["y"][0], t.inner_slice["x"][0]
        assert np.array_equal(own[t.block_index], wide[:, y : y + 4, x0 : x0 + 4])


def test_whole_equals_blockwise(spark):
    from lattica.catalog import mean_filter

    a = np.random.default_rng(5).standard_normal((1, 9, 8))
    pipeline = PredictionPipeline(FunctionModel(mean_filter), {"output": Output(("channel", "y", "x"))})
    x = tensor(spark, a, ("channel", "y", "x"))
    whole = pipeline.predict({"input": x})["output"].to_numpy()
    assert np.allclose(whole, mean_filter(a))
    assert np.allclose(pipeline.predict_blockwise({"input": x}, {"y": 5, "x": 5}, {"y": 1, "x": 1})["output"].to_numpy(), whole)
    with pytest.raises(TypeError):
        next(predict_many(pipeline, {"input": x}))
    with pytest.raises(ValueError):
        create_model({"torchscript": b""}, ["i"], ["o"])


def test_comparison(spark):
    a = np.array([1.0, 2.0, math.nan])
    x = tensor(spark, a, ("x",))
    assert checking.check_outputs({"m": x}, {"m": x}).status == "passed"
    assert checking.check_outputs({"m": x + 1.0}, {"m": x}).status == "failed"
    assert checking.mismatches(tensor(spark, np.array([1.0, math.nan, math.nan]), ("x",)), x).first()["mismatched"] == 1
    assert checking.check_outputs({}, {"m": x}).status == "failed" and checking.Tolerance.of_decimal(4).atol == pytest.approx(1.5e-4)


@pytest.mark.parametrize("shape", [(4, 5), (3, 4, 5), (1, 4, 5), (5, 4, 3)])
def test_files(spark, tmp_path, shape):
    a = np.arange(np.prod(shape), dtype=np.uint8).reshape(shape)
    assert np.array_equal(arrays.read_npy(arrays.write_npy(a)), a) and np.array_equal(arrays.read_npy(arrays.write_npy(np.asfortranarray(a))), a)
    path = str(tmp_path / "t.npy")
    arrays.save_tensor(path, TensorFrame.from_numpy(spark, a))
    found = arrays.load_tensor(spark, path)
    assert found.dtype == "uint8" and np.array_equal(found.to_numpy(), a)


def test_statistics_files_and_names(spark, tmp_path):
    x = tensor(spark, np.arange(12.0).reshape(3, 4), ("channel", "x"))
    wanted = [M.dataset_mean("m"), M.dataset_quantile(0.5, "m", ("batch", "x"))]
    statistics.save_dataset_stat(M.compute(wanted, {"m": x}), tmp_path / "s.json")
    found = statistics.load_dataset_stat(spark, tmp_path / "s.json")
    assert found.value(wanted[0]).item() == 5.5 and found.value(wanted[1]).to_numpy().tolist() == [1.5, 5.5, 9.5]
    with pytest.raises(ValueError):
        statistics.cached_dataset_stat(spark, {M.dataset_var("m")}, tmp_path / "s.json", None)
    assert arrays.sample_ids([["a/im_01_raw.npy"], ["a/im_02_raw.npy"]]) == ["1", "2"]
    assert arrays.member_path("o/{sample_id}/{member_id}.npy", "7", "raw") == "o/7/raw.npy"


def test_command_line(tmp_path, capsys):
    (tmp_path / "d.json").write_text('{"inputs": [{"id": "a", "processing": [{"id": "none"}]}], "outputs": [], "model": "m:f"}')
    assert cli.main(["validate", str(tmp_path / "d.json")]) == 1
    assert cli.main(["compare", str(tmp_path / "d.json"), str(tmp_path / "d.json")]) == 0
    assert cli.main(["package", str(tmp_path / "p.zip"), str(tmp_path / "d.json")]) == 0 and (tmp_path / "p.zip").exists()
    assert "unknown" not in capsys.readouterr().out


def test_running_statistics_keep_precision(spark):
    from lattica.streaming.running import merged, partials, running_statistics

    rng = np.random.default_rng(6)
    v = 1e8 + rng.standard_normal(300) / 8
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "t long, value double").repartition(3)
    rows = running_statistics(df, [], ["t"]).orderBy("t").collect()
    assert np.allclose([r["var"] for r in rows], [v[: i + 1].var() for i in range(300)], atol=1e-6)
    states = partials(df.withColumn("g", F.col("t") % 7), ["g"])
    assert np.isclose(merged(states, []).first()["var"], v.var(), rtol=1e-6)
