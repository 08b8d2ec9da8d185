import numpy as np, pytest
from lattica.frame import TensorFrame
from lattica.operators import padding
from pyspark.sql import functions as F
from lattica.streaming import running

RANGES = {"uint8": [0, 1, 5, 250, 255], "int8": [-128, -7, 0, 3, 127], "int32": [-(2**31), -9, 0, 7, 2**31 - 1], "uint32": [0, 3, 2**32 - 1], "int64": [-(2**63), -11, 0, 5, 2**63 - 1], "uint64": [0, 9, 2**64 - 1], "uint16": [0, 65535, 300], "bool": [True, False]}


@pytest.mark.parametrize("dtype", sorted(RANGES))
def test_integer_arithmetic_equals_numpy(spark, dtype):
    pairs = np.array([(a, b) for a in RANGES[dtype] for b in RANGES[dtype]], dtype=dtype)
    a, b = pairs[:, 0].copy(), pairs[:, 1].copy()
    x, y = (TensorFrame.from_numpy(spark, v, ("x",)) for v in (a, b))
    small = (np.abs(b.astype(object)) % 5).astype(dtype if dtype != "bool" else "int8")
    z = TensorFrame.from_numpy(spark, small, ("x",))
    cases = {"+": (x + y, a + b), "*": (x * y, a * b), "//": (x // y, None), "%": (x % y, None), "**": (x ** z, a ** small)}
    with np.errstate(all="ignore"):
        cases["//"], cases["%"] = (x // y, a // b), (x % y, a % b)
        if dtype != "bool":
            cases |= {"-": (x - y, a - b), "neg": (-x, -a), "abs": (abs(x), np.abs(a)), "~": (~x, ~a), "<<": (x << 3, a << 3), ">>": (x >> 2, a >> 2), "+2": (x + 2, a + 2), "5-": (5 - x, 5 - a)}
    for name, (found, wanted) in cases.items():
        got = [r["value"] for r in found.df.orderBy("x").collect()]
        assert found.dtype == wanted.dtype.name, name
        assert [int(v) for v in got] == [int(v) for v in wanted], (dtype, name)


@pytest.mark.parametrize("mode", padding.MODES)
def test_wide_padding_equals_numpy(spark, mode):
    for n, left, right in ((1, 3, 2), (2, 5, 4), (7, 30, 1), (2000, 1500, 1700)):
        a = np.arange(n) * 3
        t = TensorFrame.from_numpy(spark, a, ("x",)).pad({"x": (left, right)}, mode)
        assert [r["value"] for r in t.df.orderBy("x").collect()] == np.pad(a, (left, right), mode=mode).tolist()


def test_packed_rows_of_another_length_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0] * 4), (2, None), (3, [1.0] * 5)], "vec_id long, data array<double>")
    assert TensorFrame.from_packed(df.where("vec_id < 3"), "data", ("y", "x"), (2, 2), ("vec_id",)).df.count() == 4
    with pytest.raises(Exception, match="should have 4 values"):
        TensorFrame.from_packed(df, "data", ("y", "x"), (2, 2), ("vec_id",)).df.collect()


def test_null_groups_and_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 3, 6.0)], "g string, t long, value double")
    found = {(r["g"], r["t"]): (r["n"], r["mean"], r["var"]) for r in running.running_statistics(df, ["g"], ["t"]).collect()}
    assert found == {(None, 1): (1, 2.0, 0.0), (None, 2): (2, 3.0, 1.0), ("a", 3): (1, 6.0, 0.0)}
    states = running.partials(df.withColumn("h", F.col("t")), ["g", "h"])
    assert {r["g"]: r["n"] for r in running.merged(states, ["g"]).collect()} == {None: 2, "a": 1}
    packed = spark.createDataFrame([(None, [1.0, 3.0]), (1, [2.0, 6.0])], "vec_id long, data array<double>")
    t = TensorFrame.from_packed(packed, "data", ("x",), (2,), ("vec_id",))
    centred = t - t.mean(("x",))
    assert sorted((r["vec_id"] or 0, r["value"]) for r in centred.df.collect()) == [(0, -1.0), (0, 1.0), (1, -2.0), (1, 2.0)]


def test_arrays_with_dims_and_values(spark):
    class Array:
        values, dims = np.array([[1, 2], [3, 4]]), ("y", "x")

    t = TensorFrame.from_xarray(spark, Array())
    assert t.dims == ("y", "x") and t.to_numpy().tolist() == [[1, 2], [3, 4]]
