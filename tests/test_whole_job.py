"""Cases in which the tensor engine once did less than its whole job."""

import numpy as np

from lattica import catalog, checking
from lattica.frame import TensorFrame
from lattica.plans import pipeline as plans


def cells(spark, x):
    rows = [("s", i, j, float(v)) for (i, j), v in np.ndenumerate(x)]
    return TensorFrame(spark.createDataFrame(rows, "sample_id string, y int, x int, value double"), ("y", "x"), ("sample_id",), known=x.shape)


def test_largest_differences_are_located(spark):
    expected = np.array([[1.0, 100.0, np.nan], [0.001, 1.0, 5.0]])
    actual = expected + np.array([[0, 2.0, 1.0], [0.01, 0, 2.0]])
    row = checking.mismatches(cells(spark, actual), cells(spark, expected)).first()
    assert (row["abs_at"].asDict(), row["rel_at"].asDict()) == ({"sample_id": "s", "y": 0, "x": 1}, {"sample_id": "s", "y": 1, "x": 0})
    report = checking.check_outputs({"a": cells(spark, actual)}, {"a": cells(spark, expected)})
    assert "at {'sample_id': 's', 'y': 0, 'x': 1}" in report.entries[0][2]


def test_frozen_statistics_reach_every_sample(spark):
    sf = "/root/testdata/sf0.001"
    wanted = catalog.embeddings(spark, sf).df.count()
    assert catalog.queries()["frozen_stats_scaled"](spark, sf).count() == wanted


def test_blocks_from_parametrised_sizes(spark):
    shapes = []
    x = np.arange(72.0).reshape(12, 6)
    model = plans.FunctionModel(lambda a: a + 1)
    chain = plans.PredictionPipeline(model, {"output": plans.Output(("y", "x"))})
    whole = chain.predict_blockwise
    chain.predict_blockwise = lambda members, shape, *a, **b: shapes.append(dict(shape)) or whole(members, shape, *a, **b)
    for n, options in ((1, {"block_parameter": 1}), (10, {})):
        found = plans.predict(chain, {"input": cells(spark, x)}, block_sizes={"y": (1, 1), "x": 3}, **options)["output"]
        assert shapes[-1] == {"y": 1 + n, "x": 3}
        assert {(r["y"], r["x"]): r["value"] for r in found.df.collect()} == {k: v + 1 for k, v in np.ndenumerate(x)}
