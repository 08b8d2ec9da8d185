"""Statistics of a data set as JSON: a list of {measure, value}; a value with axes is {data, dims}."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from ..frame import TensorFrame
from ..plans.measures import Measure, Stat, StatTable


def save_dataset_stat(stat: Stat, path: str | Path) -> None:
    rows = []
    for table in stat.tables:
        for measure in table.columns:
            if measure.scope != "dataset":
                continue
            value = stat.value(measure)
            found = value.to_numpy() if value.dims else value.item()
            rows.append({"measure": measure.as_json(), "value": {"data": found.tolist(), "dims": list(value.dims)} if value.dims else found})
    Path(path).write_text(json.dumps(rows, indent=1))


def load_dataset_stat(spark: SparkSession, path: str | Path) -> Stat:
    tables = []
    for row in json.loads(Path(path).read_text()):
        measure = Measure.from_json(row["measure"])
        value = row["value"]
        if isinstance(value, dict):
            tensor = TensorFrame.from_numpy(spark, np.array(value["data"], np.float64), value["dims"])
            tables.append(StatTable(tensor.df.withColumnRenamed("value", "_v"), (), tensor.dims, {measure: "_v"}))
        else:
            tables.append(StatTable(spark.createDataFrame([(float(value),)], "_v double"), (), (), {measure: "_v"}))
    return Stat(tables)


def cached_dataset_stat(spark: SparkSession, measures: set[Measure], path: str | Path, compute) -> Stat:
    """What the file holds, which must cover the measures; without a file, what `compute` gives, which is saved."""
    if Path(path).exists():
        stat = load_dataset_stat(spark, path)
        if missing := [m for m in measures if m not in stat]:
            raise ValueError(f"{path} lacks {missing}")
        return stat
    stat = compute(measures)
    save_dataset_stat(stat, path)
    return stat
