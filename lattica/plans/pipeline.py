"""Prediction: statistics, preprocessing, a model over packed tensors or tiles, postprocessing.

The model is a black box that maps arrays to arrays. It runs in Arrow-fed
Python workers, one packed tensor (or tile) at a time; all else is one lazy
DataFrame plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..frame import V, TensorFrame
from ..functions.numeric import SPARK_TYPES
from ..operators.processing import EnsureDtype, Members, Operator, UpdateStats, get_proc
from ..operators.tiling import Tile, split, split_shape, stitch
from .measures import Measure, Stat, StatsCalculator

#: A packed tensor must fit into a worker.
MOST_CELLS = 50_000_000


class Model(Protocol):
    """What a custom model offers; load() is called once per worker."""

    def load(self) -> None: ...

    def forward(self, arrays: dict[str, np.ndarray | None]) -> dict[str, np.ndarray]: ...

    def unload(self) -> None: ...


@dataclass
class FunctionModel:
    """A function of the input arrays, in the order of `inputs`."""

    function: Callable[..., np.ndarray | tuple[np.ndarray, ...]]
    inputs: Sequence[str] = ("input",)
    outputs: Sequence[str] = ("output",)

    def load(self) -> None:
        pass

    def unload(self) -> None:
        pass

    def forward(self, arrays):
        found = self.function(*[arrays.get(i) for i in self.inputs])
        found = found if isinstance(found, tuple) else (found,)
        if len(found) != len(self.outputs):
            raise ValueError(f"the model gave {len(found)} outputs, not {len(self.outputs)}")
        return dict(zip(self.outputs, found, strict=True))


@dataclass
class OnnxModel:
    """An ONNX graph given as bytes; the session starts in the worker."""

    graph: bytes
    inputs: Sequence[str] = ("input",)
    outputs: Sequence[str] = ("output",)
    _session: Any = field(default=None, repr=False, compare=False)

    def load(self) -> None:
        import onnxruntime

        self._session = onnxruntime.InferenceSession(self.graph, providers=onnxruntime.get_available_providers())

    def unload(self) -> None:
        self._session = None

    def forward(self, arrays):
        if self._session is None:
            self.load()
        named = {i.name: arrays[m] for i, m in zip(self._session.get_inputs(), self.inputs, strict=True) if arrays.get(m) is not None}
        return dict(zip(self.outputs, self._session.run(None, named), strict=True))


#: Formats in the order in which they are tried, with what makes a model of bytes.
ADAPTERS: dict[str, Callable[..., Model] | None] = {"pytorch_state_dict": None, "tensorflow_saved_model_bundle": None, "torchscript": None, "onnx": OnnxModel, "keras_hdf5": None}


def weight_formats() -> list[str]:
    return list(ADAPTERS)


def create_model(weights: Mapping[str, bytes], inputs: Sequence[str], outputs: Sequence[str]) -> Model:
    """The first format that can be run here; the errors of all others if none can."""
    errors = []
    for name, make in ADAPTERS.items():
        if name in weights:
            if make is None:
                errors.append(f"{name}: its framework isn't supported here")
                continue
            try:
                model = make(weights[name], inputs, outputs)
                model.load()
                model.unload()
                return model
            except Exception as error:  # noqa: BLE001  the next format may work
                errors.append(f"{name}: {error}")
    raise ValueError("; ".join(errors) or "no weights")


@dataclass(frozen=True)
class Output:
    """What the driver must know of an output: dims, dtype, and sizes as functions of the first input's."""

    dims: tuple[str, ...]
    dtype: str = "float64"
    size: Callable[[dict[str, int]], dict[str, int]] | None = None


def run_model(model: Model, members: Members, outputs: Mapping[str, Output], order: Mapping[str, Sequence[str]] | None = None) -> Members:
    """model.forward over every sample: members are packed, joined by their keys and unpacked. Absent members are None."""
    members = {m: t.transpose((order or {}).get(m, t.dims)) for m, t in members.items()}
    first = next(iter(members.values()))
    keys = first.keys
    packed = None
    for name, tensor in members.items():
        if tensor.keys != keys:
            raise ValueError("members need equal keys")
        if tensor.size > MOST_CELLS:
            raise ValueError(f"{name} has more than {MOST_CELLS} cells a sample; predict by blocks")
        own = tensor.packed().select(*keys, F.col("data").alias(f"_d_{name}"))
        packed = own if packed is None else (packed.join(own, list(keys)) if keys else packed.crossJoin(own))
    shapes = {m: (t.shape, t.dtype) for m, t in members.items()}
    sizes = {m: (o.size or (lambda s: s))(first.sizes) for m, o in outputs.items()}
    expected = {m: tuple(sizes[m][d] for d in o.dims) for m, o in outputs.items()}
    kinds = {m: o.dtype for m, o in outputs.items()}

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        try:
            for batch in batches:
                found: dict[str, list] = {m: [] for m in expected}
                for i in range(len(batch)):
                    arrays = {m: np.array(batch[f"_d_{m}"].iloc[i]).reshape(shape).astype(dtype) for m, (shape, dtype) in shapes.items()}
                    result = model.forward(arrays)
                    for m, shape in expected.items():
                        if result[m].shape != shape:
                            raise ValueError(f"{m} has shape {result[m].shape}, not {shape}")
                        found[m].append(result[m].ravel().tolist())
                yield pd.DataFrame({**{k: batch[k] for k in keys}, **found})
        finally:
            model.unload()

    schema = ", ".join([*(f"`{k}` {packed.schema[k].dataType.simpleString()}" for k in keys), *(f"`{m}` array<{SPARK_TYPES[kinds[m]]}>" for m in expected)])
    result = packed.mapInPandas(turn, schema)
    return {m: TensorFrame.from_packed(result, m, o.dims, expected[m], keys, o.dtype) for m, o in outputs.items()}


@dataclass
class PredictionPipeline:
    """Operators around a model, with statistics computed where operators need them.

    fixed: dataset statistics that are given and win over computed ones.
    initial: a data set whose statistics are used for every prediction. With
    neither, the statistics are those of the samples that are predicted.
    """

    model: Model
    outputs: Mapping[str, Output]
    preprocessing: Sequence[Operator] = ()
    postprocessing: Sequence[Operator] = ()
    fixed: Stat | None = None
    initial: Members | None = None
    keep_updating: bool = False
    order: Mapping[str, Sequence[str]] | None = None

    def __enter__(self) -> PredictionPipeline:
        return self

    def __exit__(self, *error: object) -> None:
        pass

    def required_measures(self, operators: Iterable[Operator]) -> frozenset[Measure]:
        return frozenset(m for o in operators for m in o.required_measures)

    def _process(self, operators: Sequence[Operator], members: Members) -> Members:
        for operator in operators:
            # An operator sees the statistics of the data as they were before the chain.
            members = operator(members, self._stat)
        return members

    def _statistics(self, operators: Sequence[Operator], members: Members) -> None:
        needed = self.required_measures(operators)
        if self.fixed:
            needed = frozenset(m for m in needed if m not in self.fixed)
        calculator = StatsCalculator(needed)
        dataset = [m for m in needed if m.scope == "dataset"]
        if self.initial is not None and dataset and all(m.member in self.initial for m in dataset):
            calculator.update(self.initial)
            if not self.keep_updating:
                calculator = StatsCalculator(needed, calculator.finalize())
        stat = UpdateStats(calculator, self.keep_updating)(members)
        self._stat = stat.with_tables(self.fixed.tables) if self.fixed else stat

    def apply_preprocessing(self, members: Members) -> Members:
        self._statistics(self.preprocessing, members)
        return self._process(self.preprocessing, members)

    def apply_postprocessing(self, members: Members, inputs: Members | None = None) -> Members:
        """Inputs stay in reach of operators that refer to them."""
        every = {**(inputs or {}), **members}
        self._statistics(self.postprocessing, every)
        out = self._process(self.postprocessing, every)
        return {m: out[m] for m in members}

    def predict(self, members: Members, *, skip_preprocessing: bool = False, skip_postprocessing: bool = False) -> Members:
        """All samples of the members, whole."""
        ready = members if skip_preprocessing else self.apply_preprocessing(members)
        found = run_model(self.model, ready, self.outputs, self.order)
        return found if skip_postprocessing else self.apply_postprocessing(found, ready)

    def predict_blockwise(self, members: Members, block_shape: Mapping[str, int], halo: Mapping[str, Any] | None = None, *, pad_mode: str = "reflect", skip_preprocessing: bool = False, skip_postprocessing: bool = False) -> Members:
        """Preprocessing on whole samples, the model on tiles with a halo, stitched, then postprocessing on the whole."""
        ready = members if skip_preprocessing else self.apply_preprocessing(members)
        tiles = {m: split_shape(t.sizes, {a: n for a, n in block_shape.items() if a in t.dims}, halo) for m, t in ready.items()}
        counts = {len(t) for t in tiles.values()}
        if len(counts) > 1:
            raise ValueError("members have unlike numbers of tiles")
        blocks = {m: split(t, tiles[m], pad_mode) for m, t in ready.items()}
        found = run_model(self.model, blocks, self.outputs, self.order)
        own: list[Tile] = next(iter(tiles.values()))
        out = {}
        for m, tensor in found.items():
            axes = {d: (own[0].sample_shape[d], True) if d in own[0].sample_shape else (n, False) for d, n in tensor.sizes.items()}
            moved = [Tile({a: n for a, (n, _) in axes.items()}, {a: t.inner_slice[a] if same else (0, n) for a, (n, same) in axes.items()}, {a: t.halo.get(a, (0, 0)) for a, (_, same) in axes.items() if same}, t.block_index, t.blocks_in_sample) for t in own]
            out[m] = stitch(tensor, moved)
        return out if skip_postprocessing else self.apply_postprocessing(out, ready)


def create_pipeline(model: Model, outputs: Mapping[str, Output], inputs: Mapping[str, Sequence[Mapping[str, Any]]] | None = None, post: Mapping[str, Sequence[Mapping[str, Any]]] | None = None, older: bool = False, **options: Any) -> PredictionPipeline:
    """From descriptions of each member's operators; older ones cast to float32 around the model."""

    def chain(described: Mapping[str, Sequence[Mapping[str, Any]]]) -> list[Operator]:
        out: list[Operator] = []
        for member, steps in described.items():
            own = [get_proc(s, member) for s in steps]
            if older and any(not isinstance(o, EnsureDtype) for o in own):
                own = [*own, EnsureDtype(member, member, "float32")]
            out += own
        return out

    return PredictionPipeline(model, outputs, chain(inputs or {}), chain(post or {}), **options)


def parametrised_shape(sizes: Mapping[str, int | tuple[int, int]], n: int = 10) -> dict[str, int]:
    """The block shape for n of axes that are given by their (least size, step), or by a fixed size."""
    return {a: s if isinstance(s, int) else s[0] + n * s[1] for a, s in sizes.items()}


def predict(pipeline: PredictionPipeline, members: Members, *, block_shape: Mapping[str, int] | None = None, block_sizes: Mapping[str, int | tuple[int, int]] | None = None, block_parameter: int = 10, halo: Mapping[str, Any] | None = None, save_to: str | None = None, **skip: bool) -> Members:
    """By blocks of a fixed shape, else of the shape that parametrised sizes have for block_parameter, else whole."""
    block_shape = block_shape or (parametrised_shape(block_sizes, block_parameter) if block_sizes else None)
    found = pipeline.predict_blockwise(members, block_shape, halo, **skip) if block_shape else pipeline.predict(members, **skip)
    if save_to:
        for m, tensor in found.items():
            tensor.df.write.parquet(save_to.format(member_id=m, output_id=m))
    return found


def predict_many(pipeline: PredictionPipeline, samples: Iterable[Members], **options: Any) -> Iterator[Members]:
    """Lazily, one sample after the other."""
    if isinstance(samples, Mapping):
        raise TypeError("samples must be an iterable of samples, not one sample")
    for members in samples:
        yield predict(pipeline, members, **options)


def union_members(members: Mapping[str, TensorFrame]):
    """Cells of several members as one table with a `member` column."""
    out = None
    for name, t in members.items():
        df = t.df.withColumn("member", F.lit(name)).withColumn(V, F.col(V).cast("double"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
