"""Axis names, kinds and the guessing of dims from shapes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations
from typing import Any

KINDS = {"batch": "batch", "time": "time", "index": "index", "channel": "channel", "x": "space", "y": "space", "z": "space"}
SHORT = {"b": "batch", "t": "time", "i": "index", "c": "channel"}


def axis_kind(name: str) -> str:
    """batch, time, index, channel or space; ValueError for any other name."""
    kind = KINDS.get(SHORT.get(name, name))
    if kind is None:
        raise ValueError(f"no axis kind is known for {name!r}")
    return kind


@dataclass(frozen=True)
class Axis:
    """An axis id with its kind; batch and channel have one id each."""

    id: str
    kind: str

    @classmethod
    def create(cls, axis: Any) -> Axis:
        """From a name, an Axis, or anything with `id` and `type`."""
        if isinstance(axis, Axis):
            return axis
        if isinstance(axis, str):
            kind = axis_kind(axis)
            name = axis
        else:
            kind = getattr(axis, "kind", None) or axis.type
            name = getattr(axis, "id", None) or kind
        return cls(kind if kind in ("batch", "channel") else name, kind)


@dataclass(frozen=True)
class AxisInfo(Axis):
    """maybe_singleton: whether the axis can have size 1, by how its size is described."""

    maybe_singleton: bool = True

    @classmethod
    def create(cls, axis: Any, maybe_singleton: bool | None = None) -> AxisInfo:  # type: ignore[override]
        if isinstance(axis, AxisInfo) and maybe_singleton is None:
            return axis
        base = Axis.create(axis)
        if maybe_singleton is None:
            size = getattr(axis, "size", None)
            maybe_singleton = size == 1 if isinstance(size, int) else (size is None or getattr(size, "min", 1) == 1)
        return cls(base.id, base.kind, bool(maybe_singleton))


def axis_ids(letters: str | Sequence[str], per_dataset: bool = False) -> tuple[str, ...]:
    """Full axis names for letters or names; batch is added for statistics over a data set."""
    names = [SHORT.get(a, a) for a in letters]
    if per_dataset and "batch" not in names:
        names = ["batch", *names]
    return tuple(names)


def guess_dims(shape: Sequence[int]) -> tuple[str, ...]:
    """The dims of a bare array, by its number of axes."""
    n = len(shape)
    if n == 2:
        return ("y", "x")
    if n == 3:
        return ("channel", "y", "x") if min(shape) <= 3 else ("z", "y", "x")
    if n == 4:
        return ("channel", "z", "y", "x")
    if n == 5:
        return ("batch", "channel", "z", "y", "x")
    raise ValueError(f"dims of an array with {n} axes can't be guessed")


def match_dims(shape: Sequence[int], axes: Sequence[Any]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(order of the array's axes, shape after singletons are added or removed) that fits the axes.

    Identity comes first, then the full transpose, then the other permutations.
    """
    infos = [AxisInfo.create(a) for a in axes]
    n = len(shape)
    orders = [tuple(range(n)), tuple(reversed(range(n))), *permutations(range(n))]
    for order in dict.fromkeys(orders):
        if (fitted := _with_singletons([shape[i] for i in order], infos)) is not None:
            return order, fitted
    raise ValueError(f"an array of shape {tuple(shape)} doesn't fit the axes {[a.id for a in infos]}")


def _with_singletons(shape: list[int], infos: list[AxisInfo]) -> tuple[int, ...] | None:
    out: list[int] = []
    left = list(shape)
    spare = len(shape) - len(infos)
    for info in infos:
        while spare > 0 and left and left[0] == 1 and not info.maybe_singleton:
            left.pop(0)
            spare -= 1
        if left and (left[0] != 1 or info.maybe_singleton) and not (spare < 0 and info.maybe_singleton and left[0] != 1):
            out.append(left.pop(0))
        elif info.maybe_singleton:
            out.append(1)
            spare += 1
        else:
            return None
    return tuple(out) if all(n == 1 for n in left) else None
