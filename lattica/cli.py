"""Command line: statistics and predictions over folders of arrays, comparison, packaging."""

from __future__ import annotations

import argparse
import difflib
import importlib
import json
import sys
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def compare_text(a: str, b: str, name_a: str = "a", name_b: str = "b", form: str = "unified") -> str:
    """A unified or HTML diff."""
    left, right = a.splitlines(), b.splitlines()
    if form == "html":
        return difflib.HtmlDiff().make_file(left, right, name_a, name_b)
    return "\n".join(difflib.unified_diff(left, right, name_a, name_b, lineterm=""))


def validate(description: dict[str, Any]) -> list[str]:
    """What is wrong with a pipeline description {inputs, outputs, model}."""
    from .operators.processing import get_proc

    wrong = [f"{k} is missing" for k in ("inputs", "outputs", "model") if k not in description]
    for part in ("inputs", "outputs"):
        for member in description.get(part, []):
            if "id" not in member:
                wrong.append(f"a member of {part} has no id")
            for step in member.get("processing", []):
                try:
                    get_proc(step, member.get("id", "?"))
                except (KeyError, ValueError, NotImplementedError) as error:
                    wrong.append(f"{member.get('id')}: {error}")
    return wrong


def package(files: list[str], out: str) -> str:
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for f in files:
            archive.write(f, Path(f).name)
    return out


def _session() -> SparkSession:
    return SparkSession.builder.appName("lattica").getOrCreate()


def _samples(spark: SparkSession, path: str, dims: str | None):
    from .frame import TensorFrame
    from .sources.arrays import load_samples

    packed = load_samples(spark, {"input": path}, {"input": dims.split(",") if dims else None})["input"]
    head = packed.select("dims", "shape").first()
    if head is None:
        raise SystemExit(f"no files at {path}")
    return TensorFrame.from_packed(packed, "data", head["dims"], head["shape"], ("sample_id",))


def _predict(args: argparse.Namespace) -> int:
    from .plans.pipeline import FunctionModel, Output, create_pipeline, predict

    spark = _session()
    description = json.loads(Path(args.description).read_text())
    tensor = _samples(spark, args.inputs, args.dims)
    module, _, name = description["model"].partition(":")
    model = FunctionModel(getattr(importlib.import_module(module), name))
    steps = {part: {m["id"]: m.get("processing", []) for m in description[part]} for part in ("inputs", "outputs")}
    pipeline = create_pipeline(model, {"output": Output(tensor.dims)}, steps["inputs"], steps["outputs"])
    blocks = {k: int(v) for k, v in (x.split("=") for x in args.block or [])}
    if Path(args.out.format(output_id="output", member_id="output")).exists() and not args.overwrite:
        raise SystemExit("the output exists; use --overwrite")
    found = predict(pipeline, {"input": tensor}, block_shape=blocks or None, halo={a: args.halo for a in blocks} if args.halo else None)
    if args.preview:
        found["output"].df.explain("formatted")
        return 0
    found["output"].df.write.mode("overwrite" if args.overwrite else "error").parquet(args.out.format(output_id="output", member_id="output"))
    return 0


def _statistics(args: argparse.Namespace) -> int:
    from .plans.measures import Measure, compute
    from .sources.statistics import cached_dataset_stat

    spark = _session()
    tensor = _samples(spark, args.inputs, args.dims)
    wanted = {Measure("dataset", n, "input") for n in ("mean", "std", "var")} | {Measure("dataset", "quantile", "input", None, q) for q in args.q or []}
    stat = cached_dataset_stat(spark, wanted, args.out, lambda m: compute(m, {"input": tensor}))
    for m in sorted(wanted, key=str):
        print(m.name, m.q if m.q is not None else "", stat.value(m).item())
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lattica")
    parser.add_argument("--settings", help="JSON file whose values are the defaults of the options")
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("validate")
    p.add_argument("description")
    p = sub.add_parser("predict")
    for name in ("description", "inputs", "out"):
        p.add_argument(name)
    p.add_argument("--dims")
    p.add_argument("--block", action="append")
    p.add_argument("--halo", type=int, default=0)
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--preview", action="store_true")
    p = sub.add_parser("statistics")
    p.add_argument("inputs")
    p.add_argument("out")
    p.add_argument("--dims")
    p.add_argument("--q", type=float, action="append")
    p = sub.add_parser("package")
    p.add_argument("out")
    p.add_argument("files", nargs="+")
    p = sub.add_parser("compare")
    p.add_argument("a")
    p.add_argument("b")
    p.add_argument("--form", default="unified", choices=("unified", "html"))
    sub.add_parser("empty-cache")
    first, _ = parser.parse_known_args(argv)
    if first.settings:
        for command in sub.choices.values():
            command.set_defaults(**json.loads(Path(first.settings).read_text()))
    args = parser.parse_args(argv)
    if args.command == "validate":
        wrong = validate(json.loads(Path(args.description).read_text()))
        print("\n".join(wrong) or "valid")
        return int(bool(wrong))
    if args.command == "package":
        print(package(args.files, args.out))
        return 0
    if args.command == "compare":
        print(compare_text(Path(args.a).read_text(), Path(args.b).read_text(), args.a, args.b, args.form))
        return 0
    if args.command == "empty-cache":
        _session().catalog.clearCache()
        return 0
    return _predict(args) if args.command == "predict" else _statistics(args)


if __name__ == "__main__":
    sys.exit(main())
