"""Tensors from and to files: .npy without any decoder, images where one is installed, Parquet of cells or packed rows."""

from __future__ import annotations

import ast
import io
import re
import struct
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..axes import guess_dims
from ..frame import TensorFrame

PACKED = "path string, dims array<string>, shape array<int>, dtype string, data array<double>"
IMAGE_SUFFIXES = (".png", ".tif", ".tiff", ".jpg", ".jpeg", ".gif", ".bmp")


def read_npy(raw: bytes) -> np.ndarray:
    """Parses the header itself: arrays of objects are refused."""
    if raw[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    wide = raw[6] > 1
    n = struct.unpack_from("<I" if wide else "<H", raw, 8)[0]
    at = 12 if wide else 10
    head = ast.literal_eval(raw[at : at + n].decode("latin1"))
    dtype = np.dtype(head["descr"])
    if dtype.hasobject:
        raise ValueError("arrays of objects aren't read")
    flat = np.frombuffer(raw, dtype, int(np.prod(head["shape"])), at + n)
    return flat.reshape(head["shape"], order="F" if head["fortran_order"] else "C")


def write_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def decode(raw: bytes, suffix: str) -> np.ndarray:
    if suffix == ".npy":
        return read_npy(raw)
    if suffix in IMAGE_SUFFIXES:
        try:
            import imageio.v3 as reader
        except ImportError as error:
            raise NotImplementedError(f"{suffix} needs an image decoder, which isn't installed") from error
        return np.asarray(reader.imread(raw, extension=suffix))
    raise ValueError(f"no decoder for {suffix!r}")


def suffix_of(path: str) -> str:
    found = re.search(r"\.[^./]+$", path)
    return found.group().lower() if found else ""


def read_arrays(spark: SparkSession, path: str | list[str], dims: Sequence[str] | None = None) -> DataFrame:
    """PACKED rows of all files under a path or glob; files are decoded on the executors."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, raw in zip(batch["path"], batch["content"], strict=True):
                array = decode(bytes(raw), suffix_of(name))
                own = list(dims) if dims else list(guess_dims(array.shape))
                rows.append((name, own, list(array.shape), "bool" if array.dtype == bool else array.dtype.name, array.astype(np.float64).ravel()))
            yield pd.DataFrame(rows, columns=["path", "dims", "shape", "dtype", "data"])

    return files.mapInPandas(turn, PACKED)


def load_tensor(spark: SparkSession, path: str, dims: Sequence[str] | None = None) -> TensorFrame:
    """One file as a tensor without keys."""
    packed = read_arrays(spark, path, dims)
    head = packed.select("dims", "shape", "dtype").take(2)
    if len(head) != 1:
        raise ValueError(f"{path} names {len(head) or 'no'} files")
    frame = TensorFrame.from_packed(packed, "data", head[0]["dims"], head[0]["shape"], (), "float64")
    return frame.astype(head[0]["dtype"]) if head[0]["dtype"] != "float64" else frame


def save_tensor(path: str | Path, tensor: TensorFrame) -> None:
    """One tensor as .npy (or .parquet cells); a batch axis of size 1 is dropped in images."""
    suffix = suffix_of(str(path))
    if not suffix:
        raise ValueError("the path needs a suffix")
    if suffix in (".h5", ".hdf", ".hdf5"):
        raise NotImplementedError("HDF5 isn't written")
    if suffix == ".parquet":
        tensor.df.write.parquet(str(path))
        return
    if suffix != ".npy":
        if tensor.dims[:1] == ("batch",) and tensor.sizes["batch"] == 1:
            tensor = tensor[{"batch": 0}]
        try:
            import imageio.v3 as writer
        except ImportError as error:
            raise NotImplementedError(f"{suffix} needs an image encoder, which isn't installed") from error
        writer.imwrite(path, tensor.to_numpy())
        return
    array = tensor.to_numpy()
    if tensor.dtype not in ("uint64",):
        array = array.astype(tensor.dtype)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_bytes(write_npy(array))


def member_path(pattern: str, sample_id: str, member: str) -> str:
    """A pattern with {sample_id} and {member_id} ({input_id} and {output_id} mean the same)."""
    return pattern.format(sample_id=sample_id, member_id=member, input_id=member, output_id=member)


def save_sample(pattern: str, members: Mapping[str, TensorFrame], sample_id: str = "") -> list[str]:
    if len(members) > 1 and not any(p in pattern for p in ("{member_id}", "{input_id}", "{output_id}")):
        raise ValueError("several members need a member placeholder")
    paths = []
    for name, tensor in members.items():
        paths.append(member_path(pattern, sample_id, name))
        save_tensor(paths[-1], tensor)
    return paths


def save_dataset(df: DataFrame, path: str, keys: Sequence[str] = ("member",)) -> None:
    """Cells of many samples as Parquet, one folder per member: a reader of one member prunes the others."""
    df.write.partitionBy(*keys).parquet(path)


def load_samples(spark: SparkSession, paths: Mapping[str, str], dims: Mapping[str, Sequence[str]], pattern: str = r"([^/]+)\.[^./]+$") -> dict[str, DataFrame]:
    """For each member, the packed rows of its files with the sample_id that the pattern finds in the path."""
    return {m: read_arrays(spark, p, dims.get(m)).withColumn("sample_id", F.regexp_extract("path", pattern, 1)) for m, p in paths.items()}


def sample_ids(paths: Sequence[Sequence[str]]) -> list[str]:
    """A short distinct name per sample from its members' paths: what they share, cut to what tells samples apart."""
    from difflib import SequenceMatcher

    names = []
    for group in paths:
        stems = [Path(p).stem for p in group]
        common = stems[0]
        for other in stems[1:]:
            match = SequenceMatcher(None, common, other, autojunk=False).find_longest_match()
            common = common[match.a : match.a + match.size]
        names.append(common)
    if len(set(names)) != len(names):
        raise ValueError("samples can't be told apart by their paths")
    if len(names) < 2:
        return names
    longest = max(map(len, names))
    best = names
    for cut in range(1, longest):
        short = [n[cut:] for n in names]
        if len(set(short)) != len(names) or not all(short):
            break
        best = short
    names = best
    for cut in range(1, longest):
        short = [n[:-cut] for n in names]
        if len(set(short)) != len(names) or not all(short):
            break
        best = short
    return best


def ensure_unzipped(source: str | Path, folder: str | Path) -> Path:
    """The archive's content under <folder>/<name>.unzipped, or a copy of a file that is none; members can't leave the folder."""
    source, folder = Path(source), Path(folder)
    if zipfile.is_zipfile(source):
        out = folder / f"{source.name}.unzipped"
        out.mkdir(parents=True, exist_ok=True)
        with zipfile.ZipFile(source) as archive:
            archive.extractall(out)
        return out
    folder.mkdir(parents=True, exist_ok=True)
    out = folder / source.name
    out.write_bytes(source.read_bytes())
    return out
