"""Token counts: every distinct pre-token of the corpus is counted once and joined to the documents' frequencies.

Texts are cut into pre-tokens where the vocabulary's pre-tokenizer cuts them.
A chunk of documents holds its distinct pre-tokens once and, for each
document, their places and frequencies. Chunks' pre-tokens meet sorted, so each
is counted once and handed to every chunk that has it: a common pre-token costs
one row per chunk. The counts are joined to their chunk, which sums by
frequency; no id list of a document is materialised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut
from .text import chunks, utf8
from .vocabulary import run_table
from .worker import task

SCHEMA = "n_bytes long, n_tokens long"
#: Bytes of text whose pre-tokens are told apart together.
CHUNK = 8 << 20


def squeezed(x: np.ndarray) -> bytes:
    """Integers below 2**31 as bytes, four planes of them compressed; the number of integers comes first."""
    planes = np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def spread(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def places(texts: list[str], path: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct pre-tokens; for each text the end of its pairs; the pairs' pre-tokens, by index; their frequencies)."""
    table = run_table(path, keep_ids=False)
    cuts = [table.pre_tokens(t) for t in texts]
    found = pa.array([p for own in cuts for p in own], pa.large_string()).dictionary_encode()
    row = np.repeat(np.arange(len(texts)), [len(own) for own in cuts])
    del cuts
    size, order = max(1, len(found.dictionary)), pc.sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    pair, times = np.unique(row * size + rank[found.indices.to_numpy()], return_counts=True)
    return found.dictionary.take(order), np.searchsorted(pair, (np.arange(len(texts)) + 1) * size), pair % size, times


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give
    repeated results; a null doc_id stays null; other columns of docs, whatever their names, are not read.
    An empty table gives an empty result.
    """

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("_chunk"))
    kind = ids.schema["doc_id"].dataType.simpleString()

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets, CHUNK):
                own, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).to_pylist()
                tokens, ends, at, times = places([t or "" for t in texts], path)
                whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                packed = [pa.array([squeezed(x)], pa.binary()) for x in (ends, np.diff(at, prepend=0), times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(lo, 1), whole(own), whole(pa.array(np.diff(offsets[lo : hi + 1]), pa.int64())), whole(tokens.cast(pa.string())), *packed],
                    ["_chunk", "ids", "sizes", "tokens", "ends", "at", "times"],
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = run_table(path, keep_ids=False)
        last: dict[str, int] = {}  # of sorted pre-tokens, the one that may go on in the next batch
        for batch in batches:
            found = batch.column(2).dictionary_encode()
            names = found.dictionary.to_pylist()
            new = [t for t in names if t not in last]
            n = last | dict(zip(new, table.sizes(new), strict=True))
            last = {t: n[t] for t in names[-1:]}
            packed = batch.column(1).to_numpy().astype(np.int64) << 32 | np.array([n[t] for t in names], np.int64)[found.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed)], ["_chunk", "_packed"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own, sizes, ends, at, times, counted = (batch.column(k)[i] for k in range(6))
                ends, at, times = spread(ends.as_py()), np.cumsum(spread(at.as_py())), spread(times.as_py())
                n = np.zeros(len(at), np.int64)
                if len(at):
                    packed = counted.values.to_numpy()
                    of_token = np.zeros(len(packed), np.int64)
                    of_token[packed >> 32] = packed & 0xFFFFFFFF
                    n = of_token[at] * times
                sums = np.concatenate([[0], np.cumsum(n)])
                totals = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                yield pa.RecordBatch.from_arrays([own.values, sizes.values, pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    apart = cut(ids.mapInArrow(task(take_apart, holds=True), f"_chunk long, ids array<{kind}>, sizes array<long>, tokens array<string>, ends binary, at binary, times binary"), "zstd")
    uses = apart.select("_chunk", F.posexplode("tokens").alias("_place", "token")).repartition("token").sortWithinPartitions("token")
    counted = uses.mapInArrow(task(count, holds=True), "_chunk long, _packed long").groupBy("_chunk").agg(F.collect_list("_packed").alias("_counted"))
    joined = apart.join(counted, "_chunk", "left").select("ids", "sizes", "ends", "at", "times", "_counted")
    return joined.mapInArrow(task(total), f"doc_id {kind}, {SCHEMA}").withColumn("over_limit", F.col("n_tokens") > limit)
