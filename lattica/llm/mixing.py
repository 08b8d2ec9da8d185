"""Mixing sources to target weights by fixed-length blocks.

A source's words, document after document, are cut into blocks of a fixed
number of words. For each output shard the source counts are drawn from a
multinomial over what the sources still have to give, so totals meet their
targets; the slots of a source map to its blocks through a pseudorandom
permutation of the block indices (a new one for each pass over the source),
and blocks are joined to documents by source and index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, fresh
from .text import chunks, utf8, words
from .worker import task

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 128
SEED = 20240607
#: Slots of one output shard; shards whose draws one task makes. The driver draws once for all shards of such a task.
SHARD_SLOTS, SHARDS_AT_ONCE = 1 << 12, 1 << 10
#: A source's documents are laid end to end in so many parts, so no window holds all of a large source.
PARTS = 1024


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", row: str | None = None) -> DataFrame:
    """_row, doc_id, source, size: the number of words `[^\\x20\\x09-\\x0D]+` of each text (null: 0)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(3))
            sizes = [np.diff(words(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2]) for lo, hi in chunks(offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64())], ["_row", "doc_id", "source", "size"])

    key = F.col(row) if row else F.monotonically_increasing_id()
    columns = docs.select(key.alias("_row"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(task(count), f"_row long, doc_id {columns.schema['doc_id'].dataType.simpleString()}, source string, size long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: shares by weight, stopped at `most` times its size, the excess shared again."""
    out = [0.0] * len(sizes)
    left, free = share * sum(sizes), list(range(len(sizes)))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while free:
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def draws(slots: np.ndarray, sizes: np.ndarray, seed: list[int]) -> Iterator[np.ndarray]:
    """For each part, the number of its slots from every source; parts have `sizes` slots, as many as the sources have together.

    Multinomial over what the sources still have to give.
    """
    left = np.array(slots, np.int64)
    rng = np.random.default_rng(seed)
    for n in sizes:
        if n >= left.sum():
            count = left.copy()
        else:
            count = np.minimum(rng.multinomial(n, left / left.sum()), left)
            while (short := n - int(count.sum())) > 0:  # what a nearly spent source could not give
                room = left - count
                count += np.minimum(rng.multinomial(short, room / room.sum()), room)
        left -= count
        yield count


def parts_of(total: int, each: int) -> np.ndarray:
    """total in parts of `each`, the last one smaller."""
    return np.diff(np.append(np.arange(0, total, each), total))


def group_draws(slots: list[int], seed: int = SEED) -> list[tuple[int, list[int], list[int]]]:
    """(group, first slot of every source, slots of every source) of each group of SHARDS_AT_ONCE output shards."""
    given, rows = np.zeros(len(slots), np.int64), []
    for group, count in enumerate(draws(np.array(slots, np.int64), parts_of(sum(slots), SHARD_SLOTS * SHARDS_AT_ONCE), [seed, 0])):
        rows.append((group, given.tolist(), count.tolist()))
        given += count
    return rows


def shard_draws(group: int, first: list[int], count: list[int], seed: int = SEED) -> Iterator[tuple[int, int, int]]:
    """(source, first slot, end slot) of each output shard of a group and source that it draws from."""
    given = np.array(first, np.int64)
    for own in draws(np.array(count, np.int64), parts_of(sum(count), SHARD_SLOTS), [seed, 1, group]):
        yield from ((s, int(given[s]), int(given[s] + own[s])) for s in np.flatnonzero(own).tolist())
        given += own


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at `index`: a Feistel network on the next power of four, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.ones(len(index), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for turn in range(4):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


def taken_blocks(counted: DataFrame, block: int = BLOCK, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size, target and _start; documents' overlaps with blocks and how often each block is taken).

    counted must be a written table. The list of sources is collected to the
    driver, for their targets hang on each other: one row per named data set.
    Every table made of it is joined as the planner sees fit by its size.
    """
    spark = counted.sparkSession
    sources = sorted(((r["source"], r["n"]) for r in counted.groupBy("source").agg(F.sum("size").alias("n")).collect()), key=lambda x: (x[0] is None, x[0]))
    sizes = [n for _, n in sources]
    goal = targets(sizes, weights, share, most)
    blocks = [-(-n // block) for n in sizes]
    slots = [min(most * b, round(g * b / n)) if n else 0 for n, g, b in zip(sizes, goal, blocks, strict=True)]
    table = spark.createDataFrame([(s, i, n, g) for i, ((s, n), g) in enumerate(zip(sources, goal, strict=True))], "_name string, _source int, source_size long, target double")
    docs = counted.join(table, counted["source"].eqNullSafe(table["_name"])).drop("_name")

    docs = docs.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.groupBy("_source", "_part").agg(F.sum("size").alias("_n")).select("_source", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_source", "_part").orderBy("doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    laid = docs.withColumn("_end", F.sum("size").over(inside)).join(starts, ["_source", "_part"])
    laid = laid.withColumn("_start", F.col("_before") + F.col("_end") - F.col("size")).drop("_part", "_end", "_before")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = np.array(list(shard_draws(row["group"], row["first"], row["count"], seed)), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], ["s", "lo", "hi"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = np.arange(lo, hi)
                found = np.empty(len(slot), np.int64)
                for turn in np.unique(slot // blocks[s]):
                    these = slot // blocks[s] == turn
                    found[these] = permuted(slot[these] % blocks[s], blocks[s], seed + 1000003 * s + int(turn))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), s, np.int32)), pa.array(found)], ["_source", "_block"])

    tasks = max(1, spark.sparkContext.defaultParallelism)
    groups = spark.createDataFrame(group_draws(slots, seed), "group long, first array<long>, count array<long>").repartition(tasks)
    # A shard's draw is a few rows here and SHARD_SLOTS rows after it.
    ranges = groups.mapInArrow(task(dealt), "s long, lo long, hi long").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    times = ranges.mapInArrow(task(drawn), "_source int, _block long").groupBy("_source", "_block").agg(F.count("*").alias("_times"))
    spread = laid.where("size > 0").withColumn("_block", F.explode(F.sequence(F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("_start") + F.col("size"), (F.col("_block") + 1) * block) - F.greatest(F.col("_start"), F.col("_block") * block)
    spread = spread.select("_row", "_source", "_block", overlap.alias("_words"), (F.greatest(F.col("_block") * block, F.col("_start")) - F.col("_start")).alias("_from"))
    # The planner can't know how many rows `drawn` makes of a range, and must not broadcast them.
    return laid, spread.join(times.hint("merge"), ["_source", "_block"])


def mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Null and empty texts have size 0 and take 0. Null is a source of its own,
    the last one. Repeated rows are laid out each for itself (rows equal in
    doc_id and size may swap what they take). Other columns are not read; an
    empty table gives an empty result.
    """
    laid, overlaps = taken_blocks(cut(word_counts(docs, **columns)), block, seed)
    taken = overlaps.groupBy("_row").agg(F.sum(F.col("_words") * F.col("_times")).alias("taken"))
    return laid.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", source: str = "source", size: str = "n_chars") -> DataFrame:
    """docs as the mix takes them: for each pass over its source, a document with the words that the pass takes of it.

    Words keep their order and are joined by single spaces; `size`, where
    there is such a column, is the new text's code points. A document of which
    nothing is taken goes, as do null and empty texts; other columns stay as
    they are, whatever their names. Repeated rows are taken each for itself; an
    empty table gives an empty result.
    """
    key, spans = fresh(docs, "_mix_row"), fresh(docs, "_mix_spans")
    kept = cut(docs.withColumn(key, F.monotonically_increasing_id()))
    _, overlaps = taken_blocks(cut(word_counts(kept, text, doc_id, source, row=key)), block, seed)
    taken = overlaps.groupBy(F.col("_row").alias(key)).agg(F.sort_array(F.collect_list(F.struct("_from", "_words", "_times"))).alias(spans))
    joined = kept.join(taken, key).drop(key)
    names = docs.columns
    at, sized = names.index(text), names.index(size) if size in names else None

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(at))
            for lo, hi in chunks(offsets):
                texts, rows = [], []
                for i in range(lo, hi):
                    split = batch.column(at)[i].as_py().encode().split()
                    for turn in range(1, MOST + 1):
                        part = [w for s in batch.column(len(batch.columns) - 1)[i].as_py() if s["_times"] >= turn for w in split[s["_from"] : s["_from"] + s["_words"]]]
                        if part:
                            texts.append(b" ".join(part).decode())
                            rows.append(i)
                columns = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
                columns[at] = pa.array(texts, columns[at].type)
                if sized is not None:
                    columns[sized] = pa.array([len(t) for t in texts], columns[sized].type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(task(take), docs.schema)
