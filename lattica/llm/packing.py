"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits into one sequence.
The linear program (cover each length's count with as few configurations as
possible) is solved on the driver over the histogram of lengths, which has at
most `capacity` entries at any data size: multiplicative weights price the
lengths, a knapsack dynamic program finds the best configuration for these
prices. The fractional solution, which covers no length more than once over,
is rounded down, and what is left of the histogram is packed best fit, also by
counts. Pieces then take their places by their rank among equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .text import chunks, utf8
from .vocabulary import run_table
from .worker import task

CAPACITY = 2048
#: Rows of one length are ranked in so many parts, so no window holds all rows of a common length.
RANK_PARTS = 1024
#: Of the multiplicative weights: rounds at most, configurations in a round, fall of a price over a full cover, part covered in a step.
ROUNDS, AT_ONCE, RATE, STEP = 200, 64, 6.0, 0.25
#: Parts of the fractional solution that are tried in rounding.
KEEP = (1.0, 0.9, 0.75, 0.5, 0.25, 0.1)


def document_ids(texts: list[str], path: str, end: int) -> list[bytes]:
    """Each text's ids and then `end`, as little-endian unsigned 32-bit values."""
    table = run_table(path, keep_ids=True)
    if table.merger:  # faster on whole texts than through the table: most distinct runs are rare
        return table.direct(texts, end)
    whole, cut_up, distinct = [], [], set()
    for i, text in enumerate(texts):
        runs = table.runs(text)
        if runs is None:
            whole.append(i)
        else:
            cut_up.append((i, runs))
            distinct.update(runs[1:])
    table.learn(distinct)
    of = table.table.__getitem__
    tail = end.to_bytes(4, "little")
    out: list[bytes] = [b""] * len(texts)
    heads = dict(zip(names := list({r[0] for _, r in cut_up}), table.kept(names), strict=True))
    for i, runs in cut_up:
        head = heads[runs[0]]
        del runs[0]
        out[i] = b"".join((head, *map(of, runs), tail))
    for i, ids in zip(whole, table.whole([texts[i] for i in whole]), strict=True):
        out[i] = ids + tail
    return out


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per document, or per `capacity` ids of a longer one (the first piece may be shorter)."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for lo, hi in chunks(offsets):
                rows = batch.slice(lo, hi - lo)
                took, out = [], []
                for k, ids in enumerate(document_ids([t or "" for t in rows.column(1).to_pylist()], path, end)):
                    n, start, piece = len(ids) // 4, 0, 0
                    while start < n:
                        length = n - start if n - start <= capacity else (n - start) % capacity or capacity
                        out.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        took.append(k)
                        start, piece = start + length, piece + 1
                if out:
                    piece, start, length, crc = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0).take(pa.array(took, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                        ["doc_id", "piece", "start", "length", "ids_crc32"],
                    )

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(task(pieces, holds=True), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every capacity up to len(price) - 1, the greatest price of lengths that fit, and the length to take first (0: leave one unit)."""
    best, first = np.zeros(len(price)), np.zeros(len(price), np.int64)
    for c in range(1, len(price)):
        value = best[c - 1 :: -1] + price[1 : c + 1] if c > 1 else best[:1] + price[1:2]
        k = int(value.argmax())
        best[c] = best[c - 1]
        if value[k] > best[c]:
            best[c], first[c] = value[k], k + 1
    return best, first


def configuration(first: np.ndarray, capacity: int) -> list[int]:
    """The lengths that knapsack() takes for a capacity."""
    out, c = [], capacity
    while c > 0:
        out += [int(first[c])] if first[c] else []
        c -= int(first[c]) or 1
    return out


def solve(counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[tuple[int, ...], float]], float]:
    """A fractional cover of counts[length] by configurations, none covered more than once over, and a lower bound on any cover.

    Multiplicative weights: a length's price falls by a factor as it gets
    covered. Each round solves one knapsack for the current prices and adds,
    for the lengths with most left to cover, the best configuration that holds
    each of them, as much of it as covers its scarcest length by a fixed part.
    """
    n = counts.astype(float)
    live = n > 0
    share = np.arange(capacity + 1) / capacity
    covered = np.where(live, 0.0, 1.0)
    found: dict[tuple[int, ...], float] = {}
    bound = float((n * share).sum())
    for _ in range(rounds):
        price = np.where(covered < 1, share * np.exp(-RATE * covered), 0.0)
        if not price.any():
            break
        best, first = knapsack(price)
        # Prices over that of the dearest configuration are a solution of the dual program.
        bound = max(bound, float((n * price).sum()) / float(best[capacity]))
        for length in np.argsort(-n * price, kind="stable")[:AT_ONCE]:
            if not price[length]:
                break
            lengths = [int(length), *configuration(first, capacity - int(length))]
            kinds, uses = np.unique(lengths, return_counts=True)
            each = n[kinds] / uses
            step = min(float(((1 - covered[kinds]) * each).min()), max(1.0, STEP * float(each.min())))
            if step <= 0:
                continue  # another configuration of this round has used a length up
            covered[kinds] += step / each
            covered[covered > 1 - 1e-9] = 1
            key = tuple(sorted(lengths, reverse=True))
            found[key] = found.get(key, 0.0) + step
    return sorted(found.items()), bound


def pack_counts(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences have each; together they hold counts[length] pieces of every length."""
    left = counts.astype(np.int64).copy()
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    fractional, _ = solve(left, capacity)
    # The part of the solution that rounding keeps is the one that needs fewest sequences.
    tries = [rounded(fractional, left, capacity, part) for part in KEEP]
    return plan + min(tries, key=lambda t: sum(n for _, n in t))


def rounded(fractional: list[tuple[tuple[int, ...], float]], counts: np.ndarray, capacity: int, part: float) -> list[tuple[tuple[int, ...], int]]:
    """`part` of the solution rounded down, the pieces left packed best fit."""
    left, plan = counts.copy(), []
    for lengths, amount in fractional:
        if sum(lengths) < capacity:
            continue  # rounding keeps full sequences only; best fit does better with the pieces of the others
        uses = np.bincount(lengths, minlength=capacity + 1)
        used = uses > 0
        copies = min(int(amount * part + 1e-6), int((left[used] // uses[used]).min()))
        if copies > 0:
            left -= uses * copies
            plan.append((lengths, copies))
    return plan + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing by counts: equal sequences are filled together."""
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # by free space
    has = np.zeros(capacity + 1, bool)

    def put(lengths: tuple[int, ...], copies: int, free: int) -> None:
        open_[free].append((lengths, copies))
        has[free] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            free = length + int(has[length:].argmax()) if has[length:].any() else -1
            if free < 0:
                each = capacity // length
                if n >= each:
                    put((length,) * each, n // each, capacity - each * length)
                if n % each:
                    put((length,) * (n % each), 1, capacity - n % each * length)
                break
            lengths, copies = open_[free].pop()
            has[free] = bool(open_[free])
            take = min(n, copies)
            if copies > take:
                put(lengths, copies - take, free)
            put((*lengths, length), take, free - length)
            n -= take
    return [x for group in open_ for x in group]


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces per sequence, first offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for lengths, copies in plan:
        at = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            rank = ranks.get(length, 0)
            rows.append((length, rank, sequence, each, at))
            ranks[length] = rank + each * copies
            at += each * length
        sequence += copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (which must be a written table: it is read more than once)."""
    # The histogram has at most `capacity` rows, whatever the input.
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        counts[row["length"]] = row["count"]
    where = places(pack_counts(counts, capacity))
    keyed = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_PARTS)))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("length", "_part").agg(F.count("*").alias("_n")).select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1).join(starts, ["length", "_part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).cast("long").alias("_rank"))
    kind = ranked.schema["doc_id"].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (where[:, 0] << 48) + where[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = where[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            at = rank - row[:, 1]
            sequence = row[:, 2] + at // row[:, 3]
            offset = row[:, 4] + at % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(task(put), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `capacity` ids.

    A null or empty text is the id `end` alone. Repeated rows are packed each
    for itself; a null doc_id stays null; other columns are not read; an empty
    table gives an empty result. Equal lengths are ranked by doc_id and piece,
    so reruns give the same places.
    """
    return place(cut(cut_pieces(docs, path, capacity, end, text, doc_id)), capacity)
