"""MinHash near-duplicates with sequential Bayesian verification.

1. Every document gets its set of distinct word shingles, a MinHash signature
   and a key of the set. Equal sets form one class; only classes go on.
2. Signatures are cut into bands; classes that share a band are candidates. In
   each band bucket, pairs are compared batch of hashes by batch, and go as
   soon as the posterior probability that they are similar enough falls below
   the miss probability. A bucket yields a spanning forest of its survivors,
   never all pairs.
3. Survivors' connected components are small and pure. Within each, full
   shingle sets are compared exactly, and the verified links yield the final
   components.

A bucket or component of more than a chunk of classes is worked on chunk by
chunk. What chunks have found is joined through representatives (of each part
found, the class with most links), and only classes that are then outside their
group's largest part are compared with the whole group, so no task holds an
unbounded group and a group whose parts meet costs its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, forest, keyed_join
from .store import cut
from .text import LOWER, chunks, mix, span_hashes, utf8, words
from .worker import task

#: Hashes per band, probability of losing a pair at the threshold in banding, and in each posterior test.
BAND_ROWS, MISS_BANDS, MISS_TEST = 5, 1e-6, 1e-5
#: Hashes compared at once.
BATCH = 24
#: Classes in a chunk of a bucket; classes and shingles in a chunk of a component.
CHUNK, EXACT_CHUNK, EXACT_SHINGLES = 4096, 3072, 1 << 20
PAIRS_AT_ONCE = 1 << 16
#: 64-bit words of a bitmap that spares texts the way to an exact join: broadcast, 4 MB of content at most. It lets
#: through what it must and, the fuller it gets, more; with far over 64 * WORDS hashes all texts take that way.
WORDS = 1 << 18
SEED = 11


def band_count(threshold: float, rows: int = BAND_ROWS, miss: float = MISS_BANDS) -> int:
    """Bands by which a pair at the threshold shares none with probability `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_matches(threshold: float, hashes: int, batch: int = BATCH, miss: float = MISS_TEST) -> list[tuple[int, int]]:
    """(n, m): after n hashes, fewer than m matches leave P(similarity >= threshold) below `miss`, from a uniform prior.

    The posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum.
    """
    out = []
    for n in [*range(batch, hashes, batch), hashes]:
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def shingle_sets(raw: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its shingles; a row of fewer words is one shingle, without words none."""
    low = LOWER[raw]
    starts, ends, first = words(low, bounds)
    if not len(starts):
        return [np.zeros(0, np.uint64)] * (len(bounds) - 1)
    hashes = span_hashes(low, starts, ends)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(hashes), np.uint64)
        for i in range(min(width, len(hashes))):
            rolled[: len(hashes) - i] = mix(rolled[: len(hashes) - i] + hashes[i:] * np.uint64(2 * i + 1))
        out = []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif hi > lo:
                short = np.uint64(hi - lo)
                for i in range(lo, hi):
                    short = mix(short + hashes[i] * np.uint64(2 * (i - lo) + 1))
                out.append(np.array([short], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def hash_family(n: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    factor, shift = family
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (np.multiply.outer(x[at : at + 256], factor) + shift).min(0), out=out)
    return out


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def described(docs: DataFrame, width: int, hashes: int, text: str, doc_id: str) -> DataFrame:
    """_row, doc_id, n_shingles, _key, _sig, _text, _check (hashes of the text) of every row; _sig is null without shingles."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(hashes)
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            n, keys, sigs = [], [], []
            for lo, hi in chunks(offsets):
                for s in shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width):
                    n.append(len(s))
                    keys.append(set_key(s))
                    sigs.append(signature(s, family).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), *batch.columns[3:]], ["_row", "doc_id", "n_shingles", "_key", "_sig", "_text", "_check"])

    words = F.col(text).cast("string")
    columns = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), words.alias("text"), F.xxhash64(words).alias("_text"), F.hash(words).alias("_check"))
    return columns.mapInArrow(task(turn), f"_row long, doc_id {columns.schema['doc_id'].dataType.simpleString()}, n_shingles long, _key binary, _sig binary, _text long, _check int")


def banded(signed: DataFrame, bands: int, rows: int) -> DataFrame:
    """node, _keys (a bucket key for each band) of rows with node and _sig."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            if not len(node):
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(node), -1)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(node), bands)).copy()
                for i in range(rows):
                    key = mix(key + sig[:, i : bands * rows : rows].astype(np.uint64) * np.uint64(2 * i + 3))
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, key.size + 1, bands, dtype=np.int32)), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys], ["node", "_keys"])

    return signed.select("node", "_sig").mapInArrow(task(turn), "node long, _keys array<long>")


def marks(hashes: DataFrame, column: str) -> DataFrame:
    """_word, _bits: a bitmap of 64 * WORDS places, with the place of each hash set; at most WORDS rows at any size."""
    return cut(hashes.select(_word(F.col(column)).alias("_word"), _bit(F.col(column)).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))


def marked(rows: DataFrame, hashed: Column, bits: DataFrame, how: str) -> DataFrame:
    """The rows whose hash's place is set in `bits` (how: left_semi), or the others (left_anti), without moving any."""
    return rows.join(F.broadcast(bits), (_word(hashed) == bits["_word"]) & (_bit(hashed).bitwiseAND(bits["_bits"]) != 0), how)


def _word(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(WORDS))


def _bit(hashed: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 32), F.lit(64)).cast("int"))


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The sorted rows again, in frames that end where a group ends."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        if rest:
            batch = pd.concat([*rest, batch], ignore_index=True)
        last = np.ones(len(batch), bool)
        for k in keys:
            last &= batch[k].to_numpy() == batch[k].iloc[-1]
        cut_at = int(last.argmax())
        if cut_at:
            yield batch.iloc[:cut_at]
        rest = [batch.iloc[cut_at:]]
    if rest:
        yield rest[0]


def group_numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    for k in keys:
        x = frame[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


Allowed = Callable[[np.ndarray, np.ndarray], np.ndarray]


def close_pairs(frame: pd.DataFrame, group: np.ndarray, allowed: Allowed, rows: int, tests: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that are allowed and pass all posterior tests; in a bucket of one chunk, if it is the first that they share."""
    sig = np.frombuffer(b"".join(frame["_sig"]), np.uint32).reshape(len(frame), -1)
    band, alone = frame["_band"].to_numpy(), (frame["_chunks"] == 1).to_numpy()
    bands = sig.shape[1] // rows
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    index = np.arange(len(group))
    step, held_a, held_b, held = 1, [], [], 0

    def test(a: np.ndarray, b: np.ndarray) -> None:
        matches, done = np.zeros(len(a), np.int64), 0
        for n, least in tests:
            matches += (sig[a, done:n] == sig[b, done:n]).sum(1)
            keep = matches >= least
            a, b, matches, done = a[keep], b[keep], matches[keep], n
            if not len(a):
                return
        same = (sig[a, : bands * rows] == sig[b, : bands * rows]).reshape(len(a), bands, rows).all(2)
        use = ~alone[a] | (same.argmax(1) == band[a])
        left.append(a[use])
        right.append(b[use])

    while len(index):
        index = index[index + step < len(group)]
        index = index[group[index] == group[index + step]]
        use = index[allowed(index, index + step)]
        held_a.append(use)
        held_b.append(use + step)
        held += len(use)
        if held >= PAIRS_AT_ONCE or not len(index):
            a, b = np.concatenate(held_a), np.concatenate(held_b)
            for at in range(0, len(a), PAIRS_AT_ONCE):
                test(a[at : at + PAIRS_AT_ONCE], b[at : at + PAIRS_AT_ONCE])
            held_a, held_b, held = [], [], 0
        step += 1
    return np.concatenate(left), np.concatenate(right)


def similar_pairs(frame: pd.DataFrame, group: np.ndarray, allowed: Allowed, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one group that are allowed and have 100 * intersection >= percent * union, by exact counts."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bounds = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        a, b = similar([np.frombuffer(s, np.uint64) for s in frame["_set"].iloc[lo:hi]], percent)
        use = allowed(lo + a, lo + b)
        left.append(lo + a[use])
        right.append(lo + b[use])
    return np.concatenate(left), np.concatenate(right)


def similar(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with 100 * intersection >= percent * union, by exact counts."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) <= 8:
        found = []
        for i, j in combinations(range(len(sets)), 2):
            if 100 * min(sizes[i], sizes[j]) < percent * max(sizes[i], sizes[j]):
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                found.append((i, j))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    code, owner = np.unique(code[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    # Counts are below 2 ** 24, so they are exact; a chunk's table of them has EXACT_CHUNK ** 2 entries at most, four times that where minor rows meet their group.
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 2048
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [lo, lo + width])
        used = np.unique(owner[a:b])
        block = np.zeros((len(used), width), np.float32)
        block[np.searchsorted(used, owner[a:b]), code[a:b] - lo] = 1
        both[np.ix_(used, used)] += block @ block.T
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(sets), 256):
        part = both[i : i + 256, i:].astype(np.float64)
        a, b = np.nonzero(100 * part >= percent * (sizes[i : i + 256, None] + sizes[None, i:] - part))
        left.append(i + a[a < b])
        right.append(i + b[a < b])
    return np.concatenate(left), np.concatenate(right)


def compare(rows: DataFrame, group: str, keys: list[str], pairs: Callable[[pd.DataFrame, np.ndarray, Allowed], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """a, b, _of, _best: edges (a, b) that connect what `pairs` finds in each frame of equal `keys`, b being the least of its part.

    Rows of a group of several chunks come back each, with their group as _of;
    _best marks the one with most links of each part there. Where rows has
    _minor and _part, only a minor row and one that isn't are compared, if of unlike parts.
    """

    def turn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, keys):
            frame = frame.reset_index(drop=True)
            allowed: Allowed = lambda a, b: np.ones(len(a), bool)
            if "_minor" in frame:
                minor, part = frame["_minor"].to_numpy(), frame["_part"].to_numpy()
                allowed = lambda a, b: (minor[a] != minor[b]) & (part[a] != part[b])
            node, number = frame["node"].to_numpy(), group_numbers(frame, keys)
            a, b = pairs(frame, number, allowed)
            links = np.bincount(np.concatenate([a, b]), minlength=len(node))
            a, b = forest(node[a], node[b])
            yield pd.DataFrame({"a": a, "b": b, "_of": pd.array([None] * len(a), "Int64"), "_best": False})
            member = np.flatnonzero((frame["_chunks"] > 1).to_numpy())
            if len(member) and "_minor" not in frame:
                label = node[member]
                if len(a):
                    order = np.argsort(a)
                    at = np.minimum(np.searchsorted(a, label, sorter=order), len(a) - 1)
                    label = np.where(a[order[at]] == label, b[order[at]], label)
                links, number = links[member], number[member]
                order = np.lexsort((node[member], -links, label, number))
                best = np.zeros(len(member), bool)
                best[order] = (np.diff(label[order], prepend=-1) != 0) | (np.diff(number[order], prepend=-1) != 0)
                yield pd.DataFrame({"a": node[member], "b": label, "_of": pd.array(frame[group].to_numpy()[member], "Int64"), "_best": best & (links > 0)})

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(task(turn), "a long, b long, _of long, _best boolean")


def connected(rows: DataFrame, group: str, several: bool, pairs: Callable) -> DataFrame:
    """node, label of what `pairs` connects among the rows of each group.

    rows: `group`, node, _chunks, _each and what `pairs` reads; a group goes by
    _chunks chunks of about _each rows. several: whether any group has more than one.
    """
    dealt = lambda n: F.pmod(F.xxhash64("node", group), n).cast("int")
    keys = [group, "_lo"]
    found = compare(rows.withColumn("_lo", dealt(F.col("_chunks"))), group, keys, pairs)
    if not several:
        return components(found)
    found, large = cut(found), cut(rows.where("_chunks > 1"))
    # Representatives of the chunks' parts meet in chunks of their own.
    parts = found.where("_of is not null").select(F.col("_of").alias(group), F.col("a").alias("node"), F.col("b").alias("_own"), "_best")
    heads = parts.where("_best").select(group, "node", "_own")
    count = heads.groupBy(group).agg(F.count("*").alias("_heads"))
    meeting = large.join(heads.drop("_own"), [group, "node"]).join(count, group).withColumn("_lo", dealt(F.ceil(F.col("_heads") / F.col("_each")).cast("int"))).drop("_heads")
    met = cut(compare(meeting, group, keys, pairs))
    joined = heads.join(met.where("_of is not null").select(F.col("_of").alias(group), F.col("a").alias("node"), F.col("b").alias("_met")), [group, "node"])
    joined = joined.groupBy(group, "_own").agg(F.min("_met").alias("_met"))
    # What is outside its group's largest part is compared with all of the group.
    parts = cut(parts.join(joined, [group, "_own"], "left").select(group, "node", F.coalesce("_met", "_own").alias("_part")))
    sizes = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    largest = sizes.groupBy(group).agg(F.max(F.struct("_n", "_part")).alias("_top"), F.sum("_n").alias("_all")).where("_all > _top._n")
    sided = large.join(parts, [group, "node"]).join(largest.select(group, F.col("_top._part").alias("_most"), (F.col("_all") - F.col("_top._n")).alias("_left")), group)
    sided = cut(sided.withColumn("_minors", F.ceil(F.col("_left") / F.col("_each")).cast("int")).drop("_left"))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = sided.withColumn("_minor", F.lit(False)).withColumn("_lo", dealt(F.col("_chunks"))).withColumn("_hi", every(F.col("_minors")))
    minor = sided.where("_part <> _most").withColumn("_minor", F.lit(True)).withColumn("_hi", dealt(F.col("_minors"))).withColumn("_lo", every(F.col("_chunks")))
    rest = compare(whole.unionByName(minor).drop("_most", "_minors"), group, [*keys, "_hi"], pairs)
    return components(found.select("a", "b").union(met.select("a", "b")).union(rest.select("a", "b")))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id", hashed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; where `hashed`, _text and _check too, xxhash64 and hash of its text.

    Documents with 100 * intersection >= percent * union of their sets of
    distinct `width`-word shingles are linked; component_id is the smallest
    doc_id that links reach. Words are split at bytes 9-13 and 32, A-Z lower-cased. Fewer
    words than `width` make one shingle; a null, empty or blank text has none,
    is linked with nothing and is its own component. Rows that repeat a doc_id
    are rows of their own with that id. A null doc_id is never the smallest
    where there is another. Other columns are not read; an empty table gives
    an empty result.
    """
    threshold = percent / 100
    bands = band_count(threshold)
    tests = least_matches(threshold, bands * BAND_ROWS)
    rows = cut(described(docs, width, bands * BAND_ROWS, text, doc_id))
    carried = ["_text", "_check"] if hashed else []
    slim = rows.select("_row", "doc_id", "n_shingles", "_key", *carried)
    # A class's rows are counted in part before they meet, so copies cost nothing.
    classes = cut(slim.where("n_shingles > 0").groupBy("_key").agg(F.min("_row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("n")))
    signed = rows.where("n_shingles > 0").withColumnRenamed("_row", "node")
    # Bucket keys meet their classes, being shorter than signatures; those go to candidates alone.
    keyed = banded(signed, bands, BAND_ROWS).join(classes.select("node"), "node", "left_semi")
    buckets = cut(keyed.select("node", F.posexplode("_keys").alias("_band", "_bucket")))
    shared = cut(buckets.groupBy("_bucket").agg(F.count("*").alias("_n")).where("_n > 1").select("_bucket", F.ceil(F.col("_n") / CHUNK).cast("int").alias("_chunks"), F.lit(CHUNK).alias("_each")))
    # Merged, not broadcast where it is small: the plan is one at every size.
    candidates = buckets.join(shared.hint("merge"), "_bucket").join(signed.select("node", "_sig"), "node")
    likely = connected(candidates, "_bucket", not shared.where("_chunks > 1").isEmpty(), lambda f, g, ok: close_pairs(f, g, ok, BAND_ROWS, tests))

    # Exact verification: full sets, from the texts of the survivors' representatives.
    alike = cut(likely.join(signed.select("node", "doc_id", "n_shingles", "_key", "_text"), "node"))
    parts = F.greatest(F.ceil(F.count("*") / EXACT_CHUNK), F.ceil(F.sum("n_shingles") / EXACT_SHINGLES)).cast("int")
    sizes = cut(alike.groupBy("label").agg(parts.alias("_chunks"), F.ceil(F.count("*") / parts).cast("int").alias("_each")))
    wanted = alike.join(sizes, "label").select("node", "label", "_chunks", "_each", "_key", F.col("doc_id").alias("_id"), F.col("_text").alias("_wanted"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # By id and a hash of the text: many rows may have one id or none.
    met = texts["doc_id"].eqNullSafe(wanted["_id"]) & (F.xxhash64(texts["text"]) == wanted["_wanted"])
    texts = marked(texts, F.xxhash64(texts["text"]), marks(alike, "_text"), "left_semi")
    texts = texts.join(wanted.hint("shuffle_hash"), met).select("node", "label", "_chunks", "_each", "_key", "text").distinct()  # rows that repeat an id and its text

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(5))
            keep, sets = [], []
            for lo, hi in chunks(offsets):
                for i, s in enumerate(shingle_sets(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width), lo):
                    if set_key(s) == batch.column(4)[i].as_py():  # else another text with this hash
                        keep.append(i)
                        sets.append(s.tobytes())
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:4], pa.array(sets, pa.binary())], ["node", "label", "_chunks", "_each", "_set"])

    several = not sizes.where("_chunks > 1").isEmpty()
    full = texts.mapInArrow(task(full_sets), "node long, label long, _chunks int, _each int, _set binary")
    linked = connected(cut(full) if several else full, "label", several, lambda f, g, ok: similar_pairs(f, g, ok, percent))
    labels = cut(classes.join(linked, "node", "left").select("_key", "n", F.coalesce("label", "node").alias("_label"), "least"))
    least = labels.groupBy("_label").agg(F.min("least").alias("_least"), F.count("*").alias("_n"))
    of_key = keyed_join(labels.select("_key", "_label", F.col("n").alias("_n")), least, "_label", "_n", labels.count()).select("_key", "_least", "_n")
    some = slim.where("n_shingles > 0")
    full = keyed_join(some, cut(of_key), "_key", "_n", rows.count()).select(*carried, "doc_id", "n_shingles", F.col("_least").alias("component_id"))
    empty = slim.where("n_shingles = 0").select(*carried, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that near_duplicates keeps, with all their columns: of each component those with its smallest doc_id, whatever other texts have that id.

    Null, empty and blank texts all stay; of rows without an id, those whose
    component has no id stay; repeated rows stay together; an empty table stays empty.
    """
    found = near_duplicates(docs, width, percent, text, doc_id, hashed=True)
    # Equal ids with equal texts have one fate, so 96 bits of the text stand for it, and docs needs no numbered copy.
    gone = cut(found.where("not kept").select("doc_id", "_text", "_check").distinct())
    words = docs[text].cast("string")
    met = docs[doc_id].eqNullSafe(gone["doc_id"]) & (F.xxhash64(words) == gone["_text"]) & (F.hash(words) == gone["_check"])
    # Most texts are none of those, which the bitmap tells where they are.
    bits = marks(gone, "_text")
    some, rest = (marked(docs, F.xxhash64(words), bits, how) for how in ("left_semi", "left_anti"))
    return rest.union(some.join(gone, met, "left_anti"))
