"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded
(byte classes, word shapes, repetition within the document) and projected;
gated attention weights, learned from document labels alone, mix the
projections into one document vector that a logistic unit scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import adam, fold, sample, sigmoid, spaced
from .text import CHUNK_BYTES, chunks, mix, span_hashes, utf8, words
from .worker import task

PASSAGE = 64
HIDDEN, ATTENTION = 16, 8
#: Passages of a document to fit on, at most: of a longer one, evenly spaced ones. Scores are of all passages.
TRAIN_PASSAGES = 400
#: Labelled documents to fit on, at most.
SAMPLE = 2500
ROUNDS, RATE, RIDGE = 250, 0.02, 1e-4

_PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
#: Byte classes: each ASCII punctuation mark, then upper, lower, digit, line feed, other space or control, beyond ASCII.
_CLASS = np.full(256, len(_PUNCTUATION) + 5, np.uint8)
for _i, _b in enumerate(_PUNCTUATION):
    _CLASS[_b] = _i
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), (10,), [b for b in range(33) if b != 10] + [127])):
    _CLASS[list(_bytes)] = len(_PUNCTUATION) + _k
CLASSES = len(_PUNCTUATION) + 6
UPPER = len(_PUNCTUATION)
FEATURES = CLASSES + 7


def passages(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each row); a row without words is one passage of zeros."""
    rows = len(bounds) - 1
    starts, ends, first = words(raw, bounds)
    n_words = np.diff(first)
    count = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(count)])
    total = int(base[-1])
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, count
    row_of = np.repeat(np.arange(rows), n_words)
    index = np.arange(len(starts)) - first[:-1][row_of]
    of_word = base[:-1][row_of] + index // PASSAGE
    # A passage's bytes run up to the next passage's first word or the row's end, and a row's first passage has those before it.
    heads = np.flatnonzero(index % PASSAGE == 0)
    of_head = row_of[heads]
    begins = np.where(index[heads] == 0, bounds[:-1][of_head], starts[heads])
    lengths = np.minimum(np.append(starts[heads[1:]], len(raw)), bounds[1:][of_head]) - begins
    of_byte = np.repeat(of_word[heads], lengths)
    body = _CLASS[raw[np.repeat(n_words > 0, np.diff(bounds))]]
    counts = np.bincount(of_byte * CLASSES + body, minlength=total * CLASSES).reshape(total, CLASSES)
    out[:, :CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))

    words_in = np.bincount(of_word, minlength=total)
    n = np.maximum(1, words_in)
    upper = np.concatenate([[0], np.cumsum(_CLASS[raw] == UPPER)])
    n_upper = upper[ends] - upper[starts]
    size = ends - starts
    share = lambda x: np.bincount(of_word, x, total) / n
    out[:, CLASSES] = share(size) / 10
    out[:, CLASSES + 1] = share(n_upper >= np.maximum(2, size // 2))
    out[:, CLASSES + 2] = share(_CLASS[raw[ends - 1]] < UPPER)
    out[:, CLASSES + 3] = share((_CLASS[raw[starts]] < UPPER) & (size == 1))
    # Repetition: the share of words that the row had before, alone and as the last of three.
    hashes = span_hashes(raw, starts, ends)
    out[:, CLASSES + 4] = share(_seen(hashes, row_of))
    with np.errstate(over="ignore"):
        triples = hashes.copy()
        triples[2:] += mix(hashes[1:-1] + np.uint64(1)) + mix(hashes[:-2] + np.uint64(2))
    third = index >= 2  # else the words before are another row's
    repeated = np.zeros(len(triples), bool)
    repeated[third] = _seen(triples[third], row_of[third])
    out[:, CLASSES + 5] = share(repeated)
    out[:, CLASSES + 6] = np.log1p(words_in) / 4
    return out, count


def _seen(hashes: np.ndarray, row_of: np.ndarray) -> np.ndarray:
    """Whether an earlier word of the same row has the same hash."""
    with np.errstate(over="ignore"):
        key = mix(hashes + row_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, summed in one order: BLAS may round a row differently beside other rows."""
    wide = w.reshape(len(w), -1)
    out = np.zeros((len(x), wide.shape[1]))
    for column, weights in zip(x.T, wide, strict=True):
        out += column[:, None] * weights
    return out.reshape(len(x), *w.shape[1:])


class AttentionModel:
    """Parameters of projection, gated attention and scorer; arrays are float64."""

    SHAPES = ((FEATURES, HIDDEN), (HIDDEN,), (HIDDEN, ATTENTION), (HIDDEN, ATTENTION), (ATTENTION,), (HIDDEN,), (1,))

    def __init__(self, flat: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.flat, self.mean, self.scale = flat, mean, scale

    @classmethod
    def parts(cls, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in cls.SHAPES:
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def forward(self, x: np.ndarray, count: np.ndarray, flat: np.ndarray | None = None) -> tuple:
        project, shift, v, u, w, c, b = self.parts(self.flat if flat is None else flat)
        times = product if flat is None else np.matmul  # in fitting, no row has to repeat exactly
        heads = np.concatenate([[0], np.cumsum(count)[:-1]])
        bag = np.repeat(np.arange(len(count)), count)
        h = np.tanh(times(x, project) + shift)
        t, g = np.tanh(times(h, v)), sigmoid(times(h, u))
        logit = times(t * g, w)
        e = np.exp(logit - np.maximum.reduceat(logit, heads)[bag])
        a = e / np.add.reduceat(e, heads)[bag]
        z = np.add.reduceat(a[:, None] * h, heads, axis=0)
        return h, t, g, a, z, times(z, c) + b[0], heads, bag

    def score(self, features: np.ndarray, count: np.ndarray) -> np.ndarray:
        return sigmoid(self.forward((features - self.mean) / self.scale, count)[5])

    def attention(self, features: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The weight of each passage in its document."""
        return self.forward((features - self.mean) / self.scale, count)[3]

    @classmethod
    def fit(cls, features: np.ndarray, count: np.ndarray, label: np.ndarray, seed: int = 7) -> AttentionModel:
        mean, scale = features.mean(0), features.std(0) + 0.05
        x = ((features - mean) / scale).astype(np.float32)
        rng = np.random.default_rng(seed)
        start = np.concatenate([(rng.standard_normal(s) / np.sqrt(s[0])).ravel() if len(s) == 2 else np.zeros(s) for s in cls.SHAPES])
        model = cls(start, mean, scale)
        cls.parts(start)[4][:] = rng.standard_normal(ATTENTION) * 0.1
        cls.parts(start)[5][:] = rng.standard_normal(HIDDEN) * 0.1
        n = len(label)

        def gradient(flat: np.ndarray) -> np.ndarray:
            project, shift, v, u, w, c, b = cls.parts(flat)
            h, t, g, a, z, logit, heads, bag = model.forward(x, count, flat)
            p = sigmoid(logit)
            out = (p - label) / n
            dz = out[:, None] * c
            da = (h * dz[bag]).sum(1)
            dh = a[:, None] * dz[bag]
            ds = a * (da - np.add.reduceat(a * da, heads)[bag])
            dt, dg = ds[:, None] * w * g * (1 - t * t), ds[:, None] * w * t * g * (1 - g)
            dh += dt @ v.T + dg @ u.T
            dx = dh * (1 - h * h)
            grads = [x.T @ dx, dx.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ ds, z.T @ out, np.array([out.sum()])]
            return np.concatenate([x_.ravel() for x_ in grads]) + RIDGE * flat

        model.flat = adam(gradient, start, ROUNDS, RATE)
        return model


def fit(docs: DataFrame, labels: DataFrame, keep: Column, target: str = "quality", doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> AttentionModel | None:
    """A model of at most `limit` labelled documents (learning.sample); None where no row is labelled. A repeated doc_id counts once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            out = []
            for lo, hi in chunks(offsets):
                features, count = passages(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                out += [spaced(part, TRAIN_PASSAGES).tobytes() for part in np.split(features, np.cumsum(count)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["_id", "_label", "_bag"])

    chosen = sample(labels, target, keep, doc_id, limit)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    kind = rows.schema["_id"].dataType.simpleString()
    encoded = rows.select("_id", "_text", "_label").mapInArrow(task(encode), f"_id {kind}, _label int, _bag binary")
    # Bounded by `limit` documents of at most TRAIN_PASSAGES passages; ordered, so that reruns agree.
    once = encoded.groupBy("_id").agg(F.min("_bag").alias("_bag"), F.min("_label").alias("_label"))
    found = sorted((r["_id"], bytes(r["_bag"]), r["_label"]) for r in once.collect())
    if not found:
        return None
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b, _ in found]
    return AttentionModel.fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([float(y) for *_, y in found]))


def scores(column: pa.Array, model: AttentionModel | None) -> np.ndarray:
    """Of each text of an Arrow column; 0.5 without a model."""
    raw, offsets = utf8(column)
    if model is None:
        return np.full(len(column), 0.5)
    out = [model.score(*passages(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])) for lo, hi in chunks(offsets, CHUNK_BYTES)]
    return np.concatenate([np.zeros(0), *out])


def score_documents(docs: DataFrame, labels: DataFrame, of: int = 3, held: int = 1, target: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; learned from labelled rows whose fold is not `held`.

    Null and empty texts are a bag of one empty passage and get the model's
    score for it. Repeated rows get equal scores. Without usable labels every
    score is 0.5. Other columns are not read; an empty table gives an empty result.
    """
    model = fit(docs, labels, fold(doc_id, of) != held, target, doc_id, text)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores(batch.column(2), model))], ["doc_id", "held_out", "score"])

    columns = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, of) == held).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    scored = columns.mapInArrow(task(turn), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, of: int = 3, held: int = 1, target: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject (score >= 0.5), with all their columns.

    Null and empty texts are judged as one empty passage; repeated rows stay or
    go together; null ids are no obstacle; without usable labels all rows stay;
    an empty table stays empty.
    """
    model = fit(docs, labels, fold(doc_id, of) != held, target, doc_id, text)
    at = docs.columns.index(text)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at), model) >= 0.5))

    return docs.mapInArrow(task(turn), docs.schema)
