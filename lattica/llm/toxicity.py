"""Toxicity by multiple-instance learning over sentences.

A sentence's score is a logistic function of its words and their beginnings
(hashed, so inflected forms share a stem's weight); a document's score is the
noisy-or of its sentences. The weights are learned from document labels alone,
with a lasso that leaves weight on few of them, and then locate the offending
sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import SAMPLE, adam, fold, sample, sigmoid, spaced
from .text import CHUNK_BYTES, LOWER, chunks, span_hashes, utf8, words
from .worker import task

BITS = 20
#: Bytes of a word's beginnings that are features besides the word.
STEMS = (4, 6)
#: Features in fewer training documents get no weight; of the others, those most associated with the labels do.
LEAST_DOCUMENTS, FEATURES = 3, 4096
#: Words of a document to fit on, about: of a longer one, evenly spaced sentences. Scores are of all sentences.
TRAIN_WORDS = 2_500
#: Of the fit: steps of each of its two parts, their size, the lasso, the least weight that passes it, the first bias.
ROUNDS, RATE, LASSO, LEAST_WEIGHT, BIAS = 200, 0.1, 1e-3, 0.5, -6.0

#: Letters (ASCII or beyond) make words; sentences end at . ! ? and line feeds.
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_END = np.zeros(256, bool)
_END[[10, 33, 46, 63]] = True


def sentence_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket and sentence of each feature; row, start and end byte of each sentence that has words)."""
    low = LOWER[raw]
    starts, ends, first = words(low, bounds, _NO_LETTER)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    bucket = (span_hashes(low, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    stops = np.cumsum(_END[raw])[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (row[1:] != row[:-1])
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    last = np.append(heads[1:], len(starts)) - 1
    buckets, sentences = [bucket], [sentence]
    for k in STEMS:
        long = ends - starts > k
        buckets.append((span_hashes(low, starts[long], starts[long] + k) >> np.uint64(64 - BITS)).astype(np.int64))
        sentences.append(sentence[long])
    bucket, sentence = np.concatenate(buckets), np.concatenate(sentences)
    return bucket, sentence, row[heads], starts[heads], ends[last]


def shortened(bag: np.ndarray) -> np.ndarray:
    """The (bucket, sentence) rows of evenly spaced sentences, renumbered, where a text has more than TRAIN_WORDS words."""
    most = 3 * TRAIN_WORDS  # a word has up to three features
    if len(bag) <= most:
        return bag
    used = spaced(np.arange(bag[:, 1].max() + 1), max(1, int(most * (bag[:, 1].max() + 1) / len(bag))))
    number = np.full(bag[:, 1].max() + 1, -1)
    number[used] = np.arange(len(used))
    bag = np.stack([bag[:, 0], number[bag[:, 1]]], 1)[number[bag[:, 1]] >= 0]
    return spaced(bag, most)  # a single sentence can be longer than that


class NoisyOr:
    """Weights of word buckets and the bias of every sentence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def sentences(self, bucket: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(np.bincount(sentence, self.weights[bucket], n) + self.bias)

    @staticmethod
    def documents(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return -np.expm1(np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-9)), rows))

    @classmethod
    def fit(cls, bucket: np.ndarray, sentence: np.ndarray, row: np.ndarray, label: np.ndarray) -> NoisyOr:
        seen = np.unique((row[sentence] << BITS) | bucket)
        in_toxic = np.bincount(seen & ((1 << BITS) - 1), label[seen >> BITS], minlength=1 << BITS)
        in_all = np.bincount(seen & ((1 << BITS) - 1), minlength=1 << BITS)
        # The squared difference from what independence of the label would give, in units of its variance.
        rate = label.mean()
        association = (in_toxic - in_all * rate) ** 2 / np.maximum(in_all * (1 - in_all / len(label)), 0.5)
        association[in_all < LEAST_DOCUMENTS] = 0
        used = np.sort(np.argsort(-association, kind="stable")[:FEATURES])
        used = used[association[used] > 0]
        weights, bias = np.zeros(1 << BITS), BIAS
        # First a lasso picks the features that offend, then their weights are fitted without it.
        for lasso, least in ((LASSO, LEAST_WEIGHT), (0.0, 0.0)):
            place = np.full(1 << BITS, -1)
            place[used] = np.arange(len(used))
            keep = place[bucket] >= 0
            word, of, n, rows, k = place[bucket[keep]], sentence[keep], len(row), len(label), len(used)

            def gradient(x: np.ndarray) -> np.ndarray:
                p = np.clip(sigmoid(np.bincount(of, x[word], n) + x[-1]), 1e-9, 1 - 1e-9)
                doc = np.clip(-np.expm1(np.bincount(row, np.log1p(-p), rows)), 1e-9, 1)
                # Of a sentence's logit: p for clean documents, -p * (1 - doc) / doc for toxic ones.
                each = np.where(label == 1, -(1 - doc) / doc, 1.0)[row] * p / rows
                return np.append(np.bincount(word, each[of], k), each.sum())

            def project(x: np.ndarray) -> np.ndarray:
                return np.append(np.maximum(x[:-1] - lasso, 0), x[-1])  # words can offend, not excuse

            x = adam(gradient, np.append(weights[used], bias), ROUNDS, RATE, project)
            weights[:] = 0
            weights[used], bias = x[:-1], float(x[-1])
            used = used[weights[used] > least]
        return cls(weights, bias)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, target: str = "toxic", doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE) -> NoisyOr | None:
    """A model of at most `limit` labelled documents (learning.sample); None where no row is labelled. A repeated doc_id counts once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            out = []
            for lo, hi in zip(offsets[:-1], offsets[1:], strict=True):
                bucket, sentence, *_ = sentence_words(raw[lo:hi], np.array([0, hi - lo]))
                out.append(shortened(np.stack([bucket, sentence], 1)).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["_id", "_label", "_bag"])

    chosen = sample(labels, target, keep, doc_id, limit)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")
    kind = rows.schema["_id"].dataType.simpleString()
    encoded = rows.select("_id", "_text", "_label").mapInArrow(task(encode), f"_id {kind}, _label int, _bag binary")
    # Bounded by `limit` documents of about TRAIN_WORDS words; ordered, so that reruns agree.
    once = encoded.groupBy("_id").agg(F.min("_bag").alias("_bag"), F.min("_label").alias("_label"))
    found = sorted((r["_id"], bytes(r["_bag"]), r["_label"]) for r in once.collect())
    if not found:
        return None
    bags = [np.frombuffer(b, np.int32).reshape(-1, 2).astype(np.int64) for _, b, _ in found]
    sizes = np.array([int(b[:, 1].max()) + 1 if len(b) else 0 for b in bags])
    base = np.concatenate([[0], np.cumsum(sizes)])
    bucket = np.concatenate([b[:, 0] for b in bags])
    sentence = np.concatenate([b[:, 1] + base[i] for i, b in enumerate(bags)])
    return NoisyOr.fit(bucket, sentence, np.repeat(np.arange(len(bags)), sizes), np.array([y for *_, y in found]))


def offences(raw: np.ndarray, bounds: np.ndarray, model: NoisyOr | None, threshold: float = 0.5) -> tuple[np.ndarray, list[list[tuple[int, int, int, int, float]]]]:
    """(score of each row; for each row its offending sentences: start, end in code points, start, end in bytes of raw, score).

    Offending are sentences with a score of at least `threshold`; in a document
    that reaches it only by many lesser sentences, the worst of them.
    """
    rows = len(bounds) - 1
    found: list[list[tuple[int, int, int, int, float]]] = [[] for _ in range(rows)]
    if model is None:
        return np.zeros(rows), found
    bucket, sentence, row, start, end = sentence_words(raw, bounds)
    p = model.sentences(bucket, sentence, len(row))
    score = model.documents(p, row, rows)
    bad = p >= threshold
    for i in np.flatnonzero(score >= threshold):
        lo, hi = np.searchsorted(row, [i, i + 1])
        own = lo + np.flatnonzero(bad[lo:hi]) if bad[lo:hi].any() else [lo + int(p[lo:hi].argmax())]
        heads = np.concatenate([[0], np.cumsum((raw[bounds[i] : bounds[i + 1]] & 0xC0) != 0x80)])
        found[i] = [(int(heads[start[k] - bounds[i]]), int(heads[end[k] - bounds[i]]), int(start[k]), int(end[k]), float(p[k])) for k in own]
    return score, found


def score_documents(docs: DataFrame, labels: DataFrame, of: int = 5, held: int = 0, target: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, sentences for every row of docs; learned from labelled rows whose fold is not `held`.

    sentences: the places of the offending sentences, start:end (code points,
    end exclusive), comma-joined. Texts without words (null and empty ones
    too) score 0. Repeated rows get equal scores. Without usable labels every
    score is 0. Other columns are not read; an empty table gives an empty result.
    """
    model = fit(docs, labels, fold(doc_id, of) != held, target, doc_id, text)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            score, places = [np.zeros(0)], []
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                own, found = offences(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model)
                score.append(own)
                places += [",".join(f"{a}:{b}" for a, b, *_ in spans) for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(score)), pa.array(places, pa.string())], ["doc_id", "held_out", "score", "sentences"])

    columns = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, of) == held).alias("held_out"), F.col(text).cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()
    scored = columns.mapInArrow(task(turn), f"doc_id {kind}, held_out boolean, score double, sentences string")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "sentences")


def offending_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (code points, end exclusive), sentence, score: one row per offending sentence of every row of docs.

    Texts without words, null and empty ones too, have none; repeated rows give
    repeated results; a null doc_id stays null; other columns are not read; an
    empty table gives an empty result.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            ids, rows = [], []
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                part = raw[offsets[lo] : offsets[hi]]
                for i, spans in enumerate(offences(part, offsets[lo : hi + 1] - offsets[lo], model, threshold)[1], lo):
                    ids += [i] * len(spans)
                    rows += [(a, b, part[x:y].tobytes().decode(), p) for a, b, x, y, p in spans]
            if rows:
                start, end, sentence, p = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids)), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(sentence), pa.array(p)], ["doc_id", "start", "end", "sentence", "score"])

    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(task(turn), f"doc_id {columns.schema['doc_id'].dataType.simpleString()}, start long, end long, sentence string, score double")
